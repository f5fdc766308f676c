"""Quality classifier: a sparse ensemble of rules over document statistics, compiled into Spark columns.

Shallow trees are boosted on the statistics of a bounded sample of labelled documents.  Every path
from a root to a node is a conjunction of comparisons; these rules become 0/1 features of a logistic
regression with an L1 penalty, which leaves few of them with weights.  The surviving rules are plain
column expressions, so scoring needs the statistics and nothing of the model but literals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import class_sizes, class_weights, crc_of_id, small_batches, training_sample

#: Bound of the training sample: rows of each label value (only their statistics are collected).
SAMPLE_ROWS = 5000
STATISTICS = ["n_words", "chars_per_word", "unique_share", "adjacent_share", "upper_share", "symbols_per_word", "marks_per_word", "digit_share", "dup_line_share", "words_per_line", "letter_share"]
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
MARKS = np.frombuffer(b"!?", np.uint8)


def measure(text: str) -> list[float]:
    """STATISTICS of a whole text; byte counts stand for the ASCII classes."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    data = text.encode("utf-8", "surrogatepass")
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = len(text)
    upper, lower, wide = int(c[65:91].sum()), int(c[97:123].sum()), int(c[192:].sum())
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return [
        float(n), sum(map(len, words)) / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n, upper / max(1, upper + lower),
        float(c[SYMBOLS].sum()) / n, float(c[MARKS].sum()) / n, float(c[48:58].sum()) / chars, 1 - len(set(lines)) / len(lines), n / len(lines), (upper + lower + wide) / chars,
    ]


def statistics(docs: DataFrame, also: list[str], text: str = "text") -> DataFrame:
    """The columns ``also`` of each row and the STATISTICS of its ``text``; a null text counts as empty."""
    small_batches(docs.sparkSession)
    kinds, names = dict(docs.dtypes), list(dict.fromkeys([*also, text]))
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in also] + [f"{c} double" for c in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([measure(t or "") for t in b.column(names.index(text)).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(also)], *(pa.array(x) for x in found.T)], [*also, *STATISTICS])

    return docs.select(*names).mapInArrow(run, schema)


@dataclass
class Rule:
    """All of (statistic, is above, threshold) hold."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, t in self.parts:
            out &= (x[:, k] > t) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, t in self.parts:
            out = out & (F.col(STATISTICS[k]) > F.lit(float(t)) if above else F.col(STATISTICS[k]) <= F.lit(float(t)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[k]} {'>' if above else '<='} {t:.6g}" for k, above, t in self.parts)


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: np.ndarray
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += w * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        z = F.lit(float(self.intercept))
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(r.column(), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def grow(x: np.ndarray, bins: list[np.ndarray], code: np.ndarray, target: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple, out: list, value: np.ndarray) -> None:
    """One regression tree on gradients; adds the path of each node to ``out`` and leaf steps to ``value``."""
    g, h = target[rows].sum(), hessian[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        for k, cuts in enumerate(bins):
            if not len(cuts):
                continue
            c = code[rows, k]
            n = np.cumsum(np.bincount(c, minlength=len(cuts) + 1))[:-1]
            gl = np.cumsum(np.bincount(c, target[rows], len(cuts) + 1))[:-1]
            hl = np.cumsum(np.bincount(c, hessian[rows], len(cuts) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < least) | (len(rows) - n < least)] = -1
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], (k, at))
    if best[1] is None:
        value[rows] = g / (h + 1)
        return
    k, at = best[1]
    for above in (False, True):
        side = rows[(code[rows, k] > at) == above]
        more = (*path, (k, above, float(bins[k][at])))
        out.append(Rule(more))
        grow(x, bins, code, target, hessian, side, depth - 1, least, more, out, value)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 20, depth: int = 3, rate: float = 0.3, penalty: float = 5e-4, steps: int = 300, seed: int = 11) -> Ensemble:
    """Boost trees, pool the rules of their paths and fit weights under an L1 penalty (proximal gradient with momentum).

    ``weight`` (of mean 1) gives the rows of a sample their class's share of all labelled rows.
    """
    weight = np.ones(len(y)) if weight is None else weight
    share = float((weight * y).mean()) if len(y) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Ensemble([], np.zeros(0), start)
    rng = np.random.default_rng(seed)
    bins = [np.unique(np.quantile(v, np.linspace(0.01, 0.99, 64))) for v in x.T]
    bins = [b[(b >= v.min()) & (b < v.max())] for b, v in zip(bins, x.T, strict=True)]
    code = np.stack([np.searchsorted(b, v, side="left") for b, v in zip(bins, x.T, strict=True)], axis=1)
    z, pool, least = np.full(len(y), start), [], max(3, len(y) // 1000)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        step = np.zeros(len(y))
        if len(rows):
            grow(x, bins, code, weight * (y - p), weight * p * (1 - p), rows, depth, least, (), pool, step)
        z += rate * step
    pool = list({r.parts: r for r in pool}.values())
    held, keep, seen = [], [], set()
    for r in pool:
        h = r.holds(x)
        if (key := np.packbits(h).tobytes()) not in seen and 0 < h.sum() < len(h):
            seen.add(key)
            held.append(h)
            keep.append(r)
    if not keep:
        return Ensemble([], np.zeros(0), start)
    a = np.stack(held, axis=1).astype(float)
    w, b, v, vb, t = np.zeros(a.shape[1]), start, np.zeros(a.shape[1]), start, 1.0
    pace = 4.0 * len(y) / (np.linalg.norm(a, 2) ** 2 + len(y)) / max(1.0, weight.max())
    for _ in range(steps):
        e = weight * (1 / (1 + np.exp(-(a @ v + vb))) - y)
        u = v - pace * (a.T @ e) / len(y)
        new, nb = np.sign(u) * np.maximum(0, np.abs(u) - pace * penalty), vb - pace * e.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    some = np.flatnonzero(w)
    return Ensemble([keep[i] for i in some], w[some], float(b))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Ensemble:
    """Fit on a bounded sample of labelled rows whose crc32 of the id, modulo 5, is not 0."""
    known = labels.where(F.col("quality").isNotNull() & (F.pmod(crc_of_id(), F.lit(5)) != 0)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    sizes = class_sizes(known, "quality")
    few = training_sample(known, "quality", rows, sizes=sizes)
    found = statistics(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), ["doc_id", "quality"]).toPandas()
    found = found.sort_values(["doc_id", *STATISTICS])
    return fit(found[STATISTICS].to_numpy(float), found.quality.to_numpy(float), class_weights(found.quality, sizes))


def quality(docs: DataFrame, labels: DataFrame, at: float = 0.3, also: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted (and the columns ``also``) for every row of ``docs``.

    A null text is scored like an empty one, by the rules that hold for zeros; texts of any length
    are read whole.  Repeated rows are scored alike; other columns are ignored, and those of ``also`` may
    have any names but doc_id, held_out, score and predicted, which come out under ``original_<name>``.
    An empty table gives no rows.  Without labels of both values the score is a constant.
    """
    model = train(docs, labels)
    names = list(dict.fromkeys(c for c in also or [] if c != "doc_id"))
    own = [f"_own{i}" for i in range(len(names) + 2)]
    rows = statistics(docs.select("doc_id", "text", *(F.col(f"`{c}`") for c in names)).toDF(*own), [own[0], *own[2:]], own[1])
    score = model.column().alias("score")
    new = {"held_out", "score", "predicted"}
    shown = [F.col(o).alias(f"original_{c}" if c in new else c) for o, c in zip(own[2:], names, strict=True)]
    out = rows.select(F.col(own[0]).alias("doc_id"), *shown, (F.pmod(crc_of_id(own[0]), F.lit(5)) == 0).alias("held_out"), score)
    return out.withColumn("predicted", (F.col("score") >= at).cast("int"))


def keep_rows(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose score is below ``at``; all columns, whatever their names, stay."""
    model = train(docs, labels)
    own = [f"_own{i}" for i in range(len(docs.columns))]
    rows = statistics(docs.toDF(*own), own, own[docs.columns.index("text")]).where(model.column() >= at)
    return rows.select(*(F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)))
