"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Only documents are labelled, so tokens are labelled first: a word or word beginning that is many
times likelier in toxic than in clean training documents (smoothed log odds ratio and its z value)
marks its tokens as toxic, as long as they stand in a toxic document.  A two-state chain over the tokens of a line is
then trained on those labels, by exact gradients from the forward and backward messages.  Features are the token, its beginnings
and endings, its shape and its neighbours, hashed.  A document's statistics are sums and
maxima of the tokens' marginals; a logistic curve fitted on the training documents maps them to 0..1.

The messages of a two-state chain are kept as odds, and all lines of a batch advance together, so
the recursion is one vector step per token position.  A line is one chain, however long: a long one is
worked on in blocks side by side, whose transfer matrices give the odds at the blocks' borders first.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import class_sizes, class_weights, crc_of_id, small_batches, with_texts

TOKEN = re.compile(r"\w+|\n")
#: Bound of the training sample: rows and megabytes of text of each class.
SAMPLE_ROWS, SAMPLE_MB = 2500, 10
#: Lines of the sample that train the chain, and the share of lines without a marked token that are drawn for it.
SAMPLE_LINES, UNTAGGED_SHARE = 15_000, 0.15
#: Tokens of whole lines whose messages are in memory at once, and characters of whole texts that are scored together.
CHUNK_TOKENS, CHUNK_CHARS = 200_000, 500_000
BITS = 16
FAR = 30.0
#: Tokens of a chain that are worked on in one block.
BLOCK = 256
CACHE_WORDS = 200_000
SPAN_AT = 0.5


MASK = (1 << BITS) - 1
#: Start values of the hashes of each kind of feature.
WORD, PREV, NEXT, SHAPE, EDGE = 1, 2, 3, 4, 5
HEADS, TAILS = (2, 3, 4, 5, 6, 7), (2, 3)


def own_features(word: str) -> list[int]:
    """Slots of the token itself, its shape, its endings and its beginnings; two bytes hold a character."""
    low = word.lower().encode("utf-16-le", "surrogatepass")
    shape = b"A" if word.isupper() else b"a" if word.islower() else b"0" if word.isdigit() else b"x"
    crc = zlib.crc32
    return [crc(low, WORD) & MASK, crc(shape, SHAPE) & MASK, *[crc(low[-2 * k :], 20 + k) & MASK for k in TAILS], *[crc(low[: 2 * k], 10 + k) & MASK for k in HEADS]]


def near_features(word: str) -> tuple[int, int]:
    """Slots that a word gives to the token after it and to the one before it."""
    low = word.lower().encode("utf-16-le", "surrogatepass")
    return zlib.crc32(low, PREV) & MASK, zlib.crc32(low, NEXT) & MASK


def edge() -> int:
    return zlib.crc32(b"", EDGE) & MASK


@dataclass
class Crf:
    weights: np.ndarray  # of features, for the toxic state
    moves: np.ndarray  # log potentials [from, to]
    curve: np.ndarray  # intercept and weights of the document statistics

    def lines(self, emission: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward odds, backward odds and token odds, for lines laid end to end."""
        lengths = lengths[lengths > 0]
        parts = -(-lengths // block)
        size = np.full(parts.sum(), block)
        last = np.cumsum(parts) - 1
        size[last] = lengths - (parts - 1) * block
        begins, ends = np.zeros(len(size), bool), np.zeros(len(size), bool)
        ends[last], begins[last - parts + 1] = True, True
        starts = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        sizes, first = size[order], starts[order]
        push = np.exp(np.clip(emission, -FAR, FAR))
        t = np.exp(self.moves)
        forward, backward = np.empty_like(push), np.ones_like(push)
        active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        ahead = lambda odds, odds_in: np.clip(odds * (t[0, 1] + odds_in * t[1, 1]) / (t[0, 0] + odds_in * t[1, 0]), 1e-15, 1e15)
        behind = lambda x: np.clip((t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x), 1e-15, 1e15)
        forward[starts] = push[starts]
        if not begins.all():
            enter, leave = self._borders(push, starts, size, begins, ends, t)
            inner = np.flatnonzero(~begins)
            forward[starts[inner]] = ahead(push[starts[inner]], enter[inner])
            inner = np.flatnonzero(~ends)
            backward[starts[inner] + size[inner] - 1] = leave[inner]
        for k in range(1, len(active)):
            at = first[: active[k]] + k
            forward[at] = ahead(push[at], forward[at - 1])
        for k in range(len(active) - 1, 0, -1):
            at = first[: active[k]] + k
            backward[at - 1] = behind(push[at] * backward[at])
        return forward, backward, push

    @staticmethod
    def _borders(push: np.ndarray, starts: np.ndarray, size: np.ndarray, begins: np.ndarray, ends: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward odds that enter each block and backward odds at its end, by the blocks' transfer matrices."""
        long = np.flatnonzero(~(begins & ends))  # in the order of the text; all but the last of a chain are full
        matrix = np.tile(np.eye(2), (len(long), 1, 1))
        for k in range(int(size[long].max())):
            live = np.flatnonzero(size[long] > k)
            odds = push[starts[long[live]] + k]
            step = np.stack([np.ones(len(live)), odds], axis=1)
            move = np.where((begins[long[live]] & (k == 0))[:, None, None], np.eye(2), t)
            matrix[live] = matrix[live] @ (move * step[:, None, :])
            matrix[live] /= matrix[live].sum((1, 2))[:, None, None]
        enter, leave = np.ones(len(size)), np.ones(len(size))
        odds = 1.0
        for i, at in enumerate(long):
            if begins[at]:
                row = matrix[i].sum(0)  # before the first token both states are alike
            else:
                enter[at] = odds
                row = np.array([1.0, odds]) @ matrix[i]
            odds = min(max(row[1] / max(row[0], 1e-300), 1e-15), 1e15)
        odds = 1.0
        for i in range(len(long) - 1, -1, -1):
            at = long[i]
            if ends[at]:
                odds = 1.0
            leave[at] = odds
            column = matrix[i] @ np.array([1.0, odds])
            odds = min(max(column[1] / max(column[0], 1e-300), 1e-15), 1e15)
        return enter, leave

    def marginals(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        forward, backward, _ = self.lines(emission, lengths)
        odds = forward * backward
        return odds / (1 + odds)


def statistics(p: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Per document: 1, log(1 + expected toxic tokens), the root of their share of all tokens, the largest marginal."""
    expected = np.bincount(owner, p, docs)
    tokens = np.bincount(owner, minlength=docs)
    most, some = np.zeros(docs), np.flatnonzero(tokens)
    if len(some):
        most[some] = np.maximum.reduceat(p, (np.cumsum(tokens) - tokens)[some])
    return np.stack([np.ones(docs), np.log1p(expected), 10 * np.sqrt(expected / np.maximum(1, tokens)), most], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3, steps: int = 50) -> np.ndarray:
    """Newton's method for ridge-penalised logistic regression; the first column isn't penalised."""
    w, keep = np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -FAR, FAR)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (weight * (p - y)) + keep @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text)


def marked_features(docs: list[np.ndarray], words: list[str], toxic: np.ndarray) -> set[str]:
    """Words and word beginnings that mark toxic documents (ids in ``words``, 0 at line ends); near copies count once."""
    seen, totals, first = set(), [0, 0], []
    crc = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint32)
    for at, (ids, y) in enumerate(zip(docs, toxic, strict=True)):
        key = (int(y), *np.sort(crc[np.unique(ids)])[:3].tolist())
        if key not in seen:
            seen.add(key)
            totals[y] += 1
            first.append(at)

    def features(ids: np.ndarray) -> set[str]:
        found = {words[i].lower() for i in np.unique(ids) if i}
        return {f"w={w}" for w in found} | {f"p={w[:k]}" for w in found for k in (4, 5, 6, 7) if len(w) > k}

    bad, clean = Counter(), Counter()
    for at in first:
        if toxic[at]:
            bad.update(features(docs[at]))
    bad = Counter({f: n for f, n in bad.items() if n >= 4})  # only these can be marked
    for at in first:
        if not toxic[at]:
            clean.update(features(docs[at]).intersection(bad))
    marked = set()
    for f, a in bad.items():
        if a >= 4:
            b = clean[f]
            ratio = np.log((a + 0.5) / (totals[1] - a + 0.5)) - np.log((b + 0.5) / (totals[0] - b + 0.5))
            z = ratio / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (totals[1] - a + 0.5) + 1 / (totals[0] - b + 0.5))
            if ratio >= 3.0 and z >= 2.5:
                marked.add(f)
    return marked


def is_marked(word: str, marked: set[str]) -> bool:
    low = word.lower()
    return f"w={low}" in marked or any(f"p={low[:k]}" in marked for k in (4, 5, 6, 7) if len(low) > k)


@dataclass
class _Chunk:
    """Whole lines end to end: the words, the words beside them (0 beyond a line's ends), and their labels."""

    ids: np.ndarray
    before: np.ndarray
    after: np.ndarray
    tag: np.ndarray
    lengths: np.ndarray
    inner: np.ndarray  # places that have a token before them

    @classmethod
    def of(cls, lines: list[tuple[np.ndarray, np.ndarray]]) -> _Chunk:
        ids, tag = (np.concatenate(x) for x in zip(*lines, strict=True))
        lengths = np.array([len(x) for x, _ in lines])
        starts = np.cumsum(lengths) - lengths
        before, after, inside = np.roll(ids, 1), np.roll(ids, -1), np.ones(len(ids), bool)
        before[starts], after[starts + lengths - 1], inside[starts] = 0, 0, False
        return cls(ids, before, after, tag, lengths, np.flatnonzero(inside))


def _train_chain(crf: Crf, words: list[str], lines: list[tuple[np.ndarray, np.ndarray]], steps: int, rate: float, ridge: float) -> None:
    """Gradient steps with one rate for each weight.

    Potentials and residuals are summed for each distinct word first, so that a token costs three look-ups
    however many features it has, and the messages of no more than a chunk of lines are in memory.
    """
    if not lines:
        return
    chunks, group, size = [], [], 0
    for line in lines:
        group.append(line)
        size += len(line[0])
        if size >= CHUNK_TOKENS:
            chunks, group, size = [*chunks, _Chunk.of(group)], [], 0
    if group:
        chunks.append(_Chunk.of(group))
    none = edge()
    own = np.array([own_features(w) for w in words], np.int32)
    near = np.array([(none, none), *(near_features(w) for w in words[1:])], np.int32)
    slots = 1 << BITS
    seen_moves = np.zeros((2, 2))
    for c in chunks:
        np.add.at(seen_moves, (c.tag[c.inner - 1].astype(int), c.tag[c.inner].astype(int)), 1)
    squares, move_squares = np.full(slots, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        pull, left, right = crf.weights[own].sum(1), crf.weights[near[:, 0]], crf.weights[near[:, 1]]
        wrong, expected, t = np.zeros((3, len(words))), np.zeros((2, 2)), np.exp(crf.moves)
        for c in chunks:
            f, b, push = crf.lines(pull[c.ids] + left[c.before] + right[c.after], c.lengths)
            p = f * b / (1 + f * b) - c.tag
            for k, at in enumerate((c.ids, c.before, c.after)):
                wrong[k] += np.bincount(at, p, len(words))
            a, onward = f[c.inner - 1], push[c.inner] * b[c.inner]
            joint = np.array([[np.full(len(a), t[0, 0]), t[0, 1] * onward], [t[1, 0] * a, t[1, 1] * a * onward]])
            expected += (joint / joint.sum((0, 1))).sum(2)
        g = sum(np.bincount(column, wrong[0], slots) for column in own.T)
        g = (g + np.bincount(near[:, 0], wrong[1], slots) + np.bincount(near[:, 1], wrong[2], slots)) / len(lines) + ridge * crf.weights
        squares += g * g
        crf.weights = crf.weights - rate * g / np.sqrt(squares)
        g2 = (expected - seen_moves) / len(lines)
        move_squares += g2 * g2
        crf.moves = crf.moves - 0.1 * g2 / np.sqrt(move_squares)


def fit(texts: list[str], toxic: list[int], weight: np.ndarray | None = None, steps: int = 80, rate: float = 0.5, ridge: float = 1e-3, seed: int = 5) -> Crf:
    """Train the chain and the document curve; with no label of one class the curve is a constant.

    ``weight`` gives the documents of a sample their class's share of all labelled documents in the curve.
    """
    y = np.array(toxic, int)
    crf = Crf(np.zeros(1 << BITS), np.zeros((2, 2)), np.array([-3.0, 0, 0, 0]))
    if len(y) and y.min() == y.max():
        crf.curve[0] = 3.0 if y[0] else -3.0
    if not len(y) or y.min() == y.max():
        return crf
    known = {"\n": 0}
    docs = [np.array([known.setdefault(t, len(known)) for t in tokens_of(text)], np.int32) for text in texts]
    words = list(known)
    marked = marked_features(docs, words, y)
    hot = np.array([i > 0 and is_marked(w, marked) for i, w in enumerate(words)])
    rng = np.random.default_rng(seed)
    lines: list[tuple[np.ndarray, np.ndarray]] = []
    for ids, bad in zip(docs, y, strict=True):
        tags, begin = hot[ids] & bool(bad), 0
        for end in [*np.flatnonzero(ids == 0).tolist(), len(ids)]:
            if end > begin and (tags[begin:end].any() or rng.random() < UNTAGGED_SHARE):
                lines.append((ids[begin:end], tags[begin:end]))
            begin = end + 1
    lines = [lines[i] for i in rng.permutation(len(lines))[:SAMPLE_LINES]]
    _train_chain(crf, words, lines, steps, rate, ridge)
    del docs, lines, known, words
    scorer = Scorer(crf)
    group = np.cumsum([len(t) for t in texts]) // CHUNK_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    stats = np.concatenate([scorer.statistics(texts[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)])
    crf.curve = logistic(stats, y, np.ones(len(y)) if weight is None else weight)
    return crf


class Scorer:
    """Scores of texts by one model; keeps the features' sums of the words met lately, up to a bound."""

    def __init__(self, crf: Crf) -> None:
        self.crf, self.known = crf, {}
        self._reset()

    def _reset(self) -> None:
        self.known = {"\n": 0}
        beside = self.crf.weights[edge()]
        self.table = np.zeros((CACHE_WORDS + 1, 3))
        self.table[0] = (0.0, beside, beside)

    def _learn(self, words: list[str]) -> None:
        w = self.crf.weights
        own = w[np.array([own_features(x) for x in words])].sum(1)
        near = w[np.array([near_features(x) for x in words])]
        at = len(self.known)
        self.table[at : at + len(words)] = np.column_stack([own, near])
        self.known.update(zip(words, range(at, at + len(words)), strict=True))

    def _ids(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[t] for t in tokens], np.int32)
        except KeyError:
            self._learn([t for t in dict.fromkeys(tokens) if t not in known])
            return np.array([known[t] for t in tokens], np.int32)

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Toxic marginals of all tokens (0 at line ends) and the text that each belongs to."""
        parts, emissions, lengths = [], [], []
        for text in texts:
            tokens = ["\n", *tokens_of(text), "\n"]
            new = len(set(tokens).difference(self.known))
            if len(self.known) + new > CACHE_WORDS:
                self._reset()
                if new > CACHE_WORDS // 2:
                    self.table = np.zeros((new + CACHE_WORDS, 3))
                    self.table[0, 1:] = self.crf.weights[edge()]
            ids = self._ids(tokens)
            rows = self.table[ids]
            emissions.append((rows[1:-1, 0] + rows[:-2, 1] + rows[2:, 2])[ids[1:-1] != 0])
            ends = np.flatnonzero(ids == 0)
            lengths.append(np.diff(ends) - 1)
            parts.append(len(emissions[-1]))
        emission = np.concatenate(emissions) if emissions else np.zeros(0)
        size = np.concatenate(lengths) if lengths else np.zeros(0, int)
        return self.crf.marginals(emission, size), np.repeat(np.arange(len(texts)), parts)

    def statistics(self, texts: list[str]) -> np.ndarray:
        return statistics(*self.marginals(texts), len(texts))

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Document scores and the offsets [start, end) of runs of tokens that are likelier toxic than not."""
        p, owner = self.marginals(texts)
        stats = statistics(p, owner, len(texts))
        score = 1 / (1 + np.exp(-np.clip(stats @ self.crf.curve, -FAR, FAR)))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        hit = p >= SPAN_AT
        first = np.searchsorted(owner, np.arange(len(texts)))
        for i in np.unique(owner[hit]):
            k = first[i]
            for m in TOKEN.finditer(texts[i]):
                if m.group() == "\n":
                    continue
                if hit[k]:
                    before = spans[i][-1] if spans[i] else None
                    if before and k and hit[k - 1] and not texts[i][before[1] : m.start()].count("\n"):
                        spans[i][-1] = (before[0], m.end())
                    else:
                        spans[i].append((m.start(), m.end()))
                k += 1
        return score, spans


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, megabytes: int = SAMPLE_MB) -> Crf:
    """Fit on a bounded sample of labelled rows whose crc32 of the id, modulo 5, is not 0."""
    known = labels.where(F.col("toxic").isNotNull() & (F.pmod(crc_of_id(), F.lit(5)) != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = class_sizes(known, "toxic")
    found = with_texts(docs, known, "toxic", rows, megabytes, sizes)
    found = found.select("doc_id", "text", "toxic").toPandas().sort_values(["doc_id", "text"])
    return fit(found.text.tolist(), found.toxic.tolist(), class_weights(found.toxic, sizes))


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>"


def toxicity(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and the offsets of offending spans, for every row of ``docs``.

    Null and empty texts have no tokens and get the score of no evidence.  Texts and lines of any length
    are scored whole.  Repeated rows are scored alike; other columns, whatever their names, are ignored; an
    empty table gives no rows.  Without labels of both classes the score is a constant.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            score, spans = scorer.score([t or "" for t in b.column(1).to_pylist()])
            offsets = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score), pa.array((score >= at).astype(np.int32)), offsets], ["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select("doc_id", "text", (F.pmod(crc_of_id(), F.lit(5)) == 0).alias("held_out"))
    return rows.mapInArrow(run, SCHEMA)
