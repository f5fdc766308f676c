"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters, of lower-cased words with a blank at either end, are hashed.  A
document's value of an n-gram is its share of the document's n-grams times its inverse document
frequency.  Weights are learned online by follow-the-regularised-leader with L1 and L2 penalties,
and a temperature fitted on training documents that the weights did not see calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import class_sizes, crc_of_id, in_bytes, small_batches, training_sample

BITS = 17
#: Bound of the training sample: rows and megabytes of text of each language.
SAMPLE_ROWS, SAMPLE_MB = 500, 3
#: Languages that are learned: the most frequent ones, which bounds the tables of weights.
LANGUAGES = 64
SCALE = 40.0
UNKNOWN = "und"
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
BLANK = np.uint32(32)


def grams(text: str) -> np.ndarray:
    """Hashes of the n-grams of a text, repeats included; none spans two words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint32)
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(31) + one[1:] + np.uint32(7)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(2246822519) + one[2:] + np.uint32(11)
    found = np.concatenate([one[c != BLANK], two, three[c[1:-1] != BLANK]])
    found ^= found >> np.uint32(16)
    return (found * np.uint32(3266489917)) >> np.uint32(32 - BITS)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # n-gram x language: weight times inverse document frequency
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        g = grams(text)
        return self.bias + SCALE * self.table[g].sum(0, dtype=np.float64) / max(1, len(g))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(texts: list[str], langs: list[str], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 3) -> Model:
    """FTRL-proximal over the documents in a seeded order; a fifth of them only sets the temperature."""
    languages = sorted(set(langs))
    k, size = len(languages), 1 << BITS
    model = Model(languages, np.zeros((size, k), np.float32), np.zeros(k))
    if k < 2:
        return model
    rows = []
    for t in texts:
        g, n = np.unique(grams(t), return_counts=True)
        rows.append((g, n / max(1, n.sum())))
    df = np.zeros(size)
    for g, _ in rows:
        df[g] += 1
    idf = np.log((len(rows) + 1) / (df + 1)) + 1
    y = np.array([languages.index(x) for x in langs])
    order = np.random.default_rng(seed).permutation(len(rows))
    held, order = order[: len(order) // 5], order[len(order) // 5 :]
    z, n, w = (np.zeros((size, k)) for _ in range(3))
    bias_z, bias_n = np.zeros(k), np.zeros(k)
    closed = lambda z, n, l1: -np.sign(z) * np.maximum(0, np.abs(z) - l1) / ((beta + np.sqrt(n)) / alpha + l2)
    for _ in range(epochs):
        for i in order:
            g, tf = rows[i]
            x = SCALE * tf * idf[g]
            w[g] = closed(z[g], n[g], l1)
            bias = closed(bias_z, bias_n, 0.0)
            error = softmax(x @ w[g] + bias)
            error[y[i]] -= 1
            step = x[:, None] * error
            more = n[g] + step * step
            z[g] += step - (np.sqrt(more) - np.sqrt(n[g])) / alpha * w[g]
            n[g] = more
            more = bias_n + error * error
            bias_z += error - (np.sqrt(more) - np.sqrt(bias_n)) / alpha * bias
            bias_n = more
    model.table = (closed(z, n, l1) * idf[:, None]).astype(np.float32)
    model.bias = closed(bias_z, bias_n, 0.0)
    if len(held):
        logits = np.array([model.logits(texts[i]) for i in held])
        loss = lambda t: -np.mean(logits[np.arange(len(held)), y[held]] / t - np.log(np.exp((logits - logits.max(1, keepdims=True)) / t).sum(1)) - logits.max(1) / t)
        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, megabytes: int = SAMPLE_MB) -> Model:
    """Fit on a bounded sample of documents with a language whose crc32 of the id, modulo 4, is not 2."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(crc_of_id(), F.lit(4)) != 2))
    sizes = class_sizes(known, "lang", LANGUAGES)
    few = training_sample(known.select("doc_id", "text", "lang"), "lang", rows, sizes=sizes)
    found = in_bytes(few, "lang", megabytes).toPandas().sort_values(["doc_id", "text"])
    return fit(found.text.tolist(), found.lang.tolist())


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0.  With no labelled row every text
    is ``und``.  Texts of any length are read whole.  Repeated rows get equal results; of equal
    scores the first language by name wins.  Other columns, whatever their names, are ignored; an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.value.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", (F.pmod(crc_of_id(), F.lit(4)) == 2).alias("held_out"))
    return rows.mapInArrow(run, SCHEMA)
