"""Near duplicates by Order MinHash, verified by banded alignment.

A document is the sequence of its five-word shingles, each labelled with its occurrence number in
the document, so that labels are unique.  For each hash function the few smallest labels are
put back into text order and hashed to one bucket: two documents share it if they share these
shingles in one order, which follows edit similarity better than plain min-hashing does.

Documents with equal word sequences are collapsed to one representative before anything else.  In a bucket,
every member is first compared with the bucket's leader (the smallest row number for even hash functions, the largest
for odd ones).  The links found so far join rows to groups.  A bucket whose members are all in one group is done; in
the others every pair of members of different groups is examined: a small bucket in one task, a larger one in blocks,
one task for each pair of blocks.  Two blocks of the bucket's largest group need no such task.  So no bucket is capped,
none emits its pairs, and the result does not depend on a bucket's size.

Verification aligns the two shingle sequences: matching labels within a diagonal band (wider than
the threshold allows to be unmatched), and the longest chain of them that runs forward in both.
The similarity is aligned / (all of both - aligned); from 0.8 on it is a link.  Classes are the
connected components of the links.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import keep_named, materialise, release, row_digest, small_batches, text_of
from ruleloom.llm.graph import components

WORDS, SIMILARITY = 5, 0.8
#: Hash functions, and smallest labels that each one takes.
HASHES, TAKEN = 12, 3
#: Members of a bucket that one task settles; a larger bucket is split into blocks of half as many.
SETTLED = 2000
TABLE = "rid bigint, doc_id bigint, digest bigint, key binary, buckets array<bigint>, labels binary"

_ODD = np.random.default_rng(20).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(21).integers(1, 1 << 63, HASHES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def shingle_labels(words: list[bytes], k: int = WORDS) -> np.ndarray:
    """One 64-bit label per shingle, unique in the document; fewer than k words make one shingle."""
    w = np.array(list(map(zlib.crc32, words)), np.uint64)
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
    if same.any():
        at = np.arange(len(h))
        first = np.maximum.accumulate(np.where(same, 0, at))
        occurrence = np.empty(len(h), np.uint64)
        occurrence[order] = at - first
        h = _mix(h + occurrence * np.uint64(0xD1B54A32D192ED03))
    return h


def buckets(labels: np.ndarray, hashes: int = HASHES, taken: int = TAKEN) -> list[int]:
    """The Order MinHash values of a document as signed 64-bit numbers."""
    out = []
    for i in range(hashes if len(labels) else 0):
        v = labels * _ODD[i] + _ADD[i]
        at = np.sort(np.argpartition(v, taken - 1)[:taken]) if len(v) > taken else np.arange(len(v))
        key = np.uint64(i + 1)
        for x in labels[at]:
            key = _mix(np.array([key * np.uint64(31) + x]))[0]
        out.append(int(key.astype(np.int64)))
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """The similarity of two label sequences, or 0 where it is sure to be below ``least``."""
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m) or not n:
        return 0.0
    need = least / (1 + least) * (n + m)
    _, i, j = np.intersect1d(a, b, return_indices=True)
    band = n + m - 2 * need
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < need - 1e-9:
        return 0.0
    chain = j[np.argsort(i, kind="stable")]
    if np.all(chain[1:] > chain[:-1]):
        size = len(chain)
    else:
        tails: list[int] = []
        for x in chain.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        size = len(tails)
    found = size / (n + m - size)
    return found if found >= least - 1e-9 else 0.0


def _signatures(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = [f.split()[0] for f in TABLE.split(", ")]
        with np.errstate(over="ignore"):
            rid = TaskContext.get().partitionId() << 36
            for b in batches:
                keys, found, labels = [], [], []
                for text in b.column(0).to_pylist():
                    words = words_of(text)
                    h = shingle_labels(words)
                    keys.append(hashlib.md5(b" ".join(words), usedforsecurity=False).digest())
                    found.append(buckets(h))
                    labels.append((h >> np.uint64(32)).astype("<u4").tobytes())
                rids = pa.array(range(rid, rid + len(keys)), pa.int64())
                rid += len(keys)
                yield pa.RecordBatch.from_arrays([rids, b.column(1), b.column(2), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(labels, pa.binary())], names)

    return docs.select(text_of().alias("text"), "doc_id", row_digest().alias("digest")).mapInArrow(run, TABLE)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
        linked = [aligned(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) > 0 for x, y in pairs]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], ["rid", "leader", "linked"])


def shared_labels(labels: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many labels each two documents share, by products of blocks of their 0/1 matrix."""
    doc = np.repeat(np.arange(len(labels)), [len(x) for x in labels])
    _, column, count = np.unique(np.concatenate(labels), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    order = order[count[column[order]] > 1]
    found, column, doc = np.zeros((len(labels), len(labels)), np.float32), column[order], doc[order]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [at, at + columns])
        block = np.zeros((len(labels), columns), np.float32)
        block[doc[a:b], column[a:b] - at] = 1
        found += block @ block.T
    return found


def _settle(group: pd.DataFrame) -> pd.DataFrame:
    """Links of a bucket or of two of its blocks: only pairs that share enough labels and that no earlier link connects are aligned."""
    rows = group.sort_values("rid")
    rid, labels, known = rows.rid.tolist(), [np.frombuffer(x, "<u4") for x in rows.labels], rows.known.to_numpy()
    size = np.array([len(x) for x in labels], np.float32)
    need = SIMILARITY / (1 + SIMILARITY) * (size[:, None] + size[None, :])
    wanted = np.triu(shared_labels(labels) >= need - 1e-3, 1) & (known[:, None] != known[None, :])
    if rows.left.iat[0] != rows.right.iat[0]:
        block = rows.block.to_numpy()
        wanted &= block[:, None] != block[None, :]
    first: dict[int, int] = {}
    top, out = [first.setdefault(k, i) for i, k in enumerate(known.tolist())], []

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for i, j in np.argwhere(wanted).tolist():
        if root(i) != root(j) and aligned(labels[i], labels[j]):
            top[root(j)] = root(i)
            out.append((rid[i], rid[j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _blocks(members: DataFrame, known: DataFrame) -> DataFrame:
    """bucket, rid, known, block, left, right: the members of each pair of blocks that can hold a new link.

    ``known`` (node, label) names the group of the rows that have one.  The members of a large bucket
    that are outside its largest group have the first blocks, and meet all blocks.
    """
    grouped = members.join(known.withColumnRenamed("node", "rid"), "rid", "left")
    grouped = materialise(grouped.select("bucket", "rid", F.coalesce("label", "rid").alias("known")))
    sizes = grouped.groupBy("bucket", "known").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.max(F.struct("n", "known")).alias("most")).where("groups > 1")
    half = F.lit(max(1, SETTLED // 2))
    others, most = F.ceil((F.col("n") - F.col("most.n")) / half), F.ceil(F.col("most.n") / half)
    small = F.col("n") <= SETTLED
    mixed = materialise(mixed.select("bucket", F.col("most.known").alias("largest"), F.when(small, 1).otherwise(others).cast("int").alias("others"), F.when(small, 0).otherwise(most).cast("int").alias("most")))
    place = F.xxhash64("bucket", "rid")
    block = F.when((F.col("most") > 0) & (F.col("known") == F.col("largest")), F.col("others") + F.pmod(place, "most")).otherwise(F.pmod(place, "others"))
    dealt = grouped.join(mixed, "bucket").withColumn("block", block.cast("int"))
    met = F.col("others") + F.when(F.col("block") < F.col("others"), F.col("most")).otherwise(0)
    dealt = dealt.select("bucket", "rid", "known", "block", F.explode(F.sequence(F.lit(0), met - 1)).alias("other"))
    dealt = materialise(dealt.select("bucket", "rid", "known", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")))
    release(grouped, mixed)
    return dealt


def _links(members: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: verified links of ``members`` (bucket, rid); ``labels`` has rid and labels."""
    order = F.when(F.pmod("bucket", F.lit(2)) == 0, F.col("rid")).otherwise(-F.col("rid"))
    sized = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(order).alias("o")).where("n > 1")
    sized = materialise(sized)  # a join of two exchanges can be split where a bucket is very large
    leader = F.abs("o").alias("leader")
    pairs = members.join(sized.select("bucket", leader), "bucket").where("rid <> leader").select("rid", "leader").distinct()
    own = labels.select("rid", F.col("labels").alias("x"))
    other = labels.select(F.col("rid").alias("leader"), F.col("labels").alias("y"))
    both = pairs.join(own, "rid").join(other, "leader").select("rid", "leader", "x", "y")
    verdict = materialise(both.mapInArrow(_judge, "rid bigint, leader bigint, linked boolean"))
    release(sized)
    found = verdict.where("linked").select(F.col("rid").alias("a"), F.col("leader").alias("b"))
    dealt = _blocks(members, components(found))
    settled = materialise(dealt.join(labels, "rid").groupBy("bucket", "left", "right").applyInPandas(_settle, "a bigint, b bigint"))
    links = materialise(found.unionByName(settled))
    release(dealt, verdict, settled)
    return links


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest, class_id (the smallest id of the class), class_size and kept, for every row of ``docs``.

    The first row of a class by id (null ids last) is kept.  Words are split at ASCII white space and
    compared in lower case.  A text of fewer than five words is one shingle, so only equal ones are
    linked; all texts without words (null and empty ones too) form one class.  Repeated rows are copies of each
    other, and one of them is kept.  Texts of any length are compared whole.  Other columns, whatever
    their names, are ignored; an empty table gives no rows.
    """
    table = materialise(_signatures(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("rid").alias("row")))
    texts = materialise(table.groupBy("key").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"), first.alias("first")))
    only = table.select("rid", "buckets").join(texts.select("rid"), "rid", "left_semi")
    every = materialise(only.select("rid", F.explode("buckets").alias("bucket")))
    shared = every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = materialise(every.join(shared.hint("merge"), "bucket"))
    release(every)
    wanted = members.select("rid").distinct()
    labels = materialise(table.select("rid", "labels").join(wanted.hint("merge"), "rid"))
    links = _links(members, labels)
    label = components(links)
    release(members, labels, links)
    grouped = texts.join(label.withColumnRenamed("node", "rid"), "rid", "left").withColumn("class", F.coalesce("label", "rid"))
    grouped = materialise(grouped.select("key", "copies", "first", "class"))
    release(texts)
    # written, so that the joins below are of plain exchanges, which adaptive execution can split
    whole = materialise(grouped.groupBy("class").agg(F.sum("copies").alias("class_size"), F.min("first").alias("best")))
    named = materialise(grouped.join(whole.hint("merge"), "class").select("key", "class_size", "best"))
    release(grouped, whole)
    out = table.select("key", "doc_id", "digest", "rid").join(named.hint("merge"), "key")
    return out.select("doc_id", "digest", F.col("best.id").alias("class_id"), "class_size", (F.col("rid") == F.col("best.row")).alias("kept"))


def keep_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class; all columns stay."""
    return keep_named(docs, classes(docs).where("kept"))
