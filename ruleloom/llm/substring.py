"""Substring deduplication by hashing text units.

A text is cut into lines and, within lines, after sentence ends, so that a repeated passage is found
whether it stands alone or inside a paragraph.  A unit is normalised (lower case, white space
collapsed) and hashed to 128 bits.  Digests are grouped over all documents; of each digest that occurs more than
once the earliest occurrence (by rank, document id and position) is kept.  Later occurrences are
removed where they form a run of neighbouring repeated units of ``min_words`` words or more; very short
lines on their own stay.  In scripts without blanks characters count, not words.  What is removed, with
the white space that goes with it, is reported by its offsets in the original text: the original
without these spans is the text that is returned.

Texts are cut and hashed once; the digests of a document are written as one array.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import BLANKS, materialise, release, row_digest, small_batches, text_of

#: Least words of a run of repeated units: only very short ones, such as a heading of their own, stay.
MIN_WORDS = 4
#: A character of a script that puts no blanks between words (Thai to Burmese, Khmer, kana, Chinese).
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: The end of a unit: a line break, or white space after a sentence's last mark.
CUT = re.compile(r"\n+|(?<=[.!?])[^\S\n]+")
#: Digests of one document that travel in one row.
BLOCK = 2048


def units(text: str) -> list[tuple[int, int]]:
    """Offsets [start, end) of the units; separators belong to no unit."""
    out, at = [], 0
    for m in CUT.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def unit_digest(unit: str) -> bytes:
    words = " ".join(unit.lower().split())
    return hashlib.md5(words.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def length(unit: str) -> int:
    """Words of a unit; of a script without blanks each character counts as one."""
    found = UNSPACED.findall(unit)
    return len(found) + len((UNSPACED.sub(" ", unit) if found else unit).split())


def repeated_runs(text: str, spans: list[tuple[int, int]], repeated: set[int], min_words: int) -> list[tuple[int, int]]:
    """Offsets of the runs of repeated units (given by number) with ``min_words`` words or more, and what goes with them.

    The separator after a run goes too, but for a line break that ends a line whose beginning stays.
    """
    out, i = [], 0
    while i < len(spans):
        if i not in repeated:
            i += 1
            continue
        j = i
        while j + 1 < len(spans) and j + 1 in repeated:
            j += 1
        if sum(length(text[a:b]) for a, b in spans[i : j + 1]) >= min_words:
            start, end = spans[i][0], spans[j + 1][0] if j + 1 < len(spans) else len(text)
            if start and text[start - 1] != "\n" and "\n" in text[spans[j][1] : end]:
                end = spans[j][1]
            out.append((start, end))
        i = j + 1
    return out


def cut_out(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the runs."""
    bounds = [0, *(x for run in runs for x in run), len(text)]
    return "".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))


def _digests(docs: DataFrame, rank: str) -> DataFrame:
    """rank, doc_id, row, first and digests (pairs of 64-bit numbers) of the units of each document, ``BLOCK`` a row."""
    small_batches(docs.sparkSession)
    schema = "rank double, doc_id bigint, row bigint, first int, digests array<struct<hi:bigint,lo:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, first, sizes, found = [], [], [0], []
            for i, text in enumerate(b.column(3).to_pylist()):
                d = [unit_digest(text[x:y]) for x, y in units(text)]
                found += d
                for at in range(0, len(d), BLOCK):
                    index.append(i)
                    first.append(at)
                    sizes.append(min(BLOCK, len(d) - at))
            words = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            pairs = pa.StructArray.from_arrays([pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())], ["hi", "lo"])
            digests = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pairs)
            take = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(3)), pa.array(first, pa.int32()), digests], ["rank", "doc_id", "row", "first", "digests"])

    return docs.select(F.col(rank).cast("double").alias("rank"), "doc_id", row_digest().alias("row"), text_of().alias("text")).mapInArrow(run, schema)


def _repeated(docs: DataFrame, rank: str) -> DataFrame:
    """doc_id, row and the positions of the units that are not the earliest of their digest."""
    table = materialise(_digests(docs, rank))
    occurrences = table.select("rank", "doc_id", "row", "first", F.posexplode("digests").alias("i", "digest"))
    occurrences = occurrences.select("rank", "doc_id", "row", (F.col("first") + F.col("i")).alias("pos"), "digest.hi", "digest.lo")
    place = F.struct(F.col("rank").isNull().alias("a"), F.col("rank").alias("b"), F.col("doc_id").isNull().alias("c"), F.col("doc_id").alias("d"), F.col("row").alias("e"), F.col("pos").alias("f"))
    many = occurrences.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("hi", "lo", "first")
    many = materialise(many)  # a join of two exchanges can be split where one unit is very frequent
    later = occurrences.join(many, ["hi", "lo"]).where(place != F.col("first"))
    found = materialise(later.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("repeated")))
    release(table, many)
    return found


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, rank: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without repeated passages, with ``removed_spans``
    (offsets in the original text), ``n_units``, ``n_repeated_units`` and ``n_removed_words``.

    A null text stays null and an empty one empty.  Null ranks and ids come last.  Rows with one id
    and one text are one document and keep the same units.  Texts of any length are cut whole.  A column of
    ``docs`` named like one of the four new ones keeps its values under ``original_<name>`` (with more of
    ``original_`` if that is taken).  An empty table gives no rows.
    """
    found = _repeated(docs, rank).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "repeated")
    taken = ["removed_spans", "n_units", "n_repeated_units", "n_removed_words"]
    names = renamed(docs.columns)
    keyed = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    at_id, at_text = f"_c{docs.columns.index('doc_id')}", f"_c{docs.columns.index('text')}"
    digest = F.xxhash64(F.coalesce(F.col(at_text), F.lit("")))
    joined = keyed.withColumn("_digest", digest).join(found, F.col(at_id).eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_row")), "left").drop("_id", "_row", "_digest")
    kinds = [f.dataType.simpleString() for f in keyed.schema.fields]
    schema = ", ".join([f"_c{i} {k}" for i, k in enumerate(kinds)] + ["removed_spans array<struct<start:int,end:int>>", "n_units int", "n_repeated_units int", "n_removed_words int"])
    text_column = docs.columns.index("text")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans, counts = [], [], []
            for text, repeated in zip(b.column(text_column).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if not text or not repeated:
                    texts.append(text)
                    spans.append([])
                    counts.append((len(units(text)) if text else 0, 0, 0))
                    continue
                all_units = units(text)
                runs = repeated_runs(text, all_units, set(repeated), min_words)
                texts.append(cut_out(text, runs))
                spans.append([{"start": x, "end": y} for x, y in runs])
                counts.append((len(all_units), len(repeated), sum(len(text[x:y].split()) for x, y in runs)))
            columns = list(b.columns[: len(names)])
            columns[text_column] = pa.array(texts, pa.string())
            table = np.array(counts, np.int32).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, span), *(pa.array(x) for x in table.T)], [*(f"_c{i}" for i in range(len(names))), *taken])

    return joined.mapInArrow(run, schema).toDF(*names, *taken)


def renamed(columns: list[str]) -> list[str]:
    """Names of the columns of ``docs`` beside the four new ones."""
    out, taken = [], {"removed_spans", "n_units", "n_repeated_units", "n_removed_words"}
    for c in columns:
        name = c
        while name in taken or (name != c and name in columns):
            name = f"original_{name}"
        out.append(name)
        taken = taken | {name} if name != c else taken
    return out


def keep_rows(docs: DataFrame, min_words: int = MIN_WORDS, rank: str = "doc_id") -> DataFrame:
    """``docs`` with repeated passages cut out; documents of which no word is left go."""
    out = substring_dedup(docs, min_words, rank)
    gone = (F.size("removed_spans") > 0) & (F.translate("text", BLANKS, "") == "")
    kept = out.where(~F.coalesce(gone, F.lit(False)))
    return kept.toDF(*(f"_c{i}" for i in range(len(out.columns)))).select(*(f"_c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)
