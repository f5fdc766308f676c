"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

1.  Every row becomes (doc_id, digest of the normalised text, code points, row number); texts stay behind.
2.  A mergeable Misra-Gries family summary (``approx_top_k``, bounded counters, merged from partial
    summaries of each task) names the digests that may be frequent; an exact count of those alone
    verifies them and picks the row that stays.  At most ``counters`` winners exist, whatever the
    input, so they are broadcast and their rows are settled without a shuffle.
3.  All other digests are shuffled: rows are counted per digest, with partial sums in each task, and
    joined with the digests that occur more than once.  No task sorts or holds the rows of a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import BLANKS, keep_named, materialise, text_of

#: Counters of the summary, and so the largest number of winners that are broadcast.
COUNTERS = 1024
#: Rows from which a verified digest counts as heavy: this share of all, and at least this many.
HEAVY_SHARE, HEAVY_ROWS = 1 / 512, 32


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def digests(docs: DataFrame) -> DataFrame:
    text = text_of()
    rows = docs.select("doc_id", F.sha2(normalised(text).cast("binary"), 256).alias("text_sha256"), F.length(text).alias("_points"))
    return rows.withColumn("_row", F.monotonically_increasing_id())


def _best() -> Column:
    """The least is the best: most code points, then the smallest id, null ids last; the row number tells repeated rows apart."""
    return F.struct((-F.col("_points")).alias("minus"), F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))


def groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(_best()).alias("best"))


def winners(rows: DataFrame, counters: int = COUNTERS, share: float = HEAVY_SHARE, least: int = HEAVY_ROWS) -> DataFrame:
    """Verified heavy digests: text_sha256, group_size and the best row; at most ``counters`` rows."""
    sketch = rows.agg(F.count("*").alias("total"), F.expr(f"approx_top_k(text_sha256, {counters}, {4 * counters})").alias("top"))
    named = sketch.select("total", F.explode("top").alias("item")).where("item.count >= 2").select("total", F.col("item.item").alias("text_sha256"))
    found = rows.join(F.broadcast(named), "text_sha256").groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(_best()).alias("best"), F.first("total").alias("total"))
    return found.where((F.col("group_size") >= least) & (F.col("group_size") >= F.col("total") * share)).drop("total")


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    A null text counts as empty; empty texts form one group.  Repeated rows with one doc_id are one
    group whose rows all carry that keep_id, and one of them is kept.  A null doc_id is kept only if
    no row with an id and as many code points is in its group.  Any 64-bit id is allowed.  Texts of any
    length count whole.  Other columns, whatever their names, are ignored.  An empty table gives no rows.
    """
    rows = materialise(digests(docs))
    heavy = materialise(winners(rows, counters))
    light = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    # written, so that the join below is one of two plain exchanges, which adaptive execution can split
    many = materialise(groups(light).where("group_size > 1"))
    alone = F.col("best").isNull()
    settled = light.join(many.hint("merge"), "text_sha256", "left").unionByName(rows.join(F.broadcast(heavy), "text_sha256"))
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("best.id"))
    kept = alone | (F.col("best.row") == F.col("_row"))
    return settled.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), kept.alias("kept"), "text_sha256")


def keep_rows(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the rows that exact_dedup drops; all columns stay."""
    kept = exact_dedup(docs, counters).where("kept").select("doc_id", F.col("text_sha256").alias("digest"))
    return keep_named(docs, kept, lambda t: F.sha2(normalised(t).cast("binary"), 256))
