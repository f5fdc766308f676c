"""Proportional stratified interleaving of documents into shards.

Rows are shuffled by a seeded digest of their id and ranked within their source; a row's fractional
rank is (rank - 1/2) / rows of the source.  Sorted by that fraction, any contiguous cut holds every
source in proportion, so equal cuts of the global order give shards that match the mixture and whose
row counts differ by one at most.

A source may hold any share of the rows, so no rank is taken by one task.  Rows are put into slices
of the (uniform) sort key, slices are counted, running totals over the counts give each slice its
offset, and only rows of one slice are sorted together.  An id may hold any share of the rows too: the
digest of an id that occurs more than once also takes in the row's number, which deals its rows out evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import materialise, text_of

SHARDS = 8
#: Rows that one slice holds on average.
SLICE_ROWS = 2_000
#: Slices whose counts are summed in one task; their totals are summed one level up.
SLICES_A_BLOCK = 10_000
SCHEMA = "doc_id bigint, source string, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"


def _offsets(counts: DataFrame, keys: list[str], slice_name: str) -> DataFrame:
    """Rows before each slice, in two levels: within blocks of slices and over the blocks."""
    block = F.floor(F.col(slice_name) / SLICES_A_BLOCK).alias("block")
    counts = counts.select(*keys, slice_name, "n", block)
    before = lambda *more: Window.partitionBy(*more).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(*keys, "block").agg(F.sum("n").alias("in_block"))
    top = [*keys] or [F.lit(0)]
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("in_block").over(before(*top).orderBy("block")), F.lit(0))).drop("in_block")
    within = F.coalesce(F.sum("n").over(before(*keys, "block").orderBy(slice_name)), F.lit(0))
    return counts.withColumn("within", within).join(blocks, [*keys, "block"]).select(*keys, slice_name, (F.col("within") + F.col("ahead")).alias("offset"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = 7, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per document (see SCHEMA); ``slot`` runs without gaps from 0 in each shard.

    A null source is a source of its own.  A null text has size 1 and the checksum of no bytes; texts of
    any length count whole.  A null id is shuffled like an empty one.  Rows that share an id are shuffled by
    their place in the table as well, so which of them takes which place may change if the table is laid out
    anew; all other rows keep theirs.  Other columns, whatever their names, are ignored; an empty table gives
    no rows, and fewer rows than shards leave shards empty.
    """
    data = F.encode(text_of(), "UTF-8")
    rows = docs.select("doc_id", "source", (F.octet_length(text_of()) + 1).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    often = materialise(rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key", F.lit(True).alias("often")))
    name = F.when(F.col("often"), F.concat_ws(":", F.lit(str(seed)), "key", F.col("row").cast("string"))).otherwise(F.concat_ws(":", F.lit(str(seed)), "key"))
    rows = rows.join(often.hint("merge"), "key", "left").withColumn("digest", F.md5(name.cast("binary"))).drop("key", "row", "often")
    rows = rows.withColumn("stratum", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("none")))
    rows = materialise(rows)
    totals = rows.groupBy("stratum").agg(F.count("*").alias("rows"))
    unit = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / 2.0**32
    rows = rows.join(totals, "stratum").withColumn("slice", F.floor(unit * F.ceil(F.col("rows") / slice_rows)))
    # else the window below would take over the join's partitions, one for each source
    rows = rows.repartition("stratum", "slice")
    offsets = _offsets(rows.groupBy("stratum", "slice").agg(F.count("*").alias("n")), ["stratum"], "slice")
    order = ["digest", "doc_id", "text_crc32", "size"]
    here = F.row_number().over(Window.partitionBy("stratum", "slice").orderBy(*order))
    ranked = rows.withColumn("here", here).join(offsets, ["stratum", "slice"])
    rank = F.col("offset") + F.col("here")
    ranked = ranked.withColumn("fraction", (F.lit(2) * rank - 1) / (F.lit(2) * F.col("rows")))
    ranked = materialise(ranked.select("doc_id", "source", "size", "text_crc32", "digest", "stratum", "fraction"))

    total = ranked.agg(F.count("*").alias("total"))
    placed = ranked.join(F.broadcast(total)).withColumn("slice", F.floor(F.col("fraction") * F.ceil(F.col("total") / slice_rows)))
    offsets = _offsets(placed.groupBy("slice").agg(F.count("*").alias("n")), [], "slice")
    here = F.row_number().over(Window.partitionBy("slice").orderBy("fraction", "stratum", *order))
    position = F.col("offset") + F.col("here") - 1
    # shard s takes the positions from floor(s * total / shards) on
    shard = F.floor((F.lit(shards) * (position + 1) - 1) / F.col("total"))
    placed = placed.withColumn("here", here).join(offsets, "slice").select("*", position.alias("position")).withColumn("shard", shard)
    slot = F.col("position") - F.floor(F.col("shard") * F.col("total") / shards)
    return placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
