"""Shared helpers of the document operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the word rules: a space and the characters from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound an Arrow batch by rows and bytes, so that very long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local master, where all tasks are threads of one process, gets a folder of its own if none is named.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them again.

    A step that reads its own table no more hands it to ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote; everything that is made of them must be written out."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_of_id(name: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def spread(name: str = "doc_id", seed: int = 17) -> Column:
    """A number from 0 to 1 that only depends on the id."""
    return F.pmod(F.xxhash64(F.col(name), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _thinned(df: DataFrame, stratum: str, share, seed: int) -> DataFrame:
    """Rows whose id's hash is below their stratum's share; strata are the few values of a label."""
    rate = F.lit(0.0)
    for value, part in share.items():
        rate = F.when(F.col(stratum) == F.lit(value), F.lit(min(1.0, float(part)))).otherwise(rate)
    return df.where(spread("doc_id", seed) < rate)


def class_sizes(labelled: DataFrame, stratum: str, most: int = 64) -> dict:
    """Rows of each of the ``most`` most frequent values of ``stratum`` (ties by value); nulls don't count."""
    found = labelled.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count("*").alias("n"))
    return {r[stratum]: r["n"] for r in found.orderBy(F.desc("n"), stratum).limit(most).collect()}


def training_sample(labelled: DataFrame, stratum: str, rows: int, seed: int = 17, sizes: dict | None = None) -> DataFrame:
    """A reproducible sample of labelled rows: about ``rows`` are expected of each value of ``stratum`` at most."""
    sizes = class_sizes(labelled, stratum) if sizes is None else sizes
    return _thinned(labelled, stratum, {k: rows / n for k, n in sizes.items()}, seed)


def with_texts(docs: DataFrame, labelled: DataFrame, stratum: str, rows: int, megabytes: int, sizes: dict | None = None) -> DataFrame:
    """doc_id, text and label of a bounded sample; its size in rows is bounded before it is broadcast.

    ``megabytes`` bounds the text of each label value: the rows found are thinned once more by it.
    """
    few = training_sample(labelled, stratum, rows, sizes=sizes)
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(few), "doc_id")
    return in_bytes(found, stratum, megabytes)


def in_bytes(found: DataFrame, stratum: str, megabytes: int, seed: int = 29) -> DataFrame:
    """Rows of each value of ``stratum`` in the order of their ids' hashes, as long as their texts fit; one row at least.

    ``found`` is a sample with a bounded number of rows; only their ids and sizes are sorted.
    """
    found = materialise(found.withColumn("_row", F.monotonically_increasing_id()))
    order = Window.partitionBy(stratum).orderBy("at", "doc_id", "_row")
    sizes = found.select(stratum, "doc_id", "_row", spread("doc_id", seed).alias("at"), F.octet_length("text").alias("b"))
    sizes = sizes.withColumns({"sum": F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(order)})
    fit = sizes.where((F.col("sum") <= megabytes * 1e6) | (F.col("place") == 1)).select("_row")
    return found.join(F.broadcast(fit), "_row", "left_semi").drop("_row")


def class_weights(found, sizes: dict) -> np.ndarray:
    """Weights of sampled rows, given by their label, that restore the shares of all labelled rows; their mean is 1."""
    seen = {k: max(1, int((found == k).sum())) for k in sizes}
    weight = np.array([sizes[k] / seen[k] for k in found], float)
    return weight / weight.mean() if len(weight) else weight


def row_digest() -> Column:
    """Tells rows with one id apart by their text."""
    return F.xxhash64(text_of())


def keep_named(docs: DataFrame, kept: DataFrame, digest=None) -> DataFrame:
    """Rows of ``docs`` named by ``kept`` (doc_id, digest), once each; all columns stay.

    ``digest`` makes the digest of a text column, row_digest's by default.  Of rows that share a name
    the longest text stays, then the first by text and the other columns that have an order.  Each task drops such
    rows before they are shuffled, so a name with very many rows is no more than a row of each task.
    Columns of ``docs`` may have any names.
    """
    key = lambda i, d: [F.coalesce(i, F.lit(0)).alias("_id"), i.isNull().alias("_none"), d.alias("_digest")]
    named = kept.select(*key(F.col("doc_id"), F.col("digest"))).distinct()
    own = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))
    doc_id, text = (f"_c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    sortable = [f.name for f in own.schema.fields if not re.search("map<|variant|void|interval", f.dataType.simpleString())]
    rows = own.select(*own.columns, *key(F.col(doc_id), (digest or F.xxhash64)(text_of(text))))
    order = Window.partitionBy("_id", "_none", "_digest").orderBy(F.length(text_of(text)).desc(), text, *sortable)
    rows = rows.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    return rows.join(named, ["_id", "_none", "_digest"], "left_semi").select(*own.columns).toDF(*docs.columns)
