"""Readers of raw impression logs and catalogs, and exclusive writers."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

# Columns and time layouts of the logs.
NEWS = ["id", "topic", "subcategory", "title", "abstract", "url", "title_entities", "abstract_entities"]
BEHAVIORS = ["impression", "usr", "time", "history", "candidates"]
TIME_LAYOUTS = ["M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "yyyy-M-d H:mm:ss", "yyyy-M-d'T'H:mm:ss"]

# Names of evaluation folders by preference; fields that derive from vectors, entities or annotations; models that don't.
EVAL_NAMES = ["valid", "validation", "dev"]
NEURAL_PARTS = ("embedding", "entity", "entities", "vector", "neural")
NEURAL_STARTS = ("text_semantic", "mi_semantic", "semantic_", "llm_")
NEURAL_NAMES = {"transformer_model", "encoder_model", "sentence_model", "recency_workspace"}
STATISTIC_MODELS = {"title_idf_model", "lexical_idf_model", "subcategory_transition_model"}


def _tsv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    schema = ", ".join(f"{n} string" for n in names)
    rows = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "FAILFAST").csv(path)
    return rows.withColumn(names[0], F.regexp_replace(names[0], "^﻿", ""))


def entity_ids(c: Column) -> Column:
    """Ids of a JSON list of entities; the first key that is filled counts."""
    items = F.from_json(c, "array<struct<WikidataId:string,EntityId:string,id:string,Label:string>>")
    return F.array_distinct(F.filter(F.transform(items, lambda e: F.coalesce(*(F.nullif(e[k], F.lit("")) for k in ("WikidataId", "EntityId", "id", "Label")))), lambda x: x.isNotNull()))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """The catalog; one id with different rows is an error."""
    rows = _tsv(spark, path, NEWS).distinct()
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("the catalog has an id with conflicting rows")
    return rows.withColumn("entities", F.array_union(F.coalesce(entity_ids(F.col("title_entities")), F.array().cast("array<string>")), F.coalesce(entity_ids(F.col("abstract_entities")), F.array().cast("array<string>"))))


def parse_time(c: Column) -> Column:
    """The first layout that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(x)) for x in TIME_LAYOUTS))


def parse_behaviors(rows: DataFrame) -> DataFrame:
    """Log lines to one row per candidate with its position, label, time and the history before it."""
    split = rows.select("impression", "usr", parse_time(F.col("time")).alias("ts"), F.filter(F.split(F.coalesce("history", F.lit("")), " "), lambda x: x != "").alias("history"), F.posexplode(F.filter(F.split(F.coalesce("candidates", F.lit("")), " "), lambda x: x != "")).alias("position", "token"))
    return split.select("impression", "usr", "ts", "history", "position", F.regexp_extract("token", r"^(.+)-([01])$", 1).alias("article"), F.regexp_extract("token", r"^(.+)-([01])$", 2).cast("int").alias("click"))


def read_behaviors(spark: SparkSession, path: str) -> DataFrame:
    return parse_behaviors(_tsv(spark, path, BEHAVIORS))


def read_candidate_rows(spark: SparkSession, path: str) -> DataFrame:
    """The archive form with one candidate a row and ^-separated histories."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col("imp_id").alias("impression"), F.col("user_id").alias("usr"), F.col("news_id").alias("article"), F.col("click").cast("int").alias("click"), "hour", F.filter(F.split(F.coalesce("news_his", F.lit("")), r"\^"), lambda x: x != "").alias("history"))


def merge_catalog(splits: list[DataFrame], core: list[str]) -> DataFrame:
    """One row per id: the first split's values, empty fields filled from later ones; core conflicts raise."""
    tagged = [s.withColumn("_split", F.lit(i)) for i, s in enumerate(splits)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    names = [c for c in splits[0].columns if c != "id"]
    filled = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct("_split", F.col(c).alias("v")))
    out = rows.groupBy("id").agg(*(F.min(filled(c))["v"].alias(c) for c in names), *(F.count_distinct(F.nullif(c, F.lit(""))).alias(f"_n_{c}") for c in core))
    bad = out.where(" or ".join(f"_n_{c} > 1" for c in core)).limit(1).count()
    if bad:
        raise ValueError("splits disagree in a core field")
    return out.drop(*(f"_n_{c}" for c in core))


def files(spark: SparkSession, path: str):
    """The Hadoop file system and path of ``path``, so that remote folders work as local ones do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def split_kind(name: str) -> str | None:
    """train or eval, by the tokens of a folder's name."""
    tokens = set(re.split("[^a-z0-9]+", name.casefold()))
    return "train" if "train" in tokens else "eval" if tokens & set(EVAL_NAMES) else None


def choose_splits(folders: list[str]) -> dict[str, str]:
    """One folder for each kind: a conventional name first, then the shallowest path, then the first by name."""
    name = lambda f: f.rstrip("/").rsplit("/", 1)[-1]
    rank = {"train": 0} | {n: i for i, n in enumerate(EVAL_NAMES)}
    order = lambda f: (rank.get(name(f).casefold(), len(EVAL_NAMES)), f.count("/"), f)
    return {kind: min(found, key=order) for kind in ("train", "eval") if (found := [f for f in folders if split_kind(name(f)) == kind])}


def find_splits(spark: SparkSession, root: str) -> dict[str, str]:
    """The train and eval folders below ``root`` that hold both logs; a kind without a folder is an error."""
    fs, top = files(spark, root)
    folders, queue = [], [top]
    while queue:
        at = queue.pop()
        names = {status.getPath().getName(): status for status in fs.listStatus(at)}
        if {"news.tsv", "behaviors.tsv"} <= names.keys():
            folders.append(at.toString())
        queue += [x.getPath() for n, x in names.items() if x.isDirectory() and not n.endswith(".tsv")]
    found = choose_splits(folders)
    if len(found) < 2:
        raise FileNotFoundError(f"no folder with both logs for {sorted({'train', 'eval'} - found.keys())}")
    return found


def unpack(spark: SparkSession, archive: str, folder: str) -> list[str]:
    """Copy the members of a zip archive to files below ``folder``, buffer by buffer; names may not lead out of it."""
    jvm, (fs, source) = spark.sparkContext._jvm, files(spark, archive)
    target, _ = files(spark, folder)
    packed, out = jvm.java.util.zip.ZipInputStream(fs.open(source)), []
    try:
        while (entry := packed.getNextEntry()) is not None:
            name = entry.getName()
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError("the archive has a member outside its folder")
            if not entry.isDirectory():
                sink = target.create(jvm.org.apache.hadoop.fs.Path(folder, name), False)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(packed, sink, 65536)
                finally:
                    sink.close()
                out.append(name)
    finally:
        packed.close()
    return out


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A prepared JSON dataset, compressed or not."""
    return spark.read.option("multiLine", True).json(path)


def neural_field(name: str) -> bool:
    low = name.casefold()
    return any(x in low for x in NEURAL_PARTS) or low.startswith(NEURAL_STARTS) or low in NEURAL_NAMES


def _without(c: Column, kind: DataType) -> Column | None:
    """``c`` without neural fields at any depth; None if nothing is left of a struct."""
    if isinstance(kind, StructType):
        kept = [(f, _without(c[f.name], f.dataType) if f.name not in STATISTIC_MODELS else c[f.name]) for f in kind.fields if not neural_field(f.name)]
        kept = [x.alias(f.name) for f, x in kept if x is not None]
        return F.when(c.isNotNull(), F.struct(*kept)) if kept else None
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType, MapType)):
        return F.transform(c, lambda x: _without(x, kind.elementType)) if _without(F.lit(None), kind.elementType) is not None else None
    if isinstance(kind, MapType) and isinstance(kind.valueType, (StructType, ArrayType, MapType)):
        return F.transform_values(c, lambda _, x: _without(x, kind.valueType)) if _without(F.lit(None), kind.valueType) is not None else None
    return c


def strip_neural(df: DataFrame) -> DataFrame:
    """Drop fields derived from vectors, entities or annotations at any depth; statistic models stay as they are.

    Keys of maps are data (users, topics), not fields, and stay.
    """
    kept = [(f.name, F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if not neural_field(f.name)]
    done = [(n, c if n in STATISTIC_MODELS else _without(c, t)) for n, c, t in kept]
    return df.select(*(c.alias(n) for n, c in done if c is not None))


def write_exclusive(df: DataFrame, path: str) -> None:
    """Publish a table once; an existing one is never replaced."""
    df.write.mode("errorifexists").parquet(path)


def digest_rows(df: DataFrame) -> tuple[str, int]:
    """Digest and count of a table's rows, whatever their order: sums of the parts of each row's digest, taken where the rows are."""
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(38,0)")).cast("string") for at in range(1, 65, 8)]
    found = df.agg(F.count("*").alias("rows"), F.concat_ws(":", *(F.coalesce(p, F.lit("0")) for p in parts)).alias("sums")).first()
    return hashlib.sha256(f"{found.rows}:{found.sums}".encode()).hexdigest(), found.rows


def save_model(rules: DataFrame, path: str) -> str:
    """Write a serving rule set with a manifest that holds its digest; refuses to overwrite."""
    write_exclusive(rules, f"{path}/rules")
    digest, n = digest_rows(rules.sparkSession.read.parquet(f"{path}/rules"))
    write_exclusive(rules.sparkSession.createDataFrame([(digest, n)], "digest string, rules bigint"), f"{path}/manifest")
    return digest


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """Read a serving rule set; a digest or count that doesn't fit, or a repeated rule, is an error."""
    import hmac

    rules, manifest = spark.read.parquet(f"{path}/rules"), spark.read.parquet(f"{path}/manifest").first()
    digest, n = digest_rows(rules)
    if not hmac.compare_digest(digest, manifest.digest) or n != manifest.rules:
        raise ValueError("the model's digest doesn't fit its manifest")
    if rules.groupBy("premises").count().where("count > 1").limit(1).count():
        raise ValueError("the model has a repeated rule")
    return rules
