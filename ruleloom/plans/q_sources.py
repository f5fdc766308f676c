"""Queries of sources and sinks: each writes the files of a log to the shared folder and reads them with the engine's readers."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.operators import ranking, vectors
from ruleloom.plans.q_pipelines import FIXTURE_ARTICLES, FIXTURE_USERS
from ruleloom.plans.q_ranking import POINTS
from ruleloom.plans.registry import query
from ruleloom.plans.views import BASE, R6, Views, r6
from ruleloom.session import shared_folder
from ruleloom.sources import logs

FIRST_DAY = "1997-01-01"


def _folder(v: Views) -> str:
    return f"{shared_folder(v.spark)}/source-{uuid.uuid4().hex}"


def _catalog_lines(v: Views) -> DataFrame:
    """Catalog lines with entity lists in JSON; every tenth is there twice and every hundredth begins with a byte order mark."""
    entity = lambda e: F.concat(F.lit('{"Label": "x", "WikidataId": "Q'), e.cast("string"), F.lit('"}'))
    k = F.col("p_partkey")
    title, abstract = F.concat(F.lit("["), entity(k), F.lit(", "), entity((k * 7 + 3) % 1000), F.lit("]")), F.concat(F.lit("["), entity(k * 13 % 1000), F.lit("]"))
    mark = F.when(k % 100 == 0, "\ufeff").otherwise("")
    line = F.concat_ws("\t", F.concat(mark, k.cast("string")), "p_type", "p_brand", "p_name", F.concat(F.lit('say "'), "p_name", F.lit('"')), F.lit("url"), title, abstract)
    times = F.explode(F.sequence(F.lit(1), F.when(k % 10 == 0, 2).otherwise(1)))
    return v.table("part").select(line.alias("line"), times.alias("time")).select("line")


def _catalog(v: Views) -> DataFrame:
    path = f"{_folder(v)}/news.tsv"
    _catalog_lines(v).write.text(path)
    return logs.read_news(v.spark, path)


_ENTITIES = "SELECT DISTINCT p_partkey AS article, unnest([p_partkey, (p_partkey * 7 + 3) % 1000, p_partkey * 13 % 1000]) AS e FROM part"


@query("src_news_tsv", f"WITH ent AS ({_ENTITIES}), k AS (SELECT article, string_agg('Q' || e, ',' ORDER BY 'Q' || e) AS entities FROM ent GROUP BY 1) SELECT p_partkey::VARCHAR AS id, p_type AS topic, p_brand AS subcategory, p_name AS title, 'say \"' || p_name || '\"' AS abstract, entities FROM part JOIN k ON article = p_partkey")
def news_tsv(v: Views) -> DataFrame:
    """The catalog from tab-separated files without quoting: repeated lines are one article, marks go, entities are parsed."""
    return _catalog(v).select("id", "topic", "subcategory", "title", "abstract", F.array_join(F.array_sort("entities"), ",").alias("entities"))


_MEAN = f"""WITH ent AS ({_ENTITIES}), v AS (SELECT article, e, pos, embedding[pos]::DOUBLE AS x FROM ent JOIN embeddings ON vec_id = e, (SELECT unnest(range(1, 65)) AS pos)),
m AS (SELECT article, pos, count(*) AS n, avg(x) AS x FROM v GROUP BY 1, 2), s AS (SELECT article, sqrt(sum(x * x)) AS norm FROM m GROUP BY 1)"""


@query("src_entity_hdf5", f"{_MEAN} SELECT article::VARCHAR AS article, pos - 1 AS pos, n, {R6('x / norm')} AS x FROM m JOIN s USING (article) WHERE norm > 0")
def entity_vectors(v: Views) -> DataFrame:
    """Article vectors: the normalised mean of the raw vectors of the catalog's entities; an article without a known entity has none."""
    known = v.table("embeddings").select(F.concat(F.lit("Q"), F.col("vec_id").cast("string")).alias("entity"), F.col("embedding").alias("vector"))
    rows = vectors.entity_means(_catalog(v).select(F.col("id").alias("article"), "entities"), known)
    return rows.select("article", "pos", "n", r6(F.col("x")).alias("x"))


def _behavior_lines(v: Views) -> DataFrame:
    """Impressions as log lines `id-label`, with the clicks before them."""
    found = F.transform(F.array_sort(F.collect_list(F.struct("position", F.concat_ws("-", "article", "click").alias("t")))), lambda i: i["t"])
    lines = v.exposures().groupBy("impression", "usr", "ts").agg(F.array_join(found, " ").alias("candidates"))
    past = v.histories().select("impression", F.array_join(F.col("history").cast("array<string>"), " ").alias("history"))
    rows = lines.join(past, "impression")
    return rows.select("ts", F.concat_ws("\t", "impression", "usr", F.date_format("ts", "MM/dd/yyyy hh:mm:ss a"), "history", "candidates").alias("line"))


@query("src_behaviors_tsv", f"{BASE}, hs AS (SELECT impression, count(*) AS known FROM hist GROUP BY 1) SELECT impression, usr, ts::DATE::VARCHAR AS day, article, click, position, coalesce(known, 0) AS known FROM exposures LEFT JOIN hs USING (impression)")
def behaviors_tsv(v: Views) -> DataFrame:
    """Candidates from tab-separated impression logs, with their position, label and the size of the history."""
    path = f"{_folder(v)}/behaviors.tsv"
    _behavior_lines(v).select("line").write.text(path)
    out = logs.read_behaviors(v.spark, path)
    return out.select(F.col("impression").cast("bigint"), F.col("usr").cast("bigint"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("article").cast("bigint"), "click", "position", F.size("history").alias("known"))


_DAYS = f"SELECT CASE WHEN o_orderdate < '{FIRST_DAY}' THEN 'train' ELSE 'eval' END AS kind, count(DISTINCT o_orderkey) AS impressions, count(*) AS candidates FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"


@query("src_split_discovery", f"SELECT k.*, CASE kind WHEN 'train' THEN 'data/small-train' ELSE 'data/deep/valid' END AS folder FROM ({_DAYS}) k")
def split_discovery(v: Views) -> DataFrame:
    """Train and eval logs found below a root that also holds a worse name, an incomplete folder and other files."""
    root = _folder(v)
    rows, one = _behavior_lines(v), v.spark.range(1).select(F.lit("x").alias("line"))
    for folder, day in (("data/small-train", f"ts < '{FIRST_DAY}'"), ("data/deep/valid", f"ts >= '{FIRST_DAY}'")):
        rows.where(day).select("line").write.text(f"{root}/{folder}/behaviors.tsv")
        one.write.text(f"{root}/{folder}/news.tsv")
    for other in ("data/later/other/train-2", "data/dev"):
        one.write.text(f"{root}/{other}/behaviors.tsv")
        one.write.text(f"{root}/{other}/news.tsv")
    one.write.text(f"{root}/train/behaviors.tsv")  # without a catalog
    parts = []
    for kind, folder in logs.find_splits(v.spark, root).items():
        n = logs.read_behaviors(v.spark, f"{folder}/behaviors.tsv").agg(F.count_distinct("impression").alias("impressions"), F.count("*").alias("candidates"))
        parts.append(n.select(F.lit(kind).alias("kind"), "impressions", "candidates", F.lit(folder[folder.index("data/"):]).alias("folder")))
    return parts[0].unionByName(parts[1])


def _pack(v: Views, folder: str, header: str, archive: str) -> None:
    """One zip archive of the text parts in ``folder``, copied buffer by buffer on the file system."""
    jvm = v.spark.sparkContext._jvm
    fs, at = logs.files(v.spark, archive)
    packed = jvm.java.util.zip.ZipOutputStream(fs.create(at, False))
    packed.putNextEntry(jvm.java.util.zip.ZipEntry("log/train.csv"))
    packed.write(f"{header}\n".encode())
    for part in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")):
        source = fs.open(part.getPath())
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, packed, 65536)
        source.close()
    packed.close()


@query("src_reczoo_zip", f"{BASE}, hs AS (SELECT impression, count(*) AS known, max(article) FILTER (lag = 0) AS latest FROM hist GROUP BY 1) SELECT impression, usr, article, click, hour(ts) AS hour, coalesce(known, 0) AS known, latest FROM exposures LEFT JOIN hs USING (impression)")
def candidate_archive(v: Views) -> DataFrame:
    """A zip archive with one candidate a row and ^-separated histories: packed, unpacked to a staging folder, and read."""
    root = _folder(v)
    past = v.histories().select("impression", F.array_join(F.col("history").cast("array<string>"), "^").alias("news_his"))
    rows = v.exposures().join(past, "impression").select("impression", "click", F.date_format("ts", "ha").alias("hour"), "usr", "article", "news_his")
    rows.write.csv(f"{root}/parts", emptyValue="")
    _pack(v, f"{root}/parts", "imp_id,click,hour,user_id,news_id,news_his", f"{root}/log.zip")
    member, = logs.unpack(v.spark, f"{root}/log.zip", f"{root}/staged")
    out = logs.read_candidate_rows(v.spark, f"{root}/staged/{member}")
    clock = F.hour(F.to_timestamp("hour", "ha"))
    return out.select(F.col("impression").cast("bigint"), F.col("usr").cast("bigint"), F.col("article").cast("bigint"), "click", clock.alias("hour"), F.size("history").alias("known"), F.try_element_at("history", F.lit(-1)).cast("bigint").alias("latest"))


@query("src_snapshot_json", f"SELECT * FROM (VALUES {', '.join(map(repr, FIXTURE_ARTICLES))}) AS a(id, title, topic, format), (VALUES {', '.join(repr((u, len(t))) for u, t in FIXTURE_USERS.items())}) AS u(usr, topics)")
def snapshot(v: Views) -> DataFrame:
    """The bundled fixture as one compressed JSON document, read back and unfolded."""
    path = _folder(v)
    a = v.spark.createDataFrame(FIXTURE_ARTICLES, "id string, title string, topic string, format string")
    u = v.spark.createDataFrame(list(FIXTURE_USERS.items()), "usr string, topics array<string>")
    whole = a.agg(F.collect_list(F.struct(*a.columns)).alias("articles")).join(F.broadcast(u.agg(F.collect_list(F.struct(*u.columns)).alias("users"))))
    whole.select(F.to_json(F.struct("articles", "users"))).coalesce(1).write.option("compression", "gzip").text(path)
    d = logs.read_snapshot(v.spark, path)
    return d.select(F.explode("articles").alias("a"), "users").select("a.*", F.explode("users").alias("u")).select("id", "title", "topic", "format", "u.usr", F.size("u.topics").alias("topics"))


@query("prj_strip_neural", "SELECT p_partkey, 'facts,p_partkey,title_idf_model,users' AS columns, '{\"topic\":\"' || p_type || '\",\"parts\":[{\"size\":' || p_size || '}]}' AS facts, '{\"neural_fans\":{\"n\":' || p_size || '}}' AS users, '{\"entity\":' || p_size || '}' AS model FROM part")
def strip_neural(v: Views) -> DataFrame:
    """Neural fields go at any depth; keys of maps are data, and statistic models stay whole."""
    size, topic = F.col("p_size").alias("size"), F.col("p_type").alias("topic")
    part = F.struct(size, F.lit(1.0).alias("title_embedding"), F.lit("Q1").alias("entity_id"))
    user = F.struct(F.col("p_size").alias("n"), F.lit(0.5).alias("llm_match"))
    rows = v.table("part").select(
        "p_partkey", F.lit(1).alias("semantic_top1"), F.array(F.lit(0.1)).alias("title_vector"), F.struct(F.lit(1).alias("entities")).alias("cache"),
        F.struct(topic, F.array(part).alias("parts"), F.lit("x").alias("encoder_model")).alias("facts"),
        F.create_map(F.lit("neural_fans"), user).alias("users"), F.struct(F.col("p_size").alias("entity")).alias("title_idf_model"))
    out = logs.strip_neural(rows)
    return out.select("p_partkey", F.lit(",".join(sorted(out.columns))).alias("columns"), F.to_json("facts").alias("facts"), F.to_json("users").alias("users"), F.to_json("title_idf_model").alias("model"))


def _refused(action, kind) -> bool:
    try:
        action()
    except kind:
        return True
    return False


@query("snk_exclusive", "SELECT n_nationkey, n_name, true AS refused FROM nation")
def exclusive(v: Views) -> DataFrame:
    """A table published once: a second write is refused and changes nothing."""
    path, rows = _folder(v), v.table("nation").select("n_nationkey", "n_name")
    logs.write_exclusive(rows, path)
    refused = _refused(lambda: logs.write_exclusive(rows.limit(1), path), AnalysisException)
    return v.spark.read.parquet(path).withColumn("refused", F.lit(refused))


_SERVED = f"{POINTS} SELECT premises, size, {R6('strength')} AS strength, {R6('confidence')} AS confidence"


@query("snk_serving_model", f"{_SERVED}, true AS refused FROM sel")
def serving_model(v: Views) -> DataFrame:
    """The serving rule set as a model with a digest; another model doesn't replace it."""
    path, rules = _folder(v), ranking.serving_rules(v)
    logs.save_model(rules, path)
    refused = _refused(lambda: logs.save_model(v.spark.range(1), path), AnalysisException)
    out = v.spark.read.parquet(f"{path}/rules")
    return out.select("premises", "size", r6(F.col("strength")).alias("strength"), r6(F.col("confidence")).alias("confidence"), F.lit(refused).alias("refused"))


@query("src_serving_model", f"{_SERVED}, true AS tampered_refused, true AS shortened_refused FROM sel")
def loaded_model(v: Views) -> DataFrame:
    """A model read with its digest checked; one with a changed rule and one without a rule are refused."""
    path, rules = _folder(v), ranking.serving_rules(v)
    logs.save_model(rules, path)
    out = logs.load_model(v.spark, path)
    spoilt = {}
    least = out.agg(F.min("premises").alias("least"))
    for name, rows in (("tampered", out.withColumn("strength", F.col("strength") + 1e-9)), ("shortened", out.join(F.broadcast(least)).where("premises <> least").drop("least"))):
        rows.write.parquet(f"{path}-{name}/rules")
        v.spark.read.parquet(f"{path}/manifest").write.parquet(f"{path}-{name}/manifest")
        spoilt[name] = _refused(lambda name=name: logs.load_model(v.spark, f"{path}-{name}"), ValueError)
    return out.select("premises", "size", r6(F.col("strength")).alias("strength"), r6(F.col("confidence")).alias("confidence"), *(F.lit(x).alias(f"{n}_refused") for n, x in spoilt.items()))
