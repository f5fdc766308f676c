"""Queries of sampling, set operations, retention, anti joins, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.operators import sampling
from ruleloom.plans.registry import query
from ruleloom.plans.views import BASE, Views
from ruleloom.session import shared_folder
from ruleloom.sources import logs
from ruleloom.streaming import feedback

SEED = "7"


def _priority(*parts: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(SEED), *(F.col(p).cast("string") for p in parts)), 256)


def _sql_priority(*parts: str) -> str:
    return f"sha256('{SEED}|' || {" || '|' || ".join(parts)})"


_SIZES = BASE + f", s AS (SELECT impression, count(*) AS n, {_sql_priority('impression')} AS p FROM exposures GROUP BY 1)"


@query("smp_hash_priority", f"{_SIZES}, r AS (SELECT *, sum(n) OVER (ORDER BY p) AS upto FROM s) SELECT impression, n FROM r WHERE upto <= 20000")
def hash_priority(v: Views) -> DataFrame:
    """Whole impressions by smallest digest, up to the first that would overflow 20000 cases.

    The running total is over counts per digest slice first; only the slice where the budget ends is
    totalled row by row.
    """
    s = v.candidates().groupBy("impression").agg(F.count("*").alias("n")).withColumn("p", _priority("impression"))
    return sampling.prefix_within(s, "p", "n", 20_000).select("impression", "n")


@query("smp_eval_cap", f"SELECT o_orderkey AS impression FROM orders ORDER BY {_sql_priority('o_orderkey')} LIMIT 500")
def eval_cap(v: Views) -> DataFrame:
    return v.impressions().orderBy(_priority("impression")).limit(500).select("impression")


@query("smp_reservoir")
def reservoir(v: Views) -> DataFrame:
    """A fixed-size uniform sample; hash priority instead of arrival order, so that it can be repeated."""
    return v.table("events").orderBy(_priority("event_id")).limit(1000).select("event_id")


_NEG = BASE + f", r AS (SELECT impression, article, click, row_number() OVER (PARTITION BY impression, click ORDER BY {_sql_priority('impression', 'article')}) AS r, sum(click) OVER (PARTITION BY impression) AS pos FROM exposures)"


@query("smp_negatives_point", f"{_NEG} SELECT impression, article, click FROM r WHERE pos > 0 AND (click = 1 OR r <= 2 * pos)")
def negatives_point(v: Views) -> DataFrame:
    """All clicked candidates and at most twice as many others of a slate; slates without clicks go."""
    rank = F.row_number().over(Window.partitionBy("impression", "click").orderBy(_priority("impression", "article")))
    rows = v.candidates().withColumns({"r": rank, "pos": F.sum("click").over(Window.partitionBy("impression"))})
    return rows.where("pos > 0 and (click = 1 or r <= 2 * pos)").select("impression", "article", "click")


@query("smp_negatives_pair", f"{BASE}, r AS (SELECT p.impression, p.article AS clicked, n.article AS other, row_number() OVER (PARTITION BY p.impression, p.article ORDER BY {_sql_priority('p.impression', 'p.article', 'n.article')}) AS r FROM exposures p JOIN exposures n ON p.impression = n.impression AND p.click = 1 AND n.click = 0) SELECT impression, clicked, other FROM r WHERE r <= 2")
def negatives_pair(v: Views) -> DataFrame:
    c = v.candidates()
    n = c.where("click = 0").select("impression", F.col("article").alias("other"))
    p = c.where("click = 1").select("impression", F.col("article").alias("clicked")).join(n, "impression")
    r = F.row_number().over(Window.partitionBy("impression", "clicked").orderBy(_priority("impression", "clicked", "other")))
    return p.withColumn("r", r).where("r <= 2").drop("r")


@query("smp_candidates", f"{BASE} SELECT impression, article, position FROM exposures WHERE position < 5")
def smp_candidates(v: Views) -> DataFrame:
    return v.exposures().where("position < 5").select("impression", "article", "position")


_SEEN = "WITH seen AS (SELECT o_orderkey AS impression FROM orders WHERE o_orderstatus = 'F')"


@query("smp_holdout", f"{_SEEN} SELECT o_orderkey AS impression FROM orders WHERE o_orderkey NOT IN (SELECT impression FROM seen) ORDER BY {_sql_priority('o_orderkey')} LIMIT 300")
def holdout(v: Views) -> DataFrame:
    seen = v.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("impression"))
    return v.impressions().join(seen, "impression", "left_anti").orderBy(_priority("impression")).limit(300).select("impression")


@query("jn_anti_holdout", f"{_SEEN} SELECT count(*) AS fresh FROM orders WHERE o_orderkey NOT IN (SELECT impression FROM seen)")
def anti_holdout(v: Views) -> DataFrame:
    seen = v.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("impression"))
    return v.impressions().join(seen, "impression", "left_anti").agg(F.count("*").alias("fresh"))


@query("ord_shuffle", f"SELECT c_mktsegment AS segment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_sql_priority('c_mktsegment', 'c_custkey')}) AS place FROM customer")
def shuffle(v: Views) -> DataFrame:
    return v.table("customer").select(F.col("c_mktsegment").alias("segment"), "c_custkey", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(_priority("c_mktsegment", "c_custkey"))).alias("place"))


@query("lim_page", f"{BASE} SELECT impression, article, position // 3 AS page FROM exposures WHERE position BETWEEN 3 AND 5")
def page(v: Views) -> DataFrame:
    """The second page of three of each slate."""
    return v.exposures().where("position between 3 and 5").select("impression", "article", F.floor(F.col("position") / 3).alias("page"))


@query("jn_anti_seen", f"{BASE} SELECT e.impression, e.article FROM exposures e WHERE NOT EXISTS (SELECT 1 FROM items h WHERE h.impression = e.impression AND h.article = e.article AND h.lag < 200)")
def anti_seen(v: Views) -> DataFrame:
    """Candidates that are not in the slate's history."""
    return v.candidates().select("impression", "article").join(v.history_items().select("impression", "article").distinct(), ["impression", "article"], "left_anti")


@query("win_retention", f"{BASE}, u AS (SELECT usr, count(*) AS n, max(ts) AS last, max(impression) AS li FROM exposures GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY last DESC, li DESC) AS k, sum(n) OVER (ORDER BY last DESC, li DESC) AS upto FROM u) SELECT usr, n FROM r WHERE k <= 400 AND upto <= 12000 AND k < coalesce((SELECT min(k) FROM r WHERE upto > 12000), 1000000000)")
def retention(v: Views) -> DataFrame:
    """The newest complete units (users) within 400 units and 12000 cases; stops at the first overflow."""
    u = v.exposures().groupBy("usr").agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.max("impression").alias("li"))
    newest = u.orderBy(F.col("last").desc(), F.col("li").desc()).limit(400)
    return newest.withColumn("upto", F.sum("n").over(Window.orderBy(F.col("last").desc(), F.col("li").desc()))).where("upto <= 12000").select("usr", "n")


@query("st_retention", f"{BASE}, u AS (SELECT impression, count(*) AS n, max(ts) AS ts FROM exposures GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY ts DESC, impression DESC) AS upto FROM u) SELECT impression, n FROM r WHERE upto <= 5000")
def st_retention(v: Views) -> DataFrame:
    u = v.exposures().groupBy("impression").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    newest = u.orderBy(F.col("ts").desc(), F.col("impression").desc()).limit(5000)
    return newest.withColumn("upto", F.sum("n").over(Window.orderBy(F.col("ts").desc(), F.col("impression").desc()))).where("upto <= 5000").select("impression", "n")


# --- sets ---------------------------------------------------------------------------------------

_AB = "WITH a AS (SELECT l_partkey AS k, min(l_orderkey) AS o FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS k, min(l_orderkey) AS o FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)"


def _sides(v: Views) -> tuple[DataFrame, DataFrame]:
    x = v.table("lineitem")
    side = lambda c: x.where(c).groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_orderkey").alias("o"))
    return side("l_returnflag = 'R'"), side("l_linestatus = 'F'")


@query("set_union_dedupe", f"{_AB} SELECT k, min(o) AS o FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1")
def union_dedupe(v: Views) -> DataFrame:
    a, b = _sides(v)
    return a.unionByName(b).groupBy("k").agg(F.min("o").alias("o"))


@query("set_intersect", f"{_AB} SELECT k FROM a INTERSECT SELECT k FROM b")
def intersect(v: Views) -> DataFrame:
    a, b = _sides(v)
    return a.select("k").intersect(b.select("k"))


@query("set_except", f"{_AB} SELECT k, o FROM a EXCEPT SELECT k, o FROM b")
def except_(v: Views) -> DataFrame:
    a, b = _sides(v)
    return a.subtract(b)


_ARR = "SELECT o_custkey AS k, list_sort(list_distinct(list(o_orderpriority))) AS a, list_sort(list_distinct(list(o_orderstatus || o_orderpriority))) AS b FROM orders GROUP BY 1"


@query("set_union_arrays", f"SELECT k, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS joined, len(list_distinct(list_concat(a, b))) AS n FROM ({_ARR})")
def union_arrays(v: Views) -> DataFrame:
    g = v.table("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("a"), F.collect_set(F.concat("o_orderstatus", "o_orderpriority")).alias("b"))
    u = F.array_sort(F.array_union("a", "b"))
    return g.select("k", F.array_join(u, ",").alias("joined"), F.size(u).alias("n"))


@query("set_symmetric_check", f"{_AB} SELECT (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_a, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_b")
def symmetric_check(v: Views) -> DataFrame:
    a, b = (x.select("k") for x in _sides(v))
    one = lambda x, y, n: x.exceptAll(y).agg(F.count("*").alias(n))
    return one(a, b, "only_a").join(F.broadcast(one(b, a, "only_b")))


_COMPANION = "SELECT o_orderkey, sha256(o_orderkey || '|' || CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_custkey END) AS h FROM orders WHERE o_orderkey % 17 <> 0"


@query("jn_companion_rows", f"SELECT count(*) AS rows, count(*) FILTER (a.h <> b.h) AS mismatches, count(*) FILTER (b.h IS NULL) AS missing FROM (SELECT o_orderkey, sha256(o_orderkey || '|' || o_custkey) AS h FROM orders) a FULL OUTER JOIN ({_COMPANION}) b USING (o_orderkey)")
def companion_rows(v: Views) -> DataFrame:
    """A table against a companion that lacks some of its rows and disagrees in others."""
    digest = lambda c, n: F.sha2(F.concat_ws("|", "o_orderkey", c), 256).alias(n)
    a = v.table("orders").select("o_orderkey", digest("o_custkey", "a"))
    b = v.table("orders").where("o_orderkey % 17 <> 0").select("o_orderkey", digest(F.when(F.col("o_orderkey") % 13 == 0, 0).otherwise(F.col("o_custkey")), "b"))
    return a.join(b, "o_orderkey", "full").agg(F.count("*").alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("mismatches"), F.count_if(F.col("b").isNull()).alias("missing"))


# --- sources and sinks: written as the logs' formats, then read back --------------------------------


@query("src_time_parse", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def time_parse(v: Views) -> DataFrame:
    """Four layouts, dealt over the rows, all parsed back."""
    e, k = v.table("events"), F.col("event_id") % 4
    text = F.when(k == 0, F.date_format("ts", "MM/dd/yyyy hh:mm:ss a")).when(k == 1, F.date_format("ts", "MM/dd/yyyy HH:mm:ss")).when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", logs.parse_time(text).alias("ts"))


@query("src_news_merge", "SELECT p_partkey AS id, p_name AS title, p_type AS topic FROM part")
def news_merge(v: Views) -> DataFrame:
    """One catalog from two splits: the first filled value of each field; a conflict in a core field is an error."""
    p = v.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("topic"))
    train = p.where("id % 3 <> 0").withColumn("title", F.when(F.col("id") % 2 == 0, "").otherwise(F.col("title")))
    return logs.merge_catalog([train, p], core=["topic"]).select("id", "title", "topic")


@query("st_incremental_support", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def incremental_support(v: Views) -> DataFrame:
    """Additive supports by a streaming aggregation over the events, one micro-batch a file."""
    return feedback.streamed_counts(v)


@query("st_feedback_profile")
def feedback_profile(v: Views) -> DataFrame:
    """Profiles of users after the whole stream of events: history, skips, pending count."""
    return feedback.streamed_profiles(v)


@query("st_session_ttl", "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM s), e AS (SELECT user_id, min(ts) AS started, max(ts) AS latest, count(*) AS events FROM g GROUP BY user_id, s) SELECT user_id, started, events FROM e WHERE latest + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)")
def session_ttl(v: Views) -> DataFrame:
    """Sessions that a stream of the events has expired: idle for an hour before the watermark; open ones stay in its state."""
    return feedback.expired_sessions(v)


@query("st_pending_counter", "SELECT user_id, count(*) AS events, count(*) // 8 AS minings, count(*) % 8 AS pending FROM events GROUP BY 1")
def pending_counter(v: Views) -> DataFrame:
    """Events, minings that every eighth of them triggered, and events since the last one, from the stream's state."""
    p = feedback.streamed_profiles(v)
    return p.select("user_id", "events", ((F.col("events") - F.col("pending")) / feedback.INTERVAL).cast("bigint").alias("minings"), "pending")


_LOT = "event_type = 'click'"


@query("st_snapshot_promote", f"SELECT event_type, count(*) AS n, 2 AS version FROM events WHERE NOT ({_LOT}) GROUP BY 1")
def snapshot_promote(v: Views) -> DataFrame:
    """Supports served after four builds: the first is promoted, the second replaces it, a stale and a reconfigured one are discarded."""
    versions = feedback.RuleVersions(v.spark, f"{shared_folder(v.spark)}/versions-{uuid.uuid4().hex}")
    counts = lambda rows: rows.groupBy("event_type").agg(F.count("*").alias("n"))
    e = v.table("events")
    versions.promote(versions.capture(), counts(e))
    versions.promote(versions.capture(), counts(e.where(f"not ({_LOT})")))
    versions.promote(versions.capture(), counts(e.where(_LOT)), config_unchanged=False)
    versions.promote(versions.capture() - 1, counts(e.where(_LOT)))
    version, path = feedback.RuleVersions(v.spark, versions.root).current()
    return v.spark.read.parquet(path).withColumn("version", F.lit(version))


@query("st_single_flight", "SELECT event_type, count(*) AS n, 2 AS builds, 3 AS coalesced FROM events GROUP BY 1")
def single_flight(v: Views) -> DataFrame:
    """Triggers during a build start no other one, but one more build after it, which sees all events."""
    versions = feedback.RuleVersions(v.spark, f"{shared_folder(v.spark)}/versions-{uuid.uuid4().hex}")
    seen, e = [_LOT, "true"], v.table("events")
    builds, coalesced, again = 0, 0, True
    while again:
        version = versions.capture()
        if builds == 0:
            coalesced = sum(versions.capture() is None for _ in range(3))
        again = versions.promote(version, e.where(seen[builds]).groupBy("event_type").agg(F.count("*").alias("n"))) and versions.wanted()
        builds += 1
    return v.spark.read.parquet(versions.current()[1]).withColumns({"builds": F.lit(builds), "coalesced": F.lit(coalesced)})


@query("win_tumbling", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(v: Views) -> DataFrame:
    """An addition: event-time windows, which Structured Streaming offers for free."""
    return v.table("events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")
