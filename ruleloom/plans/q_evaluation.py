"""Queries of slate metrics, reliability, slices and paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import buckets
from ruleloom.operators import evaluation, ranking, running
from ruleloom.operators.ranking import grid
from ruleloom.plans.q_ranking import PAIRS, POINTS
from ruleloom.plans.registry import query
from ruleloom.plans.views import BASE, FEATURES, R6, Views, r6

_G = POINTS + ", g AS (SELECT impression, article, y, floor(score * 1e6 + 0.5) AS g, score FROM pt)"
EVAL = _G + """,
rk AS (SELECT impression, article, y, g, score, row_number() OVER (PARTITION BY impression ORDER BY g DESC, article) AS place FROM g),
au AS (SELECT a.impression, avg(CASE WHEN a.g > b.g THEN 1.0E0 WHEN a.g = b.g THEN 0.5E0 ELSE 0 END) AS auc FROM g a JOIN g b ON a.impression = b.impression AND a.y = 1 AND b.y = 0 GROUP BY 1),
sl AS (SELECT impression, count(*) AS n, sum(y) AS k, coalesce(avg(1.0E0 / place) FILTER (y = 1), 0) AS mrr, min(place) FILTER (y = 1) AS best,
  coalesce(sum(1 / log2(place + 1)) FILTER (y = 1 AND place <= 5), 0) AS dcg5, coalesce(sum(1 / log2(place + 1)) FILTER (y = 1 AND place <= 10), 0) AS dcg10 FROM rk GROUP BY 1),
ideal AS (SELECT k, j, sum(1 / log2(i + 1)) AS idcg FROM (SELECT DISTINCT k FROM sl WHERE k > 0), (SELECT unnest([5, 10]) AS j), (SELECT unnest(range(1, 11)) AS i) WHERE i <= least(k, j) GROUP BY 1, 2)"""


@query("ev_auc", f"{EVAL} SELECT count(*) AS slates, {R6('avg(auc)')} AS auc FROM au")
def auc(v: Views) -> DataFrame:
    """Macro mean over the slates with both classes; by average ranks, where the SQL compares pairs."""
    s = evaluation.slate_auc(evaluation.scored(v))
    return s.agg(F.count("*").alias("slates"), r6(F.avg("auc")).alias("auc"))


_POP = BASE + """, pop AS (SELECT article, sum(click) AS g FROM exposures GROUP BY 1), g AS (SELECT e.impression, e.article, e.click AS y, pop.g FROM exposures e JOIN pop USING (article)),
au AS (SELECT a.impression, avg(CASE WHEN a.g > b.g THEN 1.0E0 WHEN a.g = b.g THEN 0.5E0 ELSE 0 END) AS auc FROM g a JOIN g b ON a.impression = b.impression AND a.y = 1 AND b.y = 0 GROUP BY 1)"""


@query("ev_auc_popularity", f"{_POP} SELECT count(*) AS slates, {R6('avg(auc)')} AS auc FROM au")
def auc_popularity(v: Views) -> DataFrame:
    c = v.candidates()
    g = c.join(c.groupBy("article").agg(F.sum("click").alias("g")), "article").select("impression", F.col("click").alias("y"), "g")
    return evaluation.slate_auc(g).agg(F.count("*").alias("slates"), r6(F.avg("auc")).alias("auc"))


@query("ev_auc_pairwise", f"{PAIRS}, g AS (SELECT b.impression, b.article, e.click AS y, floor(b.score * 1e6 + 0.5) AS g FROM bal b JOIN exposures e ON e.impression = b.impression AND e.article = b.article), au AS (SELECT a.impression, avg(CASE WHEN a.g > b.g THEN 1.0E0 WHEN a.g = b.g THEN 0.5E0 ELSE 0 END) AS auc FROM g a JOIN g b ON a.impression = b.impression AND a.y = 1 AND b.y = 0 GROUP BY 1) SELECT count(*) AS slates, {R6('avg(auc)')} AS auc FROM au")
def auc_pairwise(v: Views) -> DataFrame:
    g = ranking.balanced(v).join(v.candidates(), ["impression", "article"]).select("impression", F.col("click").alias("y"), grid(F.col("score")).alias("g"))
    return evaluation.slate_auc(g).agg(F.count("*").alias("slates"), r6(F.avg("auc")).alias("auc"))


def _per_slate(v: Views) -> DataFrame:
    return evaluation.slate_metrics(evaluation.scored(v))


@query("ev_mrr", f"{EVAL} SELECT count(*) AS slates, {R6('avg(mrr)')} AS mrr FROM sl")
def mrr(v: Views) -> DataFrame:
    return _per_slate(v).agg(F.count("*").alias("slates"), r6(F.avg("mrr")).alias("mrr"))


@query("ev_ndcg", f"{EVAL} SELECT {R6('sum(dcg5 / a.idcg) / (SELECT count(*) FROM sl)')} AS ndcg5, {R6('sum(dcg10 / b.idcg) / (SELECT count(*) FROM sl)')} AS ndcg10 FROM sl JOIN ideal a ON a.k = sl.k AND a.j = 5 JOIN ideal b ON b.k = sl.k AND b.j = 10")
def ndcg(v: Views) -> DataFrame:
    return _per_slate(v).agg(r6(F.avg("ndcg5")).alias("ndcg5"), r6(F.avg("ndcg10")).alias("ndcg10"))


@query("ev_hit", f"{EVAL} SELECT {R6('avg(CASE WHEN best <= 1 THEN 1.0E0 ELSE 0 END)')} AS hit1, {R6('avg(CASE WHEN best <= 3 THEN 1.0E0 ELSE 0 END)')} AS hit3 FROM sl")
def hit(v: Views) -> DataFrame:
    at = lambda k: r6(F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)))
    return _per_slate(v).agg(at(1).alias("hit1"), at(3).alias("hit3"))


_REL = EVAL + ", w AS (SELECT *, 1.0E0 / count(*) OVER (PARTITION BY impression) AS w, greatest(1e-9, least(1 - 1e-9, score)) AS p FROM g)"


@query("ev_reliability", f"{_REL}, b AS (SELECT least(9, floor(score * 10))::INT AS bin, sum(w) AS mass, sum(w * score) / sum(w) AS pred, sum(w * y) / sum(w) AS obs FROM w GROUP BY 1) SELECT {R6('(SELECT sum(w * (score - y) * (score - y)) / sum(w) FROM w)')} AS brier, {R6('(SELECT sum(w * -(y * ln(p) + (1 - y) * ln(1 - p))) / sum(w) FROM w)')} AS log_loss, {R6('sum(mass * abs(pred - obs)) / sum(mass)')} AS ece, count(*) AS bins FROM b")
def reliability(v: Views) -> DataFrame:
    """Brier, log loss and calibration error in ten bins; every impression has mass 1."""
    return evaluation.reliability(evaluation.scored(v))


@query("ev_balanced_margin", f"{PAIRS}, l AS (SELECT p.impression, p.l_article, p.r_article, sum(p.margin) / 2 AS m FROM pm p GROUP BY 1, 2, 3) SELECT count(*) AS pairs, {R6('avg(1 / (1 + exp(-m)))')} AS mean_probability FROM l")
def balanced_margin(v: Views) -> DataFrame:
    m = ranking.pair_margins(v).groupBy("impression", "l_article", "r_article").agg((F.sum("margin") / len(ranking.FAMILIES)).alias("m"))
    return m.agg(F.count("*").alias("pairs"), r6(F.avg(0.5 + 0.5 * F.tanh(F.col("m") / 2))).alias("mean_probability"))


_SL = EVAL + """, z AS (SELECT a.impression, a.auc, """ + buckets.sql("history_size", "coalesce(h.known, 0)") + """ AS history, year(o.o_orderdate) AS year FROM au a JOIN orders o ON o.o_orderkey = a.impression LEFT JOIN hsize h ON h.impression = a.impression)"""


@query("ev_slices", f"{_SL} SELECT history, year, count(*) AS slates, {R6('avg(auc)')} AS auc FROM z GROUP BY GROUPING SETS ((history), (year), ())")
def slices(v: Views) -> DataFrame:
    s = evaluation.slate_auc(evaluation.scored(v)).join(v.histories().select("impression", F.size("history").alias("known"), F.year("ts").alias("year")), "impression")
    rows = s.withColumn("history", buckets.column("history_size", "known"))
    return rows.groupingSets([["history"], ["year"], []], "history", "year").agg(F.count("*").alias("slates"), r6(F.avg("auc")).alias("auc"))


_TWO = EVAL + ", pop AS (SELECT article, sum(y) AS p FROM cases GROUP BY 1), g2 AS (SELECT c.impression, c.article, c.y, pop.p AS g FROM cases c JOIN pop USING (article)), au2 AS (SELECT a.impression, avg(CASE WHEN a.g > b.g THEN 1.0E0 WHEN a.g = b.g THEN 0.5E0 ELSE 0 END) AS auc FROM g2 a JOIN g2 b ON a.impression = b.impression AND a.y = 1 AND b.y = 0 GROUP BY 1)"


def _both(v: Views) -> DataFrame:
    a = evaluation.slate_auc(evaluation.scored(v)).select("impression", F.col("auc").alias("a"))
    c = v.candidates()
    g = c.join(c.groupBy("article").agg(F.sum("click").alias("g")), "article").select("impression", F.col("click").alias("y"), "g")
    return a.join(evaluation.slate_auc(g).select("impression", F.col("auc").alias("b")), "impression")


@query("ev_compare", f"{_TWO} SELECT count(*) AS slates, {R6('avg(a.auc - b.auc)')} AS delta, count(*) FILTER (a.auc > b.auc + 1e-9) AS wins FROM au a JOIN au2 b USING (impression)")
def compare(v: Views) -> DataFrame:
    """Paired differences on one cohort: rules against popularity."""
    d = _both(v)
    return d.agg(F.count("*").alias("slates"), r6(F.avg(F.col("a") - F.col("b"))).alias("delta"), F.count_if(F.col("a") > F.col("b") + 1e-9).alias("wins"))


@query("jn_paired_runs", f"{_TWO} SELECT (SELECT count(*) FROM au) AS first, (SELECT count(*) FROM au2) AS second, (SELECT count(*) FROM au JOIN au2 USING (impression)) AS both")
def paired_runs(v: Views) -> DataFrame:
    a = evaluation.slate_auc(evaluation.scored(v)).select("impression", F.lit(1).alias("a"))
    c = v.candidates()
    b = c.groupBy("impression").agg(F.sum("click").alias("k"), F.count("*").alias("n")).where("k > 0 and k < n").select("impression", F.lit(1).alias("b"))
    return a.join(b, "impression", "full").agg(F.count("a").alias("first"), F.count("b").alias("second"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def _bootstrap(v: Views, unit: Column | None) -> DataFrame:
    d = _both(v).withColumn("d", F.col("a") - F.col("b"))
    found = evaluation.bootstrap(d, F.col("impression")) if unit is None else evaluation.bootstrap(d.join(v.impressions(), "impression"), unit)
    return found.select(*(r6(F.col(c)).alias(c) for c in ("mean", "low", "high")))


_DIFF = f"{_TWO}, df AS (SELECT a.impression, o_custkey AS usr, a.auc - b.auc AS d FROM au a JOIN au2 b USING (impression) JOIN orders ON o_orderkey = impression), us AS (SELECT impression AS unit, sum(d) AS s, count(*) AS n FROM df GROUP BY 1), uu AS (SELECT usr AS unit, sum(d) AS s, count(*) AS n FROM df GROUP BY 1), bs AS ({evaluation.DRAWS('us')}), bu AS ({evaluation.DRAWS('uu')})"


@query("ev_bootstrap", f"{_DIFF} SELECT {R6('mean')} AS mean, {R6('low')} AS low, {R6('high')} AS high FROM bs")
def bootstrap(v: Views) -> DataFrame:
    """Percentile interval of the mean paired difference, resampling slates."""
    return _bootstrap(v, None)


@query("ev_cluster_bootstrap", f"{_DIFF} SELECT {R6('mean')} AS mean, {R6('low')} AS low, {R6('high')} AS high FROM bu")
def cluster_bootstrap(v: Views) -> DataFrame:
    """The same with whole users as units; the estimand stays the macro mean over slates."""
    return _bootstrap(v, F.col("usr"))


@query("ev_gate", f"{_DIFF}, z AS (SELECT count(*) AS slates, count(DISTINCT usr) AS users FROM df) SELECT slates, users, {R6('bs.low')} AS low_slates, {R6('bu.low')} AS low_users, bs.low > 0 AND bu.low > 0 AND slates >= 100 AND users >= 30 AS passed FROM z, bs, bu")
def gate(v: Views) -> DataFrame:
    """Pass iff both lower bounds clear 0 and the cohort has 100 slates and 30 users or more."""
    d = _both(v).withColumn("d", F.col("a") - F.col("b")).join(v.impressions(), "impression")
    size = d.agg(F.count("*").alias("slates"), F.count_distinct("usr").alias("users"))
    low = lambda u, n: evaluation.bootstrap(d, F.col(u)).select(F.col("low").alias(n))
    rows = size.join(F.broadcast(low("impression", "low_slates"))).join(F.broadcast(low("usr", "low_users")))
    rows = rows.withColumn("passed", (F.col("low_slates") > 0) & (F.col("low_users") > 0) & (F.col("slates") >= 100) & (F.col("users") >= 30))
    return rows.withColumns({c: r6(F.col(c)) for c in ("low_slates", "low_users")})


_CHR = "WITH o AS (SELECT o_orderkey AS impression, o_orderdate::DATE AS d FROM orders), g AS (SELECT d, count(*) AS n FROM o GROUP BY 1), r AS (SELECT d, sum(n) OVER (ORDER BY d) AS upto, sum(n) OVER () AS total FROM g)"


@query("win_chrono_split", f"{_CHR} SELECT d::VARCHAR AS day, CASE WHEN upto <= floor(total * 2 / 3.0E0) THEN 'prefix' ELSE 'tail' END AS part FROM r")
def chrono_split(v: Views) -> DataFrame:
    """Whole days in time order: the first two thirds of the impressions are the prefix."""
    g = v.impressions().groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    order = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    total = g.agg(F.sum("n").alias("total"))
    rows = g.withColumn("upto", F.sum("n").over(order)).join(F.broadcast(total))
    return rows.select(F.col("d").cast("string").alias("day"), F.when(F.col("upto") <= F.floor(F.col("total") * 2 / 3), "prefix").otherwise("tail").alias("part"))


@query("ev_chrono_split", f"{_CHR} SELECT part, count(*) AS days, sum(n)::BIGINT AS impressions FROM (SELECT g.n, CASE WHEN upto <= floor(total * 2 / 3.0E0) THEN 'prefix' ELSE 'tail' END AS part FROM r JOIN g USING (d)) GROUP BY 1")
def ev_chrono_split(v: Views) -> DataFrame:
    days = v.impressions().groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return chrono_split(v).join(days, "day").groupBy("part").agg(F.count("*").alias("days"), F.sum("n").alias("impressions"))


@query("win_source_third", "SELECT o_orderkey AS impression, floor(3 * (row_number() OVER (ORDER BY o_orderkey) - 1) / count(*) OVER ())::INT AS third FROM orders")
def source_third(v: Views) -> DataFrame:
    """Thirds by source order; ranks come from slices of the key, so no task sorts all rows."""
    o = v.impressions().select("impression").withColumn("slice", F.floor(F.col("impression") / 10_000))
    n = o.groupBy("slice").agg(F.count("*").alias("n"))
    ahead = n.select("slice", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    total = n.agg(F.sum("n").alias("total"))
    rows = o.withColumn("r", F.row_number().over(Window.partitionBy("slice").orderBy("impression"))).join(ahead, "slice").join(F.broadcast(total))
    return rows.select("impression", F.floor(3 * (F.col("ahead") + F.col("r") - 1) / F.col("total")).cast("int").alias("third"))


_PARTS = "pa AS (SELECT impression // 1000 AS part, sha256(string_agg(impression || ':' || k || ':' || n, ',' ORDER BY impression)) AS d FROM sl GROUP BY 1), pb AS (SELECT part // 1000 AS part, sha256(string_agg(d, ',' ORDER BY part)) AS d FROM pa GROUP BY 1)"


@query("ev_slate_digest", f"{EVAL}, {_PARTS} SELECT sha256(string_agg(d, ',' ORDER BY part)) AS digest FROM pb")
def slate_digest(v: Views) -> DataFrame:
    """One digest of all slates in order, in levels: no task holds more than a thousand slates or digests, but for the last."""
    s = v.candidates().groupBy("impression").agg(F.sum("click").alias("k"), F.count("*").alias("n"))
    s = s.select(F.col("impression").alias("part"), F.concat_ws(":", "impression", "k", "n").alias("d"))
    for _ in range(2):
        at, whole = F.floor(F.col("part") / 1000).alias("to"), F.array_sort(F.collect_list(F.struct("part", "d")))
        s = s.groupBy(at).agg(F.sha2(F.array_join(F.transform(whole, lambda x: x["d"]), ","), 256).alias("d")).withColumnRenamed("to", "part")
    whole = F.array_sort(F.collect_list(F.struct("part", "d")))
    return s.agg(F.sha2(F.array_join(F.transform(whole, lambda x: x["d"]), ","), 256).alias("digest"))


@query("ev_cohort_audit", f"{FEATURES} SELECT year(ts) AS year, count(DISTINCT impression) AS slates, count(*) AS candidates, count(DISTINCT usr) AS users FROM feat GROUP BY 1")
def cohort_audit(v: Views) -> DataFrame:
    return v.exposures().groupBy(F.year("ts").alias("year")).agg(F.count_distinct("impression").alias("slates"), F.count("*").alias("candidates"), F.count_distinct("usr").alias("users"))


_TUNE = "WITH t AS (SELECT s_suppkey AS run, floor(s_acctbal)::BIGINT % 100 AS objective, s_suppkey % 7 AS atoms, s_suppkey % 5 AS rules FROM supplier), m AS (SELECT max(objective) AS best FROM t)"


@query("ev_tune_select", f"{_TUNE} SELECT run, objective, atoms, rules FROM t, m WHERE objective >= best - 5 ORDER BY atoms, rules, objective DESC, run LIMIT 1")
def tune_select(v: Views) -> DataFrame:
    """Within a tolerance of the best objective, the simplest run."""
    t = v.table("supplier").select(F.col("s_suppkey").alias("run"), (F.floor("s_acctbal") % 100).alias("objective"), (F.col("s_suppkey") % 7).alias("atoms"), (F.col("s_suppkey") % 5).alias("rules"))
    return t.join(F.broadcast(t.agg(F.max("objective").alias("best")))).where("objective >= best - 5").orderBy("atoms", "rules", F.col("objective").desc(), "run").limit(1).drop("best")


@query("agg_latency", "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def latency(v: Views) -> DataFrame:
    """Nearest-rank percentiles of each event type, from counts of distinct values; NULL values count as rows but have no rank."""
    n = v.table("events").groupBy("event_type", "value").agg(F.count("*").alias("weight"))
    c = running.ordered(n.where("value is not null"), ["event_type"])
    at = lambda q: F.min(F.when(F.col("cum") >= F.ceil(F.col("total") * F.lit(q)), F.col("value")))
    ranks = c.groupBy(F.col("event_type").alias("of")).agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    rows = n.groupBy("event_type").agg(F.sum("weight").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    return rows.join(ranks, F.col("event_type").eqNullSafe(F.col("of")), "left").select("event_type", "n", "p50", "p95", "least", "most")
