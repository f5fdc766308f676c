"""Queries of history joins, aggregations and order-sensitive features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import buckets, text
from ruleloom.operators import running, vectors
from ruleloom.plans.registry import query
from ruleloom.plans.views import BASE, DECAY, FEATURES, R6, Views, r6

KEY = "impression, article"


@query("jn_history_resolve", f"{BASE} SELECT impression, article, lag, h_topic, h_subcategory FROM hist")
def history_resolve(v: Views) -> DataFrame:
    return v.history_articles().select("impression", "article", "lag", "h_topic", "h_subcategory")


@query("agg_topic_profile", f"{BASE} SELECT impression, h_topic, count(*) AS n, sum(count(*)) OVER (PARTITION BY impression)::BIGINT AS known FROM hist GROUP BY 1, 2")
def topic_profile(v: Views) -> DataFrame:
    rows = v.history_articles().groupBy("impression", "h_topic").agg(F.count("*").alias("n"))
    return rows.withColumn("known", F.sum("n").over(Window.partitionBy("impression")))


@query("agg_affinity", f"{FEATURES} SELECT {KEY}, CASE WHEN known = 0 THEN 0 ELSE {R6('topic_count / (known * 1.0E0)')} END AS topic_affinity, CASE WHEN recent_known = 0 THEN 0 ELSE {R6('topic_recent / (recent_known * 1.0E0)')} END AS recent_topic_affinity, CASE WHEN known = 0 THEN 0 ELSE {R6('subcategory_count / (known * 1.0E0)')} END AS subcategory_affinity, topic_count, topic_recent FROM feat")
def affinity(v: Views) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(r6(F.col(a) / F.col(b)))
    return v.features().select("impression", "article", share("topic_count", "known").alias("topic_affinity"), share("topic_recent", "recent_known").alias("recent_topic_affinity"), share("subcategory_count", "known").alias("subcategory_affinity"), "topic_count", "topic_recent")


@query("win_lag_distance", f"{FEATURES} SELECT {KEY}, CASE WHEN topic_lag IS NULL THEN 0 ELSE {R6('1.0E0 / (1 + topic_lag)')} END AS topic_recency_score, CASE WHEN subcategory_lag IS NULL THEN 0 ELSE {R6('1.0E0 / (1 + subcategory_lag)')} END AS subcategory_recency_score, CASE WHEN recent_known = 0 THEN 0 ELSE {R6('subcategory_recent / (recent_known * 1.0E0)')} END AS recent_subcategory_affinity_score FROM feat")
def lag_distance(v: Views) -> DataFrame:
    near = lambda c: F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(r6(F.lit(1.0) / (1 + F.col(c))))
    recent = F.when(F.col("recent_known") == 0, F.lit(0.0)).otherwise(r6(F.col("subcategory_recent") / F.col("recent_known")))
    return v.features().select("impression", "article", near("topic_lag").alias("topic_recency_score"), near("subcategory_lag").alias("subcategory_recency_score"), recent.alias("recent_subcategory_affinity_score"))


@query("win_recent_k", f"{BASE} SELECT impression, count(*) FILTER (lag < 5) AS last5, count(*) FILTER (lag < 20) AS last20, string_agg(article::VARCHAR, ',' ORDER BY lag DESC) FILTER (lag < 5) AS last5_articles FROM hist GROUP BY 1")
def recent_k(v: Views) -> DataFrame:
    h = v.histories().where(F.size("history") > 0)
    tail = lambda k: F.when(F.size("history") > k, F.slice("history", -k, k)).otherwise(F.col("history"))
    return h.select("impression", F.size(tail(5)).alias("last5"), F.size(tail(20)).alias("last20"), F.array_join(F.transform(tail(5), lambda x: x.cast("string")), ",").alias("last5_articles"))


@query("win_decay", f"{BASE} SELECT impression, {R6('sum(pow(0.85, lag))')} AS decayed, {R6('sum(exp(-ln(2.0E0) * lag / 8))')} AS half8, {R6('sum(exp(-ln(2.0E0) * lag / 16))')} AS half16 FROM hist WHERE lag < 20 GROUP BY 1")
def decay(v: Views) -> DataFrame:
    half = lambda h: r6(F.sum(F.exp(-F.log(F.lit(2.0)) * F.col("lag") / h)))
    return v.history_items().where("lag < 20").groupBy("impression").agg(r6(F.sum(F.pow(F.lit(DECAY), F.col("lag")))).alias("decayed"), half(8).alias("half8"), half(16).alias("half16"))


@query("agg_profile_topics", f"{BASE} SELECT usr, string_agg(topic, ',' ORDER BY n DESC, topic) AS topics FROM (SELECT e.usr, a.topic, count(*) AS n FROM exposures e JOIN articles a USING (article) WHERE click = 1 GROUP BY 1, 2) GROUP BY 1")
def profile_topics(v: Views) -> DataFrame:
    n = v.exposures().where("click = 1").join(v.articles(), "article").groupBy("usr", "topic").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), F.col("topic").alias("b"))))
    return n.groupBy("usr").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), ",").alias("topics"))


@query("agg_popularity", f"{BASE} SELECT article, sum(click)::BIGINT AS clicks FROM exposures GROUP BY 1")
def popularity(v: Views) -> DataFrame:
    return v.candidates().groupBy("article").agg(F.sum("click").alias("clicks"))


@query("agg_tiebreak_prior", f"{BASE} SELECT topic, format, subcategory, count(*) AS n, {R6('(sum(click) + 1.0E0) / (count(*) + 10)')} AS prior FROM (SELECT e.click, a.topic, a.subcategory, CASE WHEN length(a.title) <= 12 THEN 'short' ELSE 'long' END AS format FROM exposures e JOIN articles a USING (article)) GROUP BY GROUPING SETS ((topic), (format), (subcategory))")
def tiebreak_prior(v: Views) -> DataFrame:
    rows = v.candidates().join(v.articles(), "article").withColumn("format", F.when(F.length("title") <= 12, "short").otherwise("long"))
    sets = rows.groupingSets([["topic"], ["format"], ["subcategory"]], "topic", "format", "subcategory")
    return sets.agg(F.count("*").alias("n"), r6((F.sum("click") + 1.0) / (F.count("*") + 10)).alias("prior"))


# --- prequential (as-of) counters: whole impressions, never rows ---------------------------------

_BEFORE = BASE + """,
per AS (SELECT article, impression, ts, count(*) AS n, sum(click) AS c FROM exposures GROUP BY 1, 2, 3),
prior AS (SELECT article, impression, coalesce(sum(n) OVER w, 0)::BIGINT AS exposures_before, coalesce(sum(c) OVER w, 0)::BIGINT AS clicks_before
  FROM per WINDOW w AS (PARTITION BY article ORDER BY ts, impression ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_SMOOTH = "CASE WHEN exposures_before = 0 THEN NULL ELSE (clicks_before + 1.0E0) / (exposures_before + 10) END"


def prior_counters(v: Views) -> DataFrame:
    """Exposures and clicks of each candidate's article before its impression."""
    rows = v.candidates().join(v.impressions().select("impression", "ts"), "impression").select("impression", "article", "ts", "click")
    return running.before(rows, ["article"], {"exposures_before": F.lit(1), "clicks_before": F.col("click")}).drop("click")


@query("win_prior_ctr", f"{_BEFORE} SELECT {KEY}, exposures_before, clicks_before, {R6('(clicks_before + 1.0E0) / (exposures_before + 10)')} AS smoothed_ctr FROM prior")
def prior_ctr(v: Views) -> DataFrame:
    p = prior_counters(v)
    return p.select("impression", "article", "exposures_before", "clicks_before", r6((F.col("clicks_before") + 1.0) / (F.col("exposures_before") + 10)).alias("smoothed_ctr"))


@query("prj_ctr_bucket", f"{_BEFORE} SELECT {KEY}, {buckets.sql('smoothed_ctr', _SMOOTH)} AS ctr_bucket FROM prior")
def ctr_bucket(v: Views) -> DataFrame:
    return prior_counters(v).select("impression", "article", buckets.column("smoothed_ctr", _SMOOTH).alias("ctr_bucket"))


@query("jn_asof_prequential", f"{BASE} SELECT e.impression, e.article, count(p.article) AS exposures_before, coalesce(sum(p.click), 0)::BIGINT AS clicks_before FROM exposures e LEFT JOIN exposures p ON p.article = e.article AND (p.ts < e.ts OR (p.ts = e.ts AND p.impression < e.impression)) GROUP BY 1, 2")
def asof_prequential(v: Views) -> DataFrame:
    """The as-of join as one cumulative window; the SQL spells it as a self-join."""
    return prior_counters(v).drop("ts")


_SEQ = BASE + """,
started AS (SELECT impression, ts, sum(n) OVER (ORDER BY ts, impression) - n AS seq FROM (SELECT impression, min(ts) AS ts, count(*) AS n FROM exposures GROUP BY 1)),
seen AS (SELECT e.article, e.impression, s.seq, min(s.seq) OVER (PARTITION BY e.article ORDER BY s.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first FROM exposures e JOIN started s USING (impression))"""


def sequence(v: Views) -> DataFrame:
    """impression and seq: exposures before the impression began.

    A running total over all impressions is taken in two levels: days first, then within a day.
    """
    n = v.candidates().groupBy("impression").agg(F.count("*").alias("n")).join(v.impressions().select("impression", "ts"), "impression").withColumn("day", F.to_date("ts"))
    days = n.groupBy("day").agg(F.sum("n").alias("d"))
    ahead = days.withColumn("ahead", F.coalesce(F.sum("d").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("d")
    within = F.coalesce(F.sum("n").over(Window.partitionBy("day").orderBy("ts", "impression").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.withColumn("within", within).join(ahead, "day").select("impression", "ts", (F.col("ahead") + F.col("within")).alias("seq"))


def first_seen(v: Views) -> DataFrame:
    earlier = Window.partitionBy("article").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return v.candidates().join(sequence(v), "impression").select("impression", "article", "seq", F.min("seq").over(earlier).alias("first"))


@query("win_first_seen", f"{_SEQ} SELECT {KEY}, seq::BIGINT AS seq, first::BIGINT AS first_seq FROM seen")
def win_first_seen(v: Views) -> DataFrame:
    return first_seen(v).select("impression", "article", "seq", F.col("first").alias("first_seq"))


@query("prj_freshness", f"{_SEQ} SELECT {KEY}, {buckets.sql('age', 'seq - first')} AS freshness_bucket FROM seen")
def freshness(v: Views) -> DataFrame:
    return first_seen(v).select("impression", "article", buckets.column("age", "seq - first").alias("freshness_bucket"))


# --- hierarchical transition model ------------------------------------------------------------

_PAIRS = BASE + """,
recent AS (SELECT DISTINCT impression, h_subcategory AS a FROM hist WHERE lag < 5),
ex AS (SELECT e.impression, e.article, e.click, a.subcategory AS b FROM exposures e JOIN articles a USING (article)),
overall AS (SELECT sum(click) * 1.0E0 / count(*) AS g FROM ex),
cand AS (SELECT b, (sum(click) + 20 * min(g)) / (count(*) + 20) AS cs FROM ex, overall GROUP BY 1),
trans AS (SELECT r.a, x.b, (sum(x.click) + 10 * min(c.cs)) / (count(*) + 10) AS tr FROM ex x JOIN recent r USING (impression) JOIN cand c ON c.b = x.b GROUP BY 1, 2)"""


def transition_model(v: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    ex = v.candidates().join(v.articles().select("article", F.col("subcategory").alias("b")), "article")
    recent = v.history_articles().where("lag < 5").select("impression", F.col("h_subcategory").alias("a")).distinct()
    overall = ex.agg((F.sum("click") / F.count("*")).alias("g"))
    cand = ex.groupBy("b").agg(F.sum("click").alias("c"), F.count("*").alias("e")).join(F.broadcast(overall)).select("b", ((F.col("c") + 20 * F.col("g")) / (F.col("e") + 20)).alias("cs"))
    trans = ex.join(recent, "impression").groupBy("a", "b").agg(F.sum("click").alias("c"), F.count("*").alias("e")).join(cand, "b")
    return ex, recent, cand, trans.select("a", "b", ((F.col("c") + 10 * F.col("cs")) / (F.col("e") + 10)).alias("tr"))


@query("agg_transition", f"{_PAIRS} SELECT a, b, {R6('cs')} AS candidate_score, {R6('tr')} AS transition_score FROM trans JOIN cand USING (b)")
def transition(v: Views) -> DataFrame:
    _, _, cand, trans = transition_model(v)
    return trans.join(cand, "b").select("a", "b", r6(F.col("cs")).alias("candidate_score"), r6(F.col("tr")).alias("transition_score"))


@query("agg_transition_score", f"{_PAIRS} SELECT x.impression, x.article, {R6('greatest(min(c.cs), coalesce(max(t.tr), -1.0))')} AS score FROM ex x JOIN cand c ON c.b = x.b LEFT JOIN recent r USING (impression) LEFT JOIN trans t ON t.a = r.a AND t.b = x.b GROUP BY 1, 2")
def transition_score(v: Views) -> DataFrame:
    ex, recent, cand, trans = transition_model(v)
    best = ex.select("impression", "article", "b").join(recent, "impression").join(trans, ["a", "b"]).groupBy("impression", "article").agg(F.max("tr").alias("tr"))
    rows = ex.join(cand, "b").join(best, ["impression", "article"], "left")
    return rows.select("impression", "article", r6(F.greatest("cs", F.coalesce("tr", F.lit(-1.0)))).alias("score"))


_PRIOR_T = BASE + """,
ex AS MATERIALIZED (SELECT e.impression, e.article, e.click, e.ts, a.subcategory AS b FROM exposures e JOIN articles a USING (article)),
pair AS MATERIALIZED (SELECT DISTINCT x.impression, x.ts, x.b, r.a FROM ex x JOIN (SELECT DISTINCT impression, h_subcategory AS a FROM hist WHERE lag < 5) r USING (impression)),
ab AS MATERIALIZED (SELECT p.a, p.b, p.impression, p.ts, sum(x.click) AS c, count(*) AS e FROM pair p JOIN ex x ON x.impression = p.impression AND x.b = p.b GROUP BY 1, 2, 3, 4),
bb AS MATERIALIZED (SELECT b, impression, ts, sum(click) AS c, count(*) AS e FROM ex GROUP BY 1, 2, 3),
gg AS MATERIALIZED (SELECT impression, ts, sum(click) AS c, count(*) AS e FROM ex GROUP BY 1, 2),
g AS MATERIALIZED (SELECT impression, coalesce(sum(c) OVER w, 0) AS c, coalesce(sum(e) OVER w, 0) AS e FROM gg WINDOW w AS (ORDER BY ts, impression ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS MATERIALIZED (SELECT b, impression, coalesce(sum(c) OVER w, 0) AS c, coalesce(sum(e) OVER w, 0) AS e FROM bb WINDOW w AS (PARTITION BY b ORDER BY ts, impression ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS MATERIALIZED (SELECT a, b, impression, coalesce(sum(c) OVER w, 0) AS c, coalesce(sum(e) OVER w, 0) AS e FROM ab WINDOW w AS (PARTITION BY a, b ORDER BY ts, impression ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gs AS MATERIALIZED (SELECT impression, CASE WHEN e = 0 THEN 0.0E0 ELSE c * 1.0E0 / e END AS g FROM g),
bs AS MATERIALIZED (SELECT b.b, b.impression, (b.c + 20 * gs.g) / (b.e + 20) AS cs FROM b JOIN gs USING (impression)),
tbest AS MATERIALIZED (SELECT t.b, t.impression, max((t.c + 10 * bs.cs) / (t.e + 10)) AS tr FROM t JOIN bs ON bs.b = t.b AND bs.impression = t.impression WHERE t.e > 0 GROUP BY 1, 2)"""


@query("win_prior_transition", f"{_PRIOR_T} SELECT b, impression, {R6('greatest(bs.cs, coalesce(tbest.tr, -1.0))')} AS score FROM bs LEFT JOIN tbest USING (b, impression)")
def prior_transition(v: Views) -> DataFrame:
    """The transition score from counters before the impression, at all three levels."""
    ex = v.candidates().join(v.impressions().select("impression", "ts"), "impression").join(v.articles().select("article", F.col("subcategory").alias("b")), "article")
    both = {"c": F.col("clicks"), "e": F.col("shown")}
    bb = ex.groupBy("b", "impression", "ts").agg(F.sum("click").alias("clicks"), F.count("*").alias("shown"))
    gg = bb.groupBy("impression", "ts").agg(F.sum("clicks").alias("clicks"), F.sum("shown").alias("shown"))
    g = running.before(gg, [], both).select("impression", F.when(F.col("e") == 0, F.lit(0.0)).otherwise(F.col("c") / F.greatest(F.col("e"), F.lit(1))).alias("g"))
    bs = running.before(bb, ["b"], both).join(g, "impression")
    bs = bs.select("b", "impression", ((F.col("c") + 20 * F.col("g")) / (F.col("e") + 20)).alias("cs"))
    recent = v.history_articles().where("lag < 5").select("impression", F.col("h_subcategory").alias("a")).distinct()
    t = running.before(bb.join(recent, "impression"), ["a", "b"], both).where("e > 0")
    best = t.join(bs, ["b", "impression"]).groupBy("b", "impression").agg(F.max((F.col("c") + 10 * F.col("cs")) / (F.col("e") + 10)).alias("tr"))
    return bs.join(best, ["b", "impression"], "left").select("b", "impression", r6(F.greatest("cs", F.coalesce("tr", F.lit(-1.0)))).alias("score"))


# --- prototypes -------------------------------------------------------------------------------

_PROTO = BASE + """,
proto AS (SELECT impression, h_subcategory AS key, count(*) AS n, sum(pow(0.85, lag)) AS w, min(lag) AS lag FROM hist WHERE lag < 20 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY impression ORDER BY floor(w * 1e6 + 0.5) DESC, n DESC, lag, key) AS rank FROM proto)"""


def prototypes(v: Views) -> DataFrame:
    p = v.history_articles().where("lag < 20").groupBy("impression", F.col("h_subcategory").alias("key")).agg(F.count("*").alias("n"), F.sum(F.pow(F.lit(DECAY), F.col("lag"))).alias("w"), F.min("lag").alias("lag"))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("impression").orderBy(F.floor(F.col("w") * 1e6 + 0.5).desc(), F.col("n").desc(), "lag", "key")))


@query("agg_prototypes", f"{_PROTO} SELECT impression, key, n, {R6('w')} AS weight, lag, rank FROM ranked")
def agg_prototypes(v: Views) -> DataFrame:
    return prototypes(v).select("impression", "key", "n", r6(F.col("w")).alias("weight"), "lag", "rank")


@query("agg_slot_scores", f"{_PROTO}, tot AS (SELECT impression, sum(w) AS total, sum(n) AS size, max(CASE WHEN rank = 1 THEN key END) AS slot1, max(CASE WHEN rank = 2 THEN key END) AS slot2 FROM ranked GROUP BY 1) SELECT e.impression, e.article, {R6('coalesce(r.w / t.total, 0)')} AS matched_share, {R6('coalesce(least(1.0E0, r.n / (t.size * 1.0E0)), 0)')} AS support, {R6('coalesce(pow(0.85, r.lag), 0)')} AS recency, coalesce(r.rank, 0) AS match_rank, t.slot1, t.slot2 FROM exposures e JOIN articles a USING (article) LEFT JOIN tot t USING (impression) LEFT JOIN ranked r ON r.impression = e.impression AND r.key = a.subcategory")
def slot_scores(v: Views) -> DataFrame:
    p = prototypes(v)
    slot = lambda k: F.max(F.when(F.col("rank") == k, F.col("key"))).alias(f"slot{k}")
    total = p.groupBy("impression").agg(F.sum("w").alias("total"), F.sum("n").alias("size"), slot(1), slot(2))
    rows = v.candidates().join(v.articles(), "article").join(total, "impression", "left").join(p.withColumnRenamed("key", "subcategory"), ["impression", "subcategory"], "left")
    return rows.select(
        "impression", "article", r6(F.coalesce(F.col("w") / F.col("total"), F.lit(0.0))).alias("matched_share"), r6(F.coalesce(F.least(F.lit(1.0), F.col("n") / F.col("size")), F.lit(0.0))).alias("support"),
        r6(F.coalesce(F.pow(F.lit(DECAY), F.col("lag")), F.lit(0.0))).alias("recency"), F.coalesce("rank", F.lit(0)).alias("match_rank"), "slot1", "slot2")


# --- titles and entities -------------------------------------------------------------------------

_TOK = BASE + f""",
tok AS (SELECT article, unnest(list_distinct(list_filter(regexp_extract_all(lower(title || ' ' || topic), '[\\w'']+'), lambda x: length(x) > 2 AND NOT list_contains({list(text.TITLE_STOP)!r}, x)))) AS token FROM articles WHERE article IN (SELECT article FROM exposures)),
nn AS (SELECT count(DISTINCT article) AS n FROM exposures),
idf AS (SELECT token, count(*) AS df, ln((min(n) + 1.0E0) / (count(*) + 1)) + 1 AS idf FROM tok, nn GROUP BY 1),
csum AS (SELECT t.article, sum(i.idf) AS s FROM tok t JOIN idf i USING (token) GROUP BY 1)"""


def title_model(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    exposed = v.candidates().select("article").distinct()
    tok = v.articles().join(exposed, "article").select("article", F.explode(text.title_tokens(F.concat_ws(" ", "title", "topic"))).alias("token"))
    n = exposed.agg(F.count("*").alias("n"))
    idf = tok.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("token", "df", (F.log((F.col("n") + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))
    weighted = tok.join(idf, "token")
    return idf, weighted, weighted.groupBy("article").agg(F.sum("idf").alias("s"))


@query("agg_title_idf", f"{_TOK} SELECT token, df, {R6('idf')} AS idf FROM idf")
def title_idf(v: Views) -> DataFrame:
    return title_model(v)[0].select("token", "df", r6(F.col("idf")).alias("idf"))


_MATCH = _TOK + """,
inter AS (SELECT e.impression, e.article, h.lag, h.article AS h_article, sum(i.idf) AS w FROM exposures e JOIN hist h USING (impression) JOIN tok c ON c.article = e.article JOIN tok d ON d.article = h.article AND d.token = c.token JOIN idf i ON i.token = c.token GROUP BY 1, 2, 3, 4)"""


def shared_tokens(v: Views, weighted: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """impression, article, h_article, lag and the idf of each token that a candidate and a history item share.

    Joined on (impression, token): the rows follow the slates' sizes, never pairs of articles.
    """
    own = v.candidates().select("impression", "article").join(weighted, "article")
    tokens = weighted.select(F.col("article").alias("h_article"), "token")
    if extra is not None:
        tokens = tokens.join(extra, "h_article")
    items = v.history_items().select("impression", F.col("article").alias("h_article"), "lag").join(tokens, "h_article")
    return own.join(items, ["impression", "token"])


def title_matches(v: Views) -> tuple[DataFrame, DataFrame]:
    """Shared title weight of each (candidate, history item) that shares a token, and each article's total."""
    _, weighted, total = title_model(v)
    return shared_tokens(v, weighted).groupBy("impression", "article", "h_article", "lag").agg(F.sum("idf").alias("w")), total


@query("agg_title_jaccard", f"{_MATCH} SELECT i.impression, i.article, {R6('max(i.w / (a.s + b.s - i.w))')} AS jaccard FROM inter i JOIN csum a ON a.article = i.article JOIN csum b ON b.article = i.h_article GROUP BY 1, 2")
def title_jaccard(v: Views) -> DataFrame:
    m, total = title_matches(v)
    rows = m.join(total, "article").join(total.select(F.col("article").alias("h_article"), F.col("s").alias("h_s")), "h_article")
    return rows.groupBy("impression", "article").agg(r6(F.max(F.col("w") / (F.col("s") + F.col("h_s") - F.col("w")))).alias("jaccard"))


_BM = _TOK + """,
dl AS (SELECT article, count(*) AS len FROM tok GROUP BY 1), av AS (SELECT avg(len) AS av FROM dl),
bm AS (SELECT c.article, d.article AS h_article, sum(i.idf / (1 + 1.2E0 * (0.25E0 + 0.75E0 * l.len / av.av))) AS raw FROM tok c JOIN tok d ON d.token = c.token JOIN idf i ON i.token = c.token JOIN dl l ON l.article = d.article, av GROUP BY 1, 2),
sc AS (SELECT e.impression, e.article, h.lag, bm.raw / s.s AS score FROM exposures e JOIN hist h USING (impression) JOIN bm ON bm.article = e.article AND bm.h_article = h.article JOIN csum s ON s.article = e.article),
rk AS (SELECT *, row_number() OVER (PARTITION BY impression, article ORDER BY score DESC, lag) AS r FROM sc),
sz AS (SELECT impression, count(*) AS n FROM hist GROUP BY 1),
cov AS (SELECT e.impression, e.article, sum(i.idf) / min(s.s) AS c_all, sum(CASE WHEN q.lag < 5 THEN i.idf ELSE 0 END) / min(s.s) AS c_recent FROM exposures e JOIN tok c ON c.article = e.article JOIN idf i ON i.token = c.token JOIN csum s ON s.article = e.article JOIN (SELECT h.impression, t.token, min(h.lag) AS lag FROM hist h JOIN tok t ON t.article = h.article GROUP BY 1, 2) q ON q.impression = e.impression AND q.token = c.token GROUP BY 1, 2)"""


@query("agg_bm25", f"{_BM} SELECT k.impression, k.article, {R6('max(score)')} AS peak, {R6('sum(CASE WHEN r <= 3 THEN score ELSE 0 END) / least(3, min(sz.n))')} AS top3, {R6('min(cov.c_all)')} AS coverage, {R6('min(cov.c_recent)')} AS recent_coverage FROM rk k JOIN sz USING (impression) JOIN cov ON cov.impression = k.impression AND cov.article = k.article GROUP BY 1, 2")
def bm25(v: Views) -> DataFrame:
    _, weighted, total = title_model(v)
    length = weighted.groupBy("article").agg(F.count("*").alias("len"))
    mean = length.agg(F.avg("len").alias("av"))
    norm = length.join(F.broadcast(mean)).select(F.col("article").alias("h_article"), (1 + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("av"))).alias("norm"))
    raw = shared_tokens(v, weighted, norm).groupBy("impression", "article", "lag").agg(F.sum(F.col("idf") / F.col("norm")).alias("raw")).join(total, "article")
    raw = raw.select("impression", "article", (F.col("raw") / F.col("s")).alias("score"))
    items = v.history_items().select("impression", F.col("article").alias("h_article"), "lag")
    slate = v.candidates().select("impression", "article")
    size = items.groupBy("impression").agg(F.count("*").alias("n"))
    top = F.sort_array(F.collect_list("score"), asc=False)
    score = raw.groupBy("impression", "article").agg(F.max("score").alias("peak"), F.slice(top, 1, 3).alias("t"))
    seen = items.join(weighted.select(F.col("article").alias("h_article"), "token"), "h_article").groupBy("impression", "token").agg(F.min("lag").alias("lag"))
    cover = slate.join(weighted, "article").join(seen, ["impression", "token"]).join(total, "article").groupBy("impression", "article").agg(
        (F.sum("idf") / F.min("s")).alias("c"), (F.sum(F.when(F.col("lag") < 5, F.col("idf")).otherwise(0.0)) / F.min("s")).alias("r"))
    rows = score.join(size, "impression").join(cover, ["impression", "article"])
    mean3 = F.aggregate("t", F.lit(0.0), lambda a, x: a + x) / F.least(F.lit(3), F.col("n"))
    return rows.select("impression", "article", r6(F.col("peak")).alias("peak"), r6(mean3).alias("top3"), r6(F.col("c")).alias("coverage"), r6(F.col("r")).alias("recent_coverage"))


_LEX = f"""WITH d AS (SELECT list_filter(regexp_extract_all({text.fold_sql("coalesce(substr(text, 1, 20000), '')")}, '{text.WORD}(?:''{text.WORD})?'), lambda x: length(x) > 2 AND NOT list_contains({list(text.LEXICAL_STOP)!r}, x))[1:512] AS t FROM documents),
u AS (SELECT DISTINCT list_sort(t) AS t FROM d WHERE len(t) > 0),
n AS (SELECT count(*) AS n FROM u), tk AS (SELECT unnest(list_distinct(t)) AS token FROM u)
SELECT token, count(*) AS df, {R6('ln(1 + (min(n) - count(*) + 0.5E0) / (count(*) + 0.5E0))')} AS idf FROM tk, n GROUP BY 1"""


def _idf(t: DataFrame) -> DataFrame:
    u = t.groupBy(F.sha2(F.array_join("t", " "), 256).alias("k")).agg(F.first("t").alias("t"))
    n = u.agg(F.count("*").alias("n"))
    tk = u.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n))
    return tk.select("token", "df", r6(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))


@query("agg_lexical_idf", _LEX)
def lexical_idf(v: Views) -> DataFrame:
    """Inverse document frequencies over the different token multisets of the texts of all languages, by Unicode words."""
    return _idf(v.table("documents").select(F.array_sort(text.unicode_tokens(F.col("text"))).alias("t")).where(F.size("t") > 0))


@query("jn_title_overlap", f"{_TOK}, seen AS (SELECT DISTINCT h.impression, t.token FROM hist h JOIN tok t USING (article)) SELECT e.impression, e.article, {buckets.sql('count_none', 'count(s.token)')} AS title_overlap FROM exposures e LEFT JOIN tok t ON t.article = e.article LEFT JOIN seen s ON s.impression = e.impression AND s.token = t.token GROUP BY 1, 2")
def title_overlap(v: Views) -> DataFrame:
    _, weighted, _ = title_model(v)
    tokens = weighted.groupBy("article").agg(F.collect_set("token").alias("tokens"))
    seen = v.history_items().join(weighted.select("article", "token"), "article").groupBy("impression").agg(F.collect_set("token").alias("seen"))
    rows = v.candidates().join(tokens, "article", "left").join(seen, "impression", "left")
    n = F.coalesce(F.size(F.array_intersect("tokens", "seen")), F.lit(0))
    return rows.select("impression", "article", F.when(F.col("tokens").isNull() | F.col("seen").isNull(), 0).otherwise(n).alias("n")).select("impression", "article", buckets.column("count_none", "n").alias("title_overlap"))


ENTITIES = "ent AS (SELECT p_partkey AS article, unnest([p_size, 100 + p_partkey % 50]) AS entity FROM part)"


def entities(v: Views) -> DataFrame:
    p = v.table("part")
    return p.select(F.col("p_partkey").alias("article"), F.explode(F.array(F.col("p_size").cast("bigint"), 100 + F.col("p_partkey") % 50)).alias("entity"))


@query("jn_entity_overlap", f"{BASE}, {ENTITIES}, seen AS (SELECT DISTINCT h.impression, t.entity FROM hist h JOIN ent t USING (article)) SELECT e.impression, e.article, {buckets.sql('overlap', 'count(s.entity)')} AS entity_overlap FROM exposures e LEFT JOIN ent t ON t.article = e.article LEFT JOIN seen s ON s.impression = e.impression AND s.entity = t.entity GROUP BY 1, 2")
def entity_overlap(v: Views) -> DataFrame:
    ent = entities(v)
    seen = v.history_items().join(ent, "article").select("impression", "entity").distinct()
    n = v.candidates().select("impression", "article").join(ent, "article").join(seen, ["impression", "entity"]).groupBy("impression", "article").agg(F.count("*").alias("n"))
    rows = v.candidates().join(n, ["impression", "article"], "left").fillna(0, ["n"])
    return rows.select("impression", "article", buckets.column("overlap", "n").alias("entity_overlap"))


_CHAIN = f"{BASE}, {ENTITIES}, chain AS (SELECT DISTINCT e.impression, e.article, h.lag, h.article AS origin FROM exposures e JOIN ent c ON c.article = e.article JOIN hist h ON h.impression = e.impression JOIN ent d ON d.article = h.article AND d.entity = c.entity)"


def chains(v: Views) -> DataFrame:
    """Click origins that share an entity with the candidate: an equi-join on the entity, one row per origin."""
    ent = entities(v)
    a = v.candidates().select("impression", "article").join(ent, "article")
    b = v.history_items().join(ent, "article").select("impression", F.col("article").alias("origin"), "lag", "entity")
    return a.join(b, ["impression", "entity"]).select("impression", "article", "lag", "origin").distinct()


@query("jn_relational_chain", f"{_CHAIN} SELECT impression, article, lag, origin FROM chain")
def relational_chain(v: Views) -> DataFrame:
    return chains(v)


@query("prf_relational", f"{_CHAIN} SELECT impression, article, count(*) AS origins, min(lag) AS latest, count(*) FILTER (lag < 5) AS recent_origins FROM chain GROUP BY 1, 2")
def prf_relational(v: Views) -> DataFrame:
    return chains(v).groupBy("impression", "article").agg(F.count("*").alias("origins"), F.min("lag").alias("latest"), F.count_if(F.col("lag") < 5).alias("recent_origins"))


_SCOPE = "CASE WHEN r > 0 THEN 'recent' WHEN n > 0 THEN 'older' WHEN known = 0 OR truncated THEN 'unknown' ELSE 'none' END"


@query("agg_relation_scope", f"{_CHAIN} SELECT impression, article, {_SCOPE} AS scope FROM (SELECT e.impression, e.article, count(c.lag) AS n, count(c.lag) FILTER (c.lag < 5) AS r, coalesce(min(z.known), 0) AS known, coalesce(min(z.known), 0) >= 20 AS truncated FROM exposures e LEFT JOIN chain c ON c.impression = e.impression AND c.article = e.article LEFT JOIN (SELECT impression, count(*) AS known FROM hist GROUP BY 1) z ON z.impression = e.impression GROUP BY 1, 2)")
def relation_scope(v: Views) -> DataFrame:
    """Continuity scope; a history at the limit of 20 counts as truncated, so `none` becomes unknown."""
    n = prf_relational(v).select("impression", "article", F.col("origins").alias("n"), F.col("recent_origins").alias("r"))
    size = v.histories().select("impression", F.size("history").alias("known"))
    rows = v.candidates().join(n, ["impression", "article"], "left").join(size, "impression", "left").fillna(0, ["n", "r", "known"]).withColumn("truncated", F.col("known") >= 20)
    return rows.select("impression", "article", F.expr(_SCOPE).alias("scope"))


@query("prf_live_relational", f"{_CHAIN} SELECT i.o_custkey AS usr, c.article, count(*) AS origins FROM chain c JOIN orders i ON i.o_orderkey = c.impression JOIN (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1) l ON l.last = c.impression GROUP BY 1, 2")
def live_relational(v: Views) -> DataFrame:
    """Continuity of the candidates of each user's latest impression."""
    last = v.impressions().groupBy("usr").agg(F.max(F.struct("ts", "impression")).alias("m")).select("usr", F.col("m.impression").alias("impression"))
    return chains(v).join(last, "impression").groupBy("usr", "article").agg(F.count("*").alias("origins"))


@query("agg_relation_counts", f"{_CHAIN} SELECT CASE WHEN year(ts) < 1996 THEN 'train' ELSE 'test' END AS split, CASE WHEN lag < 5 THEN 'recent' ELSE 'older' END AS value, count(*) AS n FROM chain c JOIN (SELECT o_orderkey, o_orderdate AS ts FROM orders) o ON o.o_orderkey = c.impression GROUP BY 1, 2")
def relation_counts(v: Views) -> DataFrame:
    rows = chains(v).join(v.impressions().select("impression", "ts"), "impression")
    return rows.groupBy(F.when(F.year("ts") < 1996, "train").otherwise("test").alias("split"), F.when(F.col("lag") < 5, "recent").otherwise("older").alias("value")).agg(F.count("*").alias("n"))


@query("agg_safety_audit", f"{_CHAIN} SELECT count(*) AS proofs, count(*) - count(DISTINCT (impression, article, lag)) AS duplicate_origins, count(*) FILTER (lag < 0) AS future_references FROM chain")
def safety_audit(v: Views) -> DataFrame:
    c = chains(v)
    n = c.groupBy("impression", "article", "lag").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("proofs"), F.sum(F.col("n") - 1).alias("duplicate_origins"), F.sum(F.when(F.col("lag") < 0, F.col("n")).otherwise(0)).alias("future_references"))


# --- annotations -----------------------------------------------------------------------------

_ANN = f"{BASE}, {ENTITIES}, ann AS (SELECT * FROM ent WHERE article % 5 <> 0), cs AS (SELECT article, count(*) AS n FROM ann GROUP BY 1), ov AS (SELECT e.impression, e.article, h.lag, count(d.entity) * 1.0E0 / min(cs.n) AS f FROM exposures e JOIN cs ON cs.article = e.article JOIN hist h ON h.impression = e.impression JOIN cs hc ON hc.article = h.article JOIN ann c ON c.article = e.article LEFT JOIN ann d ON d.article = h.article AND d.entity = c.entity GROUP BY 1, 2, 3)"


def annotations(v: Views) -> DataFrame:
    """article and concepts; every fifth article has none, and missing stays missing."""
    return entities(v).where("article % 5 <> 0").groupBy("article").agg(F.array_sort(F.collect_set("entity")).alias("concepts"))


def annotation_overlaps(v: Views) -> DataFrame:
    a = annotations(v)
    h = v.history_items().join(a, "article").select("impression", "lag", F.col("concepts").alias("h"))
    rows = v.candidates().select("impression", "article").join(a, "article").join(h, "impression")
    return rows.withColumn("f", F.size(F.array_intersect("concepts", "h")) / F.size("concepts"))


@query("jn_annotations", f"{_ANN} SELECT e.impression, e.article, cs.n IS NOT NULL AS known, coalesce(cs.n, 0) AS n FROM exposures e LEFT JOIN cs USING (article)")
def jn_annotations(v: Views) -> DataFrame:
    rows = v.candidates().join(annotations(v), "article", "left")
    return rows.select("impression", "article", F.col("concepts").isNotNull().alias("known"), F.coalesce(F.size("concepts"), F.lit(0)).alias("n")).withColumn("n", F.greatest("n", F.lit(0)))


@query("agg_llm_affinity", f"{_ANN}, seen AS (SELECT DISTINCT h.impression, a.entity FROM hist h JOIN ann a USING (article)), nv AS (SELECT e.impression, e.article, count(*) FILTER (s.entity IS NULL) * 1.0E0 / count(*) AS novelty FROM exposures e JOIN ann c USING (article) LEFT JOIN seen s ON s.impression = e.impression AND s.entity = c.entity GROUP BY 1, 2) SELECT o.impression, o.article, {R6('avg(f)')} AS affinity, {R6('max(f)')} AS peak, {R6('min(nv.novelty)')} AS novelty, count(*) AS items FROM ov o JOIN nv ON nv.impression = o.impression AND nv.article = o.article GROUP BY 1, 2")
def llm_affinity(v: Views) -> DataFrame:
    rows = annotation_overlaps(v).groupBy("impression", "article").agg(F.avg("f").alias("a"), F.max("f").alias("p"), F.first("concepts").alias("concepts"), F.array_distinct(F.flatten(F.collect_list("h"))).alias("seen"), F.count("*").alias("items"))
    novelty = F.size(F.array_except("concepts", "seen")) / F.size("concepts")
    return rows.select("impression", "article", r6(F.col("a")).alias("affinity"), r6(F.col("p")).alias("peak"), r6(novelty).alias("novelty"), "items")


@query("agg_projection_coverage", f"{_ANN} SELECT CASE WHEN year(ts) < 1996 THEN 'train' ELSE 'test' END AS split, count(*) AS contexts, count(cs.n) AS known, count(*) - count(cs.n) AS missing FROM exposures e LEFT JOIN cs USING (article) GROUP BY 1")
def projection_coverage(v: Views) -> DataFrame:
    rows = v.exposures().join(annotations(v), "article", "left")
    return rows.groupBy(F.when(F.year("ts") < 1996, "train").otherwise("test").alias("split")).agg(F.count("*").alias("contexts"), F.count("concepts").alias("known"), F.count_if(F.col("concepts").isNull()).alias("missing"))


@query("agg_coverage_report", f"{_ANN}, sl AS (SELECT e.impression, count(*) AS n, count(cs.n) AS k FROM exposures e LEFT JOIN cs USING (article) GROUP BY 1) SELECT sum(n * (n - 1) / 2)::BIGINT AS pairs, sum(k * (k - 1) / 2)::BIGINT AS comparable, sum(k * (n - k))::BIGINT AS one_sided FROM sl")
def coverage_report(v: Views) -> DataFrame:
    """Pair counts from counts per slate: groups first, never pairs of rows."""
    s = v.candidates().join(annotations(v), "article", "left").groupBy("impression").agg(F.count("*").alias("n"), F.count("concepts").alias("k"))
    half = lambda c: F.sum((F.col(c) * (F.col(c) - 1) / 2).cast("bigint"))
    return s.agg(half("n").alias("pairs"), half("k").alias("comparable"), F.sum(F.col("k") * (F.col("n") - F.col("k"))).alias("one_sided"))


# --- vectors -----------------------------------------------------------------------------------

_VEC = BASE + """,
vec AS (SELECT vec_id AS article, embedding::DOUBLE[] AS e FROM embeddings),
sim AS (SELECT x.impression, x.article, h.lag, greatest(-1.0, least(1.0, list_cosine_similarity(a.e, b.e))) AS c FROM exposures x JOIN vec a ON a.article = x.article JOIN hist h ON h.impression = x.impression JOIN vec b ON b.article = h.article),
m AS (SELECT *, (c + 1) / 2 AS s, max(c) OVER (PARTITION BY impression, article) AS top, row_number() OVER (PARTITION BY impression, article ORDER BY c DESC, lag) AS r FROM sim)"""


@query("jn_candidate_vectors", f"{_VEC} SELECT impression, article, lag, {R6('c')} AS cosine FROM sim")
def candidate_vectors(v: Views) -> DataFrame:
    return vectors.similarities(v).select("impression", "article", "lag", r6(F.col("c")).alias("cosine"))


@query("agg_semantic_match", f"{_VEC} SELECT impression, article, {R6('max(s)')} AS top1, {R6('avg(s) FILTER (r <= 3)')} AS top3, {R6('avg(s) FILTER (r <= 5)')} AS top5, {R6('sum(exp(8 * (c - top)) * s) / sum(exp(8 * (c - top)))')} AS attention8, {R6('sum(exp(12 * (c - top)) * s) / sum(exp(12 * (c - top)))')} AS attention12, coalesce({R6('max(s) FILTER (lag < 5)')}, -1) AS recent5, coalesce({R6('sum(pow(0.85, lag) * s) FILTER (lag < 20) / sum(pow(0.85, lag)) FILTER (lag < 20)')}, -1) AS decayed, count(*) AS valid FROM m GROUP BY 1, 2")
def semantic_match(v: Views) -> DataFrame:
    return vectors.match_facts(vectors.similarities(v))


@query("top3_mean", f"{_VEC} SELECT impression, article, {R6('avg(s) FILTER (r <= 3)')} AS top3 FROM m GROUP BY 1, 2")
def top3_mean(v: Views) -> DataFrame:
    return semantic_match(v).select("impression", "article", "top3")


@query("agg_recency_attention", f"{_VEC}, q AS (SELECT *, 8 * c - ln(2.0E0) * lag / 8 AS a, 8 * c - ln(2.0E0) * lag / 16 AS b FROM m), z AS (SELECT *, max(a) OVER (PARTITION BY impression, article) AS ma, max(b) OVER (PARTITION BY impression, article) AS mb FROM q) SELECT impression, article, {R6('sum(exp(a - ma) * s) / sum(exp(a - ma))')} AS half8, {R6('sum(exp(b - mb) * s) / sum(exp(b - mb))')} AS half16 FROM z GROUP BY 1, 2")
def recency_attention(v: Views) -> DataFrame:
    return vectors.recency_attention(vectors.similarities(v))


@query("agg_entity_similarity", f"{_VEC} SELECT impression, article, coalesce({R6('max(c) FILTER (lag < 5)')}, -9) AS recent_top1, {R6('avg(c)')} AS long_mean FROM m GROUP BY 1, 2")
def entity_similarity(v: Views) -> DataFrame:
    s = vectors.similarities(v).groupBy("impression", "article")
    return s.agg(F.coalesce(r6(F.max(F.when(F.col("lag") < 5, F.col("c")))), F.lit(-9.0)).alias("recent_top1"), r6(F.avg("c")).alias("long_mean"))


_CEN = BASE + """,
unit AS (SELECT vec_id AS article, pos, x / nrm AS x FROM (SELECT vec_id, pos, embedding[pos]::DOUBLE AS x, sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))) AS nrm FROM embeddings, (SELECT unnest(range(1, 65)) AS pos))),
mu AS (SELECT pos, avg(x) AS m FROM unit GROUP BY 1),
cen AS (SELECT u.article, list(u.x - mu.m ORDER BY u.pos) AS e FROM unit u JOIN mu USING (pos) GROUP BY 1),
sim AS (SELECT x.impression, x.article, h.lag, greatest(-1.0, least(1.0, list_cosine_similarity(a.e, b.e))) AS c FROM exposures x JOIN cen a ON a.article = x.article JOIN hist h ON h.impression = x.impression JOIN cen b ON b.article = h.article),
m AS (SELECT *, (c + 1) / 2 AS s, exp(8 * (c - max(c) OVER (PARTITION BY impression, article))) AS w, row_number() OVER (PARTITION BY impression, article ORDER BY c DESC, lag) AS r FROM sim)"""


@query("agg_semantic_centered", f"{_CEN} SELECT impression, article, {R6('avg(s) FILTER (r <= 3)')} AS top3, {R6('sum(w * s) / sum(w)')} AS attention, {R6('sum(w) * sum(w) / (count(*) * sum(w * w))')} AS effective_support FROM m GROUP BY 1, 2")
def semantic_centered(v: Views) -> DataFrame:
    return vectors.centered_facts(vectors.similarities(v, centered=True))


@query("src_embeddings_npz", f"SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, min(len(embedding)) AS dims, {R6('max(abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) - 1))')} AS worst_norm, count(*) FILTER (list_sum(list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN 0 ELSE 1 END)) > 0) AS not_finite FROM embeddings")
def embeddings_check(v: Views) -> DataFrame:
    return vectors.validate(v.table("embeddings"))


@query("agg_semantic_clusters")
def semantic_clusters(v: Views) -> DataFrame:
    return vectors.leader_clusters(v)
