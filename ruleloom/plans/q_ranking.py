"""Queries of activation, point ranking and the pair tournament."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.operators import mining, ranking
from ruleloom.operators.ranking import grid, midrank
from ruleloom.plans.q_mining import _RANKED
from ruleloom.plans.q_scalars import _JOINED, _PAIR_SQL
from ruleloom.plans.registry import query
from ruleloom.plans.views import R6, Views, r6

POINTS = _RANKED + """,
d AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY q DESC, n DESC, premises) AS d FROM q),
sel AS (SELECT * FROM d ORDER BY CASE WHEN d <= 10 THEN 0 ELSE 1 END, q DESC, size DESC, n DESC, premises LIMIT 30),
prem AS (SELECT premises, size, strength, confidence, unnest(string_split(premises, ' & ')) AS atom FROM sel),
act AS (SELECT f.impression, f.article, p.premises, min(p.size) AS size, min(p.strength) AS strength, min(p.confidence) AS confidence
  FROM facts f JOIN prem p ON p.atom = f.predicate || '=' || f.value GROUP BY 1, 2, 3 HAVING count(*) = min(p.size)),
pi AS (SELECT ty * 1.0E0 / tn AS pi FROM tot),
pt AS (SELECT c.impression, c.article, c.y, c.topic, count(a.premises) AS fired,
  CASE WHEN count(a.premises) = 0 THEN min(pi) ELSE sum(a.size * (pi + a.confidence * (a.strength - pi))) / sum(a.size) END AS score
  FROM cases c LEFT JOIN act a ON a.impression = c.impression AND a.article = c.article, pi GROUP BY 1, 2, 3, 4)"""


@query("jn_rule_activation", f"{POINTS} SELECT impression, article, count(*) AS fired, string_agg(premises, '; ' ORDER BY premises) AS rules FROM act GROUP BY 1, 2")
def rule_activation(v: Views) -> DataFrame:
    """Active rules of each case; the SQL divides facts by premises with joins."""
    rows = ranking.activate(mining.cases(v), ranking.serving_rules(v)).where(F.size("active") > 0)
    return rows.select("impression", "article", F.size("active").alias("fired"), F.array_join(F.array_sort(F.transform("active", lambda r: r["premises"])), "; ").alias("rules"))


_NO_HISTORY = "history = 'cold' AND (p.premises LIKE '%affinity=%' OR p.premises LIKE '%recent_count=%')"


@query("jn_rule_population", f"{POINTS}, po AS (SELECT p.premises, count(*) FILTER ({_NO_HISTORY}) AS inapplicable, count(*) FILTER (NOT ({_NO_HISTORY}) AND a.premises IS NOT NULL) AS matched, count(*) AS n FROM sel p CROSS JOIN cases c LEFT JOIN act a ON a.premises = p.premises AND a.impression = c.impression AND a.article = c.article GROUP BY 1) SELECT premises, matched, n - matched - inapplicable AS unmatched, inapplicable FROM po")
def rule_population(v: Views) -> DataFrame:
    """Matched, unmatched and inapplicable cases of each rule: what a rule says of the history has no truth for a user without one."""
    rules = ranking.serving_rules(v)
    rows = ranking.activate(mining.cases(v), rules).withColumn("cold", F.col("history") == "cold")
    matched = rows.select("cold", F.explode("active.premises").alias("premises")).groupBy("premises").agg(F.count("*").alias("all"), F.count_if(~F.col("cold")).alias("known"))
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("cold")).alias("cold"))
    out = rules.select("premises").join(matched, "premises", "left").join(F.broadcast(n)).fillna(0, ["all", "known"])
    of_history = F.col("premises").rlike("affinity=|recent_count=")
    out = out.select("premises", F.when(of_history, F.col("known")).otherwise(F.col("all")).alias("matched"), F.when(of_history, F.col("cold")).otherwise(F.lit(0).cast("bigint")).alias("inapplicable"), "n")
    return out.select("premises", "matched", (F.col("n") - F.col("matched") - F.col("inapplicable")).alias("unmatched"), "inapplicable")


@query("rank_point", f"{POINTS} SELECT impression, article, fired, {R6('score')} AS score FROM pt")
def rank_point(v: Views) -> DataFrame:
    return ranking.points(v).select("impression", "article", "fired", r6(F.col("score")).alias("score"))


@query("prf_point_active", f"{POINTS} SELECT count(*) AS cases, count(*) FILTER (fired = 0) AS without_proof, sum(fired)::BIGINT AS proofs FROM pt")
def point_active(v: Views) -> DataFrame:
    return ranking.points(v).agg(F.count("*").alias("cases"), F.count_if(F.col("fired") == 0).alias("without_proof"), F.sum("fired").alias("proofs"))


@query("prf_parity", f"{POINTS} SELECT count(*) AS cases, {R6('avg(score)')} AS mean_score FROM pt")
def parity(v: Views) -> DataFrame:
    return ranking.points(v).agg(F.count("*").alias("cases"), r6(F.avg("score")).alias("mean_score"))


@query("prf_case_identity", f"{POINTS}, k AS (SELECT impression, article, string_agg(premises, '; ' ORDER BY premises) AS rules FROM act GROUP BY 1, 2) SELECT sha256(rules) AS identity, count(*) AS cases FROM k GROUP BY 1")
def case_identity(v: Views) -> DataFrame:
    """Cases with one set of active rules share a proof; the identity is the set's digest."""
    return rule_activation(v).groupBy(F.sha2("rules", 256).alias("identity")).agg(F.count("*").alias("cases"))


_PRIORS = ", pr AS (SELECT topic, (sum(y) + 1.0E0) / (count(*) + 10) AS prior FROM cases GROUP BY 1)"
_POINT_ORDER = "ORDER BY floor(score * 1e6 + 0.5) DESC, floor(prior * 1e6 + 0.5) DESC, article"


@query("rank_tiebreak", f"{POINTS}{_PRIORS} SELECT impression, article, row_number() OVER (PARTITION BY impression {_POINT_ORDER}) AS place FROM pt JOIN pr USING (topic)")
def tiebreak(v: Views) -> DataFrame:
    p = ranking.points(v)
    prior = p.groupBy("topic").agg(((F.sum("y") + 1.0) / (F.count("*") + 10)).alias("prior"))
    place = F.row_number().over(Window.partitionBy("impression").orderBy(grid(F.col("score")).desc(), grid(F.col("prior")).desc(), "article"))
    return p.join(prior, "topic").select("impression", "article", place.alias("place"))


# Skips of a user's earlier impressions: the latest 20 for the same article, the latest 5 for its subcategory or topic.
_SKIPS = POINTS + """,
sk AS (SELECT i.o_orderkey AS impression, c.article, row_number() OVER (PARTITION BY i.o_orderkey ORDER BY c.ts DESC, c.impression DESC, c.position DESC) AS r
  FROM orders i JOIN exposures c ON c.usr = i.o_custkey AND c.click = 0 AND (c.ts < i.o_orderdate OR (c.ts = i.o_orderdate AND c.impression < i.o_orderkey))),
mt AS (SELECT e.impression, e.article, coalesce(bool_or(s.article = e.article), false) AS exact, coalesce(bool_or(s.r <= 5 AND b.subcategory = a.subcategory), false) AS sub, coalesce(bool_or(s.r <= 5 AND b.topic = a.topic), false) AS kin
  FROM exposures e JOIN articles a USING (article) LEFT JOIN sk s ON s.impression = e.impression AND s.r <= 20 LEFT JOIN articles b ON b.article = s.article GROUP BY 1, 2)"""
_LEVEL = "CASE WHEN exact THEN 'exact' WHEN sub THEN 'subcategory' WHEN kin THEN 'topic' ELSE 'none' END"
_NEG = "CASE WHEN exact THEN 0.95E0 WHEN sub THEN 0.80E0 WHEN kin THEN 0.65E0 ELSE 0.0E0 END"


def skip_matches(v: Views) -> DataFrame:
    """impression, article and whether the user's latest skips hold the article, its subcategory or its topic."""
    past = v.past(0, 20).select("impression", "past")
    late = F.when(F.size("past") > 5, F.slice("past", -5, 5)).otherwise(F.col("past"))
    item = v.articles().select("article", "subcategory", F.col("topic").alias("of"))
    kinds = past.select("impression", F.explode(late).alias("article")).join(item, "article").groupBy("impression").agg(F.collect_set("subcategory").alias("subs"), F.collect_set("of").alias("topics"))
    rows = v.candidates().select("impression", "article").join(item, "article").join(past, "impression", "left").join(kinds, "impression", "left")
    held = lambda c, x: F.coalesce(F.array_contains(c, F.col(x)), F.lit(False))
    return rows.select("impression", "article", held("past", "article").alias("exact"), held("subs", "subcategory").alias("sub"), held("topics", "of").alias("kin"))


@query("prf_live_negative", f"{_SKIPS} SELECT impression, article, {_LEVEL} AS level, {_NEG} AS confidence FROM mt")
def live_negative(v: Views) -> DataFrame:
    """The proof that a user's skips give against each candidate: none, or by topic, subcategory or the very article."""
    return skip_matches(v).select("impression", "article", F.expr(_LEVEL).alias("level"), F.expr(_NEG).cast("double").alias("confidence"))


def feedback_points(v: Views) -> DataFrame:
    """Point scores, lowered by the confidence of the skips' proof (of strength 0)."""
    m = skip_matches(v).select("impression", "article", F.expr(_NEG).cast("double").alias("against"))
    return ranking.points(v).join(m, ["impression", "article"]).withColumn("score", F.col("score") + F.col("against") * (0.0 - F.col("score")))


_LOWERED = f"{_SKIPS}, fb AS (SELECT pt.impression, pt.article, score + ({_NEG}) * (0.0E0 - score) AS score FROM pt JOIN mt ON mt.impression = pt.impression AND mt.article = pt.article)"


@query("rank_point_feedback", f"{_LOWERED} SELECT impression, article, {R6('score')} AS score FROM fb")
def point_feedback(v: Views) -> DataFrame:
    return feedback_points(v).select("impression", "article", r6(F.col("score")).alias("score"))


@query("st_feedback_rerank", f"{_LOWERED} SELECT impression, article, row_number() OVER (PARTITION BY impression ORDER BY floor(score * 1e6 + 0.5) DESC, article) AS place FROM fb")
def feedback_rerank(v: Views) -> DataFrame:
    """Slates ranked anew by the scores that the skips have lowered."""
    place = F.row_number().over(Window.partitionBy("impression").orderBy(grid(F.col("score")).desc(), "article"))
    return feedback_points(v).select("impression", "article", place.alias("place"))


# --- pairs -------------------------------------------------------------------------------------

_REV = "CASE WHEN {x} LIKE 'left%' THEN 'right' || substr({x}, 5) WHEN {x} LIKE 'right%' THEN 'left' || substr({x}, 6) ELSE {x} END"
PAIRS = _JOINED + f""",
pp AS (SELECT l_impression AS impression, l_article, r_article, l_position, r_position, {_PAIR_SQL['pair_long_affinity']} AS structured, {_PAIR_SQL['pair_recency']} AS recency FROM prs),
pf AS (SELECT impression, l_article, r_article, l_position, r_position, 'structured' AS family, structured AS value FROM pp UNION ALL SELECT impression, l_article, r_article, l_position, r_position, 'recency', recency FROM pp),
lab AS (SELECT f.*, a.click AS lc, b.click AS rc FROM pf f JOIN exposures a ON a.impression = f.impression AND a.article = f.l_article JOIN exposures b ON b.impression = f.impression AND b.article = f.r_article),
ori AS (SELECT family, value, lc AS y FROM lab WHERE lc <> rc UNION ALL SELECT family, {_REV.format(x='value')}, rc FROM lab WHERE lc <> rc),
pr AS (SELECT family, value, count(*) AS n, sum(y)::BIGINT AS ny, greatest(1e-9, least(1 - 1e-9, 0.5 + count(*) / (count(*) + 800.0E0) * (sum(y) * 1.0E0 / count(*) - 0.5))) AS p FROM ori GROUP BY 1, 2),
mg AS (SELECT family, value, ln(p / (1 - p)) AS margin FROM pr),
pm AS (SELECT f.impression, f.l_article, f.r_article, f.l_position, f.r_position, f.family, coalesce(a.margin, 0) - coalesce(b.margin, 0) AS margin FROM pf f LEFT JOIN mg a ON a.family = f.family AND a.value = f.value LEFT JOIN mg b ON b.family = f.family AND b.value = {_REV.format(x='f.value')}),
vt AS (SELECT impression, family, article, sum(m) AS margin, count(*) AS comparisons FROM (SELECT impression, family, l_article AS article, margin AS m FROM pm UNION ALL SELECT impression, family, r_article, -margin FROM pm) GROUP BY 1, 2, 3),
gr AS (SELECT *, floor(margin / comparisons * 1e6 + 0.5) AS g FROM vt),
md AS (SELECT *, 1 - (rank() OVER (PARTITION BY impression, family ORDER BY g DESC) - 1 + (count(*) OVER (PARTITION BY impression, family, g) - 1) / 2.0E0) / greatest(count(*) OVER (PARTITION BY impression, family) - 1, 1) AS mid FROM gr),
bal AS (SELECT impression, article, avg(mid) AS score FROM md GROUP BY 1, 2)"""


@query("prf_pair_active", f"{PAIRS} SELECT family, value, n, ny, {R6('ln(p / (1 - p))')} AS margin FROM pr")
def pair_active(v: Views) -> DataFrame:
    return ranking.pair_rules(ranking.pairs(v)).select("family", "value", "n", "ny", r6(F.col("margin")).alias("margin"))


@query("jn_proof_lookup", f"{PAIRS} SELECT f.family, f.value, count(*) AS pairs, {R6('min(coalesce(a.margin, 0))')} AS margin FROM pf f LEFT JOIN mg a USING (family, value) GROUP BY 1, 2")
def proof_lookup(v: Views) -> DataFrame:
    p = ranking.pairs(v)
    rules = ranking.pair_rules(p).select("family", "value", "margin")
    rows = p.select(F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.col(f).alias("value")) for f in ranking.FAMILIES))).alias("x")).select("x.*").groupBy("family", "value").agg(F.count("*").alias("pairs"))
    return rows.join(rules, ["family", "value"], "left").select("family", "value", "pairs", r6(F.coalesce("margin", F.lit(0.0))).alias("margin"))


@query("prf_dependency_max", f"{PAIRS} SELECT impression, l_article, r_article, max_by(family, (floor(abs(margin) * 1e6 + 0.5), family)) AS family FROM pm GROUP BY 1, 2, 3")
def dependency_max(v: Views) -> DataFrame:
    """The family with the largest absolute margin of each pair, ties by name."""
    m = ranking.pair_margins(v)
    return m.groupBy("impression", "l_article", "r_article").agg(F.max_by("family", F.struct(grid(F.abs("margin")), F.col("family"))).alias("family"))


@query("rank_pair_margin", f"{PAIRS} SELECT impression, article, family, {R6('margin')} AS margin, comparisons FROM vt")
def pair_margin(v: Views) -> DataFrame:
    return ranking.votes(ranking.pair_margins(v)).select("impression", "article", "family", r6(F.col("margin")).alias("margin"), "comparisons")


@query("rank_family", f"{PAIRS} SELECT family, count(*) AS votes, count(*) FILTER (margin > 1e-9) AS favourable FROM vt GROUP BY 1")
def family(v: Views) -> DataFrame:
    return ranking.votes(ranking.pair_margins(v)).groupBy("family").agg(F.count("*").alias("votes"), F.count_if(F.col("margin") > 1e-9).alias("favourable"))


@query("rank_family_norm", f"{PAIRS} SELECT impression, article, family, {R6('0.5 + 0.5 * margin / comparisons')} AS score FROM vt")
def family_norm(v: Views) -> DataFrame:
    return ranking.votes(ranking.pair_margins(v)).select("impression", "article", "family", r6(F.lit(0.5) + 0.5 * F.col("margin") / F.col("comparisons")).alias("score"))


@query("win_midrank", f"{PAIRS} SELECT impression, article, family, {R6('mid')} AS midrank FROM md")
def win_midrank(v: Views) -> DataFrame:
    t = ranking.votes(ranking.pair_margins(v)).withColumn("g", grid(F.col("margin") / F.col("comparisons")))
    return t.select("impression", "article", "family", r6(midrank(F.col("g"), "impression", "family")).alias("midrank"))


@query("rank_balanced", f"{PAIRS} SELECT impression, article, {R6('score')} AS score FROM bal")
def rank_balanced(v: Views) -> DataFrame:
    return ranking.balanced(v).select("impression", "article", r6(F.col("score")).alias("score"))


@query("win_slate_rank", f"{PAIRS} SELECT impression, article, row_number() OVER (PARTITION BY impression ORDER BY floor(score * 1e6 + 0.5) DESC, article) AS place FROM bal")
def slate_rank(v: Views) -> DataFrame:
    return ranking.balanced(v).select("impression", "article", F.row_number().over(Window.partitionBy("impression").orderBy(grid(F.col("score")).desc(), "article")).alias("place"))


@query("rank_coverage", f"{PAIRS} SELECT impression, count(*) AS pairs, {R6('count(*) FILTER (abs(margin) > 1e-9) * 1.0E0 / count(*)')} AS directional FROM pm GROUP BY 1")
def coverage(v: Views) -> DataFrame:
    m = ranking.pair_margins(v)
    return m.groupBy("impression").agg(F.count("*").alias("pairs"), r6(F.count_if(F.abs("margin") > 1e-9) / F.count("*")).alias("directional"))


@query("rank_replay", f"{PAIRS} SELECT impression, article, {R6('sum(m)')} AS margin FROM (SELECT impression, l_article AS article, margin AS m FROM pm WHERE l_position > 0 UNION ALL SELECT impression, r_article, -margin FROM pm WHERE l_position > 0) GROUP BY 1, 2")
def replay(v: Views) -> DataFrame:
    """Re-rank what is left of a slate after its first candidate went, from the proved pairs."""
    m = ranking.pair_margins(v).where("l_position > 0")
    return ranking.votes(m).groupBy("impression", "article").agg(r6(F.sum("margin")).alias("margin"))


@query("win_queue_delta", f"{PAIRS}, a AS (SELECT impression, article, row_number() OVER (PARTITION BY impression ORDER BY floor(score * 1e6 + 0.5) DESC, article) AS before FROM bal) SELECT a.impression, a.article, before - (e.position + 1) AS moved FROM a JOIN exposures e ON e.impression = a.impression AND e.article = a.article")
def queue_delta(v: Views) -> DataFrame:
    """Places moved from the source order to the ranked order."""
    r = slate_rank(v).join(v.exposures().select("impression", "article", "position"), ["impression", "article"])
    return r.select("impression", "article", (F.col("place") - (F.col("position") + 1)).alias("moved"))


@query("ev_relational_audit", f"{POINTS} SELECT premises, count(*) AS activations, sum(c.y)::BIGINT AS clicks FROM act a JOIN cases c ON c.impression = a.impression AND c.article = a.article GROUP BY 1")
def relational_audit(v: Views) -> DataFrame:
    rows = ranking.activate(mining.cases(v), ranking.serving_rules(v)).select("y", F.explode("active.premises").alias("premises"))
    return rows.groupBy("premises").agg(F.count("*").alias("activations"), F.sum("y").alias("clicks"))


@query("rank_score_api", f"{POINTS} SELECT impression, string_agg(article::VARCHAR, ',' ORDER BY floor(score * 1e6 + 0.5) DESC, article) AS page FROM pt GROUP BY 1")
def score_api(v: Views) -> DataFrame:
    """Each slate as one ordered page of candidates."""
    p = ranking.points(v).groupBy("impression").agg(F.array_sort(F.collect_list(F.struct((-grid(F.col("score"))).alias("a"), F.col("article").alias("b")))).alias("x"))
    return p.select("impression", F.array_join(F.transform("x", lambda i: i["b"].cast("string")), ",").alias("page"))
