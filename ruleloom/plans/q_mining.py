"""Queries of rule mining and calibration."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import text, truth
from ruleloom.operators import conditional as conditional_mining
from ruleloom.operators import incremental, mining
from ruleloom.operators.mining import MIN_SUPPORT, PREDICATES
from ruleloom.plans import q_scalars
from ruleloom.plans.registry import query
from ruleloom.plans.views import FEATURES, R6, Views, r6
from ruleloom.session import shared_folder, stored

CASES = FEATURES + """,
cases AS (SELECT impression, article, ts, click AS y, """ + ", ".join(f"{x} AS {p}" for p, x in PREDICATES.items()) + """ FROM feat),
facts AS (""" + " UNION ALL ".join(f"SELECT impression, article, ts, y, '{p}' AS predicate, {p} AS value FROM cases" for p in PREDICATES) + """),
tot AS (SELECT count(*) AS tn, sum(y) AS ty FROM cases),
c1 AS (SELECT predicate || '=' || value AS premises, 1 AS size, count(*) AS n, sum(y)::BIGINT AS ny FROM facts GROUP BY 1, 2),
c2 AS (SELECT a.predicate || '=' || a.value || ' & ' || b.predicate || '=' || b.value AS premises, 2 AS size, count(*) AS n, sum(a.y)::BIGINT AS ny
  FROM facts a JOIN facts b ON a.impression = b.impression AND a.article = b.article AND a.predicate < b.predicate GROUP BY 1, 2)"""


def _branches(source: str) -> str:
    return f"""SELECT premises, size, n, ny, ty, tn, ny * 1.0E0 / n AS strength, n / (n + 800.0E0) AS confidence,
      CASE WHEN tn > n THEN (ty - ny) * 1.0E0 / (tn - n) ELSE 0 END AS negative_strength, (tn - n) / (tn - n + 800.0E0) AS negative_confidence FROM {source}, tot"""


def _rules_sql(sources: list[str], where: str = f"ny >= {MIN_SUPPORT}", more: str = "") -> str:
    union = " UNION ALL ".join(f"SELECT * FROM {s}" for s in sources)
    shown = ", ".join(f"{R6(c)} AS {c}" for c in ("strength", "confidence", "negative_strength", "negative_confidence"))
    return f"{CASES}, allc AS ({union}), rules AS ({_branches('allc')}) SELECT premises, size, n, ny, {shown}{more} FROM rules WHERE {where}"


@query("mine_frequency_d2", _rules_sql(["c1"]))
def frequency_d2(v: Views) -> DataFrame:
    """Which single-feature rules predict a click, with what two-branch truth value."""
    return mining.rules_out(mining.mine(mining.cases(v), 1))


@query("mine_frequency", _rules_sql(["c1", "c2"]))
@query("mine_frequency_d3", _rules_sql(["c1", "c2"]))
def frequency_d3(v: Views) -> DataFrame:
    return mining.rules_out(mining.mine(mining.cases(v), 2))


@query("mine_candidates", f"{CASES} SELECT predicate, value, count(*) AS support FROM facts GROUP BY 1, 2 HAVING count(*) >= {MIN_SUPPORT}")
def candidates(v: Views) -> DataFrame:
    return mining.facts(mining.cases(v), ["y"]).groupBy("predicate", "value").agg(F.count("*").alias("support")).where(F.col("support") >= MIN_SUPPORT)


@query("agg_support", f"{CASES} SELECT premises, n AS support FROM c1 UNION ALL SELECT premises, n FROM c2")
def support(v: Views) -> DataFrame:
    return mining.contingency(mining.cases(v), 2).select("premises", F.col("n").alias("support"))


@query("mine_combinations", f"{CASES} SELECT premises, size, ny FROM c2 UNION ALL SELECT premises, size, ny FROM c1")
def combinations(v: Views) -> DataFrame:
    return mining.contingency(mining.cases(v), 2).select("premises", "size", "ny")


@query("mine_target_filter", f"{CASES} SELECT premises, ny AS support FROM c2 WHERE ny >= 50")
def target_filter(v: Views) -> DataFrame:
    return mining.contingency(mining.cases(v), 2).where("size = 2 and ny >= 50").select("premises", F.col("ny").alias("support"))


@query("agg_contingency", f"{CASES} SELECT premises, n AS n_a, ny AS n_ay, tn AS n, ty::BIGINT AS n_y, tn - n AS n_not_a, (ty - ny)::BIGINT AS n_not_a_y FROM c1, tot")
def contingency(v: Views) -> DataFrame:
    c = mining.contingency(mining.cases(v), 1)
    return c.select("premises", F.col("n").alias("n_a"), F.col("ny").alias("n_ay"), F.col("total_n").alias("n"), F.col("total_ny").alias("n_y"), (F.col("total_n") - F.col("n")).alias("n_not_a"), (F.col("total_ny") - F.col("ny")).alias("n_not_a_y"))


_QUALITY = "confidence * abs(strength - ty * 1.0E0 / tn) * (1 + 0.25E0 * (size - 1)) * ln(1 + n)"


@query("agg_point_ctv", _rules_sql(["c1", "c2"], more=f", {R6('CASE WHEN ty > 0 THEN strength / (ty * 1.0E0 / tn) ELSE 0 END')} AS lift, {R6(_QUALITY)} AS quality"))
def point_ctv(v: Views) -> DataFrame:
    c = mining.mine(mining.cases(v), 2)
    base = F.col("total_ny") / F.col("total_n")
    lift = F.when(F.col("total_ny") > 0, F.col("strength") / base).otherwise(0.0)
    return c.select("premises", "size", "n", "ny", *(r6(F.col(x)).alias(x) for x in ("strength", "confidence", "negative_strength", "negative_confidence")), r6(lift).alias("lift"), r6(mining.quality(base)).alias("quality"))


def _rounded_quality(c: DataFrame) -> DataFrame:
    return c.withColumn("q", F.floor(mining.quality(F.col("total_ny") / F.col("total_n")) * 1e6 + 0.5))


_RANKED = f"{CASES}, allc AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2), rules AS ({_branches('allc')}), q AS (SELECT *, floor({_QUALITY} * 1e6 + 0.5) AS q FROM rules WHERE ny >= {MIN_SUPPORT})"


@query("mine_quality", f"{_RANKED} SELECT premises, q / 1e6 AS quality, row_number() OVER (ORDER BY q DESC, size DESC, n DESC, premises) AS place FROM q")
def quality(v: Views) -> DataFrame:
    c = _rounded_quality(mining.mine(mining.cases(v), 2))
    return c.select("premises", (F.col("q") / 1e6).alias("quality"), F.row_number().over(Window.orderBy(F.col("q").desc(), F.col("size").desc(), F.col("n").desc(), "premises")).alias("place"))


@query("mine_rule_order", f"{_RANKED} SELECT premises, row_number() OVER (ORDER BY n DESC, floor(strength * 1e6 + 0.5) DESC, premises) AS place FROM q")
def rule_order(v: Views) -> DataFrame:
    c = mining.mine(mining.cases(v), 2)
    return c.select("premises", F.row_number().over(Window.orderBy(F.col("n").desc(), F.floor(F.col("strength") * 1e6 + 0.5).desc(), "premises")).alias("place"))


_TOP = f"""{_RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY q DESC, n DESC, premises) AS d FROM q),
f AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN d <= 10 THEN 0 ELSE 1 END, q DESC, size DESC, n DESC, premises) AS k FROM r)
SELECT premises, size, q / 1e6 AS quality FROM f WHERE k <= 30"""


def top_rules(c: DataFrame, quota: int = 10, limit: int = 30) -> DataFrame:
    """The best rules: a quota for each depth first, the rest filled up by quality."""
    c = _rounded_quality(c).withColumn("d", F.row_number().over(Window.partitionBy("size").orderBy(F.col("q").desc(), F.col("n").desc(), "premises")))
    return c.orderBy((F.col("d") > quota).cast("int"), F.col("q").desc(), F.col("size").desc(), F.col("n").desc(), "premises").limit(limit)


@query("top_rules_point", _TOP)
def top_rules_point(v: Views) -> DataFrame:
    return top_rules(mining.mine(mining.cases(v), 2)).select("premises", "size", (F.col("q") / 1e6).alias("quality"))


@query("flt_vocabulary", f"{CASES}, n AS (SELECT predicate, value, count(*) AS n FROM facts GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY n DESC, value) AS r FROM n) SELECT f.predicate, CASE WHEN k.r <= 3 AND k.n >= 16 THEN f.value ELSE 'other' END AS value, count(*) AS n FROM facts f JOIN k ON k.predicate = f.predicate AND k.value = f.value GROUP BY 1, 2")
def vocabulary(v: Views) -> DataFrame:
    """The three commonest values of a predicate stay, ties by value; the others become one symbol."""
    f = mining.facts(mining.cases(v), ["y"])
    n = f.groupBy("predicate", "value").agg(F.count("*").alias("n"))
    kept = n.withColumn("r", F.row_number().over(Window.partitionBy("predicate").orderBy(F.col("n").desc(), "value"))).where("r <= 3 and n >= 16").select("predicate", "value", F.col("value").alias("kept"))
    return f.join(kept, ["predicate", "value"], "left").groupBy("predicate", F.coalesce("kept", F.lit("other")).alias("value")).agg(F.count("*").alias("n"))


@query("top_vocab", f"{CASES}, n AS (SELECT predicate, value, count(*) AS n FROM facts GROUP BY 1, 2) SELECT predicate, value, n, row_number() OVER (PARTITION BY predicate ORDER BY n DESC, value) AS place FROM n")
def top_vocab(v: Views) -> DataFrame:
    n = mining.facts(mining.cases(v), ["y"]).groupBy("predicate", "value").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("predicate").orderBy(F.col("n").desc(), "value")))


@query("flt_context", "SELECT doc_id, predicate, value FROM (SELECT doc_id, 'lang' AS predicate, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE source END FROM documents UNION ALL SELECT doc_id, 'head', CASE WHEN doc_id % 5 = 0 THEN '' ELSE substr(text, 1, 200) END FROM documents) WHERE value IS NOT NULL AND value NOT IN ('', 'unknown')")
def context(v: Views) -> DataFrame:
    """Known features only, as text cut to 200 characters; NULL, empty and unknown ones go."""
    d = v.table("documents").select("doc_id", "lang", F.when(F.col("doc_id") % 7 == 0, "unknown").otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.substring("text", 1, 200)).alias("head"))
    return d.unpivot(["doc_id"], ["lang", "source", "head"], "predicate", "value").where("value is not null and value not in ('', 'unknown')")


# --- macro calibration -------------------------------------------------------------------------

_MACRO = CASES + """,
per AS (SELECT impression, count(*) AS rows, sum(y) AS ys FROM cases GROUP BY 1),
atoms AS (SELECT DISTINCT predicate, value FROM facts),
mass AS (SELECT a.predicate || '=' || a.value AS premises, p.impression, coalesce(m.n, 0) * 1.0E0 / p.rows AS a, coalesce(m.ny, 0) * 1.0E0 / p.rows AS ay, (p.rows - coalesce(m.n, 0)) * 1.0E0 / p.rows AS b, (p.ys - coalesce(m.ny, 0)) * 1.0E0 / p.rows AS byy
  FROM atoms a CROSS JOIN per p LEFT JOIN (SELECT impression, predicate, value, count(*) AS n, sum(y) AS ny FROM facts GROUP BY 1, 2, 3) m ON m.impression = p.impression AND m.predicate = a.predicate AND m.value = a.value),
mac AS (SELECT premises, sum(ay) / sum(a) AS strength, sum(a) * sum(a) / sum(a * a) AS effective, sum(byy) / sum(b) AS negative_strength, sum(b) * sum(b) / sum(b * b) AS neff, sum(a) / count(*) AS coverage FROM mass GROUP BY 1)"""


@query("agg_ctv_macro", f"{_MACRO} SELECT premises, {R6('strength')} AS strength, {R6('effective')} AS effective, {R6('effective / (effective + 800.0E0)')} AS confidence, {R6('negative_strength')} AS negative_strength, {R6('neff / (neff + 800.0E0)')} AS negative_confidence, {R6('coverage')} AS coverage FROM mac")
def ctv_macro(v: Views) -> DataFrame:
    """The SQL takes every rule for every impression; the engine adds unmatched impressions by count."""
    m = mining.macro(mining.cases(v))
    return m.select("premises", *(r6(F.col(c)).alias(c) for c in m.columns[1:]))


@query("agg_kish", f"{_MACRO} SELECT premises, {R6('effective')} AS effective, {R6('coverage')} AS coverage FROM mac")
def kish(v: Views) -> DataFrame:
    return ctv_macro(v).select("premises", "effective", "coverage")


_FOLD = CASES + """,
sl AS (SELECT impression, min(ts) AS ts, count(*) AS n FROM cases GROUP BY 1),
fo AS (SELECT impression, least(2, floor(3 * (sum(n) OVER (ORDER BY ts, impression) - n) / (sum(n) OVER ()))::INT) AS fold FROM sl),
base AS (SELECT fold, avg(y) AS base FROM cases JOIN fo USING (impression) GROUP BY 1),
fe AS (SELECT predicate || '=' || value AS premises, fold, count(*) AS n, avg(f.y) - min(base) AS effect FROM facts f JOIN fo USING (impression) JOIN base USING (fold) GROUP BY 1, 2)"""


@query("win_temporal_fold", f"{_FOLD} SELECT impression, fold FROM fo")
def temporal_fold(v: Views) -> DataFrame:
    return mining.folds(v)


def fold_effects(v: Views) -> DataFrame:
    rows = mining.cases(v).join(mining.folds(v), "impression")
    base = rows.groupBy("fold").agg(F.avg("y").alias("base"))
    atoms = rows.select("fold", "y", F.explode(F.array(*map(mining.premise, PREDICATES))).alias("premises"))
    return atoms.groupBy("premises", "fold").agg(F.count("*").alias("n"), F.avg("y").alias("p")).join(F.broadcast(base), "fold").select("premises", "fold", "n", (F.col("p") - F.col("base")).alias("effect"))


@query("agg_fold_effects", f"{_FOLD} SELECT premises, fold, n, {R6('effect')} AS effect, {R6('min(effect) OVER (PARTITION BY premises)')} AS stable FROM fe")
def agg_fold_effects(v: Views) -> DataFrame:
    stable = F.min("effect").over(Window.partitionBy("premises"))
    return fold_effects(v).select("premises", "fold", "n", r6(F.col("effect")).alias("effect"), r6(stable).alias("stable"))


#: Least effect in the worst fold; predicates whose values are categories need all three folds, others two.
MIN_EFFECT, CATEGORIES = 0.03, ("topic",)


_EFFECT = "c.ny * 1.0E0 / c.n - ty * 1.0E0 / tn"


@query("mine_gates", f"""{_FOLD}, ff AS (SELECT * FROM fe WHERE n >= {MIN_SUPPORT} / 3.0E0),
ga AS (SELECT c.premises, min(c.n) AS n, count(ff.fold) AS folds, min({_EFFECT}) AS effect, min(ff.effect) AS stable, CASE WHEN split_part(c.premises, '=', 1) = 'topic' THEN 3 ELSE 2 END AS needed FROM c1 c LEFT JOIN ff ON ff.premises = c.premises, tot GROUP BY c.premises),
gb AS (SELECT *, n >= {MIN_SUPPORT} AS supported, effect > 0 AS positive, folds >= needed AS spread, coalesce(stable >= {MIN_EFFECT}::DOUBLE, false) AS steady FROM ga)
SELECT premises, n, folds, {R6('effect')} AS effect, {R6('stable')} AS stable, supported, positive, spread, steady, supported AND positive AND spread AND steady AS passed FROM gb""")
def gates(v: Views) -> DataFrame:
    """Every rule with its gates: support, a positive effect over all cases, and an effect of MIN_EFFECT in each of enough
    folds (those that hold a third of the least support); ``passed`` takes all of them."""
    one = mining.contingency(mining.cases(v), 1)
    g = fold_effects(v).where(F.col("n") >= MIN_SUPPORT / 3).groupBy("premises").agg(F.count("*").alias("folds"), F.min("effect").alias("stable"))
    needed = F.when(F.split("premises", "=")[0].isin(*CATEGORIES), 3).otherwise(2)
    rows = one.join(g, "premises", "left").fillna(0, ["folds"]).withColumn("effect", F.col("ny") / F.col("n") - F.col("total_ny") / F.col("total_n"))
    rows = rows.withColumns({"supported": F.col("n") >= MIN_SUPPORT, "positive": F.col("effect") > 0, "spread": F.col("folds") >= needed, "steady": F.coalesce(F.col("stable") >= MIN_EFFECT, F.lit(False))})
    return rows.select("premises", "n", "folds", r6(F.col("effect")).alias("effect"), r6(F.col("stable")).alias("stable"), "supported", "positive", "spread", "steady", F.expr("supported and positive and spread and steady").alias("passed"))


# --- pairs -------------------------------------------------------------------------------------

_PN = FEATURES + """,
pn AS (SELECT p.impression, p.article AS clicked, n.article AS other, p.topic AS ct, n.topic AS ot FROM feat p JOIN feat n ON p.impression = n.impression AND p.click = 1 AND n.click = 0)"""


def pos_neg(v: Views) -> DataFrame:
    """Every clicked x other candidate of a slate; a slate's size bounds its pairs."""
    f = v.candidates()
    p = f.where("click = 1").select("impression", F.col("article").alias("clicked"))
    return p.join(f.where("click = 0").select("impression", F.col("article").alias("other")), "impression")


@query("jn_pos_neg_pairs", f"{_PN} SELECT impression, clicked AS l_article, other AS r_article, 1 AS y FROM pn UNION ALL SELECT impression, other, clicked, 0 FROM pn")
def pos_neg_pairs(v: Views) -> DataFrame:
    p = pos_neg(v)
    both = p.select("impression", F.col("clicked").alias("l_article"), F.col("other").alias("r_article"), F.lit(1).alias("y"))
    return both.unionByName(p.select("impression", F.col("other").alias("l_article"), F.col("clicked").alias("r_article"), F.lit(0).alias("y")))


@query("mine_pair_cases", f"{_PN} SELECT impression, clicked, other, {R6('1.0E0 / (2 * count(*) OVER (PARTITION BY impression))')} AS weight FROM pn")
def pair_cases(v: Views) -> DataFrame:
    """Both orientations share the slate's unit mass; the weight follows from counts, before the join."""
    p = pos_neg(v)
    n = v.candidates().groupBy("impression").agg((F.sum("click") * (F.count("*") - F.sum("click"))).alias("n"))
    return p.join(n, "impression").select("impression", "clicked", "other", r6(F.lit(1.0) / (2 * F.col("n"))).alias("weight"))


@query("jn_unordered_pairs", f"{FEATURES} SELECT a.impression, a.article AS l_article, b.article AS r_article FROM feat a JOIN feat b ON a.impression = b.impression AND a.position < b.position")
def unordered_pairs(v: Views) -> DataFrame:
    p = q_scalars.slate_pairs(v.exposures().select("impression", "article", "position"))
    return p.select(F.col("l_impression").alias("impression"), "l_article", "r_article")


# --- quantiles ---------------------------------------------------------------------------------


def _cuts_sql(source: str) -> str:
    return f"""{FEATURES}, vals AS ({source}), d AS (SELECT value, sum(weight) AS w FROM vals GROUP BY 1),
c AS (SELECT value, sum(w) OVER (ORDER BY value) AS cum, lead(value) OVER (ORDER BY value) AS nxt, row_number() OVER (ORDER BY value) AS i, sum(w) OVER () AS total FROM d),
t AS (SELECT c.*, k, floor(abs(cum - total * k / 4) * 1e6 + 0.5) AS gap FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE nxt IS NOT NULL),
r AS (SELECT k, nxt AS cut, row_number() OVER (PARTITION BY k ORDER BY gap, i) AS r FROM t)"""


_UNIT = "SELECT known AS value, 1.0E0 AS weight FROM feat"
_BY_SLATE = "SELECT known + position AS value, 1.0E0 / count(*) OVER (PARTITION BY impression) AS weight FROM feat"


@query("mine_quantile_fit", f"{_cuts_sql(_UNIT)} SELECT k, cut FROM r WHERE r = 1")
def quantile_fit(v: Views) -> DataFrame:
    return mining.quantile_cuts(v.features().select(F.col("known").alias("value"), F.lit(1.0).alias("weight")), 4)


def _slate_values(v: Views) -> DataFrame:
    f = v.features()
    return f.select("impression", "article", (F.col("known") + F.col("position")).alias("value"), (F.lit(1.0) / F.count("*").over(Window.partitionBy("impression"))).alias("weight"))


@query("mine_quantile_weights", f"{_cuts_sql(_BY_SLATE)} SELECT k, cut FROM r WHERE r = 1")
def quantile_weights(v: Views) -> DataFrame:
    return mining.quantile_cuts(_slate_values(v), 4)


@query("mine_quantile_apply", f"{_cuts_sql(_UNIT)} SELECT impression, article, 'q' || (1 + (SELECT count(DISTINCT cut) FROM r WHERE r = 1 AND cut <= known)) AS symbol FROM feat")
def quantile_apply(v: Views) -> DataFrame:
    """q1, q2, ...: how many cuts are not above the value; the few cuts travel as one array."""
    cuts = quantile_fit(v).agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    f = v.features().select("impression", "article", "known").join(F.broadcast(cuts))
    return f.select("impression", "article", F.concat(F.lit("q"), (1 + F.size(F.filter("cuts", lambda t: t <= F.col("known")))).cast("string")).alias("symbol"))


@query("jn_quantile_pairs", f"{FEATURES}, vals AS ({_BY_SLATE.replace('SELECT', 'SELECT impression, article,')}) SELECT a.impression, count(*) AS pairs, sum(abs(a.value - b.value))::BIGINT AS spread FROM vals a JOIN vals b ON a.impression = b.impression AND a.article < b.article AND a.value <> b.value GROUP BY 1")
def quantile_pairs(v: Views) -> DataFrame:
    """Unequal value pairs of a slate, from one array per slate."""
    values = _slate_values(v).groupBy("impression").agg(F.collect_list("value").alias("v"))
    gaps = F.flatten(F.transform("v", lambda x, i: F.transform(F.filter("v", lambda y, j: j > i), lambda y: F.abs(x - y))))
    rows = values.select("impression", F.filter(gaps, lambda x: x != 0).alias("g")).where(F.size("g") > 0)
    return rows.select("impression", F.size("g").alias("pairs"), F.aggregate("g", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("spread"))


# --- conditional patterns -------------------------------------------------------------------

_COND = CASES + """,
b AS (SELECT ty * 1.0E0 / tn AS base, tn, ty FROM tot),
k AS (SELECT c.premises, c.n, c.ny, c.ny * 1.0E0 / c.n AS p, split_part(c.premises, ' & ', 1) AS l, split_part(c.premises, ' & ', 2) AS r FROM c2 c WHERE c.ny >= 16),
s AS (SELECT k.premises, k.ny AS tp, k.n - k.ny AS fp, b.ty - k.ny AS fn, b.tn - k.n - (b.ty - k.ny) AS tn, k.n * 1.0E0 / b.tn AS coverage, k.p, b.base, greatest(x.ny * 1.0E0 / x.n, y.ny * 1.0E0 / y.n) AS parent FROM k JOIN c1 x ON x.premises = k.l JOIN c1 y ON y.premises = k.r, b)"""


def conditional(v: Views) -> DataFrame:
    """Two-premise patterns with their parents' best precision; one contingency pass serves both levels."""
    c = mining.contingency(mining.cases(v), 2)
    one = c.where("size = 1").select(F.col("premises").alias("parent"), (F.col("ny") / F.col("n")).alias("pp"))
    two = c.where(f"size = 2 and ny >= {MIN_SUPPORT}").withColumn("parent", F.explode(F.split("premises", " & ")))
    best = two.join(one, "parent").groupBy("premises", "n", "ny", "total_n", "total_ny").agg(F.max("pp").alias("parent"))
    base, p = F.col("total_ny") / F.col("total_n"), F.col("ny") / F.col("n")
    fn = F.col("total_ny") - F.col("ny")
    return best.select("premises", F.col("ny").alias("tp"), (F.col("n") - F.col("ny")).alias("fp"), fn.alias("fn"), (F.col("total_n") - F.col("n") - fn).alias("tn"), (F.col("n") / F.col("total_n")).alias("coverage"), p.alias("p"), base.alias("base"), "parent")


_STATS = "premises, tp, fp, fn::BIGINT AS fn, tn::BIGINT AS tn"


@query("agg_conditional_stats", f"{_COND} SELECT {_STATS}, {R6('coverage')} AS coverage, {R6('p')} AS precision, {R6('p - base')} AS effect, {R6('parent')} AS parent_precision, {R6('coverage * (p - base)')} AS wracc, {R6('coverage * (p - greatest(base, parent))')} AS incremental FROM s")
def conditional_stats(v: Views) -> DataFrame:
    c = conditional(v)
    gain = F.col("p") - F.greatest("base", "parent")
    return c.select("premises", "tp", "fp", "fn", "tn", r6(F.col("coverage")).alias("coverage"), r6(F.col("p")).alias("precision"), r6(F.col("p") - F.col("base")).alias("effect"), r6(F.col("parent")).alias("parent_precision"), r6(F.col("coverage") * (F.col("p") - F.col("base"))).alias("wracc"), r6(F.col("coverage") * gain).alias("incremental"))


_ELIGIBLE = "p - base > 1e-12 AND p - greatest(base, parent) > 1e-12"


_CROSS = _FOLD + f""",
ff AS (SELECT f.*, fo.fold FROM facts f JOIN fo USING (impression)),
k1 AS (SELECT predicate || '=' || value AS premises, 1 AS size, fold, count(*) AS n, sum(y) AS ny FROM ff GROUP BY 1, 3),
k2 AS (SELECT a.predicate || '=' || a.value || ' & ' || b.predicate || '=' || b.value AS premises, 2 AS size, a.fold, count(*) AS n, sum(a.y) AS ny
  FROM ff a JOIN ff b ON a.impression = b.impression AND a.article = b.article AND a.predicate < b.predicate GROUP BY 1, 3),
k3 AS (SELECT a.predicate || '=' || a.value || ' & ' || b.predicate || '=' || b.value || ' & ' || c.predicate || '=' || c.value AS premises, 3 AS size, a.fold, count(*) AS n, sum(a.y) AS ny
  FROM ff a JOIN ff b ON a.impression = b.impression AND a.article = b.article AND a.predicate < b.predicate JOIN ff c ON a.impression = c.impression AND a.article = c.article AND b.predicate < c.predicate GROUP BY 1, 3),
ka AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3),
kk AS (SELECT * FROM ka UNION ALL SELECT premises, size, -1, sum(n), sum(ny) FROM ka GROUP BY 1, 2),
ks AS (SELECT *, string_split(premises, ' & ') AS atoms FROM kk),
tt AS (SELECT fold, sum(n) AS fn, sum(ny) AS fny FROM (SELECT fold, count(*) AS n, sum(y) AS ny FROM cases JOIN fo USING (impression) GROUP BY 1 UNION ALL SELECT -1, count(*), sum(y) FROM cases) GROUP BY 1),
wanted AS (SELECT DISTINCT w.premises FROM (SELECT premises, unnest(atoms) AS atom FROM ks WHERE fold = -1 AND size > 1 AND ny >= {MIN_SUPPORT} AND premises LIKE '%topic=%') w JOIN (SELECT premises AS atom FROM ks WHERE fold = -1 AND size = 1 AND ny >= {MIN_SUPPORT}) USING (atom)),
pat AS (SELECT ks.* FROM ks JOIN wanted USING (premises)),
par AS (SELECT p.premises, p.fold, max(q.ny * 1.0E0 / q.n) AS parent FROM (SELECT premises, fold, array_to_string(list_filter(atoms, lambda x: x <> gone), ' & ') AS of FROM (SELECT premises, fold, atoms, unnest(atoms) AS gone FROM pat)) p JOIN ks q ON q.premises = p.of AND q.fold = p.fold GROUP BY 1, 2),
st AS (SELECT pat.premises, pat.size, pat.fold, pat.n, pat.ny, fn, pat.ny * 1.0E0 / pat.n AS p, fny * 1.0E0 / fn AS base, parent, pat.ny * 1.0E0 / pat.n - greatest(fny * 1.0E0 / fn, parent) AS inc FROM pat JOIN par ON par.premises = pat.premises AND par.fold = pat.fold JOIN tt ON tt.fold = pat.fold),
pw AS (SELECT premises, size, max(ny) FILTER (fold = -1) AS tp, max(n - ny) FILTER (fold = -1) AS fp, max(p) FILTER (fold = -1) AS p, max(base) FILTER (fold = -1) AS base, max(parent) FILTER (fold = -1) AS parent, max(inc) FILTER (fold = -1) AS inc, max(n * 1.0E0 / fn * (p - base)) FILTER (fold = -1) AS wracc,
  count(*) FILTER (fold >= 0 AND n >= 4) AS folds, min(inc) FILTER (fold >= 0 AND n >= 4) AS stable FROM st GROUP BY 1, 2)"""


@query("mine_conditional", f"{_CROSS} SELECT premises, size, tp::BIGINT AS tp, fp::BIGINT AS fp, {R6('p')} AS precision, {R6('parent')} AS parent, {R6('inc')} AS increment, {R6('wracc')} AS wracc, folds, {R6('stable')} AS stable, CASE WHEN p - base <= 1e-12 THEN 'no effect' WHEN inc <= 1e-12 THEN 'no gain' WHEN folds < 2 OR stable <= 1e-12 THEN 'unstable' ELSE 'taken' END AS verdict FROM pw")
def mine_conditional(v: Views) -> DataFrame:
    """Patterns of two and three premises that hold a seed and cross roles, with the reason why each was refused or that it was taken."""
    rows = mining.cases(v).join(mining.folds(v), "impression").withColumn("weight", F.lit(1))
    p = conditional_mining.patterns(rows, 3)
    return p.select("premises", "size", "tp", "fp", *(r6(F.col(c)).alias(c) for c in ("precision", "parent", "increment", "wracc")), "folds", r6(F.col("stable")).alias("stable"), F.coalesce("refused", F.lit("taken")).alias("verdict"))


@query("top_patterns", f"{_COND} SELECT premises FROM s WHERE {_ELIGIBLE} ORDER BY floor(coverage * (p - greatest(base, parent)) * 1e6 + 0.5) DESC, tp DESC, premises LIMIT 10")
def top_patterns(v: Views) -> DataFrame:
    gain = F.floor(F.col("coverage") * (F.col("p") - F.greatest("base", "parent")) * 1e6 + 0.5)
    return conditional(v).where(_ELIGIBLE).orderBy(gain.desc(), F.col("tp").desc(), "premises").limit(10).select("premises")


@query("jn_hybrid_seed", f"{_COND} SELECT premises FROM s WHERE premises LIKE 'long_affinity=%' OR premises LIKE '%& long_affinity=%'")
def hybrid_seed(v: Views) -> DataFrame:
    """Patterns that hold a seed atom: a left semi join on the exploded premises."""
    seeds = mining.mine(mining.cases(v), 1).where("premises like 'long_affinity=%'").select(F.col("premises").alias("atom"))
    c = conditional(v).withColumn("atom", F.explode(F.split("premises", " & ")))
    return c.join(seeds, "atom", "left_semi").select("premises").distinct()


# --- incremental ------------------------------------------------------------------------------


def _plan(v: Views) -> tuple[incremental.Plan, DataFrame]:
    """A new plan, and the cases written once, as every update reads them several times."""
    return incremental.Plan(f"{shared_folder(v.spark)}/plan-{uuid.uuid4().hex}"), stored(mining.cases(v))


@query("mine_incremental", f"{CASES}, k AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2), b AS ({_branches('k')}) SELECT premises, n, ny, {R6('strength')} AS strength, {R6('negative_strength')} AS negative_strength, 'delta_updated' AS mode FROM b WHERE ny >= {MIN_SUPPORT}")
def incremental_rules(v: Views) -> DataFrame:
    """Rules after an update with the cases from 1997 on, against a full recount in the SQL."""
    plan, rows = _plan(v)
    plan.mine(rows.where("year(ts) < 1997"))
    rules, audit = plan.mine(rows)
    return rules.select("premises", "n", "ny", r6(F.col("strength")).alias("strength"), r6(F.col("negative_strength")).alias("negative_strength"), F.lit(audit.mode).alias("mode"))


_STEP = "SELECT {k} AS step, '{mode}' AS mode, (SELECT count(*) FROM cases WHERE {cases}) AS total_cases, (SELECT count(*) FROM cases WHERE {searched}) AS researched_cases, (SELECT count(*) FROM ({patterns})) AS patterns, (SELECT sum(n)::BIGINT FROM ({patterns})) AS mass"


def _step_sql(k: int, mode: str, cases: str, searched: str, depth: int = 2, row: str = "facts") -> str:
    fact = f"(SELECT * FROM {row} WHERE {cases})"
    one = f"SELECT predicate || '=' || value AS premises, count(*) AS n FROM {fact} GROUP BY 1"
    two = f"SELECT a.predicate || '=' || a.value || ' & ' || b.predicate || '=' || b.value AS premises, count(*) AS n FROM {fact} a JOIN {fact} b ON a.impression = b.impression AND a.article = b.article AND a.predicate < b.predicate GROUP BY 1"
    return _STEP.format(k=k, mode=mode, cases=cases, searched=searched, patterns=one if depth == 1 else f"{one} UNION ALL {two}")


_ALL, _OLD, _NEW = "true", "year(ts) < 1997", "year(ts) >= 1996"
_EDITED = "(SELECT impression, article, ts, y, predicate, CASE WHEN predicate = 'history' AND impression % 97 = 0 THEN 'edited' ELSE value END AS value FROM facts)"
_STEPS = " UNION ALL ".join([
    _step_sql(1, "full_seed", _OLD, _OLD), _step_sql(2, "reused", _OLD, "false"), _step_sql(3, "delta_updated", _ALL, "year(ts) >= 1997"), _step_sql(4, "rebuilt_full", _ALL, _ALL, row=_EDITED),
    _step_sql(5, "reconfigured_full", _ALL, _ALL, depth=1), _step_sql(6, "reconfigured_full", _ALL, _ALL), _step_sql(7, "retention_expired_full", _NEW, _NEW),
])


@query("mine_incremental_modes", f"{CASES} {_STEPS}")
def incremental_modes(v: Views) -> DataFrame:
    """One plan through all six modes: what each step searched, and the mass of all its conjunctions, against full recounts."""
    (plan, rows), out = _plan(v), []
    old, new = rows.where("year(ts) < 1997"), rows.where("year(ts) >= 1996")
    edited = rows.withColumn("history", F.when(F.col("impression") % 97 == 0, "edited").otherwise(F.col("history")))
    units = lambda r: r.select("impression").distinct()
    steps = [(old, 2, None), (old, 2, None), (rows, 2, None), (edited, 2, None), (rows, 1, None), (rows, 2, units(rows)), (new, 2, units(new))]
    for k, (r, depth, kept) in enumerate(steps, 1):
        rules, audit = plan.mine(r, depth, 0, kept)
        mass = rules.agg(F.sum("n").alias("mass"))
        out.append(mass.select(F.lit(k).alias("step"), F.lit(audit.mode).alias("mode"), *(F.lit(x).cast("bigint").alias(n) for n, x in (("total_cases", audit.total_cases), ("researched_cases", audit.researched_cases), ("patterns", audit.patterns))), "mass"))
    return reduce(DataFrame.unionByName, out)


_DIFF = "WITH a AS (SELECT o_orderkey AS k, sha256(o_orderstatus || '|' || o_orderpriority) AS h FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey AS k, sha256(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END || '|' || o_orderpriority) AS h FROM orders WHERE o_orderkey % 11 <> 0)"


@query("jn_case_diff", f"{_DIFF} SELECT CASE WHEN a.k IS NULL THEN 'appended' WHEN b.k IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'reused' END AS state, count(*) AS n FROM a FULL OUTER JOIN b ON a.k = b.k GROUP BY 1")
def case_diff(v: Views) -> DataFrame:
    o = v.table("orders")
    digest = lambda status: F.sha2(F.concat_ws("|", status, "o_orderpriority"), 256)
    a = o.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("k"), digest(F.col("o_orderstatus")).alias("a"))
    b = o.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("k"), digest(F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("b"))
    state = F.when(F.col("a").isNull(), "appended").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("reused")
    return a.join(b, "k", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


# --- alias registries ----------------------------------------------------------------------------


_ALIAS = "SELECT DISTINCT lower(p_name) AS alias, p_type AS anchor FROM part"


@query("mine_alias_registry", f"SELECT alias, count(*) AS anchors, CASE WHEN count(*) = 1 THEN min(anchor) END AS entity FROM ({_ALIAS}) GROUP BY 1")
def alias_registry(v: Views) -> DataFrame:
    """An alias names an entity only if it has one anchor; the others are listed as ambiguous."""
    a = v.table("part").select(F.lower("p_name").alias("alias"), F.col("p_type").alias("anchor")).distinct()
    return a.groupBy("alias").agg(F.count("*").alias("anchors"), F.when(F.count("*") == 1, F.min("anchor")).alias("entity"))


@query("mine_acronyms", "SELECT acronym, min(phrase) AS phrase, sum(n)::BIGINT AS records FROM (SELECT substr(split_part(p_name, ' ', 1), 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1) AS acronym, p_name AS phrase, count(*) AS n FROM part WHERE p_name LIKE '% %' GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = 1 AND sum(n) >= 2")
def acronyms(v: Views) -> DataFrame:
    """Initials that stand for one phrase only, seen in two records or more."""
    words = F.split("p_name", " ")
    p = v.table("part").where("p_name like '% %'").groupBy(F.concat(F.substring(words[0], 1, 1), F.substring(words[1], 1, 1)).alias("acronym"), F.col("p_name").alias("phrase")).agg(F.count("*").alias("n"))
    return p.groupBy("acronym").agg(F.min("phrase").alias("phrase"), F.sum("n").alias("records"), F.count("*").alias("k")).where("k = 1 and records >= 2").drop("k")


@query("mine_canonicalize", f"WITH reg AS (SELECT alias, min(anchor) AS anchor FROM ({_ALIAS}) GROUP BY 1 HAVING count(*) = 1) SELECT p_partkey, coalesce('type:' || lower(r.anchor), 'local:' || lower(p.p_brand)) AS canonical FROM part p LEFT JOIN reg r ON r.alias = lower(p.p_name)")
def canonicalize(v: Views) -> DataFrame:
    """Descriptors to ids: the registry first, else the record's own form."""
    reg = alias_registry(v).where("entity is not null").select("alias", "entity")
    p = v.table("part").withColumn("alias", F.lower("p_name")).join(reg, "alias", "left")
    return p.select("p_partkey", F.coalesce(F.concat(F.lit("type:"), F.lower("entity")), F.concat(F.lit("local:"), F.lower("p_brand"))).alias("canonical"))


@query("prj_lexical_form")
def lexical_form(v: Views) -> DataFrame:
    p = v.table("part")
    return p.select("p_partkey", text.lexical_form(F.concat_ws(" & ", "p_name", "p_brand")).alias("form"), text.normalize_unicode(F.col("p_type")).alias("label"))


# --- truth values over the mined rules -----------------------------------------------------------

_TV = f"{CASES}, rules AS ({_branches('c1')})"
CLIP = "greatest(1e-6, least(1 - 1e-6, {s}))"


def V(s: str, c: str) -> str:
    p = CLIP.format(s=s)
    return f"({p} * (1 - {p}) / (({c}) * 800.0E0 / (1 - least({c}, 0.9999)) + 1))"


def FV(s: str, v: str) -> str:
    p = CLIP.format(s=s)
    top = f"({p} * (1 - {p}))"
    n = f"({top} / least({v}, {top}) - 1)"
    return f"CASE WHEN {v} <= 0 THEN 0.9999 ELSE greatest(1e-6, {n} / ({n} + 800.0E0)) END"


def _rules(v: Views) -> DataFrame:
    return mining.branches(mining.contingency(mining.cases(v), 1))


_S, _C, _NS, _NC = "strength", "confidence", "negative_strength", "negative_confidence"


@query("tv_confidence", f"{_TV} SELECT premises, {R6('confidence')} AS confidence, {R6('n / (n + 20.0E0)')} AS selection FROM rules")
def tv_confidence(v: Views) -> DataFrame:
    return _rules(v).select("premises", r6(F.col(_C)).alias("confidence"), r6(truth.confidence(F.col("n"), 20.0)).alias("selection"))


@query("tv_reencode", f"{_TV} SELECT premises, {R6('n / (n + 20.0E0)')} AS confidence FROM rules")
def tv_reencode(v: Views) -> DataFrame:
    return _rules(v).select("premises", r6(truth.reencode(F.col(_C), 800.0, 20.0)).alias("confidence"))


@query("tv_variance", f"{_TV} SELECT premises, {R6(V(_S, _C) + ' * 1000')} AS variance FROM rules")
def tv_variance(v: Views) -> DataFrame:
    return _rules(v).select("premises", r6(truth.variance(F.col(_S), F.col(_C)) * 1000).alias("variance"))


@query("tv_conf_from_var", f"{_TV} SELECT premises, {R6(FV(_S, V(_S, _C)))} AS confidence FROM rules")
def tv_conf_from_var(v: Views) -> DataFrame:
    return _rules(v).select("premises", r6(truth.from_variance(F.col(_S), truth.variance(F.col(_S), F.col(_C)))).alias("confidence"))


_V1, _V2 = V(_S, _C), V(_NS, _NC)
_AND = FV("(strength * negative_strength)", f"({_V1} * {_V2} + {_V1} * negative_strength * negative_strength + strength * strength * {_V2})")


@query("tv_and", f"{_TV} SELECT premises, {R6('strength * negative_strength')} AS strength, {R6(_AND)} AS confidence FROM rules")
def tv_and(v: Views) -> DataFrame:
    s, c = truth.conjunction(F.col(_S), F.col(_C), F.col(_NS), F.col(_NC))
    return _rules(v).select("premises", r6(s).alias("strength"), r6(c).alias("confidence"))


_MPS = "(strength * 0.7 + negative_strength * (1 - 0.7))"
_MPV = f"(0.7 * 0.7 * {_V1} + (1 - 0.7) * (1 - 0.7) * {_V2} + (strength - negative_strength) * (strength - negative_strength) * {V('0.7', '0.6')} + {V('0.7', '0.6')} * ({_V1} + {_V2}))"


@query("tv_modus_ponens", f"{_TV} SELECT premises, {R6(_MPS)} AS strength, {R6(FV(_MPS, _MPV))} AS confidence FROM rules".replace("0.7", "0.7E0").replace("0.6)", "0.6E0)"))
def tv_modus_ponens(v: Views) -> DataFrame:
    s, c = truth.modus_ponens(F.lit(0.7), F.lit(0.6), F.col(_S), F.col(_C), F.col(_NS), F.col(_NC))
    return _rules(v).select("premises", r6(s).alias("strength"), r6(c).alias("confidence"))


@query("tv_channel", f"{_TV} SELECT premises, {R6('strength')} AS strength FROM rules")
def tv_channel(v: Views) -> DataFrame:
    """A rule fired by certain premises: the channel keeps the rule's strength."""
    one, zero = F.lit(1.0), F.lit(0.0)
    s, c = truth.modus_ponens(one, one, F.col(_S), F.col(_C), F.col(_NS), F.col(_NC))
    s, c = truth.modus_ponens(s, c, one, one, zero, one)
    return _rules(v).select("premises", r6(s).alias("strength"))


@query("tv_posterior", f"{_TV} SELECT premises, {R6('ty * 1.0E0 / tn + confidence * (strength - ty * 1.0E0 / tn)')} AS posterior FROM rules")
def tv_posterior(v: Views) -> DataFrame:
    return _rules(v).select("premises", r6(truth.posterior(F.col(_S), F.col(_C), F.col("total_ny") / F.col("total_n"))).alias("posterior"))


@query("tv_log_odds", f"{_TV}, p AS (SELECT premises, greatest(1e-9, least(1 - 1e-9, 0.5 + confidence * (strength - 0.5))) AS p FROM rules) SELECT premises, {R6('ln(p / (1 - p))')} AS margin FROM p")
def tv_log_odds(v: Views) -> DataFrame:
    return _rules(v).select("premises", r6(truth.log_odds(truth.posterior(F.col(_S), F.col(_C), 0.5))).alias("margin"))


@query("prf_compile")
def compile_rules(v: Views) -> DataFrame:
    """Rules as text with a digest of their contract, for explanations."""
    body = F.concat(F.lit("if "), F.replace("premises", F.lit(" & "), F.lit(" and ")), F.lit(" then click ("), r6(F.col(_S)).cast("string"), F.lit(", "), r6(F.col(_C)).cast("string"), F.lit(")"))
    return mining.mine(mining.cases(v), 2).select("premises", body.alias("rule"), F.sha2(body, 256).alias("digest"))
