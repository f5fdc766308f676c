"""Rule activation, point scores and the balanced pair tournament.

A serving rule set is small by its own limit, so it travels as one array and every case finds its
active rules in place: relational division without a shuffle.  Pairs of a slate are formed once for
left before right; the reverse orientation is derived by rewriting symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import truth
from ruleloom.operators import mining
from ruleloom.operators.mining import PREDICATES
from ruleloom.plans import q_mining, q_scalars
from ruleloom.plans.views import Views

RULES = 30
FAMILIES = {"structured": "pair_long_affinity", "recency": "pair_recency"}


def serving_rules(v: Views) -> DataFrame:
    """The best RULES rules with their strength, confidence and the population's click rate."""
    top = q_mining.top_rules(mining.mine(mining.cases(v), 2), limit=RULES)
    return top.select("premises", "size", "strength", "confidence", (F.col("total_ny") / F.col("total_n")).alias("prior"))


def rule_array(rules: DataFrame) -> DataFrame:
    """One row: the rules as an array of structs, atoms split."""
    item = F.struct("premises", F.split("premises", " & ").alias("atoms"), "size", "strength", "confidence")
    return rules.agg(F.array_sort(F.collect_list(item)).alias("rules"), F.first("prior").alias("prior"))


def activate(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``active``, the rules all of whose premises are facts of the row, and ``prior``."""
    atoms = F.array(*map(mining.premise, PREDICATES))
    found = rows.withColumn("_atoms", atoms).join(F.broadcast(rule_array(rules)))
    return found.withColumn("active", F.filter("rules", lambda r: F.size(F.array_except(r["atoms"], F.col("_atoms"))) == 0)).drop("rules", "_atoms")


def point_score(active: str = "active") -> Column:
    """Weighted mean of the active rules' posteriors by their specificity; the prior if none is active."""
    weight = F.aggregate(active, F.lit(0.0), lambda a, r: a + r["size"])
    total = F.aggregate(active, F.lit(0.0), lambda a, r: a + r["size"] * (F.col("prior") + r["confidence"] * (r["strength"] - F.col("prior"))))
    return F.when(weight > 0, total / weight).otherwise(F.col("prior"))


def points(v: Views) -> DataFrame:
    rows = activate(mining.cases(v), serving_rules(v))
    return rows.select("impression", "article", "y", "topic", F.size("active").alias("fired"), point_score().alias("score"))


def pairs(v: Views) -> DataFrame:
    """Unordered pairs with both labels and one symbol for each family."""
    p = q_scalars.slate_pairs(q_scalars.sides(v))
    return p.select(F.col("l_impression").alias("impression"), "l_article", "r_article", "l_position", "r_position", "l_click", "r_click", *(F.expr(q_scalars._PAIR_SQL[s]).alias(f) for f, s in FAMILIES.items()))


def oriented(p: DataFrame) -> DataFrame:
    """family, value, y: both orientations of the pairs whose labels differ."""
    both = [F.struct(F.lit(f).alias("family"), F.col(f).alias("value"), F.col("l_click").alias("y")) for f in FAMILIES]
    both += [F.struct(F.lit(f).alias("family"), q_scalars.reverse(F.col(f)).alias("value"), F.col("r_click").alias("y")) for f in FAMILIES]
    return p.where("l_click <> r_click").select(F.explode(F.array(*both)).alias("x")).select("x.*")


def pair_rules(p: DataFrame) -> DataFrame:
    """family, value, n, ny and the margin: the log odds of the posterior with prior one half."""
    r = oriented(p).groupBy("family", "value").agg(F.count("*").alias("n"), F.sum("y").alias("ny"))
    posterior = truth.posterior(F.col("ny") / F.col("n"), truth.confidence(F.col("n")), 0.5)
    return r.withColumn("margin", truth.log_odds(posterior))


def pair_margins(v: Views) -> DataFrame:
    """impression, l_article, r_article, positions, family and margin (forward less reverse)."""
    p = pairs(v)
    table = pair_rules(p).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "family", "value").alias("k"), F.col("margin").alias("v")))).alias("m"))
    margin = lambda f, c: F.coalesce(F.try_element_at("m", F.concat_ws(":", F.lit(f), c)), F.lit(0.0))
    each = F.array(*(F.struct(F.lit(f).alias("family"), (margin(f, F.col(f)) - margin(f, q_scalars.reverse(F.col(f)))).alias("margin")) for f in FAMILIES))
    rows = p.join(F.broadcast(table)).select("impression", "l_article", "r_article", "l_position", "r_position", F.explode(each).alias("x"))
    return rows.select("impression", "l_article", "r_article", "l_position", "r_position", "x.family", "x.margin")


def votes(margins: DataFrame) -> DataFrame:
    """impression, article, family, margin, comparisons: the margin is added to the left and taken from the right."""
    sides = F.array(F.struct(F.col("l_article").alias("article"), F.col("margin").alias("m")), F.struct(F.col("r_article").alias("article"), (-F.col("margin")).alias("m")))
    rows = margins.select("impression", "family", F.explode(sides).alias("s"))
    return rows.groupBy("impression", "family", "s.article").agg(F.sum("s.m").alias("margin"), F.count("*").alias("comparisons"))


def grid(c: Column) -> Column:
    """Six decimals as a whole number, so that rounding noise is no rank."""
    return F.floor(c * 1e6 + 0.5)


def midrank(value: Column, *group: str) -> Column:
    """Tie-averaged descending rank scaled to 1 (best) .. 0."""
    ties = F.count("*").over(Window.partitionBy(*group, value))
    first = F.rank().over(Window.partitionBy(*group).orderBy(value.desc()))
    n = F.count("*").over(Window.partitionBy(*group))
    return 1 - (first - 1 + (ties - 1) / 2) / F.greatest(n - 1, F.lit(1))


def balanced(v: Views) -> DataFrame:
    """impression, article, score: the mean of the families' midranks; slates of one candidate have none."""
    t = votes(pair_margins(v)).withColumn("g", grid(F.col("margin") / F.col("comparisons")))
    t = t.withColumn("mid", midrank(F.col("g"), "impression", "family"))
    return t.groupBy("impression", "article").agg(F.avg("mid").alias("score"))
