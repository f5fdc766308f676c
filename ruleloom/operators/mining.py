"""Target-aware frequent conjunctions over wide case rows.

Cases are rows with one column per predicate, so a conjunction of k premises is an element of the
row's own combinations: no self-join of facts is needed, and counting is one partially aggregated
group-by whose keys are the conjunctions.  ``facts`` gives the long form for other uses.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions import buckets, truth
from ruleloom.operators import running
from ruleloom.plans.views import Views, r6

SHARE = "CASE WHEN known = 0 THEN 0.0E0 ELSE topic_count / (known * 1.0E0) END"
RECENT_SHARE = "CASE WHEN recent_known = 0 THEN 0.0E0 ELSE topic_recent / (recent_known * 1.0E0) END"
#: predicate: SQL over the feature rows, in the order of their names
PREDICATES = {
    "history": buckets.sql("history_size", "known"),
    "long_affinity": buckets.sql("share", SHARE),
    "recent_affinity": buckets.sql("share", RECENT_SHARE),
    "recent_count": buckets.sql("count_zero", "topic_recent"),
    "topic": "topic",
}
MIN_SUPPORT = 16


def cases(v: Views) -> DataFrame:
    """impression, article, ts, y and one symbol per predicate; label-like columns are no predicates."""
    return v.features().select("impression", "article", "ts", F.col("click").alias("y"), *(F.expr(x).alias(p) for p, x in PREDICATES.items()))


def facts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The long form (keys, predicate, value); NULL, empty and unknown values are no facts."""
    found = F.explode(F.array(*(F.struct(F.lit(p).alias("predicate"), F.col(p).alias("value")) for p in PREDICATES))).alias("f")
    return rows.select(*keys, found).select(*keys, "f.predicate", "f.value").where("value is not null and value not in ('', 'unknown')")


def premise(p: str) -> Column:
    return F.concat(F.lit(f"{p}="), F.col(p))


def conjunctions(depth: int) -> Column:
    """Array of (premises, size) of a row: every set of up to ``depth`` premises, each predicate at most once."""
    return F.array(*(F.struct(F.concat_ws(" & ", *map(premise, s)).alias("premises"), F.lit(k).alias("size")) for k in range(1, depth + 1) for s in combinations(PREDICATES, k)))


def counts(rows: DataFrame, depth: int) -> DataFrame:
    """premises, size, n and ny of every conjunction that occurs."""
    return rows.select("y", F.explode(conjunctions(depth)).alias("c")).groupBy("c.premises", "c.size").agg(F.count("*").alias("n"), F.sum("y").alias("ny"))


def contingency(rows: DataFrame, depth: int) -> DataFrame:
    """premises, size, n, ny and the universe's total_n, total_ny (case rows and positive rows)."""
    total = rows.agg(F.count("*").alias("total_n"), F.sum("y").alias("total_ny"))
    return counts(rows, depth).join(F.broadcast(total))


def branches(c: DataFrame, k: float = truth.K) -> DataFrame:
    """Adds both branches of the truth value; an empty branch has strength and confidence 0."""
    rest, rest_y = F.col("total_n") - F.col("n"), F.col("total_ny") - F.col("ny")
    return c.withColumns({
        "strength": F.when(F.col("n") > 0, F.col("ny") / F.col("n")).otherwise(0.0), "confidence": truth.confidence(F.col("n"), k),
        "negative_strength": F.when(rest > 0, rest_y / F.greatest(rest, F.lit(1))).otherwise(0.0), "negative_confidence": truth.confidence(rest, k),
    })


def mine(rows: DataFrame, depth: int, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Rules for the target: joint support of premises and target from ``min_support`` on."""
    return branches(contingency(rows, depth)).where(F.col("ny") >= min_support)


def quality(base: Column) -> Column:
    return F.col("confidence") * F.abs(F.col("strength") - base) * (1 + 0.25 * (F.col("size") - 1)) * F.log(1 + F.col("n"))


def macro(rows: DataFrame, k: float = truth.K) -> DataFrame:
    """Impression-macro truth values of one-premise rules, with the Kish effective size of each branch.

    Every impression has mass 1; an empty branch takes the base rate and confidence 0.
    """
    per = rows.groupBy("impression").agg(F.count("*").alias("rows"), F.sum("y").alias("ys"))
    atoms = rows.select("impression", "y", F.explode(F.array(*map(premise, PREDICATES))).alias("premises"))
    matched = atoms.groupBy("premises", "impression").agg(F.count("*").alias("m"), F.sum("y").alias("my")).join(per, "impression")
    matched = matched.select("premises", (F.col("m") / F.col("rows")).alias("a"), (F.col("my") / F.col("rows")).alias("ay"), ((F.col("rows") - F.col("m")) / F.col("rows")).alias("b"), ((F.col("ys") - F.col("my")) / F.col("rows")).alias("by"))
    sums = matched.groupBy("premises").agg(*(F.sum(c).alias(c) for c in ("a", "ay", "b", "by")), F.sum(F.col("a") * F.col("a")).alias("a2"), F.sum(F.col("b") * F.col("b")).alias("b2"), F.count("*").alias("seen"))
    total = per.agg(F.count("*").alias("slates"), F.sum(F.col("ys") / F.col("rows")).alias("mass"))
    r = sums.join(F.broadcast(total))
    # impressions without a matched row lie wholly in the negative branch
    other = F.col("slates") - F.col("seen")
    nb, nby, nb2 = F.col("b") + other, F.col("mass") - F.col("ay"), F.col("b2") + other
    base = F.col("mass") / F.col("slates")
    eff, neff = F.col("a") * F.col("a") / F.col("a2"), F.when(nb2 > 1e-12, nb * nb / nb2).otherwise(0.0)
    return r.select("premises", (F.col("ay") / F.col("a")).alias("strength"), eff.alias("effective"), truth.confidence(eff, k).alias("confidence"),
                    F.when(nb > 1e-12, nby / F.greatest(nb, F.lit(1e-12))).otherwise(base).alias("negative_strength"), truth.confidence(neff, k).alias("negative_confidence"), (F.col("a") / F.col("slates")).alias("coverage"))


def folds(v: Views) -> DataFrame:
    """impression and fold: thirds of the slates in the order in which they were first seen."""
    from ruleloom.plans.q_features import sequence  # the sequence is a two-level running total

    s = sequence(v)
    n = v.candidates().agg(F.count("*").alias("n"))
    return s.join(F.broadcast(n)).select("impression", F.least(F.lit(2), F.floor(3 * F.col("seq") / F.col("n")).cast("int")).alias("fold"))


def quantile_cuts(values: DataFrame, bins: int) -> DataFrame:
    """value, weight -> bin edges k, cut: the split of distinct values nearest to each cumulative target.

    Equal values are never split; of two splits equally near the lower one is taken.
    """
    c = running.ordered(values.groupBy("value").agg(F.sum("weight").alias("weight")), [])
    t = c.where("next is not null").select("*", F.explode(F.sequence(F.lit(1), F.lit(bins - 1))).alias("k"))
    gap = F.floor(F.abs(F.col("cum") - F.col("total") * F.col("k") / bins) * 1e6 + 0.5)
    best = t.groupBy("k").agg(F.min(F.struct(gap.alias("gap"), F.col("i").alias("i"), F.col("next").alias("cut"))).alias("b"))
    return best.select("k", F.col("b.cut").alias("cut"))


def rules_out(c: DataFrame) -> DataFrame:
    return c.select("premises", "size", "n", "ny", *(r6(F.col(x)).alias(x) for x in ("strength", "confidence", "negative_strength", "negative_confidence")))
