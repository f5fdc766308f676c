"""Conditional patterns: conjunctions that say more than each of their parts, and say it in every fold.

A pattern holds a seed (a frequent single premise), crosses roles (the article's own predicates and those of the
reader's history) and has up to ``depth`` premises.  Its increment is its precision less the larger of the base rate and
the best precision of the patterns that lack one of its premises; it is measured over all rows and in each fold.
All counts come from one group-by of the rows' own combinations; parents are joined by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.operators import mining
from ruleloom.operators.mining import MIN_SUPPORT
from ruleloom.session import stored

#: Predicates of the article itself; all others describe the reader's history.
OWN = ("topic",)
#: Least weight of a fold that counts, and how many such folds a pattern needs.
FOLD_SUPPORT, FOLDS = 4, 2
EPSILON = 1e-12
#: The fold number of the totals over all folds.
WHOLE = -1


def patterns(rows: DataFrame, depth: int = 3, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Every candidate pattern of ``rows`` (y, weight, fold and the predicates) with its statistics and verdict.

    premises, size, tp, fp, precision, base, parent, increment, wracc, folds, stable and refused: ``no effect``, ``no gain``,
    ``unstable`` or null for a pattern that is taken.
    """
    if not 2 <= depth <= 4:
        raise ValueError("patterns have 2 to 4 premises")
    taken = rows.select("fold", "weight", (F.col("weight") * F.col("y")).alias("hit"), F.explode(mining.conjunctions(depth)).alias("c"))
    per = taken.groupBy("c.premises", "c.size", "fold").agg(F.sum("weight").alias("n"), F.sum("hit").alias("ny"))
    per = stored(per)
    total = rows.groupBy("fold").agg(F.sum("weight").alias("fold_n"), F.sum(F.col("weight") * F.col("y")).alias("fold_ny"))
    per = per.unionByName(per.groupBy("premises", "size").agg(F.sum("n").alias("n"), F.sum("ny").alias("ny")).withColumn("fold", F.lit(WHOLE)))
    total = total.unionByName(total.agg(F.sum("fold_n").alias("fold_n"), F.sum("fold_ny").alias("fold_ny")).withColumn("fold", F.lit(WHOLE)))
    seeds = per.where(f"size = 1 and fold = {WHOLE} and ny >= {min_support}").select(F.col("premises").alias("atom"))
    atoms = F.split("premises", " & ")
    own = F.exists(atoms, lambda a: F.split(a, "=")[0].isin(*OWN))
    other = F.exists(atoms, lambda a: ~F.split(a, "=")[0].isin(*OWN))
    frequent = per.where(F.col("size") >= 2).where(own & other).where(f"fold = {WHOLE} and ny >= {min_support}").select("premises", F.explode(atoms).alias("atom"))
    wanted = frequent.join(seeds, "atom", "left_semi").select("premises").distinct()
    found = per.join(wanted, "premises")
    less = found.select("premises", "fold", F.explode(atoms).alias("gone"), atoms.alias("all"))
    less = less.select("premises", "fold", F.array_join(F.array_except("all", F.array("gone")), " & ").alias("of"))
    best = less.join(per.select(F.col("premises").alias("of"), "fold", (F.col("ny") / F.col("n")).alias("p")), ["of", "fold"]).groupBy("premises", "fold").agg(F.max("p").alias("parent"))
    s = found.join(best, ["premises", "fold"]).join(F.broadcast(total), "fold")
    precision, base = F.col("ny") / F.col("n"), F.col("fold_ny") / F.col("fold_n")
    s = s.select("premises", "size", "fold", "n", "ny", "fold_n", precision.alias("precision"), base.alias("base"), "parent", (precision - F.greatest(base, "parent")).alias("increment"))
    whole = F.col("fold") == WHOLE
    of = lambda c: F.max(F.when(whole, F.col(c)))
    usable = ~whole & (F.col("n") >= FOLD_SUPPORT)
    out = s.groupBy("premises", "size").agg(
        of("ny").alias("tp"), (of("n") - of("ny")).alias("fp"), *(of(c).alias(c) for c in ("precision", "base", "parent", "increment")), (of("n") / of("fold_n") * (of("precision") - of("base"))).alias("wracc"),
        F.count_if(usable).alias("folds"), F.min(F.when(usable, F.col("increment"))).alias("stable"))
    refused = F.when(F.col("precision") - F.col("base") <= EPSILON, "no effect").when(F.col("increment") <= EPSILON, "no gain").when((F.col("folds") < FOLDS) | (F.col("stable") <= EPSILON), "unstable")
    out = out.withColumn("refused", refused)
    return out
