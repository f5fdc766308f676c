"""Two-branch truth values: (strength, confidence) pairs as column expressions.

The confidence of n observations is n / (n + K).  A pair is propagated through products and modus
ponens by its variance: strength s with confidence c has s(1-s)/(count+1) with count = cK/(1-c).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 800.0
LEAST, MOST = 1e-6, 0.9999


def clip(s: Column) -> Column:
    return F.greatest(F.lit(LEAST), F.least(F.lit(1 - LEAST), s))


def confidence(n: Column, k: float = K) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(n / (n + F.lit(k)))


def count(c: Column, k: float = K) -> Column:
    """The observations behind a confidence."""
    return c * k / (1 - F.least(c, F.lit(MOST)))


def reencode(c: Column, old: float, new: float) -> Column:
    """The same observations under another K; strengths don't change."""
    n = F.when(c >= 1, F.lit(None)).otherwise(c * old / (1 - c))
    return F.when(c <= 0, F.lit(0.0)).otherwise(n / (n + F.lit(new)))


def variance(s: Column, c: Column) -> Column:
    p = clip(s)
    return p * (1 - p) / (count(c) + 1)


def from_variance(s: Column, v: Column) -> Column:
    p = clip(s)
    top = p * (1 - p)
    n = top / F.least(v, top) - 1
    return F.when(v <= 0, F.lit(MOST)).otherwise(F.greatest(F.lit(LEAST), n / (n + K)))


def conjunction(s1: Column, c1: Column, s2: Column, c2: Column) -> tuple[Column, Column]:
    v1, v2, s = variance(s1, c1), variance(s2, c2), s1 * s2
    joint = v1 * v2 + v1 * s2 * s2 + s1 * s1 * v2
    return s, F.when((c1 <= 0) | (c2 <= 0), F.lit(0.0)).otherwise(from_variance(s, joint))


def modus_ponens(sa: Column, ca: Column, sp: Column, cp: Column, sn: Column, cn: Column) -> tuple[Column, Column]:
    vp, vn, va = variance(sp, cp), variance(sn, cn), variance(sa, ca)
    s, gap = sp * sa + sn * (1 - sa), sp - sn
    v = sa * sa * vp + (1 - sa) * (1 - sa) * vn + gap * gap * va + va * (vp + vn)
    return s, from_variance(s, v)


def posterior(s: Column, c: Column, prior: Column | float) -> Column:
    p = prior if isinstance(prior, Column) else F.lit(prior)
    return p + c * (s - p)


def log_odds(p: Column) -> Column:
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(q / (1 - q))


def register_sql(spark) -> None:
    """SQL functions of the same formulas, for use inside spark.sql."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tv_confidence(n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n <= 0 THEN 0D ELSE n / (n + {K}D) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tv_posterior(s DOUBLE, c DOUBLE, prior DOUBLE) RETURNS DOUBLE RETURN prior + c * (s - prior)")
