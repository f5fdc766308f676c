"""Additive mining: a durable state of all conjunction counts, updated by the cases that came since.

A plan's versions are folders; a version counts as committed when its manifest, written last, is there, so
a build that fails leaves the version before it in force.  Counts of support 1 and more are kept, as any threshold
may be asked for later.  Counts are never subtracted: cases that changed or went, or units that expired, make a
full recount.  Everything is a join or an aggregate; the driver sees one row of counts.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.operators import mining
from ruleloom.operators.mining import MIN_SUPPORT, PREDICATES

CASE = ["impression", "article"]
#: Hard limits of a plan; beyond them a build fails and commits nothing.
MAX_CASES, MAX_PATTERNS = 100_000_000_000, 10_000_000


@dataclass
class Audit:
    version: int
    mode: str
    total_cases: int
    target_cases: int
    previous_cases: int
    appended: int
    changed: int
    removed: int
    expired_units: int
    researched_cases: int
    patterns: int
    depth: int
    predicates: str
    retained: bool


class Plan:
    """One plan's versions below ``root``, a folder that the driver and all executors share."""

    def __init__(self, root: str, max_cases: int = MAX_CASES, max_patterns: int = MAX_PATTERNS) -> None:
        self.root, self.max_cases, self.max_patterns = root, max_cases, max_patterns

    def current(self, spark) -> Audit | None:
        """The manifest of the newest committed version."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v*/manifest/_SUCCESS")
        found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path) or []
        versions = [int(f.getPath().getParent().getParent().getName()[1:]) for f in found]
        return Audit(**spark.read.json(f"{self.root}/v{max(versions)}/manifest").first().asDict()) if versions else None

    def _difference(self, old: DataFrame, new: DataFrame) -> tuple[int, int, int]:
        both = old.withColumnRenamed("digest", "was").join(new, CASE, "full")
        row = both.agg(F.count_if(F.col("was").isNull()).alias("appended"), F.count_if(F.col("was") != F.col("digest")).alias("changed"), F.count_if(F.col("digest").isNull()).alias("removed")).first()
        return row.appended, row.changed, row.removed

    def mine(self, cases: DataFrame, depth: int = 2, min_support: int = MIN_SUPPORT, units: DataFrame | None = None) -> tuple[DataFrame, Audit]:
        """Rules of the cases (impression, article, y and the predicates) and how they were come by.

        ``units`` (impression) are the retained causal units, if retention is in force.
        """
        spark, shape = cases.sparkSession, ",".join(PREDICATES)
        last = self.current(spark)
        read = lambda name: spark.read.parquet(f"{self.root}/v{last.version}/{name}")
        digest = F.sha2(F.concat_ws("\x1f", "y", *(F.coalesce(F.col(p), F.lit("\x1e")) for p in PREDICATES)), 256)
        here = cases.select(*CASE, digest.alias("digest"))
        total = cases.agg(F.count("*").alias("n"), F.sum("y").alias("ny")).first()
        if total.n > self.max_cases:
            raise MemoryError(f"{total.n} cases, {self.max_cases} allowed")
        appended, changed, removed = self._difference(read("cases"), here) if last else (total.n, 0, 0)
        expired = read("units").join(units, "impression", "left_anti").count() if last and last.retained and units is not None else 0
        if last is None:
            mode = "full_seed"
        elif (last.depth, last.predicates, last.retained) != (depth, shape, units is not None):
            mode = "reconfigured_full"
        elif expired:
            mode = "retention_expired_full"
        elif changed or removed:
            mode = "rebuilt_full"
        else:
            mode = "delta_updated" if appended else "reused"
        counts = lambda rows: mining.counts(rows, depth)
        if mode == "reused":
            patterns, researched = read("patterns"), 0
        elif mode == "delta_updated":
            new = cases.join(read("cases").select(*CASE), CASE, "left_anti")
            patterns = read("patterns").unionByName(counts(new)).groupBy("premises", "size").agg(F.sum("n").alias("n"), F.sum("ny").alias("ny"))
            researched = appended
        else:
            patterns, researched = counts(cases), total.n
        version = last.version + 1 if last else 1
        if mode == "reused":
            patterns, n, version = read("patterns"), last.patterns, last.version
        else:
            at = f"{self.root}/v{version}"
            patterns.write.mode("overwrite").parquet(f"{at}/patterns")
            patterns = spark.read.parquet(f"{at}/patterns")
            n = patterns.count()
            if n > self.max_patterns:
                raise MemoryError(f"{n} patterns, {self.max_patterns} allowed")
            here.write.mode("overwrite").parquet(f"{at}/cases")
            if units is not None:
                units.select("impression").write.mode("overwrite").parquet(f"{at}/units")
        audit = Audit(version, mode, total.n, total.ny or 0, last.total_cases if last else 0, appended, changed, removed, expired, researched, n, depth, shape, units is not None)
        if mode != "reused":
            spark.createDataFrame([tuple(asdict(audit).values())], list(asdict(audit))).coalesce(1).write.mode("errorifexists").json(f"{at}/manifest")
        rules = patterns.withColumns({"total_n": F.lit(audit.total_cases), "total_ny": F.lit(audit.target_cases)})
        return mining.branches(rules).where(F.col("ny") >= min_support), audit
