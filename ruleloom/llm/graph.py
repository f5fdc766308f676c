"""Connected components of a table of links, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import materialise, release


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of ``links`` (a, b) is connected to.

    Each round takes the smallest label of the neighbours and then the label of that label, so long
    chains shorten at a growing pace.  Rounds end when no label changes.  A node may have any number
    of links: labels are combined by partial aggregation and skewed joins can be split.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both)
    table = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    labels, changed = table, 1
    while changed:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        over = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = materialise(step.join(over, F.col("mid") == F.col("via")).select("node", "old", F.least("mid", "far").alias("label")))
        changed = step.where("old <> label").limit(1).count()
        release(table)
        table, labels = step, step.select("node", "label")
    release(both)
    return labels
