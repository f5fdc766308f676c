"""The domain views over the test tables, and the same views as SQL text for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HISTORY_LIMIT, RECENT, LONG = 200, 5, 20
DECAY = 0.85


def r6(x: Column) -> Column:
    """Six decimals by an arithmetic that both engines share."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def R6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


class Views:
    """Lazy plans over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def articles(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("article"), F.col("p_type").alias("topic"), F.col("p_brand").alias("subcategory"), F.col("p_name").alias("title"))

    def impressions(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("impression"), F.col("o_custkey").alias("usr"), F.col("o_orderdate").alias("ts"))

    def candidates(self) -> DataFrame:
        """impression, article, click and first line: one row per part of an order."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber")
        return lines.groupBy(F.col("l_orderkey").alias("impression"), F.col("l_partkey").alias("article")).agg(
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("click"), F.min("l_linenumber").alias("fl"))

    def exposures(self) -> DataFrame:
        """The fact table: every candidate of an impression with its user, time, position and label."""
        position = F.row_number().over(Window.partitionBy("impression").orderBy("fl", "article")) - 1
        return self.candidates().join(self.impressions(), "impression").select("impression", "article", "click", "usr", "ts", position.alias("position"))

    def past(self, click: int, limit: int) -> DataFrame:
        """impression, usr, ts and past: the last ``limit`` candidates with this label in the user's earlier impressions, oldest first.

        Candidates are folded into one array per impression first.  A row looks back at no more than ``limit``
        impressions that have such candidates, so what it gathers does not grow with the user's log.
        """
        place = F.struct("position", "article")
        found = self.exposures().where(F.col("click") == click).groupBy("impression").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["article"]).alias("found"))
        user = Window.partitionBy("usr")
        rows = self.impressions().join(found, "impression", "left")
        rows = rows.withColumn("filled", F.count("found").over(user.orderBy("ts", "impression").rowsBetween(Window.unboundedPreceding, -1)))
        # the place of an impression among the filled ones orders the arrays; those of the row itself have its own number
        each = F.transform(F.array_sort(F.collect_list(F.when(F.col("found").isNotNull(), F.struct("filled", "found"))).over(user.orderBy("filled").rangeBetween(-limit, -1))), lambda x: x["found"])
        rows = rows.withColumn("past", F.flatten(each))
        return rows.select("impression", "usr", "ts", F.when(F.size("past") > limit, F.slice("past", -limit, limit)).otherwise(F.col("past")).alias("past"))

    def histories(self) -> DataFrame:
        """impression, usr, ts and history: clicked articles of the user's earlier impressions, oldest first."""
        return self.past(1, HISTORY_LIMIT).withColumnRenamed("past", "history")

    def history_items(self) -> DataFrame:
        """impression, article, lag: one row per history item; lag 0 is the latest."""
        rows = self.histories().select("impression", "history", F.posexplode("history").alias("pos", "article"))
        return rows.select("impression", "article", (F.size("history") - 1 - F.col("pos")).alias("lag"))

    def history_articles(self) -> DataFrame:
        a = self.articles().select("article", F.col("topic").alias("h_topic"), F.col("subcategory").alias("h_subcategory"), F.col("title").alias("h_title"))
        return self.history_items().join(a, "article", "left")

    def features(self) -> DataFrame:
        """Causal history features of every exposure; history is aggregated per slate and key, never per candidate."""
        h = self.history_articles()
        size = h.groupBy("impression").agg(F.count("*").alias("known"), F.sum((F.col("lag") < RECENT).cast("int")).alias("recent_known"))
        by = lambda key, name: h.groupBy("impression", F.col(key).alias(name)).agg(
            F.count("*").alias(f"{name}_count"), F.sum((F.col("lag") < RECENT).cast("int")).alias(f"{name}_recent"), F.min("lag").alias(f"{name}_lag"))
        topics = by("h_topic", "topic")
        topics = topics.withColumn("topic_top", F.max("topic_count").over(Window.partitionBy("impression")))
        rows = self.exposures().join(self.articles(), "article")
        rows = rows.join(size, "impression", "left").join(topics, ["impression", "topic"], "left").join(by("h_subcategory", "subcategory"), ["impression", "subcategory"], "left")
        zero = ["known", "recent_known", "topic_count", "topic_recent", "topic_top", "subcategory_count", "subcategory_recent"]
        return rows.fillna(0, zero)


#: The same views as common table expressions; every oracle that starts with them adds its own.
BASE = """WITH expo AS (
  SELECT l_orderkey AS impression, l_partkey AS article, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS click, min(l_linenumber) AS fl
  FROM lineitem GROUP BY 1, 2),
exposures AS (
  SELECT e.impression, e.article, e.click, o.o_custkey AS usr, o.o_orderdate AS ts,
    row_number() OVER (PARTITION BY e.impression ORDER BY e.fl, e.article) - 1 AS position
  FROM expo e JOIN orders o ON o.o_orderkey = e.impression),
articles AS (SELECT p_partkey AS article, p_type AS topic, p_brand AS subcategory, p_name AS title FROM part),
items AS (
  SELECT i.o_orderkey AS impression, c.article, row_number() OVER (PARTITION BY i.o_orderkey ORDER BY c.ts DESC, c.impression DESC, c.position DESC) - 1 AS lag
  FROM orders i JOIN exposures c ON c.usr = i.o_custkey AND c.click = 1
    AND (c.ts < i.o_orderdate OR (c.ts = i.o_orderdate AND c.impression < i.o_orderkey))),
hist AS (SELECT i.impression, i.article, i.lag, a.topic AS h_topic, a.subcategory AS h_subcategory, a.title AS h_title FROM items i LEFT JOIN articles a ON a.article = i.article WHERE i.lag < 200)"""

FEATURES = BASE + """,
hsize AS (SELECT impression, count(*) AS known, count(*) FILTER (lag < 5) AS recent_known FROM hist GROUP BY 1),
ht AS (SELECT impression, h_topic, count(*) AS n, count(*) FILTER (lag < 5) AS r, min(lag) AS lag FROM hist GROUP BY 1, 2),
htop AS (SELECT impression, max(n) AS top FROM ht GROUP BY 1),
hs AS (SELECT impression, h_subcategory, count(*) AS n, count(*) FILTER (lag < 5) AS r, min(lag) AS lag FROM hist GROUP BY 1, 2),
feat AS (
  SELECT e.impression, e.article, e.click, e.usr, e.ts, e.position, a.topic, a.subcategory, a.title,
    coalesce(z.known, 0) AS known, coalesce(z.recent_known, 0) AS recent_known,
    coalesce(t.n, 0) AS topic_count, coalesce(t.r, 0) AS topic_recent, t.lag AS topic_lag, CASE WHEN t.n IS NULL THEN 0 ELSE m.top END AS topic_top,
    coalesce(s.n, 0) AS subcategory_count, coalesce(s.r, 0) AS subcategory_recent, s.lag AS subcategory_lag
  FROM exposures e JOIN articles a ON a.article = e.article
  LEFT JOIN hsize z ON z.impression = e.impression
  LEFT JOIN ht t ON t.impression = e.impression AND t.h_topic = a.topic
  LEFT JOIN htop m ON m.impression = e.impression
  LEFT JOIN hs s ON s.impression = e.impression AND s.h_subcategory = a.subcategory)"""
