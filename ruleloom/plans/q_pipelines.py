"""Queries of fixtures, registries, rule-set checks and the end-to-end mining pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import text
from ruleloom.operators import mining, ranking
from ruleloom.operators.ranking import grid
from ruleloom.plans import q_mining
from ruleloom.plans.q_mining import _COND, _RANKED
from ruleloom.plans.q_ranking import PAIRS, POINTS
from ruleloom.plans.registry import query
from ruleloom.plans.views import R6, Views, r6
from ruleloom.sources import logs

# The bundled fixture's articles (id, title, topic, format) and users' topics.
FIXTURE_ARTICLES = [
    ("n1", "A practical guide to neural networks", "ai", "guide"),
    ("n2", "AI policy and public trust", "ai", "news"),
    ("n3", "How scientists study galaxies", "science", "explainer"),
    ("n4", "New evidence about ocean warming", "climate", "news"),
    ("n5", "A short history of climate policy", "climate", "essay"),
    ("n6", "The history of computing", "history", "essay"),
    ("n7", "A beginner map of quantum physics", "science", "guide"),
    ("n8", "What ancient cities teach us", "history", "explainer"),
]
FIXTURE_USERS = {"u1": ["ai", "science"], "u2": ["climate"], "u3": ["history", "ai"], "u4": ["science", "climate"]}

_FIXTURE = f"""WITH a(article, title, topic, format) AS (VALUES {", ".join(map(repr, FIXTURE_ARTICLES))}),
u(usr, topic) AS (VALUES {", ".join(repr((u, t)) for u, topics in FIXTURE_USERS.items() for t in topics)}),
e AS (SELECT w.usr, a.article, k, a.format <> 'essay' AS plain, u.topic IS NOT NULL AS liked FROM a CROSS JOIN (SELECT DISTINCT usr FROM u) w CROSS JOIN range(4) r(k) LEFT JOIN u ON u.usr = w.usr AND u.topic = a.topic)"""


@query("src_fixture", f"{_FIXTURE} SELECT usr, article, CASE WHEN liked AND (plain OR k % 2 = 0) THEN 'click' ELSE 'skip' END AS action, 'fixture_' || k || '_' || usr AS impression FROM e")
def fixture(v: Views) -> DataFrame:
    """Four repeats of four users over eight articles; a click needs a topic of the user, and essays an even repeat."""
    a = v.spark.createDataFrame(FIXTURE_ARTICLES, "article string, title string, topic string, format string")
    u = v.spark.createDataFrame(list(FIXTURE_USERS.items()), "usr string, topics array<string>")
    rows = u.join(F.broadcast(a)).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(3))))
    click = F.array_contains("topics", F.col("topic")) & ((F.col("format") != "essay") | (F.col("repeat") % 2 == 0))
    return rows.select("usr", "article", F.when(click, "click").otherwise("skip").alias("action"), F.concat_ws("_", F.lit("fixture"), "repeat", "usr").alias("impression"))


@query("src_corpus", "SELECT count(*) AS rows, sum(('0x' || substr(sha256(p_partkey || ':' || length(p_name) || ':' || p_name), 1, 8))::BIGINT)::BIGINT AS content FROM part")
def corpus(v: Views) -> DataFrame:
    """An order-free content digest of length-prefixed records: digests are summed, so no sort is needed."""
    record = F.concat_ws(":", "p_partkey", F.length("p_name"), "p_name")
    part = F.conv(F.substring(F.sha2(record, 256), 1, 8), 16, 10).cast("bigint")
    return v.table("part").agg(F.count("*").alias("rows"), F.sum(part).alias("content"))


@query("prj_entity_keys", "SELECT l_orderkey AS impression, array_to_string(list_sort(list_distinct(list(CASE WHEN l_linenumber % 2 = 0 THEN 'Q' || l_partkey ELSE 'part' || l_partkey END))), ',') AS keys FROM lineitem GROUP BY 1")
def entity_keys(v: Views) -> DataFrame:
    """Ids of JSON entity lists, by key priority, parsed from text."""
    item = F.when(F.col("l_linenumber") % 2 == 0, F.named_struct(F.lit("WikidataId"), F.concat(F.lit("Q"), "l_partkey"), F.lit("Label"), F.lit("x"))).otherwise(F.named_struct(F.lit("WikidataId"), F.lit(""), F.lit("Label"), F.concat(F.lit("part"), "l_partkey")))
    rows = v.table("lineitem").groupBy(F.col("l_orderkey").alias("impression")).agg(F.to_json(F.collect_list(item)).alias("j"))
    return rows.select("impression", F.array_join(F.array_sort(logs.entity_ids(F.col("j"))), ",").alias("keys"))


_DESC = "lower(trim(regexp_replace(substr(p_name, 1, 80), '[[:cntrl:]]+', ' ', 'g')))"


@query("prj_descriptor", f"SELECT p_partkey, {_DESC} AS descriptor FROM part WHERE {_DESC} NOT IN ('', 'unknown', 'none', 'n/a') AND p_type <> 'PROMO'")
def descriptor(v: Views) -> DataFrame:
    """Bounded, lower-case descriptors without control characters; placeholder words are refused."""
    d = F.lower(F.trim(F.regexp_replace(F.substring("p_name", 1, 80), r"\p{Cntrl}+", " ")))
    return v.table("part").where("p_type <> 'PROMO'").select("p_partkey", d.alias("descriptor")).where("descriptor not in ('', 'unknown', 'none', 'n/a')")


@query("prj_public_labels", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority)))[1:3], ', ') AS labels FROM orders GROUP BY 1")
def public_labels(v: Views) -> DataFrame:
    return v.table("orders").groupBy("o_custkey").agg(F.array_join(F.slice(F.array_sort(F.collect_set("o_orderpriority")), 1, 3), ", ").alias("labels"))



# --- rule sets -------------------------------------------------------------------------------------


@query("mine_parse_dedupe", f"{_RANKED} SELECT premises, n FROM q")
def parse_dedupe(v: Views) -> DataFrame:
    """Rules with premises in any order and repeats become one; two counts for one rule are an error."""
    rules = mining.mine(mining.cases(v), 2).select("premises", "n")
    other = rules.select(F.array_join(F.reverse(F.split("premises", " & ")), " & ").alias("premises"), "n")
    canonical = F.array_join(F.array_sort(F.split("premises", " & ")), " & ")
    out = rules.unionByName(other).groupBy(canonical.alias("premises")).agg(F.min("n").alias("n"), F.max("n").alias("most"))
    return out.withColumn("n", F.when(F.col("n") == F.col("most"), F.col("n")).otherwise(F.raise_error(F.lit("conflicting rules")).cast("bigint"))).select("premises", "n")


_SPACE = """WITH n AS (SELECT o_orderpriority AS space, o_orderkey AS k, sha256(o_orderkey || '|' || o_custkey) AS new FROM orders WHERE o_orderpriority <> '5-LOW' OR o_orderkey % 2 = 0),
o AS (SELECT o_orderpriority AS space, o_orderkey AS k, sha256(o_orderkey || '|' || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 5 = 0 THEN 0 ELSE o_custkey END) AS old FROM orders
  WHERE o_orderpriority <> '1-URGENT' AND (o_orderpriority <> '3-MEDIUM' OR o_orderkey % 2 = 0)),
d AS (SELECT coalesce(n.space, o.space) AS space, count(old) AS n_old, count(new) AS n_new, count(*) FILTER (new <> old) AS changed, count(*) FILTER (new IS NULL) AS removed FROM n FULL JOIN o ON n.space = o.space AND n.k = o.k GROUP BY 1)"""


@query("mine_workspace_sync", f"{_SPACE} SELECT *, CASE WHEN n_old = 0 THEN 'created' WHEN changed + removed > 0 THEN 'rebuilt' WHEN n_new = n_old THEN 'reused' ELSE 'appended' END AS state FROM d")
def workspace_sync(v: Views) -> DataFrame:
    """Workspaces (order priorities) against the snapshot before, by content digests: created, reused, appended or rebuilt."""
    o = v.table("orders").select(F.col("o_orderpriority").alias("space"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    digest = lambda c: F.sha2(F.concat_ws("|", "k", c), 256)
    new = o.where("space <> '5-LOW' OR k % 2 = 0").select("space", "k", digest("c").alias("new"))
    edited = F.when((F.col("space") == "4-NOT SPECIFIED") & (F.col("k") % 5 == 0), 0).otherwise(F.col("c"))
    old = o.where("space <> '1-URGENT' AND (space <> '3-MEDIUM' OR k % 2 = 0)").select("space", "k", digest(edited).alias("old"))
    d = new.join(old, ["space", "k"], "full").groupBy("space").agg(F.count("old").alias("n_old"), F.count("new").alias("n_new"), F.count_if(F.col("old") != F.col("new")).alias("changed"), F.count_if(F.col("new").isNull()).alias("removed"))
    state = F.when(F.col("n_old") == 0, "created").when(F.col("changed") + F.col("removed") > 0, "rebuilt").when(F.col("n_new") == F.col("n_old"), "reused").otherwise("appended")
    return d.withColumn("state", state)


@query("jn_dependency_cluster")
def dependency_cluster(v: Views) -> DataFrame:
    """Rules whose covers overlap by 0.9 (Jaccard) form a cluster: overlaps in Spark, union-find over at most 30 rules."""
    rows = ranking.activate(mining.cases(v), ranking.serving_rules(v)).select(F.array_sort("active.premises").alias("a")).where(F.size("a") > 0).groupBy("a").agg(F.count("*").alias("n"))
    n = rows.select("n", F.explode("a").alias("r")).groupBy("r").agg(F.sum("n").alias("n"))
    both = rows.select("n", F.explode("a").alias("x"), "a").select("n", "x", F.explode("a").alias("y")).where("x < y").groupBy("x", "y").agg(F.sum("n").alias("k"))
    j = both.join(n.select(F.col("r").alias("x"), F.col("n").alias("nx")), "x").join(n.select(F.col("r").alias("y"), F.col("n").alias("ny")), "y")
    links = j.where(F.col("k") / (F.col("nx") + F.col("ny") - F.col("k")) >= 0.9).select("x", "y").collect()
    top = {r.r: r.r for r in n.select("r").collect()}

    def root(a: str) -> str:
        while top[a] != a:
            a = top[a]
        return a

    for x, y in links:
        a, b = sorted((root(x), root(y)))
        top[b] = a
    return v.spark.createDataFrame([(r, root(r)) for r in sorted(top)], "premises string, cluster string")


@query("top_rules_pair", f"{PAIRS}, w AS (SELECT family, value, n, abs(ln(p / (1 - p))) AS m FROM pr), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY floor(m * 1e6 + 0.5) DESC, n DESC, value) AS r FROM w) SELECT family, value, r AS place FROM k WHERE r <= 3")
def top_rules_pair(v: Views) -> DataFrame:
    """The three strongest values of each family; mirrored values keep both orientations."""
    rules = ranking.pair_rules(ranking.pairs(v)).withColumn("g", grid(F.abs("margin")))
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.col("g").desc(), F.col("n").desc(), "value"))
    return rules.withColumn("place", place).where("place <= 3").select("family", "value", "place")


@query("prf_topology_check", f"{POINTS} SELECT count(*) AS rules, count(DISTINCT premises) AS channels, count(*) FILTER (predicates < atoms) AS repeated_predicates, count(*) FILTER (size <> atoms OR size NOT BETWEEN 1 AND 2) AS bad_sizes FROM (SELECT premises, size, count(*) AS atoms, count(DISTINCT split_part(atom, '=', 1)) AS predicates FROM prem GROUP BY 1, 2)")
def topology_check(v: Views) -> DataFrame:
    """Counts that must hold for a rule set to be served: unique channels, each predicate once in a rule."""
    r = ranking.serving_rules(v).withColumn("p", F.transform(F.split("premises", " & "), lambda a: F.split(a, "=")[0]))
    return r.agg(F.count("*").alias("rules"), F.count_distinct("premises").alias("channels"), F.count_if(F.size(F.array_distinct("p")) < F.size("p")).alias("repeated_predicates"), F.count_if((F.size("p") != F.col("size")) | ~F.col("size").between(1, 2)).alias("bad_sizes"))


_PUBLISHED = f"{POINTS}, old AS (SELECT predicate || '=' || value AS premises, sum(y) AS ny FROM facts WHERE year(ts) < 1997 GROUP BY 1 UNION ALL SELECT a.predicate || '=' || a.value || ' & ' || b.predicate || '=' || b.value, sum(a.y) FROM facts a JOIN facts b ON a.impression = b.impression AND a.article = b.article AND a.predicate < b.predicate WHERE year(a.ts) < 1997 GROUP BY 1)"


@query("prf_provenance", f"{_PUBLISHED} SELECT count(*) AS proofs, count(*) FILTER (o.premises IS NULL) AS dangling, count(*) FILTER (a.size < 1) AS without_premises FROM act a LEFT JOIN (SELECT premises FROM old WHERE ny >= 400) o USING (premises)")
def provenance(v: Views) -> DataFrame:
    """Proofs by the rules of all cases, against the rules that were published before 1997; a proof whose rule is not there dangles."""
    proofs = ranking.activate(mining.cases(v), ranking.serving_rules(v)).select("impression", "article", F.explode("active").alias("r")).select("impression", "article", "r.premises", "r.size")
    published = mining.counts(mining.cases(v).where("year(ts) < 1997"), 2).where("ny >= 400").select("premises", F.lit(1).alias("served"))
    return proofs.join(published, "premises", "left").agg(F.count("*").alias("proofs"), F.count_if(F.col("served").isNull()).alias("dangling"), F.count_if(F.col("size") < 1).alias("without_premises"))


@query("mine_point_pipeline", f"{POINTS} SELECT premises, size, {R6('strength')} AS strength, {R6('confidence')} AS confidence FROM sel")
def point_pipeline(v: Views) -> DataFrame:
    """Cases, counts, truth values, quality, quotas: the serving rule set of the point score."""
    return ranking.serving_rules(v).select("premises", "size", r6(F.col("strength")).alias("strength"), r6(F.col("confidence")).alias("confidence"))


@query("mine_pair_pipeline", f"{PAIRS} SELECT family, value, {R6('ln(p / (1 - p))')} AS margin, count(*) OVER (PARTITION BY family) AS values FROM pr")
def pair_pipeline(v: Views) -> DataFrame:
    rules = ranking.pair_rules(ranking.pairs(v))
    return rules.select("family", "value", r6(F.col("margin")).alias("margin"), F.count("*").over(Window.partitionBy("family")).alias("values"))


@query("fn_text_unicode")
def unicode_labels(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", text.normalize_unicode(F.col("source")).alias("label"))


@query("agg_conditional_audit", f"{_COND} SELECT count(*) AS patterns, count(*) FILTER (p - base <= 1e-12) AS no_effect, count(*) FILTER (p - base > 1e-12 AND p - greatest(base, parent) <= 1e-12) AS no_gain FROM s")
def conditional_audit(v: Views) -> DataFrame:
    """Why patterns were refused."""
    c = q_mining.conditional(v)
    gain = F.col("p") - F.greatest("base", "parent")
    return c.agg(F.count("*").alias("patterns"), F.count_if(F.col("p") - F.col("base") <= 1e-12).alias("no_effect"), F.count_if((F.col("p") - F.col("base") > 1e-12) & (gain <= 1e-12)).alias("no_gain"))
