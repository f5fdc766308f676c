"""Queries of projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import buckets, text
from ruleloom.plans.registry import query
from ruleloom.plans.views import FEATURES, R6, Views, r6

KEY = "impression, article"


def _bucket_query(name: str, columns: dict[str, tuple[str, str]]) -> None:
    """One query over the feature rows: output column -> (bucket, expression in either SQL)."""
    listed = ", ".join(f"{buckets.sql(b, x)} AS {out}" for out, (b, x) in columns.items())

    @query(name, f"{FEATURES} SELECT {KEY}, {listed} FROM feat")
    def run(v: Views, columns=columns) -> DataFrame:
        return v.features().select("impression", "article", *(buckets.column(b, x).alias(out) for out, (b, x) in columns.items()))


_SHARE = "CASE WHEN known = 0 THEN 0.0E0 ELSE topic_count / (known * 1.0E0) END"
_bucket_query("prj_affinity_level", {"long_affinity": ("share", _SHARE), "recent_affinity": ("share", "CASE WHEN recent_known = 0 THEN 0.0E0 ELSE topic_recent / (recent_known * 1.0E0) END")})
_bucket_query("prj_history_size", {"history_size_bucket": ("history_size", "known")})
_bucket_query("prj_count_bucket", {"topic_zero": ("count_zero", "topic_count"), "topic_few": ("count_few", "topic_count"), "recent_none": ("count_none", "topic_recent")})
_bucket_query("prj_support_bucket", {"support": ("share", "CASE WHEN known = 0 THEN 0.0E0 ELSE least(1.0E0, subcategory_count / (known * 1.0E0)) END")})
_bucket_query("prj_recency_bucket", {"topic_latest": ("lag_latest", "topic_lag"), "topic_immediate": ("lag_immediate", "topic_lag"), "subcategory_immediate": ("lag_immediate", "subcategory_lag")})
_bucket_query("prj_position_bucket", {"position_bucket": ("position", "position")})


@query("prj_topic_rank", f"{FEATURES} SELECT {KEY}, CASE WHEN topic_count = 0 THEN 'none' WHEN topic_count = topic_top THEN 'top' ELSE 'secondary' END AS topic_rank FROM feat")
def topic_rank(v: Views) -> DataFrame:
    return v.features().select("impression", "article", F.when(F.col("topic_count") == 0, "none").when(F.col("topic_count") == F.col("topic_top"), "top").otherwise("secondary").alias("topic_rank"))


@query("prj_similarity_bucket", f"SELECT vec_id, {buckets.sql('similarity', 'CASE WHEN embedding[1] < -0.2 THEN NULL ELSE abs(embedding[1]) END')} AS similarity FROM embeddings")
def similarity_bucket(v: Views) -> DataFrame:
    x = F.when(F.col("embedding")[0] < -0.2, F.lit(None)).otherwise(F.abs(F.col("embedding")[0]))
    return v.table("embeddings").select("vec_id", x.alias("x")).select("vec_id", buckets.column("similarity", "x").alias("similarity"))


@query("prj_time_bucket", f"SELECT event_id, {buckets.sql('hour', 'hour(ts)')} AS time_bucket, {buckets.sql('hour', 'CASE WHEN hour(ts) % 3 = 0 THEN NULL ELSE hour(ts) END')} AS clock_bucket FROM events")
def time_bucket(v: Views) -> DataFrame:
    """From a timestamp, and from the clock texts 9AM and 14:00; a text that is no time is unknown."""
    hour = F.hour("ts")
    clock = F.when(hour % 3 == 0, F.lit("noon-ish")).when(hour % 2 == 0, F.concat(F.when(hour % 12 == 0, 12).otherwise(hour % 12), F.when(hour < 12, "AM").otherwise("PM"))).otherwise(F.concat(hour, F.lit(":05")))
    rows = v.table("events").select("event_id", hour.alias("h"), text.clock_hour(clock).alias("c"))
    return rows.select("event_id", buckets.column("hour", "h").alias("time_bucket"), buckets.column("hour", "c").alias("clock_bucket"))


_WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"


@query("prj_format_bucket", f"SELECT conv_id, turn, {buckets.sql('format', _WORDS)} AS format FROM conversations")
def format_bucket(v: Views) -> DataFrame:
    return v.table("conversations").select("conv_id", "turn", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n")).select("conv_id", "turn", buckets.column("format", "n").alias("format"))


@query("prj_normalize_label", "SELECT p_partkey, CASE WHEN s = '' THEN 'unknown' ELSE s END AS label FROM (SELECT p_partkey, lower(trim(regexp_replace(p_name || '  ' || p_type, '\\s+', ' ', 'g'))) AS s FROM part)")
def normalize_label(v: Views) -> DataFrame:
    """The ASCII rule; ``text.normalize_unicode`` adds NFKC and case folding as an Arrow UDF."""
    return v.table("part").select("p_partkey", text.normalize_label(F.concat_ws("  ", "p_name", "p_type")).alias("label"))


_SAFE = "CASE WHEN trim(c, '_') = '' THEN 'value' ELSE trim(c, '_') END"


@query("prj_safe_symbol", f"""SELECT p_partkey, 'id_' || substr(k, 1, 64) || CASE WHEN k <> raw OR length(k) > 64 THEN '_' || substr(sha256(raw), 1, 10) ELSE '' END AS symbol
FROM (SELECT p_partkey, raw, {_SAFE} AS k FROM (SELECT p_partkey, trim(p_name) AS raw, regexp_replace(trim(p_name), '[^A-Za-z0-9_]', '_', 'g') AS c FROM part))""")
def safe_symbol(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", text.safe_symbol(F.col("p_name")).alias("symbol"))


@query("prj_title_tokens", f"SELECT doc_id, len(t) AS n_tokens, coalesce(array_to_string(list_sort(t), ' '), '') AS tokens FROM (SELECT doc_id, list_distinct(list_filter(regexp_extract_all({text.fold_sql("coalesce(text, '')")}, '[\\p{{L}}\\p{{N}}_'']+'), lambda x: length(x) > 2 AND NOT list_contains({list(text.TITLE_STOP)!r}, x))) AS t FROM documents)")
def title_tokens(v: Views) -> DataFrame:
    """Distinct tokens of the texts of all languages, by Unicode words."""
    rows = v.table("documents").select("doc_id", F.array_sort(text.unicode_tokens(F.col("text"), title=True)).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("prj_lexical_tokens", f"SELECT conv_id, turn, len(t) AS n_tokens, coalesce(array_to_string(t, ' '), '') AS tokens FROM (SELECT conv_id, turn, list_filter(regexp_extract_all({text.fold_sql("coalesce(substr(text, 1, 20000), '')")}, '{text.WORD}(?:''{text.WORD})?'), lambda x: length(x) > 2 AND NOT list_contains({list(text.LEXICAL_STOP)!r}, x))[1:512] AS t FROM conversations)")
def lexical_tokens(v: Views) -> DataFrame:
    rows = v.table("conversations").select("conv_id", "turn", text.unicode_tokens(F.col("text")).alias("t"))
    return rows.select("conv_id", "turn", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("prj_wikidata_ids", "SELECT impression, CASE WHEN bool_and(ok) THEN array_to_string(list_sort(list_distinct(list(id))), ',') END AS ids FROM (SELECT l_orderkey AS impression, CASE WHEN l_linenumber = 7 THEN 'part ' ELSE 'Q' END || l_partkey AS id, l_linenumber <> 7 AS ok FROM lineitem) GROUP BY 1")
def wikidata_ids(v: Views) -> DataFrame:
    """Ids Q<n>; one item that is no such id makes the whole observation unknown."""
    item = F.concat(F.when(F.col("l_linenumber") == 7, "part ").otherwise("Q"), F.col("l_partkey").cast("string"))
    rows = v.table("lineitem").groupBy(F.col("l_orderkey").alias("impression")).agg(F.collect_list(item).alias("items"))
    return rows.select("impression", F.array_join(text.grounded_ids(F.col("items")), ",").alias("ids"))


@query("prj_canonical_id", "SELECT p_partkey, 'brand:' || trim(regexp_replace(f, '[^a-z0-9]+', '-', 'g'), '-') || '~' || substr(sha256(f), 1, 12) AS canonical_id FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(lower(p_name || ' & ' || p_brand), '&', ' and '), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS f FROM part)")
def canonical_id(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", text.canonical_id("brand", text.lexical_form(F.concat("p_name", F.lit(" & "), "p_brand"))).alias("canonical_id"))


@query("prj_article_text", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN trim(p_name) ELSE trim(p_name) || chr(10) || chr(10) || trim(p_type) END AS article_text FROM part")
def article_text(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", text.article_text(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col("p_type"))).alias("article_text"))


_PAIRS = FEATURES + """,
lv AS (SELECT impression, article, position, topic, subcategory, known, CASE WHEN subcategory_lag IS NULL THEN NULL ELSE 1.0E0 / (1 + subcategory_lag) END AS recency,
  """ + buckets.sql("share", _SHARE) + " AS aff, " + buckets.sql("history_size", "known") + " AS scope FROM feat)"


def relative(left: str, right: str, order: list[str]) -> str:
    """SQL of the comparison by an explicit order; values that it doesn't list are unknown."""
    rank = lambda x: "CASE " + " ".join(f"WHEN {x} = '{s}' THEN {i}" for i, s in enumerate(order)) + " END"
    a, b = rank(left), rank(right)
    return f"CASE WHEN {left} = {right} THEN 'equal' WHEN ({a}) IS NULL AND ({b}) IS NULL THEN 'incomparable' WHEN ({a}) IS NULL THEN 'right_known' WHEN ({b}) IS NULL THEN 'left_known' WHEN ({a}) > ({b}) THEN 'left' ELSE 'right' END"


def relative_number(left: str, right: str, missing: str = "unknown") -> str:
    same = f"abs({left} - {right}) <= greatest(1e-12, 1e-12 * greatest(abs({left}), abs({right})))"
    one = (f"WHEN {left} IS NULL THEN '{missing}' WHEN {right} IS NULL THEN '{missing}'" if missing == "incomparable"
           else f"WHEN {left} IS NULL AND {right} IS NULL THEN 'unknown' WHEN {left} IS NULL THEN 'right_known' WHEN {right} IS NULL THEN 'left_known'")
    return f"CASE {one} WHEN {same} THEN 'equal' WHEN {left} > {right} THEN 'left' ELSE 'right' END"


LEVELS = ["none", "low", "medium", "high"]


def sides(v: Views) -> DataFrame:
    """Candidates with the columns that pairs compare."""
    f = v.features().withColumn("recency", F.when(F.col("subcategory_lag").isNotNull(), F.lit(1.0) / (1 + F.col("subcategory_lag"))))
    return f.select("impression", "article", "position", "topic", "subcategory", "recency", "click", buckets.column("share", _SHARE).alias("aff"), buckets.column("history_size", "known").alias("scope"))


#: Pairs that one slate may have.
PAIR_BUDGET = 32_768


def guarded(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, which fail as they are read if a slate has more pairs than the budget; the count shares the join's exchange."""
    n = F.count("*").over(Window.partitionBy(key))
    rows = rows.withColumn("_n", n)
    many = F.raise_error(F.concat(F.lit("a slate has more pairs than the budget of "), F.lit(str(PAIR_BUDGET)), F.lit(": "), F.col(key).cast("string")))
    fits = F.when(F.col("_n") * (F.col("_n") - 1) / 2 <= PAIR_BUDGET, F.lit(True)).otherwise(many.cast("boolean"))
    return rows.where(fits).drop("_n")


def slate_pairs(rows: DataFrame) -> DataFrame:
    """Unordered pairs of each slate, left before right; a slate's size is checked before the join."""
    a = guarded(rows.select(*(F.col(c).alias(f"l_{c}") for c in rows.columns)), "l_impression")
    b = rows.select(*(F.col(c).alias(f"r_{c}") for c in rows.columns))
    return a.join(b, (F.col("l_impression") == F.col("r_impression")) & (F.col("l_position") < F.col("r_position")))


_PAIR_SQL = {
    "pair_history_scope": "CASE WHEN l_scope = r_scope THEN l_scope ELSE 'unknown' END", "pair_long_affinity": relative("l_aff", "r_aff", LEVELS),
    "pair_recency": relative_number("l_recency", "r_recency"), "pair_annotation": relative_number("l_recency", "r_recency", "incomparable"),
    "pair_same_topic": "CASE WHEN l_topic = r_topic THEN 'same' ELSE 'different' END", "pair_same_subcategory": "CASE WHEN l_subcategory = r_subcategory THEN 'same' ELSE 'different' END",
}
_SIDES = ["impression", "article", "position", "topic", "subcategory", "recency", "aff", "scope"]
_JOINED = f"{_PAIRS}, prs AS (SELECT {', '.join(f'a.{c} AS l_{c}, b.{c} AS r_{c}' for c in _SIDES)} FROM lv a JOIN lv b ON a.impression = b.impression AND a.position < b.position)"
_HEAD = "l_impression AS impression, l_article, r_article"


@query("prj_pair_features", f"{_JOINED} SELECT {_HEAD}, {', '.join(f'{x} AS {n}' for n, x in _PAIR_SQL.items())} FROM prs")
def pair_features(v: Views) -> DataFrame:
    return slate_pairs(sides(v)).select(F.col("l_impression").alias("impression"), "l_article", "r_article", *(F.expr(x).alias(n) for n, x in _PAIR_SQL.items()))


for _name, _out in (("prj_ordered_compare", "pair_long_affinity"), ("prj_numeric_compare", "pair_recency")):
    @query(_name, f"{_JOINED} SELECT {_HEAD}, {_PAIR_SQL[_out]} AS {_out} FROM prs")
    def _compare(v: Views, out=_out) -> DataFrame:
        return slate_pairs(sides(v)).select(F.col("l_impression").alias("impression"), "l_article", "r_article", F.expr(_PAIR_SQL[out]).alias(out))


def reverse(c: Column) -> Column:
    """The symbol of the same pair seen from the other side."""
    return F.when(c.startswith("left"), F.regexp_replace(c, "^left", "right")).when(c.startswith("right"), F.regexp_replace(c, "^right", "left")).otherwise(c)


@query("prj_reverse_pair", f"{_JOINED} SELECT {_HEAD}, {relative('r_aff', 'l_aff', LEVELS)} AS affinity, {relative_number('r_recency', 'l_recency')} AS recency FROM prs")
def reverse_pair(v: Views) -> DataFrame:
    """Reversal by rewriting symbols; the SQL compares the swapped sides."""
    p = pair_features(v)
    return p.select("impression", "l_article", "r_article", reverse(F.col("pair_long_affinity")).alias("affinity"), reverse(F.col("pair_recency")).alias("recency"))


@query("flt_abstain_llm", f"{_JOINED} SELECT pair_annotation, count(*) AS n FROM (SELECT {_PAIR_SQL['pair_annotation']} AS pair_annotation FROM prs) WHERE pair_annotation NOT IN ('unknown', 'incomparable', 'left_known', 'right_known') GROUP BY 1")
def abstain(v: Views) -> DataFrame:
    return pair_features(v).where(~F.col("pair_annotation").isin("unknown", "incomparable", "left_known", "right_known")).groupBy("pair_annotation").agg(F.count("*").alias("n"))


@query("fn_vector", f"SELECT vec_id, {R6('sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)))')} AS norm, {R6('list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding)')} AS mean FROM embeddings")
def vector_functions(v: Views) -> DataFrame:
    e = F.col("embedding")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.table("embeddings").select("vec_id", r6(norm).alias("norm"), r6(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(e)).alias("mean"))


@query("fn_hash_shard", "SELECT c_custkey, ('0x' || substr(sha256(c_name), 1, 7))::BIGINT % 16 AS shard FROM customer")
def hash_shard(v: Views) -> DataFrame:
    return v.table("customer").select("c_custkey", F.pmod(F.conv(F.substring(F.sha2("c_name", 256), 1, 7), 16, 10).cast("bigint"), F.lit(16)).alias("shard"))
