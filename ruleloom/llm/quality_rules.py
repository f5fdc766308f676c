"""Quality rules whose thresholds adapt to each language and source, in DataFrame functions only.

Each metric is summarised per (language, source) by a quantile sketch of logarithmic buckets: a value
v falls into bucket ceil(log(v) / log(GAMMA)), whose upper edge is within ``ACCURACY`` of v.  Sketches
are tables of bucket counts, so they merge by adding counts, and they do not depend on the order of
rows or merges.  They describe the rows that pass the base rule.  The threshold of a metric is a high
quantile of the group, shrunk towards that of its language, which is shrunk towards that of all rows, as if
each parent had ``PRIOR_ROWS`` rows.  A document beyond a threshold is not kept; nothing else decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import BLANKS, materialise, text_of

WORD, GAP, SYMBOLS = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+", "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 10, 20
ACCURACY = 0.02
GAMMA = 1 + ACCURACY
#: Rows that a parent's quantile counts as.
PRIOR_ROWS = 200
#: The quantile of each metric that is its threshold.
RULES = {"symbols_per_word": 0.95, "dup_line_share": 0.98, "repeat_share": 0.99, "chars_per_word": 0.99, "thin_words": 0.99}
#: The bucket of zeros.
ZERO = -(1 << 20)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often and deep inside lambdas it is used."""
    return F.transform(F.array(value), then)[0]


def _covered(starts: Column) -> Column:
    """Words in windows of five that begin at ``starts`` (ascending)."""
    n = F.size(starts)
    gaps = F.transform(starts, lambda x, i: F.when(i + 1 < n, F.least(F.lit(5), F.get(starts, i + 1) - x)).otherwise(F.lit(5)))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def _repeated_words(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more in the text."""

    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"]))
            return let(F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"])), _covered)

        marked = let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marked)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(5))))
    return F.when(F.size(words) < 5, F.lit(0)).otherwise(let(windows, of_hashes))


def measures(docs: DataFrame) -> DataFrame:
    """The base columns of each document, with doc_id, lang and source."""
    text = F.col("_text")
    rows = docs.select("doc_id", "lang", "source", text_of().alias("_text"))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    rows = rows.select(
        "doc_id", "lang", "source",
        let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeated_words(w).cast("bigint").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("l"),
    )
    return rows.select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def _metrics() -> dict[str, Column]:
    share = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return {
        "symbols_per_word": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "chars_per_word": share("word_chars", "n_words"), "thin_words": F.lit(1.0) / F.greatest(F.lit(0.01), share("word_chars", "n_words")),
    }


def sketches(rows: DataFrame) -> DataFrame:
    """Bucket counts of the rows that pass the base rule, by level (2: language and source, 1: language, 0: all), group and metric."""
    bucket = lambda v: F.when(v <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log(v) / F.log(F.lit(GAMMA)))).cast("int")
    items = F.array(*(F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in _metrics().items()))
    base = rows.where(~base_failed()).select("lang", "source", F.explode(items).alias("x")).groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))
    wide = base.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    whole = wide.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    two = base.select(F.lit(2).alias("level"), "lang", "source", "metric", "bucket", "n")
    one = wide.select(F.lit(1).alias("level"), "lang", none.alias("source"), "metric", "bucket", "n")
    return two.unionByName(one).unionByName(whole.select(F.lit(0).alias("level"), none.alias("lang"), none.alias("source"), "metric", "bucket", "n"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def quantiles(sketch: DataFrame) -> DataFrame:
    """level, lang, source, rows and the quantile of each metric: the upper edge of its bucket."""
    group = Window.partitionBy("level", "lang", "source", "metric")
    value = F.when(F.col("bucket") == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")))
    rows = sketch.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "rows": F.sum("n").over(group), "value": value})
    share = F.create_map(*(F.lit(x) for item in RULES.items() for x in item))
    reached = F.col("upto") >= F.ceil(F.col("rows") * F.element_at(share, F.col("metric")))
    found = lambda m: F.min(F.when(reached & (F.col("metric") == m), F.col("value"))).alias(m)
    return rows.groupBy("level", "lang", "source").agg(F.first("rows").alias("rows"), *(found(m) for m in RULES))


def thresholds(sketch: DataFrame, prior: int = PRIOR_ROWS) -> DataFrame:
    """level, lang, source and the threshold of each metric; levels 1 and 0 are for groups without a row in the sketch."""
    found = materialise(quantiles(sketch))
    level = lambda n: found.where(F.col("level") == n).select(*(F.col(c).alias(f"{c}_{n}") for c in ("lang", "source", "rows", *RULES)))
    blend = lambda m, n, parent: ((F.col(f"rows_{n}") * F.col(f"{m}_{n}") + prior * F.col(parent)) / (F.col(f"rows_{n}") + prior)).alias(f"t_{m}_{n}")
    lang = level(1).join(F.broadcast(level(0)))
    lang = lang.select("*", *(blend(m, 1, f"{m}_0") for m in RULES))
    own = level(2).join(lang, F.col("lang_2").eqNullSafe(F.col("lang_1")))
    own = own.select(F.lit(2).alias("level"), F.col("lang_2").alias("lang"), F.col("source_2").alias("source"), *(blend(m, 2, f"t_{m}_1").alias(m) for m in RULES))
    none = F.lit(None).cast("string").alias("source")
    lang = lang.select(F.lit(1).alias("level"), F.col("lang_1").alias("lang"), none, *(F.col(f"t_{m}_1").alias(m) for m in RULES))
    return own.unionByName(lang).unionByName(found.where("level = 0").select("level", "lang", "source", *RULES))


def quality_rules(docs: DataFrame, prior: int = PRIOR_ROWS) -> DataFrame:
    """doc_id, the base columns, base_failed, kept and ``beyond`` (the names of the metrics beyond their threshold).

    Needs doc_id, text, lang and source; other columns, whatever their names, are ignored.  A null text has no
    words and fails the base rule; texts of any length are measured whole.  Null languages and sources are
    groups of their own.  A value equal to its threshold is not beyond it.  Where no row of a group passes the
    base rule its language's threshold holds.  Repeated rows are judged one by one.  An empty table gives no rows.
    """
    rows = materialise(measures(docs))
    found = materialise(thresholds(sketches(rows), prior))
    level = lambda n: found.where(F.col("level") == n).select(*(F.col(c).alias(f"{c}_{n}") for c in ("lang", "source", *RULES)))
    own, lang, whole = level(2), level(1), level(0)
    joined = rows.join(own, rows.lang.eqNullSafe(own.lang_2) & rows.source.eqNullSafe(own.source_2), "left")
    joined = joined.join(lang, joined.lang.eqNullSafe(lang.lang_1), "left").join(F.broadcast(whole), F.lit(True), "left")
    metrics = _metrics()
    beyond = F.filter(F.array(*(F.when(metrics[m] > F.coalesce(f"{m}_2", f"{m}_1", f"{m}_0"), F.lit(m)) for m in RULES)), lambda x: x.isNotNull())
    failed = base_failed()
    return joined.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.size(beyond) == 0)).alias("kept"), F.array_join(beyond, ",").alias("beyond"))
