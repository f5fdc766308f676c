"""Hand-computed values of single operators, and invariances."""

import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleloom.functions import buckets, text, truth
from ruleloom.operators import evaluation, mining, ranking, sampling, vectors
from ruleloom.plans import q_scalars
from ruleloom.sources import logs
from ruleloom.streaming import feedback


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize(("values", "bins", "cuts"), [
    ([(x, 1.0) for x in range(8)], 4, [2, 4, 6]),
    ([(1.0, 1.0), (2.0, 1.0), (5.0, 1.0), (10.0, 1.0)], 4, [2, 5, 10]),
    ([(0, 3.0), (1, 2.0), (2, 1.0)], 4, [1, 2]),
    ([(1, 1 / 3), (2, 1 / 3), (3, 1 / 3), (100, 1.0)], 2, [100]),
    ([(1, 1.0), (2, 1.0), (3, 1.0), (100, 1.0)], 2, [3]),
])
def test_quantile_cuts(spark, values, bins, cuts):
    for rows in (values, values[::-1]):
        df = spark.createDataFrame([(float(v), w) for v, w in rows], "value double, weight double")
        assert sorted({r.cut for r in mining.quantile_cuts(df, bins).collect()}) == cuts


def test_macro_weights_each_impression_once(spark):
    rows = [("i1", 1, "a"), ("i1", 0, "b"), ("i1", 0, "b"), ("i2", 0, "a"), ("i2", 1, "b")]
    df = spark.createDataFrame([(i, y, *[v] * 5) for i, y, v in rows], "impression string, y int, " + ", ".join(f"{p} string" for p in mining.PREDICATES))
    got = {r.premises: r for r in mining.macro(df, k=2.0).collect()}["topic=a"]
    # mass of a: 1/3 and 1/2, of which 1/3 clicked
    assert got.strength == pytest.approx((1 / 3) / (5 / 6)) and got.effective == pytest.approx((5 / 6) ** 2 / (1 / 9 + 1 / 4))
    assert got.negative_strength == pytest.approx((1 / 2) / (2 / 3 + 1 / 2)) and got.confidence == pytest.approx(got.effective / (got.effective + 2))


def test_contingency_branches(spark):
    rows = [(1, "x"), (1, "x"), (0, "x"), (1, "y"), (0, "y"), (0, "y")]
    df = spark.createDataFrame([(y, *[v] * 5) for y, v in rows], "y int, " + ", ".join(f"{p} string" for p in mining.PREDICATES))
    r = {x.premises: x for x in mining.branches(mining.contingency(df, 1), k=2.0).collect()}["topic=x"]
    assert (r.n, r.ny, r.strength, r.confidence) == (3, 2, pytest.approx(2 / 3), pytest.approx(3 / 5))
    assert (r.negative_strength, r.negative_confidence) == (pytest.approx(1 / 3), pytest.approx(3 / 5))


def test_midranks(spark):
    df = spark.createDataFrame([(1, 0.3), (2, 0.1 + 0.2), (3, 0.0)], "k int, v double").withColumn("g", ranking.grid(F.col("v"))).withColumn("s", F.lit(1))
    assert [r.m for r in df.withColumn("m", ranking.midrank(F.col("g"), "s")).orderBy("k").collect()] == [0.75, 0.75, 0.0]


def test_truth_values(spark):
    s, c = F.lit(0.7), F.lit(0.4)
    r = one(spark, back=truth.from_variance(s, truth.variance(s, c)), zero=truth.confidence(F.lit(0)), again=truth.reencode(truth.confidence(F.lit(40.0)), 800.0, 20.0),
            sure=truth.modus_ponens(F.lit(1.0), F.lit(1.0), s, c, F.lit(0.2), F.lit(0.3))[0], odds=truth.log_odds(F.lit(0.5)), none=truth.conjunction(s, F.lit(0.0), s, c)[1])
    assert r.back == pytest.approx(0.4) and r.zero == 0 and r.again == pytest.approx(40 / 60) and r.sure == pytest.approx(0.7) and r.odds == 0 and r.none == 0


def test_truth_values_in_sql(spark):
    truth.register_sql(spark)
    r = spark.sql("SELECT tv_confidence(800) AS c, tv_posterior(1, 0.5, 0.2) AS p").first()
    assert (r.c, r.p) == (0.5, pytest.approx(0.6))


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(sorted(buckets.BUCKETS)), st.floats(-5, 2000, allow_nan=False))
def test_buckets_are_total_and_agree_with_duckdb(bucket, x):
    import duckdb

    symbols = {s for s, _ in buckets.BUCKETS[bucket][0]} | {buckets.BUCKETS[bucket][1]}
    assert duckdb.sql(f"SELECT {buckets.sql(bucket, repr(x))}").fetchall()[0][0] in symbols


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["click", "view"]), st.sampled_from("abcdef")), max_size=60))
def test_profile_is_bounded_and_exclusive(events):
    history, skips = [], []
    for e, i in events:
        history, skips = feedback.fold(history, skips, e, i)
        assert len(skips) <= feedback.SKIPS and len(set(skips)) == len(skips)
        assert (history[-1] == i and i not in skips) if e == "click" else skips[-1] == i


def test_leader_clusters_follow_order():
    a, b = np.array([1.0, 0]), np.array([0, 1.0])
    assert vectors.lead([a, a, -a, b], [3, 2, 1, 0]) == [0, 0, 1, 2]
    assert vectors.lead([], []) == []


def test_prefix_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(f"{i:03x}f", s) for i, s in enumerate([3, 4, 9, 1])], "p string, n int")
    assert sorted(r.n for r in sampling.prefix_within(df, "p", "n", 8).collect()) == [3, 4]


def test_text_functions(spark):
    d = spark.createDataFrame([("  A  bC\t",), ("",), (None,)], "c string")
    assert [r.x for r in d.select(text.normalize_label(F.col("c")).alias("x")).collect()] == ["a bc", "unknown", "unknown"]
    assert [r.x for r in d.select(text.normalize_unicode(F.col("c")).alias("x")).collect()] == ["a bc", "unknown", "unknown"]
    c = spark.createDataFrame([("9AM",), ("12 am",), ("14:00",), ("25",), ("13PM",), ("soon",)], "c string")
    assert [r.x for r in c.select(text.clock_hour(F.col("c")).alias("x")).collect()] == [9, 0, 14, None, None, None]
    s = spark.createDataFrame([("ok_1",), ("a b",), ("a_b",), ("--",)], "c string")
    out = [r.x for r in s.select(text.safe_symbol(F.col("c")).alias("x")).collect()]
    assert out[0] == "id_ok_1" and out[2] == "id_a_b" and out[1].startswith("id_a_b_") and out[3].startswith("id_value_") and len(set(out)) == 4


def test_pair_symbols_reverse(spark):
    p = spark.createDataFrame([("left",), ("right",), ("equal",), ("left_known",), ("incomparable",)], "x string")
    twice = p.select("x", q_scalars.reverse(q_scalars.reverse(F.col("x"))).alias("y")).collect()
    assert all(r.x == r.y for r in twice)


def test_logs(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("1\tu1\t11/15/2019 8:55:22 AM\tN1 N9\tN2-1 N-3-0\n2\tu2\t2019-11-15 20:01:00\t\tN2-0\n")
    rows = {(r.impression, r.article): r for r in logs.read_behaviors(spark, str(tmp_path / "b.tsv")).collect()}
    assert rows["1", "N2"].click == 1 and rows["1", "N-3"].click == 0 and rows["1", "N2"].history == ["N1", "N9"] and rows["2", "N2"].history == []
    assert rows["1", "N2"].ts.hour == 8 and rows["2", "N2"].ts.hour == 20
    news = "N1\ta\tb\tT\tA\tu\t[{\"WikidataId\": \"Q1\"}]\t[]\n"
    (tmp_path / "n.tsv").write_text("﻿" + news + news)
    assert [r.entities for r in logs.read_news(spark, str(tmp_path / "n.tsv")).collect()] == [["Q1"]]
    (tmp_path / "n.tsv").write_text(news + news.replace("\tT\t", "\tother\t"))
    with pytest.raises(ValueError, match="conflicting"):
        logs.read_news(spark, str(tmp_path / "n.tsv"))


def test_merge_refuses_core_conflicts(spark):
    a = spark.createDataFrame([(1, "", "x")], "id int, title string, topic string")
    b = spark.createDataFrame([(1, "t", "x")], "id int, title string, topic string")
    assert logs.merge_catalog([a, b], ["topic"]).first().title == "t"
    with pytest.raises(ValueError, match="core"):
        logs.merge_catalog([a, b.withColumn("topic", F.lit("y"))], ["topic"]).count()


def test_split_choice(spark, tmp_path):
    assert logs.choose_splits(["/d/smalltrain", "/d/my-train", "/d/x/train", "/d/x/deep/dev", "/d/Validation"]) == {"train": "/d/x/train", "eval": "/d/Validation"}
    (tmp_path / "train").mkdir()
    for name in ("news.tsv", "behaviors.tsv"):
        (tmp_path / "train" / name).write_text("")
    with pytest.raises(FileNotFoundError, match="eval"):
        logs.find_splits(spark, str(tmp_path))


def test_archive_members_stay_inside(spark, tmp_path):
    for member, fits in (("a/b.txt", True), ("../b.txt", False)):
        with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
            z.writestr(member, "text")
        if fits:
            assert logs.unpack(spark, str(tmp_path / "x.zip"), str(tmp_path / "out")) == [member] and (tmp_path / "out" / member).read_text() == "text"
        else:
            with pytest.raises(ValueError, match="outside"):
                logs.unpack(spark, str(tmp_path / "x.zip"), str(tmp_path / "out"))


def test_model_is_verified_and_exclusive(spark, tmp_path):
    rules = spark.createDataFrame([("topic=a", 0.5), ("topic=b", 0.25)], "premises string, strength double")
    logs.save_model(rules, str(tmp_path / "m"))
    assert logs.load_model(spark, str(tmp_path / "m")).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        logs.save_model(rules, str(tmp_path / "m"))
    rules.limit(1).write.mode("overwrite").parquet(str(tmp_path / "m" / "rules"))
    with pytest.raises(ValueError, match="digest"):
        logs.load_model(spark, str(tmp_path / "m"))


def test_snapshot_and_neural_columns(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"id": 1, "title_embedding": [1.0], "llm_topic": "x", "title_idf_model": 2}]')
    df = logs.read_snapshot(spark, str(tmp_path / "s.json"))
    assert sorted(logs.strip_neural(df).columns) == ["id", "title_idf_model"]


def test_rule_versions(spark, tmp_path):
    v = feedback.RuleVersions(spark, str(tmp_path))
    rules = spark.range(1)
    assert v.current() is None
    first = v.capture()
    assert v.capture() is None and v.wanted() and v.promote(first, rules) and v.current()[0] == 1
    second = v.capture()
    assert not v.wanted() and not v.promote(second, rules, config_unchanged=False)
    v.capture()  # its driver is lost
    other = feedback.RuleVersions(spark, str(tmp_path))
    assert other.capture() is None and other.current()[0] == 1
    other.abandon()
    late = other.capture()
    assert late == 4 and not v.promote(3, rules) and other.current()[0] == 1
    with pytest.raises(Exception, match="(?i)division|zero"):
        other.promote(late, spark.range(1).select(F.raise_error(F.lit("division")).alias("x")))
    assert other.current()[0] == 1 and other.promote(other.capture(), rules) and v.current()[0] == 5


def test_bootstrap_draws_are_even_and_unrelated(spark):
    units = spark.range(400).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(200))).alias("r"))
    x = units.select("u", "r", (evaluation.drawn(F.col("u"), F.col("r"), 7) / evaluation.PRIME).alias("x")).toPandas().pivot(index="u", columns="r", values="x").to_numpy()
    assert abs(x.mean() - 0.5) < 0.005 and abs(x.var() - 1 / 12) < 0.002
    for rows in (x, x.T):
        c = np.corrcoef(rows)[np.triu_indices(len(rows), 1)]
        assert abs(c.mean()) < 0.002 and abs(c.std() * np.sqrt(rows.shape[1]) - 1) < 0.05
    weight = (x[:, :, None] >= np.array(evaluation.CUTS)).sum(2)
    assert abs(weight.mean() - 1) < 0.02 and abs(weight.var() - 1) < 0.03


def test_bootstrap_interval_matches_the_normal_one(spark):
    rows = spark.range(3000).select("id", F.sin(F.col("id") * 1.7).alias("d"))
    got, d = evaluation.bootstrap(rows, F.col("id")).first(), np.sin(np.arange(3000) * 1.7)
    half = 1.96 * d.std() / np.sqrt(len(d))
    assert abs(got.mean - d.mean()) < 1e-9 and abs(got.high - d.mean() - half) < 0.15 * half and abs(d.mean() - got.low - half) < 0.15 * half
