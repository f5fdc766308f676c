"""Running totals, the incremental miner, saved models and slate guards against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from ruleloom.operators import conditional, incremental, mining, running
from ruleloom.operators.mining import PREDICATES
from ruleloom.plans import q_pipelines, q_scalars
from ruleloom.sources import logs


def test_before_matches_a_loop(spark):
    rnd = random.Random(1)
    rows = [(k, i, f"2020-01-{1 + rnd.randrange(9):02d} 10:{rnd.randrange(60):02d}:00", rnd.randrange(5)) for i in range(300) for k in ("hot", f"k{i % 7}")]
    df = spark.createDataFrame(rows, "key string, impression int, at string, x int").withColumn("ts", F.to_timestamp("at"))
    got = {(r.key, r.impression): (r.n, r.total) for r in running.before(df, ["key"], {"n": F.lit(1), "total": F.col("x")}).collect()}
    for k, i, at, _ in rows:
        earlier = [x for k2, i2, at2, x in rows if k2 == k and (at2, i2) < (at, i)]
        assert got[k, i] == (len(earlier), sum(earlier))
    whole = {(r.key, r.impression): r.n for r in running.before(df.where("key = 'hot'"), [], {"n": F.lit(1)}).collect()}
    assert whole == {k: n for k, (n, _) in got.items() if k[0] == "hot"}


@pytest.mark.parametrize("slices", [2, 64])
def test_ordered_matches_a_sort(spark, slices):
    rnd = random.Random(2)
    rows = [(k, float(v), rnd.randrange(1, 9)) for k in ("a", "b") for v in rnd.sample(range(5000), 400)] + [("one", 1.0, 3)]
    df = spark.createDataFrame(rows, "key string, value double, weight int")
    got = {(r.key, r.value): (r.cum, r.next, r.i, r.total) for r in running.ordered(df, ["key"], slices).collect()}
    for key in ("a", "b", "one"):
        own = sorted((v, w) for k, v, w in rows if k == key)
        for i, (v, _) in enumerate(own):
            assert got[key, v] == (sum(w for _, w in own[: i + 1]), own[i + 1][0] if i + 1 < len(own) else None, i + 1, sum(w for _, w in own))


def cases(spark, ids, symbol="s"):
    rows = [(i, i % 3, i % 2, *(f"{symbol}{(i + k) % 3}" for k in range(len(PREDICATES)))) for i in ids]
    return spark.createDataFrame(rows, "impression int, article int, y int, " + ", ".join(f"{p} string" for p in PREDICATES))


def supports(rules):
    return {r.premises: (r.n, r.ny) for r in rules.collect()}


def test_incremental_modes_equal_full_recounts(spark, tmp_path):
    plan, seen = incremental.Plan(str(tmp_path / "plan")), []
    units = lambda ids: spark.createDataFrame([(i,) for i in ids], "impression int")
    steps = [
        (cases(spark, range(40)), 2, None, "full_seed", 40), (cases(spark, range(40)), 2, None, "reused", 0), (cases(spark, range(60)), 2, None, "delta_updated", 20),
        (cases(spark, range(60), "t"), 2, None, "rebuilt_full", 60), (cases(spark, range(50), "t"), 2, None, "rebuilt_full", 50), (cases(spark, range(50), "t"), 1, None, "reconfigured_full", 50),
        (cases(spark, range(50)), 2, units(range(50)), "reconfigured_full", 50), (cases(spark, range(10, 70)), 2, units(range(10, 70)), "retention_expired_full", 60),
    ]
    for rows, depth, kept, mode, researched in steps:
        rules, audit = plan.mine(rows, depth, 3, kept)
        assert (audit.mode, audit.researched_cases) == (mode, researched)
        assert supports(rules) == supports(mining.mine(rows, depth, 3))
        seen.append(audit.version)
    assert seen == [1, 1, 2, 3, 4, 5, 6, 7]
    # counts below a threshold are kept, so that a later call may lower it
    assert len(supports(plan.mine(cases(spark, range(10, 70)), 2, 25, units(range(10, 70)))[0])) < len(supports(rules))


def test_a_failed_build_commits_nothing(spark, tmp_path):
    plan = incremental.Plan(str(tmp_path / "plan"))
    first, _ = plan.mine(cases(spark, range(20)), 1, 1)
    before = supports(first)
    tight = incremental.Plan(plan.root, max_patterns=2)
    with pytest.raises(MemoryError):
        tight.mine(cases(spark, range(30)), 1, 1)
    with pytest.raises(MemoryError):
        incremental.Plan(plan.root, max_cases=5).mine(cases(spark, range(30)), 1, 1)
    assert plan.current(spark).version == 1 and supports(plan.mine(cases(spark, range(20)), 1, 1)[0]) == before
    rules, audit = plan.mine(cases(spark, range(30)), 1, 1)
    assert (audit.mode, audit.version) == ("delta_updated", 2) and supports(rules) == supports(mining.mine(cases(spark, range(30)), 1, 1))


def test_a_slate_beyond_the_budget_fails(spark):
    rows = spark.range(300).select(F.lit(1).alias("impression"), F.col("id").alias("article"), F.col("id").alias("position"))
    with pytest.raises(Exception, match="budget"):
        q_scalars.slate_pairs(rows).count()
    assert q_scalars.slate_pairs(rows.limit(200)).count() == 200 * 199 // 2


def test_the_fixture_has_its_clicks(spark):
    from ruleloom.plans.views import Views

    rows = q_pipelines.fixture(Views(spark, "none")).groupBy("action").count().collect()
    assert {r.action: r["count"] for r in rows} == {"click": 50, "skip": 78}


def test_row_digests_ignore_the_order_only(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    one = logs.digest_rows(rows)
    assert one == logs.digest_rows(rows.repartition(7).select("s", "id")) and one[1] == 100
    assert one != logs.digest_rows(rows.where("id > 0")) and one != logs.digest_rows(rows.withColumn("s", F.coalesce("s", F.lit(""))))


def test_a_pattern_beats_its_parents_in_every_fold(spark, monkeypatch):
    """Three folds of four rows: the two premises together are a click, and each alone is one of two."""
    monkeypatch.setattr(conditional, "FOLD_SUPPORT", 1)
    rows = [(f, y, 2 if heavy and y else 1, topic, *[h] * 4) for heavy in (0,) for f in range(3) for topic, h, y in (("rel", "loyal", 1), ("rel", "new", 0), ("other", "loyal", 0), ("other", "new", 0))]
    kinds = "fold int, y int, weight int, topic string, history string, long_affinity string, recent_affinity string, recent_count string"
    df = spark.createDataFrame(rows, kinds)
    got = {r.premises: r for r in conditional.patterns(df, 2, 3).collect()}
    r = got["history=loyal & topic=rel"]
    assert (r.tp, r.fp, r.base, r.precision, r.parent, r.increment, r.stable, r.folds, r.refused) == (3, 0, 0.25, 1.0, 0.5, 0.5, 0.5, 3, None)
    assert all("topic=" in p and p.count("=") == 2 for p in got)
    weighted = {r.premises: r for r in conditional.patterns(df.withColumn("weight", F.when(F.col("y") == 1, 2).otherwise(1)), 2, 3).collect()}
    r = weighted["history=loyal & topic=rel"]
    assert (r.tp, r.fp) == (6, 0) and abs(r.parent - 2 / 3) < 1e-12 and abs(r.increment - 1 / 3) < 1e-12 and abs(r.wracc - 0.4 * 0.6) < 1e-12
    # a fold in which the pattern fails makes it unstable; without enough clicks there is no seed
    broken = df.withColumn("y", F.when((F.col("fold") == 2) & (F.col("topic") == "rel"), 1 - F.col("y")).otherwise(F.col("y")))
    assert {r.refused for r in conditional.patterns(broken, 2, 2).where("premises = 'history=loyal & topic=rel'").collect()} == {"unstable"}
    assert conditional.patterns(df, 2, 4).count() == 0
    with pytest.raises(ValueError):
        conditional.patterns(df, 5)
