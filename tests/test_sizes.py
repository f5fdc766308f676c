"""Findings on larger tables, each on a small table of the same kind."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from ruleloom.operators import running, vectors
from ruleloom.plans import q_evaluation
from ruleloom.plans.views import DECAY, Views
from ruleloom.streaming import feedback


def test_sessions_of_files_in_any_order_of_time_without_the_driver(spark, tmp_path):
    """The second file holds the earlier day; sessions of all slices come, and none lies in a table of the driver's memory."""
    rnd = random.Random(3)
    rows = [(i % 7, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(2880), microseconds=i)) for i in range(300)]
    rows = sorted(rows, key=lambda r: r[1])
    for file in (rows[150:], rows[:150]):
        df = spark.createDataFrame(file, "user_id bigint, ts timestamp_ntz").coalesce(1)
        df = df.select(F.monotonically_increasing_id().alias("event_id"), "ts", "user_id", F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
        df.write.mode("append").parquet(str(tmp_path / "events.parquet"))
    want, hour = [], dt.timedelta(hours=1)
    end = rows[-1][1].replace(microsecond=rows[-1][1].microsecond // 1000 * 1000)
    for user in range(7):
        sessions = []
        for t in (t for u, t in rows if u == user):
            if not sessions or t - sessions[-1][-1] > hour:
                sessions.append([])
            sessions[-1].append(t)
        want += [(user, s[0], len(s)) for s in sessions if s[-1] + hour <= end]
    before = {t.name for t in spark.catalog.listTables()}
    got = feedback.expired_sessions(Views(spark, str(tmp_path)), slice_rows=90)
    assert sorted((r.user_id, r.started, r.events) for r in got.collect()) == sorted(want)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_order_by_borders_that_differ_at_each_evaluation(spark, monkeypatch):
    """Sketches depend on how they are merged; the borders here are drawn anew whenever they are computed."""
    draw = F.udf(lambda most: sorted(most * random.SystemRandom().random() for _ in range(9)), "array<double>")
    monkeypatch.setattr(running.F, "percentile_approx", lambda value, shares, accuracy: draw(F.max(value)))
    d = spark.range(1000).select(F.lit("a").alias("key"), ((F.col("id") * 7) % 1000).cast("double").alias("value"), F.lit(1).alias("weight"))
    got = running.ordered(d, ["key"]).collect()
    assert sorted((r.value, r.cum, r.i, r.total) for r in got) == [(float(v), v + 1, v + 1, 1000) for v in range(1000)]


def test_percentiles_of_null_values_and_types(spark, tmp_path):
    rows = [("a", None)] * 5 + [("a", float(x)) for x in range(1, 21)] + [(None, 7.0), ("b", None)]
    spark.createDataFrame(rows, "event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_type: (r.n, r.p50, r.p95, r.least, r.most) for r in q_evaluation.latency(Views(spark, str(tmp_path))).collect()}
    assert got == {"a": (25, 10.0, 19.0, 1.0, 20.0), None: (1, 7.0, 7.0, 7.0, 7.0), "b": (1, None, None, None, None)}


def test_histories_clustered_together_as_each_alone(spark, tmp_path):
    """Long and short logs over several batches, clicks without a vector, impressions without a click and without a user."""
    rnd, directions = random.Random(4), np.random.default_rng(5)
    base = directions.normal(size=(4, 8))
    embeddings = [(a, [float(x) for x in base[a % 4] + 0.5 * directions.normal(size=8)]) for a in range(40) if a % 5] + [(45, [0.0] * 8)]
    orders = [(i, rnd.choice([1, 1, 1, 2, 3, None]), dt.datetime(2024, 1, 1) + dt.timedelta(days=rnd.randrange(60))) for i in range(300)]
    lines = [(i, a, n, rnd.choice("RRN")) for i, _, _ in orders for n, a in enumerate(rnd.sample(range(50), rnd.randrange(4)))]
    for name, rows, kinds in (("orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"), ("lineitem", lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_returnflag string"), ("embeddings", embeddings, "vec_id bigint, embedding array<float>")):
        spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / f"{name}.parquet"))
    unit = {a: np.float32(e).astype(float) / np.linalg.norm(np.float32(e).astype(float)) for a, e in embeddings if any(e)}
    want, logs = [], {}
    for i, user, _ in sorted(orders, key=lambda o: (o[2], o[0])):
        log = logs.setdefault(user, [])
        items = [(len(log) - 1 - k, a) for k, a in enumerate(log) if k >= len(log) - 20 and a in unit]
        want += [(i, a, lag, c) for (lag, a), c in zip(items, vectors.lead([unit[a] for _, a in items], [lag for lag, _ in items]), strict=True)]
        log += [a for o, a, n, flag in lines if o == i and flag == "R"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = vectors.leader_clusters(Views(spark, str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.impression, r.article, r.lag, r.cluster) for r in got) == sorted(want) and len({w[3] for w in want}) > 2


def test_no_python_call_for_each_history(spark):
    """Histories of one log are folded in one call, whatever their number."""
    calls = []
    rows = [(1, i, True, i % 3, [[1.0, float(i % 3)]]) for i in range(500)]
    batch = spark.createDataFrame(rows, "usr bigint, impression bigint, clicked boolean, article bigint, es array<array<double>>").toArrow().combine_chunks().to_batches()
    whole = vectors.lead_many
    try:
        vectors.lead_many = lambda *a: calls.append(1) or whole(*a)
        found = sum(b.num_rows for b in vectors.fold_logs(iter(batch)))
    finally:
        vectors.lead_many = whole
    assert found == sum(min(i, 20) for i in range(500)) and len(calls) == len(batch)


def test_chunks_of_histories_change_nothing(monkeypatch):
    x = np.random.default_rng(6).normal(size=(60, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    first, many = np.arange(40), np.arange(40) % 21
    monkeypatch.setattr(vectors, "CELLS", 200)
    got = vectors.lead_many(x, first, many, lambda r, t: DECAY ** (many[r] - 1.0 - t))
    for r in range(40):
        assert got[r, : many[r]].tolist() == vectors.lead(list(x[first[r] : first[r] + many[r]]), list(range(many[r] - 1, -1, -1)))
