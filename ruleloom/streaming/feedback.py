"""Online feedback as Structured Streaming: user profiles, additive supports and versioned rules."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ruleloom.plans.views import Views
from ruleloom.session import shared_folder
from ruleloom.sources.logs import files

HISTORY, SKIPS, INTERVAL = 200, 20, 8
#: Rows of a slice of the replay for sessions, which bounds the state of a micro-batch.
SLICE_ROWS = 1_000_000
PROFILE = "user_id bigint, history string, skips string, pending bigint, events bigint"


def fold(history: list[str], skips: list[str], event: str, item: str) -> tuple[list[str], list[str]]:
    """One event: a click joins the history and leaves the skips; anything else moves to the end of the skips."""
    if event == "click":
        return (history + [item])[-HISTORY:], [s for s in skips if s != item]
    return history, ([s for s in skips if s != item] + [item])[-SKIPS:]


def update_profile(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    history, skips, pending, events = (list(x) if isinstance(x, (list, tuple)) else x for x in state.get) if state.exists else ([], [], 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for event, item in zip(rows.event_type, rows.item, strict=True):
        history, skips = fold(history, skips, event, item)
        pending, events = (pending + 1) % INTERVAL, events + 1
    state.update((history, skips, pending, events))
    yield pd.DataFrame({"user_id": [key[0]], "history": [",".join(history)], "skips": [",".join(skips)], "pending": [pending], "events": [events]})


def stream(v: Views) -> DataFrame:
    """The events as a stream of files; the item is a short code of the value."""
    static = v.table("events")
    source = v.spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1).parquet(f"{v.dir}/events.parquet*")
    return source.withColumn("item", (F.floor("value") % 50).cast("string"))


def _drain(v: Views, df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return its table; the newest row of a key wins downstream."""
    name = f"stream_{uuid.uuid4().hex}"
    df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return v.spark.table(name)


def streamed_counts(v: Views) -> DataFrame:
    return _drain(v, stream(v).groupBy("event_type").agg(F.count("*").alias("n")), "complete")


def streamed_profiles(v: Views) -> DataFrame:
    """State is bounded for each user: HISTORY clicks and SKIPS skips."""
    state = "history array<string>, skips array<string>, pending bigint, events bigint"
    rows = stream(v).select("user_id", "event_id", "ts", "event_type", "item")
    out = rows.groupBy("user_id").applyInPandasWithState(update_profile, PROFILE, state, "update", GroupStateTimeout.NoTimeout)
    t = _drain(v, out, "update")
    return t.groupBy("user_id").agg(F.max_by(F.struct("history", "skips", "pending", "events"), "events").alias("x")).select("user_id", "x.*")


def expired_sessions(v: Views, idle: str = "1 hour", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """user_id, started and events of the sessions that were idle for ``idle`` before the watermark; a session's state goes with its row.

    The events are replayed in the order of time, in files of about ``slice_rows`` rows, whatever files they came in: no row is
    late, and the state holds the sessions of one slice and the open ones.  Rows, state and sessions lie in the shared
    folder; none of them passes the driver.
    """
    spark, root = v.spark, f"{shared_folder(v.spark)}/sessions-{uuid.uuid4().hex}"
    fs, _ = files(spark, root)
    at = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    events = v.table("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    slices = max(1, -(-events.count() // slice_rows))
    events.repartitionByRange(slices, "ts").write.parquet(f"{root}/staged")
    parts = sorted(n for n in (x.getPath().getName() for x in fs.listStatus(at("staged"))) if n.startswith("part-"))
    for name in ("seen", "sessions"):
        fs.mkdirs(at(name))
    rows = spark.readStream.schema(events.schema).parquet(f"{root}/seen").withWatermark("ts", "0 seconds")
    rows = rows.groupBy("user_id", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("events"))
    rows = rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "events")
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", f"{root}/sessions").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    for k in range(slices):
        for name in parts[k * len(parts) // slices:(k + 1) * len(parts) // slices]:
            if not fs.rename(at(f"staged/{name}"), at(f"seen/{name}")):
                raise RuntimeError(f"can't move {name} below {root}")
        writer.start().awaitTermination()
    for name in ("staged", "seen", "state"):
        fs.delete(at(name), True)
    return spark.read.schema(rows.schema).parquet(f"{root}/sessions")


class RuleVersions:
    """Staged builds of a rule table below ``root``, which is all the state: any driver that names it goes on with it.

    A build is captured by an empty file of its number and a lock, both made exclusively; a version counts once
    the mark beside its rules, written last, is there.  It is promoted only if nothing newer was captured meanwhile.  A trigger
    during a build leaves a note that one more is wanted.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.fs, _ = files(spark, root)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _numbers(self, pattern: str) -> list[int]:
        found = self.fs.globStatus(self._path(pattern)) or []
        return [int(re.search(r"(\d+)(/ready)?$", x.getPath().toString())[1]) for x in found]

    def _make(self, name: str) -> bool:
        """Create an empty file; False if there is one."""
        try:
            return bool(self.fs.createNewFile(self._path(name)))
        except Py4JJavaError:  # some file systems raise where others answer
            if self.fs.exists(self._path(name)):
                return False
            raise

    def capture(self) -> int | None:
        """Start a build and return its number; a trigger during a build is coalesced into the next one."""
        if not self._make("building"):
            self._make("wanted")
            return None
        self.fs.delete(self._path("wanted"), False)
        version = max(self._numbers("captured-*"), default=0) + 1
        self._make(f"captured-{version}")
        return version

    def wanted(self) -> bool:
        """Whether a trigger came during the last build."""
        return bool(self.fs.exists(self._path("wanted")))

    def abandon(self) -> None:
        """Give up the build in force, as after the loss of its driver."""
        self.fs.delete(self._path("building"), False)

    def promote(self, version: int, rules: DataFrame, config_unchanged: bool = True) -> bool:
        """Write the staged rules and mark them ready, or discard a stale build."""
        try:
            if version != max(self._numbers("captured-*"), default=0) or not config_unchanged:
                return False
            rules.write.mode("errorifexists").parquet(f"{self.root}/v{version}/rules")
            return self._make(f"v{version}/ready")
        finally:
            self.abandon()

    def current(self) -> tuple[int, str] | None:
        """The newest promoted version and the folder of its rules."""
        version = max(self._numbers("v*/ready"), default=None)
        return None if version is None else (version, f"{self.root}/v{version}/rules")
