"""State that outlives a batch: queued work that is taken back when it stalls, and builds published by compare-and-set.

Both run as transformWithStateInPandas, on streams or on tables, one small state a key. Timers and the expiry of state
are Spark's: a key that hears nothing more wakes up by itself, in whatever task holds it then.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Statuses that end an archive's way, and the one that may stall.
ENDED, RUNNING = ("done", "failed", "deleted"), "processing"
HOUR_MS = 3_600_000


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """What the operators here need of a session, set unless it has been."""
    spark.streams.active  # the stream manager starts the coordinator of state stores, which tables need too
    key = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(key, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Reclaim(StatefulProcessor):
    def __init__(self, stale_ms: int, most_attempts: int):
        self.stale_ms, self.most_attempts = stale_ms, most_attempts

    def init(self, handle):
        self.handle = handle
        self.held = handle.getValueState("held", "attempts int, updated_ms long")

    def handleInputRows(self, key, rows, timerValues):
        latest = pd.concat(list(rows)).sort_values(["updated_ms", "attempts"], kind="stable").iloc[-1]
        known = self.held.get() if self.held.exists() else None
        if known is not None and known[1] > latest["updated_ms"]:
            return iter(())  # an older row that comes late
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if latest["status"] == RUNNING:
            self.held.update((int(latest["attempts"]), int(latest["updated_ms"])))
            self.handle.registerTimer(int(latest["updated_ms"]) + self.stale_ms)
        elif latest["status"] in ENDED:
            self.held.clear()
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.held.exists():
            return iter(())
        attempts, _ = self.held.get()
        self.held.clear()
        again = attempts < self.most_attempts
        return iter([pd.DataFrame({"archive_id": [key[0]], "outcome": ["requeued" if again else "stuck"], "attempts": [attempts + again], "at_ms": [expiredTimerInfo.getExpiryTimeInMs()]})])


def reclaimed(archives: DataFrame, stale_ms: int = 3 * HOUR_MS, most_attempts: int = 5, event_time: bool = False, delay: str = "0 seconds") -> DataFrame:
    """archive_id, outcome (requeued, or stuck once it has had most_attempts), attempts and at_ms of each archive that
    has been processing without an update for stale_ms; of archives (archive_id, status, attempts, updated_at).

    An update of any kind sets the timer anew, an end clears it; an older row that comes late changes nothing. With
    event_time, time is the watermark of updated_at, else the clock."""
    keep_state_in_rocksdb(archives.sparkSession)
    timed = archives.select("archive_id", "status", F.col("attempts").cast("int").alias("attempts"), F.col("updated_at").cast("timestamp").alias("updated_at")).dropna()
    if event_time:
        timed = timed.withWatermark("updated_at", delay)
    rows = timed.withColumn("updated_ms", F.unix_millis("updated_at"))
    return rows.groupBy("archive_id").transformWithStateInPandas(_Reclaim(stale_ms, most_attempts), "archive_id long, outcome string, attempts int, at_ms long", "Update", "EventTime" if event_time else "ProcessingTime")


class _Publish(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.row = handle.getValueState("row", "data_rev long, built_rev long, version string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        data, built, version = self.row.get() if self.row.exists() else (0, 0, None)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            if r.kind == "change":
                data += 1
                continue
            rev = data if pd.isna(r.rev) else int(r.rev)
            outcome = "ahead" if rev > data else "published" if rev > built or r.force and rev == built else "outrun"
            before = version
            if outcome == "published":
                built, version = rev, r.version
            out.append((key[0], int(r.seq), rev, data, built, version, before, outcome))
        self.row.update((data, built, version))
        return iter([pd.DataFrame(out, columns=[c.split(" ")[0] for c in PUBLISHED.split(", ")])])


PUBLISHED = "user_id long, seq long, rev long, data_rev long, built_rev long, version string, previous_version string, outcome string"


def published(changes: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """What became of each build, of rows (user_id, seq, kind, rev, version, force) in order of seq within a batch.

    A row of kind 'change' raises its user's data revision by one. One of kind 'build' offers what was made of revision
    rev (null: the present one): it is published if rev is newer than what is (or, forced, the same), outrun if not,
    and refused as ahead if there is no such revision yet. With ttl_ms, a user that hears nothing for so long is
    forgotten and starts anew."""
    keep_state_in_rocksdb(changes.sparkSession)
    rows = changes.select("user_id", F.col("seq").cast("long").alias("seq"), "kind", F.col("rev").cast("long").alias("rev"), F.col("version").cast("string").alias("version"), F.coalesce(F.col("force"), F.lit(False)).alias("force")).dropna(subset=["user_id", "kind"])
    return rows.groupBy("user_id").transformWithStateInPandas(_Publish(ttl_ms), PUBLISHED, "Update", "None" if ttl_ms is None else "ProcessingTime")
