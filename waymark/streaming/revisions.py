"""Streams of activity changes: deduplicated arrivals and a revision number for each user."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "5 minutes") -> DataFrame:
    """Each key once, as long as its repeats come within delay."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events and users by window and type; a window is final once the watermark has passed it."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    counted = timed.groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "users")


def revisions(events: DataFrame, user: str = "user_id") -> DataFrame:
    """user, revision and changes after each batch in which a user's rows changed; state is two numbers a user."""

    def bump(key, batches, state: GroupState):
        revision, changes = state.get if state.exists else (0, 0)
        changes += sum(len(b) for b in batches)
        state.update((revision + 1, changes))
        yield pd.DataFrame({user: [key[0]], "revision": [revision + 1], "changes": [changes]})

    return events.groupBy(user).applyInPandasWithState(bump, f"{user} long, revision long, changes long", "revision long, changes long", "update", GroupStateTimeout.NoTimeout)


def near_deduplicated(activities: DataFrame, ts: str = "started", minutes: float = 5, share: float = 0.05, delay: str = "1 day") -> DataFrame:
    """user_id, activity_id, started and distance_m of the activities that no other of the same user, kept before, is as
    near as minutes in time and share of the distance to; of rows that come in one batch the earliest is kept.

    State is the times and distances kept of a user, back to minutes before the watermark; rows later than delay are
    dropped by Spark."""
    timed = activities.select("user_id", "activity_id", F.col(ts).cast("timestamp").alias("started"), F.col("distance_m").cast("double").alias("distance_m")).withWatermark("started", delay)
    width = minutes * 60

    def keep(key, batches, state: GroupState):
        times, lengths = ([*x] for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values(["started", "activity_id"], kind="stable")
        out = []
        for row in rows.itertuples():
            at = row.started.timestamp()
            if not any(abs(at - t) <= width and abs(row.distance_m - d) <= share * max(row.distance_m, d) for t, d in zip(times, lengths)):
                times.append(at)
                lengths.append(row.distance_m)
                out.append((key[0], row.activity_id, row.started, row.distance_m))
        since = state.getCurrentWatermarkMs() / 1000 - width
        held = [(t, d) for t, d in zip(times, lengths) if t >= since]
        state.update(([t for t, _ in held], [d for _, d in held]))
        yield pd.DataFrame(out, columns=["user_id", "activity_id", "started", "distance_m"])

    return timed.groupBy("user_id").applyInPandasWithState(keep, "user_id long, activity_id long, started timestamp, distance_m double", "times array<double>, lengths array<double>", "append", GroupStateTimeout.NoTimeout)
