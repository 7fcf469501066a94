"""Timers, compare-and-set and published snapshots."""

import random
import threading
import time

import pytest

from waymark.sources import published as snapshots
from waymark.streaming import timers

ARCHIVE = "archive_id long, status string, attempts int, updated_at timestamp"


@pytest.fixture(autouse=True)
def one_partition(spark):
    """A state store and its Python worker for each partition and batch take seconds to start."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    yield
    spark.conf.set(key, before)


def drain(df, folder, mode="update"):
    got = []
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, k: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return got


def poll(df, folder, enough, each=lambda: None):
    """By the clock a query never ends: there may always be a timer. So until there are enough rows, then stopped."""
    got = []
    q = df.writeStream.outputMode("update").foreachBatch(lambda b, k: (got.extend(tuple(r) for r in b.collect()), each())).option("checkpointLocation", str(folder)).trigger(processingTime="0 seconds").start()
    until = time.time() + 90
    while len(got) < enough and time.time() < until and q.isActive:
        time.sleep(0.2)
    q.stop()
    return got


def arrivals(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_stalled_archives_are_taken_back(spark, tmp_path):
    from datetime import datetime as at

    day = lambda h, m=0: at(2024, 1, 1, h, m)
    batches = [
        [(1, "processing", 1, day(8)), (2, "processing", 1, day(8)), (3, "processing", 5, day(8)), (4, "uploaded", 0, day(8)), (5, "processing", 2, day(8))],
        [(2, "done", 1, day(9)), (5, "processing", 2, day(10)), (9, "uploaded", 0, day(12))],  # now 12: 1 and 3 have stalled at 11
        [(5, "processing", 1, day(8, 30)), (9, "uploaded", 0, day(14))],  # an old row late; 5 has stalled at 13
    ]
    stream = arrivals(spark, tmp_path, batches, "archive_id long, status string, attempts int, updated_at timestamp")
    got = drain(timers.reclaimed(stream, event_time=True), tmp_path / "c")
    stamp = lambda h: int(day(h).timestamp() * 1000)
    assert {(i, o, n) for i, o, n, _ in got} == {(1, "requeued", 2), (3, "stuck", 5), (5, "requeued", 3)}
    assert {i: t % 3_600_000 for i, _, _, t in got} == {1: 0, 3: 0, 5: 0} and {t for i, _, _, t in got if i == 5} == {max(t for *_, t in got)}


def test_the_clock_takes_back_too(spark, tmp_path):
    from datetime import datetime as at

    stream = arrivals(spark, tmp_path, [[(1, "processing", 1, at(2020, 1, 1))], [(2, "uploaded", 0, at(2020, 1, 1))]], ARCHIVE)
    assert {r[:3] for r in poll(timers.reclaimed(stream), tmp_path / "c", 1)} == {(1, "requeued", 2)}


CHANGE = "user_id long, seq long, kind string, rev long, version string, force boolean"


def test_outrun_builds_are_not_published(spark, tmp_path):
    c = lambda u, s: (u, s, "change", None, None, None)
    b = lambda u, s, rev, v, force=None: (u, s, "build", rev, v, force)
    batches = [[c(7, 1), c(7, 2), b(7, 3, 2, "two"), c(8, 1), b(8, 2, 4, "ahead")], [b(7, 4, 1, "late"), c(7, 5), b(7, 6, None, "three"), b(7, 7, 3, "same"), b(7, 8, 3, "again", True)], [b(8, 3, 1, "one")]]
    got = drain(timers.published(arrivals(spark, tmp_path, batches, CHANGE)), tmp_path / "c")
    assert sorted((u, s, v, p, o) for u, s, _, _, _, v, p, o in got) == [(7, 3, "two", None, "published"), (7, 4, "two", "two", "outrun"), (7, 6, "three", "two", "published"), (7, 7, "three", "three", "outrun"), (7, 8, "again", "three", "published"), (8, 2, None, None, "ahead"), (8, 3, "one", None, "published")]


def test_state_expires(spark, tmp_path):
    """With no time to live left, a user's second build of revision 1 is of a new life."""
    rows = [[(7, 1, "change", None, None, None), (7, 2, "build", 1, "a", None)], [(7, 3, "change", None, None, None), (7, 4, "build", 1, "b", None)]]
    got = poll(timers.published(arrivals(spark, tmp_path, rows, CHANGE), ttl_ms=1), tmp_path / "c", 2, each=lambda: time.sleep(0.2))
    assert [(r[1], r[-1]) for r in sorted(got, key=lambda r: r[1])] == [(2, "published"), (4, "published")]


def test_only_newer_snapshots_are_published(spark, tmp_path):
    root = f"file://{tmp_path}/map"
    df = lambda k: spark.createDataFrame([(k,)], "k long")
    assert snapshots.read_current(spark, root) is None
    assert snapshots.publish(df(5), root, 5) and snapshots.publish(df(50), root, 5)  # again: as it was
    assert not snapshots.publish(df(3), root, 3) and snapshots.publish(df(9), root, 9)
    assert snapshots.read_current(spark, root).first()[0] == 9
    assert [s for s, _ in snapshots.Register(spark, root).claims()] == [5, 9]
    assert snapshots.publish(df(12), root, 12, keep=1) and [s for s, _ in snapshots.Register(spark, root).claims()] == [12]
    assert len(list((tmp_path / "map/data").iterdir())) == 1
    with pytest.raises(ValueError):
        snapshots.publish(df(1), root, -1)


def test_overtaken_between_looking_and_claiming(spark, tmp_path):
    register = snapshots.Register(spark, f"file://{tmp_path}")
    assert register.claim({"snapshot": 2, "version": "b", "path": "b"})
    aside = register.claims
    register.claims = lambda: []  # the older writer has looked before the newer one claimed
    assert register.claim({"snapshot": 1, "version": "a", "path": "a"})
    register.claims = aside
    assert register.current()["version"] == "b"


def test_many_writers_at_once(spark, tmp_path):
    root, seen, stop = f"file://{tmp_path}/map", [], threading.Event()
    order = list(range(1, 11))
    random.Random(4).shuffle(order)

    def watch():
        register = snapshots.Register(spark, root)
        while not stop.is_set():
            now = register.current()
            if now:
                seen.append(now["snapshot"])

    watcher = threading.Thread(target=watch)
    watcher.start()
    writers = [threading.Thread(target=lambda k=k: snapshots.publish(spark.createDataFrame([(k,)], "k long").coalesce(1), root, k)) for k in order]
    for w in writers:
        w.start()
    for w in writers:
        w.join(120)
    stop.set()
    watcher.join(60)
    assert seen == sorted(seen) and snapshots.read_current(spark, root).first()[0] == 10


def test_publishing_batches(spark, tmp_path):
    stream = arrivals(spark, tmp_path, [[(1,)], [(2,)], [(3,)]], "k long")
    q = stream.writeStream.foreachBatch(snapshots.publisher(f"file://{tmp_path}/map", keep=2)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert snapshots.read_current(spark, f"file://{tmp_path}/map").count() == 1
    assert [s for s, _ in snapshots.Register(spark, f"file://{tmp_path}/map").claims()] == [1, 2]
