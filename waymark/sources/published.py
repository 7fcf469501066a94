"""Snapshots published whole: a folder per version, and a register of which is current that only ever moves on.

A version is written to a folder of its own, then claimed by one small file named for its snapshot. A claim is written
aside and renamed, so it is there in full or not at all, and the current version is that of the greatest claim. Writers
therefore need no lock and can't undo each other: one whose snapshot is older than the current claims nothing, and if
it was overtaken between looking and claiming, its claim is simply not the greatest. Publishing a snapshot again, as a
retried foreachBatch does, finds its claim and changes nothing. Any Hadoop file system will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Snapshots are whole numbers (epoch microseconds, batch ids), named with as many digits as a long may have.
DIGITS = 19


class Register:
    """The claims under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def claims(self) -> list[tuple[int, str]]:
        """(snapshot, file) of all claims, the current last."""
        folder = self.path(f"{self.root}/claims")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted((int(n.removesuffix(".json")), n) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def current(self) -> dict | None:
        """What the greatest claim says: snapshot, version, path and rows; None if there is none."""
        for _, name in reversed(self.claims()):
            file = self.fs.open(self.path(f"{self.root}/claims/{name}"))
            try:
                return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(file)))
            finally:
                file.close()
        return None

    def claim(self, said: dict) -> bool:
        """Whether the claim was made: it must be newer than all there are."""
        known = self.claims()
        if known and known[-1][0] >= said["snapshot"]:
            return False
        aside = self.path(f"{self.root}/claims/_{uuid.uuid4().hex}")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        if not self.fs.rename(aside, self.path(f"{self.root}/claims/{said['snapshot']:0{DIGITS}d}.json")):
            self.fs.delete(aside, False)  # another writer of this very snapshot was first
            return False
        return True

    def prune(self, keep: int = 2) -> int:
        """Deletes all but the newest claims and what they point to; how many. Versions that nobody has claimed are
        left alone, as they may be at work."""
        old = self.claims()[: -max(keep, 1)]
        for snapshot, name in old:
            self.fs.delete(self.path(f"{self.root}/data/{snapshot:0{DIGITS}d}"), True)
            self.fs.delete(self.path(f"{self.root}/claims/{name}"), False)
        return len(old)


def publish(df: DataFrame, root: str, snapshot: int, keep: int | None = None) -> bool:
    """Writes df as the version of a snapshot (taken before df was read) and makes it current if the snapshot is newer
    than what is; whether it is current now through this or an earlier run. An older one isn't even written."""
    if not 0 <= snapshot < 10**DIGITS:
        raise ValueError(f"a snapshot is a whole number of up to {DIGITS} digits")
    register = Register(df.sparkSession, root)
    now = register.current()
    if now is not None and now["snapshot"] >= snapshot:
        return now["snapshot"] == snapshot
    version = f"v{snapshot}-{uuid.uuid4().hex[:8]}"
    path = f"{register.root}/data/{snapshot:0{DIGITS}d}/{version}"
    df.write.parquet(path)
    won = register.claim({"snapshot": snapshot, "version": version, "path": path})
    if won and keep is not None:
        register.prune(keep)
    return won or (register.current() or {}).get("snapshot") == snapshot


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    """The current version, None if nothing has been published. It stays readable until it is pruned."""
    now = Register(spark, root).current()
    return None if now is None else spark.read.parquet(now["path"])


def publisher(root: str, keep: int | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: publishes each batch under its number."""

    def each(df: DataFrame, batch: int) -> None:
        publish(df, root, batch, keep)

    return each
