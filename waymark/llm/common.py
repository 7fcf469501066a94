"""What the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that holds whole texts; a single longer text is a batch of its own.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 512, 8 << 20
#: A key with more rows than this is hot: joins with it are broadcast rather than dealt to one task.
HOT_ROWS = 1000
#: Files of a loop's state: at least so many, and one for each so many rows.
PARTS, PART_ROWS = 8, 250_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches in rows and bytes: they carry whole texts, some of them very long.

    Results are lazy and Spark reads the bounds when it runs them, so they stay in force; a bound that is tighter
    already is left alone."""
    for name, most in (("maxRecordsPerBatch", TEXT_BATCH_ROWS), ("maxBytesPerBatch", TEXT_BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, one of our own on a local master (tests), and
    ValueError on a cluster, whose machines would not share it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    set_now = sc._jsc.sc().getCheckpointDir()
    if not set_now.isDefined():
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
        set_now = sc._jsc.sc().getCheckpointDir()
    return named or set_now.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there, so that it is computed once and survives lost
    executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, str]:
    """df, of some rows if that is known, written as Parquet to the shared checkpoint folder and read from there, and where. For loops: a checkpoint
    keeps the estimated size of its plan, and estimates multiply with every join, whereas files have their own."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/waymark-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(PARTS, rows // PART_ROWS))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete what written() wrote."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str = "n") -> DataFrame:
    """left joined on key with right, which has one row for each key and in n the number of left's rows that have it.

    Keys of more than HOT_ROWS rows (and more than a millionth of all, so a million keys at most) are broadcast, so that
    their rows stay where they are; the others are joined by an exchange. right is read several times: checkpoint it."""
    total, most = right.agg(F.sum(n), F.max(n)).first()
    bound = max(HOT_ROWS, (total or 0) // 1_000_000)
    if (most or 0) <= bound:
        return left.join(right, key)
    hot = F.broadcast(right.filter(F.col(n) > bound))
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(right.filter(F.col(n) <= bound), key))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id, which therefore is neither held out nor learnt from."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(-1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, one text after another, and the offsets of its rows; a null has no bytes."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: White space of the word rule [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_counts(column: pa.Array) -> np.ndarray:
    """Words [^\\x20\\x09-\\x0D]+ of each text, straight from the Arrow buffer; 0 for null and empty."""
    data, offsets = utf8(column)
    if not len(data):
        return np.zeros(len(column), np.int64)
    solid = ~SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    start[first] = solid[first]
    total = np.concatenate([[0], np.cumsum(start, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
