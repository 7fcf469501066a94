"""A training corpus from documents, in five stages, each written as Parquet and read again.

Each stage works on all that its predecessor kept. All but the last return the columns of documents. The mix is written
shard by shard, each shuffled within, and the last stage cuts its byte-size shards along that order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontam, mixing, sharding, similar, toxicity
from waymark.llm.common import ensure_checkpoint_dir, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject."""
    return toxicity.accepted(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a Jaccard similarity of at least 0.8."""
    return similar.one_of_similar(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row for each time a document is taken, always whole; a partition is a shard of the mix."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contiguous shards of equal bytes, in the order in which the mix is written (by text and id if it isn't a file)."""
    written = [F.col("_metadata.file_name"), F.col("_metadata.row_index")] if docs.inputFiles() else None
    return sharding.shard_by_bytes(docs, order=written)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("benchmark_decontamination", drop_benchmark_leaks), ("mixing", mix_sources), ("sharding", shard)]

#: Toxicity, SimHash and mixing are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what a stage returns is kept in the shared checkpoint folder until the next
    has been written."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path.toString())
        docs = spark.read.parquet(path.toString())
        if before is not None:
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
        before = path
    return docs
