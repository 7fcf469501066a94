"""The queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, decontam, htmltext, langid, licenses, merkle, mixing, negatives, sharding, simhash, tokens, toxicity, warc
from .common import checkpointed, ensure_checkpoint_dir, forget, read_table, remainder


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read_table(spark, sf_dir, "documents"))
    each = {k: F.col(f"draws.{k}") for k in ("shard", "block", "position", "rank")}  # one of each for each time it is taken
    return found.withColumns(each).drop("draws")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read_table(spark, sf_dir, "pages"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media(read_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return merkle.prove(docs, altered=remainder("doc_id", 5) == 0, alter={"text": merkle.lower_capitals(F.col("text"))})


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw archives, the deduplicated ones, and what these say when read back; the archives go once that is kept."""
    raw, clean = (f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}/{k}" for k in ("raw", "clean"))
    warc.write_archives(read_table(spark, sf_dir, "pages"), raw)
    warc.deduplicate(spark, raw, clean)
    found = checkpointed(warc.resolve(checkpointed(warc.read_archives(spark, clean))))
    forget(spark, raw, clean)
    return found


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read_table(spark, sf_dir, "embeddings"), anchor=F.col("id") % 50 == 0, label=label)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_toxicity, op3_decontamination, op4_tokens, op5_language, op6_simhash, op7_sharding, op8_html, op9_licenses, op10_audio, op11_merkle, op12_warc, op13_negatives)}
ORACLES: dict[str, str] = {"op9_licenses": licenses.duckdb_sql(), "op11_merkle": merkle.duckdb_sql(), "op12_warc": warc.duckdb_sql(), "op13_negatives": negatives.duckdb_sql()}
