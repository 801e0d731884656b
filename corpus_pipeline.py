"""Corpus pipeline: quality rules, line dedup, near-copy removal, mixing to target weights, packing.

Each stage reads what the one before wrote as Parquet and works on all of it; all but the last give the columns of ``documents``, with
``n_chars`` counted again where a text is cut. SQL can't express the hashed fingerprints and the random rounding, so there is no ``ORACLE_SQL``;
tests hold the stages against brute force.

Defined results: a null text has no words, so quality rules drop it; null sources are a source of their own; repeated rows and ids are documents
of their own until near-copy removal, which keeps one of each group of equal or similar texts; documents that mixing takes twice are two rows;
extra columns of any name stay with their rows up to packing, which gives pieces; an empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanmoto.llm import line_dedup, mixing, near_copies, packing, quality_rules
from hanmoto.llm.common import scratch
from hanmoto.llm.tokens import public_path

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_site_lines(docs).select(*docs.columns).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_path(TOKENIZER)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-copy removal", near), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage leaves on its way goes when its result is written
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
