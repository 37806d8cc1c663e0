"""A training corpus from raw documents in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm.contamination import drop_contaminated
from tabwright.llm.exact import drop_exact_duplicates
from tabwright.llm.packing import pack
from tabwright.llm.queries import byte_bpe
from tabwright.llm.scratch import Scratch
from tabwright.llm.simhash import drop_near_duplicates
from tabwright.llm.toxicity import drop_toxic, fit


#: Workers keep little in the last stage, as a session that has run the others has less memory to give.
WORD_BYTES = 32_000_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, the one with the largest doc_id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints at most three bits apart, found with BK-trees, one stays, the one with the smallest doc_id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, placed in sequences of at most 2048 tokens."""
    return pack(docs, byte_bpe(), word_bytes=WORD_BYTES)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Tokenisation and learned scores have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
