"""A corpus pipeline: toxicity, near-dedup, suffix-array dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last returns the
packing. Run one after another, each stage's result is written as Parquet and read back as the next one's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, near_copies, packing, suffix_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't call toxic, unchanged."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: the one with the smallest id. Near copies have a Jaccard
    similarity of 0.8 or more on shingles of five words: they meet by SimHash fingerprints and are verified on the shingles."""
    return near_copies.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 50 that an earlier document has are cut; a character that is cut in part goes as a whole. Every row stays."""
    return suffix_dedup.with_repeats_cut(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: Learnt weights, XXH64, dependent rounding and tokens are not for SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What lies between them is written below spark.checkpoint.dir (unset: the warehouse)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    at = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
