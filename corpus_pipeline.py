"""Documents to tokens in five stages: quality rules, near-duplicates, secrets, mix, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame, which `run` writes as Parquet to the shared folder and reads again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faregrid.llm import bpe, common, mixing, quality, secrets, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    judged = quality.judge_documents(docs, common.read_table(spark, sf_dir, "labels"))
    return judged.where("kept").select(*map(common.quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.mask_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in shards."""
    return mixing.mixed(docs).select(*map(common.quoted, docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and whether decoding gives its text back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), path, decoded="decoded")
    return encoded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                          (F.col("decoded") == common.whole_text()).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("tokens", tokens),
]
#: SQL can express neither the near-duplicates nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
