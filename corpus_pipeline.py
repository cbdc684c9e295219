"""The corpus pipeline: quality, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; `run` writes every
stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datascout.llm import bpe, decontaminate, jaccard, quality
from datascout.llm.queries import vocabulary_path
from datascout.llm.stage import staged
from datascout.plans.registry import QUERIES

ACCEPTED = 0.7


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model, into="__score").where(F.col("__score") >= ACCEPTED).drop("__score")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and its text as decoded from them."""
    return bpe.encode_texts(docs, vocabulary_path(), decoded="text").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", keep_good), ("near_copies", keep_one_copy), ("decontaminate", keep_clean), ("bpe", encode)]
#: The first stage is a trained model, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs


QUERIES["pipeline"] = run
