"""Normalise hub payload files as they land."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def payload_stream(spark: SparkSession, path: str) -> DataFrame:
    """One payload per line of the files that appear below ``path``."""
    return spark.readStream.text(path).select(F.col("value").alias("payload"))


def land_catalog(
    payloads: DataFrame, normalize: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Append the catalog rows of all payloads present, then stop. Restarts go on from ``checkpoint``."""
    return (
        normalize(payloads)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy("provider")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
