"""The persisted catalog: Parquet, partitioned by provider."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datascout.functions.text import safe_id
from datascout.schema import PUBLIC_COLUMNS


def upsert(current: DataFrame | None, new: DataFrame) -> DataFrame:
    """New records replace those with their id. Two new versions of one id fold to one inside
    the map tasks."""
    row = F.struct(*[F.col(c) for c in PUBLIC_COLUMNS])
    order = F.struct("last_updated", F.xxhash64(*[F.col(c) for c in PUBLIC_COLUMNS]))
    latest = new.groupBy("id").agg(F.max_by(row, order).alias("r")).select("r.*")
    if current is None:
        return latest
    kept = current.select(*PUBLIC_COLUMNS).join(latest.select("id"), "id", "left_anti")
    return kept.unionByName(latest)


def write_catalog(cat: DataFrame, path: str, current: DataFrame | None = None) -> DataFrame:
    """Write ``current`` with ``cat`` merged in to a new ``path``, and read it back.

    ``path`` must not be where ``current`` is read from: rows are streamed, not collected.
    """
    merged = upsert(current, cat).withColumn("safe_id", safe_id(F.col("id")))
    merged.write.mode("overwrite").partitionBy("provider").parquet(path)
    return read_catalog(cat.sparkSession, path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_record(spark: SparkSession, path: str, id: str) -> DataFrame:
    """One record; the id reaches the Parquet scan as a pushed filter."""
    return read_catalog(spark, path).where(F.col("id") == id)
