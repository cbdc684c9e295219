"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascout.llm.stage import staged


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each batch as stars: every node with the least of its component there."""
    for batch in batches:
        parent: dict = {}

        def top(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = top(u), top(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in list(parent) if (r := top(x)) != x]
        kinds = batch.schema.field("u").type
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kinds) for i in (0, 1)], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of `links` (u, v): the least node of its component.

    Nulls and links of a node with itself are ignored; nodes are of any one ordered type. Each round
    hands every neighbour of a node to the least of them, so a round shuffles no more rows than there
    are links, and the number of rounds grows with the logarithm of the longest path.
    """
    kept = links.select("u", "v").where("u != v")
    now = staged(kept.mapInArrow(_contract, kept.schema), "links")
    told = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # Large star: greater neighbours go to the least neighbour.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = staged(small, "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if state[:2] == told and state[0] == state[2]:
            break
        told = state[:2]
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
