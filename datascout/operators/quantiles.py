"""Exact quantiles of value counts, grouped or not, by narrowing histograms.

Every group's span is cut into bins of one width. The totals of the bins tell which of them hold a
wanted rank; only the values of those bins are moved and sorted. Skewed values leave more of them in
a bin, which costs time but no exactness: what is left is dealt to ranges, so no task sorts it alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datascout.operators.groups import join_same, running_sum
from datascout.runtime import written
from datascout.schema import ident

# Few enough for a task to add up the bins of many groups, enough to leave little to sort.
BINS = 512


def quantiles(long: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """``(keys..., q array<double>)``, linear between neighbouring ranks, missing values ignored."""
    counts = long.where(ident(value).isNotNull()).groupBy(*[ident(k) for k in keys], ident(value)).agg(F.count("*").alias("__n"))
    return counted_quantiles(written(counts, "counts"), keys, value, probs, "__n")


def _bin(v: Column) -> Column:
    """The bin of a value, never smaller for a larger one; halves keep wide spans finite."""
    share = (v / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2)
    inside = F.when(F.col("__hi") > F.col("__lo"), F.least(F.lit(BINS - 1), F.floor(share * BINS))).otherwise(0)
    return F.when(F.isnan(v), BINS + 1).when(v == float("inf"), BINS).when(v == float("-inf"), -1).otherwise(inside)


def counted_quantiles(counts: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], n: str = "n") -> DataFrame:
    """The same of value counts ``(keys..., value, n)``, which are read several times and so had
    better be written. A value may have several counts; NULL is a key like any other."""
    group = [f"__g{i}" for i in range(len(keys))]
    place = [*group, "__bin"]
    rows = counts.where(ident(value).isNotNull()).select(
        *[ident(k).alias(g) for k, g in zip(keys, group)], ident(value).alias("__value"), ident(n).alias("__n")
    )
    v = F.col("__value").cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    # One row a group; written, so that Spark knows its size and broadcasts it or not.
    spans = rows.groupBy(*group).agg(F.min(finite).alias("__lo"), F.max(finite).alias("__hi"), F.sum("__n").alias("__all"))
    binned = join_same(rows, written(spans, "spans"), group).withColumn("__bin", _bin(v))
    bins = binned.groupBy(*place).agg(F.sum("__n").alias("__in"), F.first("__all").alias("__all"))
    earlier = Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("__offset", F.coalesce(F.sum("__in").over(earlier), F.lit(0)))
    ranks = [f(F.lit(float(p)) * (F.col("__all") - 1)) for p in probs for f in (F.floor, F.ceil)]
    here = (F.col("__rank") >= F.col("__offset")) & (F.col("__rank") < F.col("__offset") + F.col("__in"))
    # At most two rows for each group and probability.
    wanted = bins.withColumn("__rank", F.explode(F.array_distinct(F.array(*ranks)))).where(here)
    wanted = written(wanted.select(*place, "__rank", "__offset", "__all"), "wanted")
    near = join_same(binned, wanted.select(*place).distinct(), place, "left_semi")
    near = near.groupBy(*place, "__value").agg(F.sum("__n").alias("__n"))
    summed = running_sum(near, ["__value"], F.col("__n"), "__before", place)
    at = F.col("__rank") - F.col("__offset")
    picked = join_same(summed, wanted, place).where((at >= F.col("__before")) & (at < F.col("__before") + F.col("__n")))
    by_rank = picked.groupBy(*group).agg(
        F.map_from_entries(F.collect_list(F.struct("__rank", "__value"))).alias("__m"), F.first("__all").alias("__all")
    )
    return by_rank.select(*[F.col(g).alias(k) for k, g in zip(keys, group)], F.array(*[_between(p) for p in probs]).alias("q"))


def _between(p: float) -> Column:
    place = F.lit(float(p)) * (F.col("__all") - 1)
    low, high = (F.try_element_at("__m", f(place)).cast("double") for f in (F.floor, F.ceil))
    part = place - F.floor(place)
    return F.when(part == 0, low).otherwise((F.lit(1.0) - part) * low + part * high)
