"""Per-group top rows and running sums that stay whole under hot groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datascout.runtime import written
from datascout.schema import ident

# Spark cuts groups to their first rows before the shuffle up to this many rows.
GROUP_LIMIT = 1000
SALTS = 64
# Keys with more than one in so many rows are dealt with apart; there are fewer than that many.
HEAVY = 1000
# Bytes of a table, written as JSON, that is sent to all tasks of a join.
SENT = 64 << 20


def top_n_per_group(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of every group.

    For small ``n`` Spark cuts each group inside every map task (WindowGroupLimit), so a hot
    group shuffles at most ``n`` rows per task. Beyond its limit the same cut is made by
    salted sub-groups first.
    """
    name = rank or "__rank"
    if n > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if _hashable(df, c)]), F.lit(SALTS))
        w = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = (
            df.withColumn("__salt", salt)
            .withColumn("__pre", F.row_number().over(w))
            .where(F.col("__pre") <= n)
            .drop("__salt", "__pre")
        )
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def _hashable(df: DataFrame, name: str) -> bool:
    return "map<" not in df.schema[name].dataType.simpleString()


def first_per_group(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    return top_n_per_group(df, keys, order, 1)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, a NULL key being equal to NULL; the keys are kept once."""
    named = {k: f"__right_{i}" for i, k in enumerate(keys)}
    other = right.select(*[ident(c).alias(named.get(c, c)) for c in right.columns])
    same = [left[f"`{k}`"].eqNullSafe(other[n]) for k, n in named.items()]
    return left.join(other, reduce(lambda x, y: x & y, same), how).drop(*named.values())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def heavy_keys(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """The keys that hold more than one in ``HEAVY`` of all rows, fewer than ``HEAVY`` of them; ``counts``
    is ``(keys..., n)``, read twice. Keys with a NULL are not among them."""
    known = reduce(lambda x, y: x & y, [ident(k).isNotNull() for k in keys])
    total = counts.agg(F.sum(n).alias("__total"))  # one row
    found = counts.where(known).join(F.broadcast(total)).where(ident(n) * HEAVY > F.col("__total"))
    return found.select(*[ident(k) for k in keys])


def spread_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], heavy: DataFrame, how: str = "inner", merge: bool = False
) -> DataFrame:
    """Inner or left join on ``keys`` when few of them hold most rows of ``left``.

    The rows of a heavy key, and those with a NULL, go to the tasks by the partition they come from,
    ``SALTS`` at most, to each of which the partners of the heavy keys are sent. ``heavy`` has fewer
    than ``HEAVY`` rows (``heavy_keys``). Beyond the keys the two tables share no column name. ``merge``
    keeps Spark from sending either table whole.
    """
    salt, hot = free_name(left, free_name(right, "__salt")), free_name(left, free_name(right, "__hot"))
    marks = F.broadcast(heavy.select(*[ident(k) for k in keys], F.lit(True).alias(hot)))
    unknown = reduce(lambda x, y: x | y, [ident(k).isNull() for k in keys])
    apart = ident(hot).isNotNull() | unknown
    # The number of a partition, unlike a random one, is the same when a lost task runs again.
    dealt = left.join(marks, list(keys), "left").withColumn(
        salt, F.when(apart, F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0)
    )
    copies = F.when(ident(hot).isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    sent = right.join(marks, list(keys), "left").withColumn(salt, F.explode(copies)).drop(hot)
    others = [c for c in right.columns if c not in keys]
    if merge:
        sent = sent.hint("merge")
    return dealt.drop(hot).join(sent, [*keys, salt], how).select(*[ident(c) for c in [*left.columns, *others]])


def sent_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` that leaves the rows of ``left`` where they are, however they share keys.

    ``right``, stored and read twice, is sent to all tasks if its rows have at most ``SENT`` bytes. Beyond
    that both are dealt by the keys, but for the heavy ones; ``left`` is computed twice then and must
    be the same each time. Neither is broadcast on a guess of its size.
    """
    size = right.agg(F.sum(F.octet_length(F.to_json(F.struct(*[ident(c) for c in right.columns]))))).first()[0]
    if (size or 0) <= SENT:
        return left.join(F.broadcast(right), list(keys))
    counts = written(left.groupBy(*[ident(k) for k in keys]).agg(F.count("*").alias("n")), "counts")
    return spread_join(left, right, keys, heavy_keys(counts, keys), merge=True)


def ranged(df: DataFrame, order: Sequence[str], part: str = "__part") -> DataFrame:
    """The rows dealt to ranges of ``order`` and written, with the number of their range: however
    often they are read again, a row stays in its range."""
    dealt = df.repartitionByRange(*[ident(c).asc_nulls_first() for c in order])
    return written(dealt.withColumn(part, F.spark_partition_id()), "ranged")


def range_offsets(placed: DataFrame, within: Sequence[str], value: str) -> DataFrame:
    """``(within, __part, __offset, __all)``: the sum of ``value`` in earlier ranges, and in all."""
    totals = placed.groupBy(*within, "__part").agg(F.sum(value).alias("__t"))  # one row for each range and key in it
    group = Window.partitionBy(*within)
    prior = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    return totals.select(
        *[ident(c) for c in within],
        "__part",
        F.coalesce(F.sum("__t").over(prior), zero).alias("__offset"),
        F.coalesce(F.sum("__t").over(group), zero).alias("__all"),
    )


def running_sum(df: DataFrame, order: Sequence[str], value: Column, out: str, within: Sequence[str] = ()) -> DataFrame:
    """Sum of ``value`` over all earlier rows in the total order ``order`` (per ``within``).

    Rows are dealt to ranges; the totals of the ranges give each its offset, and one task sums one
    range.
    """
    placed = ranged(df.withColumn("__v", value), [*within, *order])
    keys = [*within, "__part"]
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("__local", F.coalesce(F.sum("__v").over(local), F.lit(0).cast("bigint")))
    found = join_same(summed, range_offsets(placed, within, "__v"), keys)
    return found.withColumn(out, F.col("__offset") + F.col("__local")).select(*[ident(c) for c in df.columns], out)


def hash_index(
    df: DataFrame, key: Sequence[str], seed: int = 42, out: str = "row_index", digits: int = 4
) -> DataFrame:
    """0-based position of every row when ordered by md5(seed, key): a fixed shuffle.

    The leading hex digits cut the hash range into even buckets without sampling (16**digits
    of them), so bucket counts give each bucket its offset and no task sorts more than one
    bucket. ``key`` should identify rows. A column of the name ``out`` is replaced, all others stay.
    """
    h, b, place, offset = (free_name(df, c) for c in ("__h", "__b", "__rn", "__offset"))
    text = F.concat_ws("|", F.lit(str(seed)), *[ident(k).cast("string") for k in key])
    hashed = df.withColumn(h, F.md5(text)).withColumn(b, F.substring(h, 1, digits))
    # At most 16**digits rows.
    counts = hashed.groupBy(b).agg(F.count("*").alias("n"))
    w = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(b, F.coalesce(F.sum("n").over(w), F.lit(0)).alias(offset))
    local = Window.partitionBy(b).orderBy(h, *[ident(k) for k in key])
    return (
        hashed.withColumn(place, F.row_number().over(local))
        .join(F.broadcast(offsets), b)
        .withColumn(out, (F.col(offset) + F.col(place) - 1).cast("bigint"))
        .drop(h, b, place, offset)
    )
