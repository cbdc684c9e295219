"""Profile a table: shape, missing values, cardinality, distribution, correlation, targets.

Two long forms carry all of it. ``numeric_long`` has one row per numeric cell and feeds the
distribution figures; ``value_counts`` has one row per distinct value of a column and feeds
cardinality, most frequent values and class balance. Both take grouping keys, so one table
and one table per key are the same work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascout.operators.groups import heavy_keys, join_same
from datascout.operators.quantiles import counted_quantiles, quantiles
from datascout.runtime import written
from datascout.schema import TARGET_PATTERNS, column_types, ident, is_numeric, nan_to_null, split_columns

QUARTILES = [0.25, 0.5, 0.75]
# Targets need exact numbers of values only below this; the rules compare with 15, 20 and 30.
MANY = 31
# Bits of `bitmap_construct_agg`.
BITS = 32_768


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def _names(df: DataFrame, columns: Sequence[str] | None, keys: Sequence[str]) -> list[str]:
    return [c for c in (columns or df.columns) if c not in keys]


def _label(names: Sequence[str], index: str | Column = "ci") -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(index) + 1 if isinstance(index, str) else index + 1)


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with its keys under names that no figure has, and those names."""
    taken = {c.lower() for c in df.columns}
    mark = "__key"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    inner = {k: f"{mark}{i}" for i, k in enumerate(keys)}
    return df.select(*[ident(c).alias(inner.get(c, c)) for c in df.columns]), list(inner.values())


def _restored(out: DataFrame, keys: Sequence[str], inner: Sequence[str]) -> DataFrame:
    """The keys under their own names again; one named like a figure becomes ``key_<name>``."""
    taken = {c.lower() for c in out.columns if c not in inner}
    names = {}
    for key, name in zip(keys, inner):
        while key.lower() in taken:
            key = f"key_{key}"
        taken.add(key.lower())
        names[name] = key
    return out.select(*[ident(c).alias(names.get(c, c)) for c in out.columns])


def _stack(df: DataFrame, keys: Sequence[str], rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """One output row for each entry of ``rows``, generated inside the scan stage. At least one entry."""
    flat = [c for row in rows for c in row]
    return df.select(*[ident(k) for k in keys], F.stack(F.lit(len(rows)), *flat).alias(*names))


# ---- value counts -------------------------------------------------------------------------


def as_text(c: Column, dtype: T.DataType) -> Column:
    """A value as text, distinct values giving distinct text."""
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    if isinstance(dtype, T.MapType):
        # Maps equal but for entry order are one value.
        return F.to_json(F.array_sort(F.map_entries(c)))
    if isinstance(dtype, (T.ArrayType, T.StructType, T.VariantType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c.cast("string")


def _cells(df: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``(keys, ci, vl, vd, vt)``: each cell in the family of its type, so that whole numbers
    never pass through doubles. A decimal has its exact text and its double. A missing cell has
    all three NULL."""
    rows = []
    for i, name in enumerate(names):
        dtype, c = df.schema[name].dataType, ident(name)
        cell = {"vl": F.lit(None).cast("bigint"), "vd": F.lit(None).cast("double"), "vt": F.lit(None).cast("string")}
        if isinstance(dtype, T.IntegralType):
            cell["vl"] = c.cast("bigint")
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            cell["vd"] = c.cast("double")
        else:
            cell["vt"] = as_text(c, dtype)
            if isinstance(dtype, T.DecimalType):
                cell["vd"] = c.cast("double")
        rows.append([F.lit(i), *cell.values()])
    return _stack(df, keys, rows, ["ci", "vl", "vd", "vt"])


def _typed_counts(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Number of cells of each value, by its whole text; frequent values are counted in the map tasks."""
    return _cells(df, names, keys).groupBy(*keys, "ci", "vl", "vd", "vt").agg(F.count("*").alias("n"))


def _number() -> Column:
    return F.coalesce(F.col("vl").cast("double"), F.col("vd"))


def _is_present() -> Column:
    return F.col("vl").isNotNull() | F.col("vd").isNotNull() | F.col("vt").isNotNull()


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, column, value, n)`` for every distinct value, missing ones as NULL.

    Here and below a key named like a column of the result is returned as ``key_<name>``."""
    df, inner = _keyed(nan_to_null(df), keys)
    names = _names(df, columns, [*keys, *inner])
    if not names:
        return _restored(_no_columns(df, inner, "value string, n bigint"), keys, inner)
    value = F.coalesce("vt", F.col("vl").cast("string"), F.col("vd").cast("string"))
    found = _typed_counts(df, names, inner).select(*inner, _label(names).alias("column"), value.alias("value"), "n")
    return _restored(found, keys, inner)


def _count_figures(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*keys, "ci").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(~_is_present(), F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count_if(_is_present()).alias("cardinality"),
    )


def _column_counts(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, ci, total, missing_count, cardinality)`` for each column."""
    return _count_figures(_typed_counts(df, names, keys), keys)


def _no_columns(df: DataFrame, keys: Sequence[str], rest: str) -> DataFrame:
    """No rows, for a table without columns of the asked kind."""
    types = ", ".join(f"cast(null as {t}) as `{c}`" for c, t in (f.split() for f in f"column string, {rest}".split(", ")))
    return df.select(*[ident(k) for k in keys], F.expr("1")).limit(0).selectExpr(*[f"`{k}`" for k in keys], *types.split(", "))


# ---- whole-table figures ------------------------------------------------------------------


def shape(df: DataFrame) -> DataFrame:
    """Row and column counts, with ``error`` set for an empty table."""
    n_columns = len(df.columns)
    return df.agg(F.count("*").alias("rows")).select(
        "rows",
        F.lit(n_columns).cast("bigint").alias("columns"),
        F.when(F.col("rows") == 0, "Dataset is empty.").alias("error"),
    )


_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def footprint(df: DataFrame) -> DataFrame:
    """Estimated bytes: the fixed width of each type, the byte length of text."""
    total = F.lit(0).cast("bigint")
    fixed = 0
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(ident(f.name)), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            total = total + F.coalesce(F.octet_length(as_text(ident(f.name), f.dataType)), F.lit(0))
        else:
            fixed += _WIDTHS.get(f.dataType.simpleString(), 8)
    size = F.coalesce(F.sum(total + F.lit(fixed).cast("bigint")), F.lit(0))
    return df.agg(size.alias("memory_bytes")).select(
        "memory_bytes", (F.col("memory_bytes") / float(1024**2)).alias("memory_mb")
    )


def duplicate_stats(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows; NULL equals NULL, NaN equals NaN.

    Rows are first counted by a 64-bit hash, so the shuffle carries eight bytes for each row
    that has no copy in its task. Only rows whose hash occurs again are compared in full; those of
    a very frequent hash are counted inside their task first, so that each travels once a task.
    """
    df = nan_to_null(df)
    plain = [
        as_text(ident(f.name), f.dataType).alias(f.name)
        if isinstance(f.dataType, (T.MapType, T.VariantType))
        else ident(f.name)
        for f in df.schema
    ]
    places = [f"c{i}" for i in range(len(plain))]
    hashed = df.select(*plain).toDF(*places).withColumn("h", F.xxhash64(*places))
    repeated = written(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "hashes")
    heavy = F.broadcast(heavy_keys(repeated, ["h"]))  # fewer than HEAVY rows
    frequent = hashed.join(heavy, "h", "left_semi")
    others = hashed.join(heavy, "h", "left_anti").join(repeated, "h", "left_semi")
    # Grouped by the hash, so that the tasks count before the shuffle, and by all columns.
    copies = [rows.groupBy("h", *places).agg(F.count("*").alias("n")) for rows in (frequent, others)]
    parts = copies[0].unionByName(copies[1]).select(F.lit(0).cast("bigint").alias("r"), (F.col("n") - 1).alias("d")).union(
        df.agg(F.count("*").alias("r")).select("r", F.lit(0).cast("bigint"))
    )
    return parts.agg(F.sum("r").alias("rows"), F.sum("d").alias("duplicate_rows")).select(
        "rows", "duplicate_rows", _percent(F.col("duplicate_rows"), F.col("rows")).alias("duplicate_pct")
    )


def missing(df: DataFrame) -> DataFrame:
    """Missing count and percentage of every column, in one pass without a wide shuffle."""
    df = nan_to_null(df)
    names = df.columns
    counts = df.agg(
        F.count("*").alias("__total"), *[F.count_if(ident(c).isNull()).alias(f"m{i}") for i, c in enumerate(names)]
    )
    rows = [[F.lit(i), F.col(f"m{i}"), F.col("__total")] for i in range(len(names))]
    return _stack(counts, [], rows, ["ci", "missing_count", "__total"]).select(
        _label(names).alias("column"),
        "missing_count",
        _percent(F.col("missing_count"), F.col("__total")).alias("missing_pct"),
    )


def overall_missing(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    cells = F.lit(0).cast("bigint")
    for c in df.columns:
        cells = cells + ident(c).isNull().cast("bigint")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(cells), F.lit(0)).alias("total_missing")).select(
        "total_missing",
        _percent(F.col("total_missing"), F.col("rows") * len(df.columns)).alias("overall_missing_pct"),
    )


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-missing values of each column; ``approx`` trades exactness for one small pass."""
    df = nan_to_null(df)
    names = _names(df, columns, ())
    if approx:
        counts = df.agg(
            *[
                F.approx_count_distinct(as_text(ident(c), df.schema[c].dataType)).alias(f"c{i}")
                for i, c in enumerate(names)
            ]
        )
        out = _stack(counts, [], [[F.lit(i), F.col(f"c{i}")] for i in range(len(names))], ["ci", "cardinality"])
    else:
        out = _column_counts(df, names)
    return out.select(_label(names).alias("column"), "cardinality")


# ---- numeric columns ----------------------------------------------------------------------


def numeric_long(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, ci, v)``: one row for each numeric cell that is not missing."""
    rows = [[F.lit(i), ident(c).cast("double")] for i, c in enumerate(names)]
    return _stack(df, keys, rows, ["ci", "v"]).where(F.col("v").isNotNull())


def column_quantiles(
    df: DataFrame,
    names: Sequence[str],
    keys: Sequence[str] = (),
    probs: Sequence[float] = tuple(QUARTILES),
    approx: bool = False,
) -> DataFrame:
    """``(keys, ci, q)``; a column without values has no row."""
    group = [*keys, "ci"]
    long = numeric_long(df, names, keys)
    if approx:
        return long.groupBy(*group).agg(F.percentile_approx("v", list(probs), 10_000).alias("q"))
    return quantiles(long, group, "v", probs)


def _outside(v: Column) -> Column:
    iqr = F.col("q75") - F.col("q25")
    return (v < F.col("q25") - iqr * 1.5) | (v > F.col("q75") + iqr * 1.5)


STATS = ["mean", "std", "min", "q25", "median", "q75", "max", "outlier_count"]


def _figures(counts: DataFrame) -> list[Column]:
    """Aggregates of value counts that need no order."""
    n, present, v = F.col("n"), _is_present(), _number()
    return [
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(~present, n)), F.lit(0)).alias("missing_count"),
        F.count_if(present).alias("cardinality"),
        F.try_divide(F.sum(v * n), F.sum(F.when(v.isNotNull(), n))).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]


def _counted_stats(counts: DataFrame, keys: Sequence[str], quartiles: DataFrame | None, texts: bool = True) -> DataFrame:
    """Every figure the value counts hold, for all columns at once; ``quartiles`` is ``(keys, ci, q)``
    of the numeric ones, ``texts`` says whether there are others. A column has its row whether it
    has values or not."""
    group = [*keys, "ci"]
    out = counts.groupBy(*group).agg(*_figures(counts))
    if texts:
        # Apart from the others: an aggregate of text sorts its rows, here only those it needs.
        worded = counts.where("vt is not null and vd is null")
        top = worded.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), "vt")).alias("best"))
        top = top.select(*group, F.col("best.vt").alias("top"), (-F.col("best.m")).alias("freq"))
        out = join_same(out, top, group, "left")
    else:
        out = out.withColumns({"top": F.lit(None).cast("string"), "freq": F.lit(None).cast("bigint")})
    if quartiles is None:
        return out
    marks = {f"q[{i}]": c for i, c in enumerate(["q25", "median", "q75"])}
    out = join_same(out, quartiles.selectExpr(*[f"`{k}`" for k in group], *[f"{e} as {c}" for e, c in marks.items()]), group, "left")
    # One row for each column and key; written, so that Spark knows whether it may be broadcast.
    out = written(out, "figures")
    bounds = out.where("mean is not null").select(*group, "mean", "q25", "q75")
    numbers = counts.withColumn("v", _number()).where("v is not null").select(*group, "v", "n")
    off = F.col("v") - F.col("mean")
    spread = (
        join_same(numbers, bounds, group)
        .groupBy(*group)
        .agg(
            F.sqrt(F.try_divide(F.sum(off * off * F.col("n")), F.sum("n") - 1)).alias("std"),
            F.coalesce(F.sum(F.when(_outside(F.col("v")), F.col("n"))), F.lit(0)).alias("outlier_count"),
        )
    )
    return join_same(out, spread, group, "left")


def _quartiles(df: DataFrame, counts: DataFrame, names: Sequence[str], keys: Sequence[str], approx: bool) -> DataFrame:
    group = [*keys, "ci"]
    if approx:
        numeric = [c for c in names if is_numeric(df.schema[c].dataType)]
        places = F.element_at(F.array(*[F.lit(names.index(c)) for c in numeric]), F.col("ci") + 1)
        return column_quantiles(df, numeric, keys, approx=True).withColumn("ci", places)
    numbers = counts.select(*[ident(k) for k in group], _number().alias("v"), "n")
    return counted_quantiles(numbers, group, "v", QUARTILES)


def numeric_summary(
    df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """Mean, sample deviation, range, quartiles and outlier count of each numeric column.

    A column without values has NULLs; a table without numeric columns gives no rows."""
    df, inner = _keyed(nan_to_null(df), keys)
    names = [c for c in _names(df, columns, [*keys, *inner]) if is_numeric(df.schema[c].dataType)]
    if not names:
        none = "mean double, std double, min double, q25 double, median double, q75 double, max double, outlier_count bigint"
        return _restored(_no_columns(df, inner, none), keys, inner)
    found = _numeric_figures(df, names, inner, approx).select(*inner, _label(names).alias("column"), *STATS)
    return _restored(found, keys, inner)


def _numeric_figures(df: DataFrame, names: Sequence[str], keys: Sequence[str], approx: bool) -> DataFrame:
    counts = written(_typed_counts(df, names, keys), "counts")
    return _counted_stats(counts, keys, _quartiles(df, counts, names, keys, approx), texts=False)


def outliers(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Values outside 1.5 interquartile ranges, as count and percentage of all rows."""
    df = nan_to_null(df)
    names = [c for c in _names(df, columns, ()) if is_numeric(df.schema[c].dataType)]
    if not names:
        return _no_columns(df, (), "outlier_count bigint, outlier_pct double")
    return _numeric_figures(df, names, (), approx).select(
        _label(names).alias("column"), "outlier_count", _percent(F.col("outlier_count"), F.col("total")).alias("outlier_pct")
    )


# ---- categorical columns ------------------------------------------------------------------


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Non-missing count, distinct count and most frequent value of each non-numeric column; of
    equally frequent values the first in order. No rows for a table without such columns."""
    df, inner = _keyed(nan_to_null(df), keys)
    names = [c for c in _names(df, columns, [*keys, *inner]) if not is_numeric(df.schema[c].dataType)]
    if not names:
        return _restored(_no_columns(df, inner, "count bigint, unique bigint, top string, freq bigint"), keys, inner)
    found = _counted_stats(_typed_counts(df, names, inner), inner, None).select(
        *inner,
        _label(names).alias("column"),
        (F.col("total") - F.col("missing_count")).alias("count"),
        F.col("cardinality").alias("unique"),
        F.coalesce("top", F.lit("N/A")).alias("top"),
        F.coalesce("freq", F.lit(0)).alias("freq"),
    )
    return _restored(found, keys, inner)


# ---- correlation --------------------------------------------------------------------------


def _pair_correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(i, j, r)`` for i <= j: Pearson over the rows that have both values, 0 where undefined.

    Each task sums products over its Arrow batches by matrix multiplication, and the per-task
    matrices (columns x columns, whatever the row count) are added up. One ``covar_pop`` per
    pair instead grows past what the JVM compiles at a dozen columns.
    """
    import numpy as np
    import pandas as pd

    k = len(names)
    numbers = df.select(*[ident(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    # Sums are taken around the column means, which keeps the products small.
    means = numbers.agg(*[F.coalesce(F.avg(f"c{i}"), F.lit(0.0)) for i in range(k)]).first()
    centre = np.array([float(m) for m in means])
    names5 = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def partial(batches):
        acc = {s: np.zeros((k, k)) for s in names5}
        for batch in batches:
            x = batch.to_numpy(dtype="float64")
            m = (~np.isnan(x)).astype("float64")
            x = np.where(m > 0, x - centre, 0.0)
            acc["n"] += m.T @ m
            acc["sx"] += x.T @ m
            acc["sy"] += m.T @ x
            acc["sxx"] += (x * x).T @ m
            acc["syy"] += m.T @ (x * x)
            acc["sxy"] += x.T @ x
        i, j = np.indices((k, k))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), **{s: acc[s].ravel() for s in names5}})

    fields = "i int, j int, " + ", ".join(f"{s} double" for s in names5)
    sums = numbers.mapInPandas(partial, fields).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in names5])
    cov = F.col("sxy") * F.col("n") - F.col("sx") * F.col("sy")

    def spread(ss: str, s: str) -> Column:
        var = F.col(ss) * F.col("n") - F.col(s) * F.col(s)
        # A constant column leaves only rounding.
        return F.when(var > F.col(ss) * F.col("n") * 1e-13, var).otherwise(0.0)

    r = F.try_divide(cov, F.sqrt(spread("sxx", "sx")) * F.sqrt(spread("syy", "sy")))
    r = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(r, F.lit(0.0))))
    return sums.where(F.col("i") <= F.col("j")).select("i", "j", r.alias("r"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_a, column_b, r)`` for all ordered pairs; no rows for fewer than two columns."""
    df = nan_to_null(df)
    names = columns or split_columns(df)[0]
    if len(names) < 2:
        return _no_pairs(df)
    return _matrix(_pair_correlations(df, names), names)


def _matrix(upper: DataFrame, names: Sequence[str]) -> DataFrame:
    mirrored = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    return upper.select(F.explode(mirrored).alias("p"), "r").select(
        _label(names, F.col("p.i")).alias("column_a"), _label(names, F.col("p.j")).alias("column_b"), "r"
    )


def _no_pairs(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "column_a string, column_b string, r double")


def top_correlations(df: DataFrame, k: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """The ``k`` column pairs with the largest absolute correlation."""
    df = nan_to_null(df)
    names = columns or split_columns(df)[0]
    if len(names) < 2:
        return _no_pairs(df)
    return _top_pairs(_pair_correlations(df, names), names, k)


def _top_pairs(pairs: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    best = pairs.where(F.col("i") < F.col("j"))
    best = best.orderBy(F.abs("r").desc(), "i", "j").limit(k)
    return best.select(
        _label(names, F.col("i")).alias("column_a"), _label(names, F.col("j")).alias("column_b"), "r"
    )


# ---- targets ------------------------------------------------------------------------------


def _candidates(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    name = F.lower("column")
    looks_like_target = F.lit(False)
    for pattern in TARGET_PATTERNS:
        looks_like_target = looks_like_target | name.rlike(pattern)
    few = (F.col("cardinality") > 1) & (
        F.col("cardinality") <= F.least(F.lit(15.0), F.col("total") * F.lit(0.1))
    )
    score = (
        F.when(looks_like_target, 50.0).otherwise(0.0)
        + F.when(few, 30.0).otherwise(0.0)
        + F.when(F.col("ci") == len(names) - 1, 20.0).otherwise(0.0)
    )
    task = F.when(F.col("cardinality") <= 20, "Classification").otherwise("Regression / High Cardinality")
    return (
        counts.withColumn("column", _label(names))
        .withColumn("score", score)
        .where(F.col("score") > 20.0)
        .select("ci", "column", "score", task.alias("inferred_task"), "cardinality")
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.orderBy(F.col("score").desc(), "ci").limit(k)


def _bounded_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(ci, total, missing_count, cardinality)`` of each column; the cardinality is exact below
    ``MANY``, of a column with more values it says no more than that.

    One pass sets a bit for each hash of a value, 4 KB a column and task. Values that share a bit
    make the number too small, never too large: a column with ``MANY`` bits has as many values. Only
    the values of the others, a handful each, are counted themselves. No value of a column with
    many is shuffled.
    """
    marks = [F.count("*").alias("total")]
    for i, name in enumerate(names):
        dtype, value = df.schema[name].dataType, ident(name)
        value = value if isinstance(dtype, (T.IntegralType, T.FloatType, T.DoubleType)) else as_text(value, dtype)
        bit = F.when(value.isNotNull(), F.pmod(F.xxhash64(value), F.lit(BITS)))
        marks += [F.count_if(value.isNull()).alias(f"m{i}"), F.bitmap_count(F.bitmap_construct_agg(bit)).alias(f"b{i}")]
    seen = df.agg(*marks).first()
    few = [i for i in range(len(names)) if seen[f"b{i}"] < MANY]
    exact = {}
    if few and seen["total"]:
        # One row for each column.
        figures = _column_counts(df, [names[i] for i in few]).collect()
        exact = {few[r["ci"]]: r["cardinality"] for r in figures}
    rows = [(i, seen["total"], seen[f"m{i}"], exact.get(i, seen[f"b{i}"])) for i in range(len(names))]
    schema = "ci int, total bigint, missing_count bigint, cardinality bigint"
    return df.sparkSession.createDataFrame(rows if seen["total"] else [], schema)


def _likeliest(df: DataFrame, k: int) -> DataFrame:
    """The ``k`` likeliest targets; a cardinality from ``MANY`` on is a lower bound."""
    return _best(_candidates(_bounded_counts(df, df.columns), df.columns), k)


def target_candidates(df: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` likeliest target columns: ``(column, score, inferred_task, cardinality)``.

    Whether a column has few values is known without counting those of the others; the shown
    cardinality is exact, so the values of a shown column with many are counted as well.
    """
    df = nan_to_null(df)
    best = _likeliest(df, k)
    shown = best.collect()  # k rows, at most one for each column
    many = [r["column"] for r in shown if r["cardinality"] >= MANY]
    found = df.sparkSession.createDataFrame(shown, best.schema)
    if many:
        counted = _column_counts(df, many).select(_label(many).alias("column"), F.col("cardinality").alias("exact"))
        found = found.join(counted, "column", "left").withColumn("cardinality", F.coalesce("exact", "cardinality"))
    return _best(found, k).select("column", "score", "inferred_task", "cardinality")


def default_target_row(df: DataFrame, fallback: str = "target") -> DataFrame:
    """One row ``(column)``: the likeliest target, or ``fallback``."""
    return _likeliest(nan_to_null(df), 1).agg(F.coalesce(F.first("column"), F.lit(fallback)).alias("column"))


def default_target(df: DataFrame, fallback: str = "target") -> str:
    return default_target_row(df, fallback).first()["column"]


def _balance(counts: DataFrame, wanted: DataFrame, max_classes: int) -> DataFrame:
    """Class balance from value counts of all columns; ``wanted`` is ``(ci, column)`` of one row at most."""
    value = F.coalesce("vt", F.col("vl").cast("string"), F.col("vd").cast("string"))
    chosen = counts.join(F.broadcast(wanted), "ci").select("column", value.alias("value"), "n")
    totals = chosen.groupBy("column").agg(F.sum("n").alias("total"), F.count("value").alias("classes"))
    return (
        chosen.where(F.col("value").isNotNull())
        .join(F.broadcast(totals), "column")
        .where(F.col("classes") <= max_classes)
        .select("column", "value", F.col("n").alias("count"), _percent(F.col("n"), F.col("total")).alias("percentage"))
    )


def class_balance(df: DataFrame, column: str | None = None, max_classes: int = 30) -> DataFrame:
    """``(column, value, count, percentage)`` of the primary target (or of ``column``); no rows
    when it has more than ``max_classes`` values. Only the values of that column are counted, and
    none of a column that is seen to have too many."""
    df, spark = nan_to_null(df), df.sparkSession
    if column:
        seen = _bounded_counts(df, [column]).first()
    else:
        seen = _likeliest(df, 1).first()
        column = seen and seen["column"]
    if seen is None or max_classes < MANY <= seen["cardinality"]:
        return spark.createDataFrame([], "column string, value string, count bigint, percentage double")
    one = spark.range(1).select(F.lit(0).alias("ci"), F.lit(column).alias("column"))
    return _balance(_typed_counts(df, [column]), one, max_classes)


# ---- the full report ----------------------------------------------------------------------


def _column_profile(df: DataFrame, keys: Sequence[str], approx: bool) -> DataFrame:
    return _profiled(df, written(_typed_counts(df, _names(df, None, keys), keys), "counts"), keys, approx)


def _profiled(df: DataFrame, counts: DataFrame, keys: Sequence[str], approx: bool) -> DataFrame:
    names = _names(df, None, keys)
    if any(is_numeric(df.schema[c].dataType) for c in names):
        texts = not all(is_numeric(df.schema[c].dataType) for c in names)
        out = _counted_stats(counts, keys, _quartiles(df, counts, names, keys, approx), texts)
    else:
        out = _counted_stats(counts, keys, None)
        out = out.withColumns({c: F.lit(None).cast("double") for c in STATS})
    dtypes = dict(column_types(df))
    return out.select(
        *[ident(k) for k in keys],
        F.col("ci").alias("position"),
        _label(names).alias("column"),
        _label([dtypes[c] for c in names]).alias("dtype"),
        "total",
        "missing_count",
        _percent(F.col("missing_count"), F.col("total")).alias("missing_pct"),
        "cardinality",
        *STATS[:-1],
        F.col("outlier_count").cast("bigint").alias("outlier_count"),
        F.when(F.col("outlier_count").isNotNull(), _percent(F.col("outlier_count"), F.col("total"))).alias("outlier_pct"),
        "top",
        "freq",
    )


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row for each column with all its figures."""
    return _column_profile(nan_to_null(df), [], approx)


def profile_by(df: DataFrame, keys: str | Sequence[str], approx: bool = False) -> DataFrame:
    """``column_profile`` of every part of the table with equal ``keys``; NULL is a key, and a key
    named like a figure (``total``, ``mean``, ...) is returned as ``key_<name>``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    df, inner = _keyed(nan_to_null(df), keys)
    return _restored(_column_profile(df, inner, approx), keys, inner)


def table_profile(df: DataFrame) -> DataFrame:
    """One row: shape, footprint, duplicates and missing cells."""
    one = F.lit(1).alias("__one")
    parts = [
        footprint(df).select(one, "memory_mb"),
        duplicate_stats(df).select(one, "duplicate_rows", "duplicate_pct"),
        overall_missing(df).select(one, "total_missing", "overall_missing_pct"),
    ]
    out = shape(df).select(one, "rows", "columns", "error")
    for part in parts:
        out = out.join(F.broadcast(part), "__one")  # single rows
    return out.drop("__one")


def profile(df: DataFrame, approx: bool = False) -> dict[str, DataFrame]:
    """The report as flat tables.

    The values of all columns are counted once; column figures, targets and class balance come from
    those counts, and matrix and top pairs from one result.
    """
    df = nan_to_null(df)
    counts = written(_typed_counts(df, df.columns), "counts")
    columns = written(_profiled(df, counts, [], approx), "columns")
    figures = columns.select(F.col("position").alias("ci"), "total", "missing_count", "cardinality")
    found = _candidates(figures, df.columns)
    names = split_columns(df)[0]
    pairs = written(_pair_correlations(df, names), "pairs") if len(names) > 1 else None
    return {
        "table": table_profile(df),
        "columns": columns,
        "correlations": _no_pairs(df) if pairs is None else _top_pairs(pairs, names, 10),
        "matrix": _no_pairs(df) if pairs is None else _matrix(pairs, names),
        "target_candidates": _best(found, 3).drop("ci"),
        "class_balance": _balance(counts, _best(found, 1).select("ci", "column"), 30),
    }
