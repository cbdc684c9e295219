"""Training-set preparation: impute, split, scale, encode, batch, fit baselines.

Statistics are fitted first (a few numbers for each column) and then applied as literals, so
that applying them is a projection without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascout.operators.groups import free_name, hash_index, heavy_keys, running_sum, spread_join
from datascout.operators.profile import (
    cardinality,
    categorical_summary,
    column_quantiles,
    default_target,
)
from datascout.runtime import written
from datascout.schema import ident, nan_to_null, split_columns


def _replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else ident(c) for c in df.columns])


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    if not columns:
        return {}
    found = column_quantiles(df, columns, probs=[0.5]).collect()  # one row for each column
    return {columns[r["ci"]]: r["q"][0] for r in found}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    found = categorical_summary(df, columns).where("freq > 0").collect()  # one row for each column
    return {r["column"]: r["top"] for r in found}


def impute_median(df: DataFrame) -> DataFrame:
    """Missing numbers become the exact column median; whole numbers widen to double."""
    df = nan_to_null(df)
    numeric = split_columns(df)[0]
    fitted = medians(df, numeric)
    return _replaced(df, {c: F.coalesce(ident(c).cast("double"), F.lit(m)) for c, m in fitted.items()})


def impute(df: DataFrame) -> DataFrame:
    """Median for numeric columns, most frequent value for text and boolean ones."""
    df = nan_to_null(df)
    other = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    fitted = modes(df, other) if other else {}
    out = {c: F.coalesce(ident(c), F.lit(m).cast(df.schema[c].dataType)) for c, m in fitted.items()}
    return impute_median(_replaced(df, out))


def features_and_target(df: DataFrame, target: str | None = None) -> DataFrame:
    """The remaining numeric columns, then the target column if the table has it."""
    target = target or default_target(df)
    features = [c for c in split_columns(df)[0] if c != target]
    return df.select(*[ident(c) for c in features], *([ident(target)] if target in df.columns else []))


def scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, 1 where there is no spread."""
    aggs = [f(ident(c).cast("double")) for c in columns for f in (F.avg, F.stddev_pop)]
    row = nan_to_null(df.select(*[ident(c) for c in columns])).agg(*aggs).first()
    return {c: (row[2 * i], row[2 * i + 1] or 1.0) for i, c in enumerate(columns) if row[2 * i] is not None}


def standard_scale(
    df: DataFrame, columns: Sequence[str], fitted: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """``(x - mean) / deviation``; pass ``fitted`` to apply what was learnt on another table."""
    fitted = fitted or scaling(df, columns)
    return _replaced(df, {c: (ident(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def _hash_share(key: Sequence[str], seed: int) -> Column:
    """A fixed number in [0, 1) for each key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[ident(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2**32)


def train_test_split(
    df: DataFrame, key: str | Sequence[str], test: float = 0.2, seed: int = 42, exact: bool = False
) -> DataFrame:
    """Add ``split`` ('train' or 'test'), fixed for a key whatever the partitioning.

    By default each key falls by its hash, without a shuffle. ``exact`` takes exactly
    ``ceil(test * rows)`` rows, those first in hash order.
    """
    key = [key] if isinstance(key, str) else list(key)
    if not exact:
        return df.withColumn("split", F.when(_hash_share(key, seed) < test, "test").otherwise("train"))
    wanted = -(-df.count() * round(test * 10**9) // 10**9)
    index = free_name(df, "__index")
    indexed = hash_index(df, key, seed, out=index)
    return indexed.withColumn("split", F.when(F.col(index) < wanted, "test").otherwise("train")).drop(index)


def batches(df: DataFrame, key: str | Sequence[str], size: int = 32, seed: int = 42) -> DataFrame:
    """Add ``batch_id``: rows in a fixed shuffled order, ``size`` to a batch."""
    key = [key] if isinstance(key, str) else list(key)
    index = free_name(df, "__index")
    indexed = hash_index(df, key, seed, out=index)
    return indexed.withColumn("batch_id", F.floor(F.col(index) / size).cast("bigint")).drop(index)


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: codes from 0 in value order."""
    values = df.select(ident(column).alias("value")).where("value is not null").distinct()
    return running_sum(values, ["value"], F.lit(1), "code")


def encode_categories(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace text columns by integer codes in value order; missing stays missing, and any column
    names are kept. No rows give no rows.

    The values of all columns are counted in one pass, which also tells the frequent ones.
    """
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not columns:
        return df
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    places = [df.columns.index(c) for c in columns]
    cells = F.stack(F.lit(len(places)), *[x for i in places for x in (F.lit(i), F.col(f"c{i}").cast("string"))])
    counts = named.select(cells.alias("ci", "value")).where("value is not null").groupBy("ci", "value").agg(F.count("*").alias("n"))
    counts = written(counts, "values")
    codes = written(running_sum(counts, ["value"], F.lit(1), "code", ["ci"]).select("ci", "value", "code"), "codes")
    out = named
    for i in places:
        of_column = counts.where(F.col("ci") == i).select(F.col("value").alias(f"c{i}"), "n")
        # Small dictionaries are broadcast by Spark's own size check, large ones are shuffled.
        coded = codes.where(F.col("ci") == i).select(F.col("value").alias(f"c{i}"), F.col("code").cast("bigint").alias(f"code{i}"))
        out = spread_join(out, coded, [f"c{i}"], heavy_keys(of_column, [f"c{i}"]), "left")
    chosen = [F.col(f"code{i}" if i in places else f"c{i}").alias(c) for i, c in enumerate(df.columns)]
    return out.select(*chosen)


def fill_missing_label(df: DataFrame, label: str = "missing") -> DataFrame:
    return df.fillna(label, subset=[f.name for f in df.schema if isinstance(f.dataType, T.StringType)])


def objective(df: DataFrame, target: str) -> DataFrame:
    """One row ``(column, objective)``: binary for at most two values of the target, else multiclass."""
    kind = F.when(F.col("cardinality") <= 2, "binary").otherwise("multiclass")
    return cardinality(df, [target]).select("column", kind.alias("objective"))


def choose_objective(df: DataFrame, target: str) -> str:
    return objective(df, target).first()["objective"]


# Defaults of the baseline learners.
TREES, SEED = 100, 42
ROUNDS, STEP, DEPTH = 10, 0.3, 6
# Fixed value: targets with at most so many values are classes.
MOST_CLASSES = 20
# Feature values of the rows that one task trains on. Tree learners keep them as objects, about 35 bytes each.
TASK_CELLS = 4_000_000


def _prepared(train: DataFrame, test: DataFrame, target: str, classes: bool, scaled: bool) -> list[DataFrame]:
    """``(features, label)`` of both tables: missing features become the medians of the training rows,
    classes are numbered in order of their text, rows without a known label are left out."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    features = [c for c in split_columns(train)[0] if c != target]
    train, test = nan_to_null(train), nan_to_null(test)
    middle = medians(train, features)

    def filled(df: DataFrame) -> DataFrame:
        label = ident(target).cast("string" if classes else "double").alias("__label")
        numbers = [F.coalesce(ident(c).cast("double"), F.lit(middle.get(c, 0.0))).alias(f"f{i}") for i, c in enumerate(features)]
        return df.select(*numbers, label).where(F.col("__label").isNotNull())

    both = [filled(train), filled(test)]
    names = [f"f{i}" for i in range(len(features))]
    if scaled:
        fitted = scaling(both[0], names)
        both = [standard_scale(d, names, fitted) for d in both]
    if classes:
        indexer = StringIndexer(inputCol="__label", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")
        coder = indexer.fit(both[0])
        both = [coder.transform(d) for d in both]
    else:
        both = [d.withColumnRenamed("__label", "label") for d in both]
    assemble = VectorAssembler(inputCols=names, outputCol="features").transform
    return [assemble(d).select("features", "label") for d in both]


def _dealt(rows: DataFrame, train: DataFrame, target: str) -> DataFrame:
    """Training rows as they are, or dealt evenly where a task has more than ``TASK_CELLS`` values of features."""
    width = max(1, len([c for c in split_columns(train)[0] if c != target]))
    counts = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    size = counts.agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
    if (size["most"] or 0) * width <= TASK_CELLS:
        return rows
    return rows.repartition(max(-(-size["total"] * width // TASK_CELLS), rows.sparkSession.sparkContext.defaultParallelism))


def _score(spark, metric: str, value: float, objective: str) -> DataFrame:
    return spark.createDataFrame([(objective, metric, float(value))], "objective string, metric string, value double")


def fit_baseline(
    train: DataFrame, test: DataFrame, target: str, regression: bool | None = None, trees: int = TREES, seed: int = SEED
) -> DataFrame:
    """Random forest on imputed, scaled features: accuracy (or R2) on the test rows. The number of
    values of the target decides between classes and regression unless ``regression`` says it."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.regression import RandomForestRegressor

    if regression is None:
        regression = cardinality(train, [target]).first()["cardinality"] > MOST_CLASSES
    data = _prepared(train, test, target, classes=not regression, scaled=True)
    learner = RandomForestRegressor if regression else RandomForestClassifier
    model = learner(numTrees=trees, seed=seed).fit(_dealt(data[0], train, target))
    metric = "r2" if regression else "accuracy"
    evaluator = (RegressionEvaluator if regression else MulticlassClassificationEvaluator)(metricName=metric)
    value = evaluator.evaluate(model.transform(data[1]))
    return _score(train.sparkSession, metric, value, "regression" if regression else "classification")


def fit_boosted(
    train: DataFrame, test: DataFrame, target: str, rounds: int = ROUNDS, step: float = STEP, depth: int = DEPTH, seed: int = SEED
) -> DataFrame:
    """Gradient-boosted trees: log loss for two classes, of any values; accuracy for more (one against
    the rest)."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    data = _prepared(train, test, target, classes=True, scaled=False)
    objective = choose_objective(train, target)
    learner = GBTClassifier(maxIter=rounds, stepSize=step, maxDepth=depth, seed=seed)
    metric = "logLoss" if objective == "binary" else "accuracy"
    model = (learner if objective == "binary" else OneVsRest(classifier=learner)).fit(_dealt(data[0], train, target))
    value = MulticlassClassificationEvaluator(metricName=metric).evaluate(model.transform(data[1]))
    return _score(train.sparkSession, metric, value, objective)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def summarize(df: DataFrame) -> DataFrame:
    return df.summary()
