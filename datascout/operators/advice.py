"""Rule-based findings over profile tables: ``(subject, rule, action)`` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datascout.operators.prep import impute
from datascout.operators.profile import (
    _pair_correlations,
    class_balance,
    missing,
    table_profile,
    target_candidates,
)
from datascout.runtime import cut_lineage
from datascout.schema import is_numeric, nan_to_null

# Limits the advice names.
MISSING_PCT_LIMIT = 1.0
NULL_COLUMN_PCT_LIMIT = 50.0
LEAKING_NAME = "^(id|uuid|index)"


def _finding(subject: Column, rule: str, action: Column) -> Column:
    return F.struct(subject.alias("subject"), F.lit(rule).alias("rule"), action.alias("action"))


def _rows(df: DataFrame, findings: Sequence[tuple[Column, Column]]) -> DataFrame:
    """One output row for each finding whose condition holds."""
    kept = F.array_compact(F.array(*[F.when(condition, finding) for condition, finding in findings]))
    return df.select(F.explode(kept).alias("f")).select("f.*")


def preprocess_findings(df: DataFrame, encoding: str | None = None, delimiter: str | None = None) -> DataFrame:
    """Cleaning steps the profile calls for."""
    numeric_types = [f.name for f in df.schema if is_numeric(f.dataType)]
    table = table_profile(df)
    many_missing = F.col("overall_missing_pct") > MISSING_PCT_LIMIT
    whole = _rows(
        table,
        [
            (many_missing, _finding(F.lit("table"), "missing_values", F.lit("drop columns above 50% missing"))),
            (~many_missing, _finding(F.lit("table"), "missing_values", F.lit("impute mean or median, mode"))),
            (F.col("duplicate_rows") > 0, _finding(F.lit("table"), "duplicate_rows", F.lit("drop duplicates"))),
            (
                F.lit(encoding is not None),
                _finding(F.lit("file"), "encoding", F.lit(f"{encoding}, {delimiter}")),
            ),
        ],
    )
    numeric = F.col("column").isin(numeric_types)
    gaps = F.col("missing_pct") > 0
    sparse = F.col("missing_pct") > NULL_COLUMN_PCT_LIMIT
    columns = _rows(
        missing(df),
        [
            (sparse, _finding(F.col("column"), "missing_values", F.lit("drop column"))),
            (gaps & ~sparse & numeric, _finding(F.col("column"), "missing_values", F.lit("impute median"))),
            (gaps & ~sparse & ~numeric, _finding(F.col("column"), "missing_values", F.lit("impute mode"))),
            (numeric, _finding(F.col("column"), "feature_scaling", F.lit("standard or min-max scale"))),
        ],
    )
    return whole.unionByName(columns)


def _primary_target(df: DataFrame) -> DataFrame:
    """Exactly one row: the first candidate, or the words for none."""
    return (
        target_candidates(df, 1)
        .agg(F.first("column").alias("column"), F.first("inferred_task").alias("inferred_task"))
        .select(
            F.coalesce("column", F.lit("None detected")).alias("target"),
            F.coalesce("inferred_task", F.lit("General Tabular")).alias("task"),
        )
    )


def model_findings(df: DataFrame) -> DataFrame:
    """Models to try and how to validate them, for the primary target."""
    classes = F.lower("task").contains("classification")
    return _rows(
        _primary_target(df),
        [
            (F.lit(True), _finding(F.col("target"), "task", F.col("task"))),
            (F.lit(True), _finding(F.col("target"), "model", F.lit("linear baseline"))),
            (F.lit(True), _finding(F.col("target"), "model", F.lit("gradient-boosted trees"))),
            (F.lit(True), _finding(F.col("target"), "model", F.lit("random forest"))),
            (classes, _finding(F.col("target"), "validation", F.lit("stratified k-fold"))),
            (~classes, _finding(F.col("target"), "validation", F.lit("k-fold, k=5"))),
        ],
    )


def leakage_findings(df: DataFrame, target: str, threshold: float = 0.99) -> DataFrame:
    """Columns that may give the target away: by name, or by correlation with it."""
    df = nan_to_null(df)
    others = [c for c in df.columns if c != target]
    names = df.sparkSession.createDataFrame([(c,) for c in others], "column string")
    by_name = names.where(F.lower("column").rlike(LEAKING_NAME)).select(
        F.col("column").alias("subject"), F.lit("identifier_name").alias("rule"), F.lit("exclude").alias("action")
    )
    numeric = [c for c in others if is_numeric(df.schema[c].dataType)]
    if not numeric or not is_numeric(df.schema[target].dataType):
        return by_name
    columns = [target, *numeric]
    label = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("j") + 1)
    by_value = (
        _pair_correlations(df, columns)
        .where((F.col("i") == 0) & (F.col("j") > 0) & (F.abs("r") >= threshold))
        .select(label.alias("subject"), F.lit("target_correlation").alias("rule"), F.lit("exclude").alias("action"))
    )
    return by_name.unionByName(by_value)


def summary_findings(df: DataFrame) -> DataFrame:
    """One row: shape, target, task, missing cells and duplicates."""
    table = table_profile(df).withColumn("__one", F.lit(1))
    target = _primary_target(df).withColumn("__one", F.lit(1))
    return table.join(F.broadcast(target), "__one").select(
        "rows",
        "columns",
        "target",
        "task",
        "total_missing",
        "overall_missing_pct",
        "duplicate_rows",
        "duplicate_pct",
    )


def profile_digest(df: DataFrame, filename: str) -> DataFrame:
    """One row with what an assistant needs to know; sizes go with the column count."""
    one = F.lit(1).alias("__one")
    table = table_profile(df).select(one, "rows", "columns", "duplicate_rows", "overall_missing_pct")
    candidates = target_candidates(df).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("score")).alias("order"), "column", "inferred_task", "cardinality"))
        ).alias("found")
    )
    balance = class_balance(df).agg(
        F.first("column").alias("balance_column"),
        F.array_sort(F.collect_list(F.struct("value", "count", "percentage"))).alias("class_balance"),
    )
    return (
        table.join(F.broadcast(candidates.select(one, "found")), "__one")
        .join(F.broadcast(balance.select(one, "balance_column", "class_balance")), "__one")
        .select(
            F.lit(filename).alias("filename"),
            "rows",
            "columns",
            F.col("duplicate_rows").alias("duplicates"),
            F.col("overall_missing_pct").alias("missing_pct"),
            F.array(*[F.lit(c) for c in df.columns]).alias("columns_list"),
            F.transform("found", lambda f: f.dropFields("order")).alias("target_candidates"),
            "balance_column",
            "class_balance",
        )
    )


def clean(df: DataFrame, max_missing_pct: float = NULL_COLUMN_PCT_LIMIT) -> DataFrame:
    """Drop sparse columns, drop duplicate rows, impute median or mode."""
    df = nan_to_null(df)
    sparse = missing(df).where(F.col("missing_pct") > max_missing_pct).select("column").collect()
    df = df.drop(*[r["column"] for r in sparse])
    # Imputing reads the rows several times; the full-row shuffle runs once.
    return impute(cut_lineage(df.dropDuplicates()))
