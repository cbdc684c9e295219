"""Schemas, fixed values and column typing shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("provider", T.StringType(), False),
        T.StructField("task", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("columns", T.LongType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("license", T.StringType()),
        T.StructField("last_updated", T.StringType()),
        T.StructField("downloads", T.LongType()),
        T.StructField("popularity", T.DoubleType()),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("description", T.StringType()),
        T.StructField("data_url", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("raw_metadata", T.StringType()),
    ]
)
PUBLIC_COLUMNS = [f.name for f in CATALOG_SCHEMA if f.name != "raw_metadata"]
LEDGER_COLUMNS = ["local_path", "downloaded_at", "actual_size"]

# Text a reader of delimited files takes as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Dataset names that count as popular, with their numbers, in listing order.
POPULAR_DATASETS = {
    "iris": 53,
    "adult": 2,
    "wine": 186,
    "heart disease": 45,
    "breast cancer": 17,
    "car evaluation": 19,
    "diabetes": 34,
    "mushroom": 73,
    "abalone": 1,
    "bank marketing": 222,
    "dry bean": 602,
    "rice": 545,
    "spambase": 94,
    "boston housing": 52,
    "sonar": 151,
    "auto mpg": 9,
    "yeast": 189,
    "glass": 42,
    "student performance": 320,
    "forest fires": 162,
    "credit approval": 27,
    "statlog german credit": 144,
    "dermatology": 33,
}

# Column-name patterns that suggest a prediction target.
TARGET_PATTERNS = ["class", "target", "label", "^y$", "predict", "outcome", "species", "diagnos"]

# Whitespace as Unicode text splitting sees it, written out so that it does not depend on regex flags.
WHITESPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

HF_PAYLOAD = (
    "id string, tags array<string>, downloads bigint, likes bigint, description string, lastModified string"
)
OPENML_PAYLOAD = (
    "did bigint, name string, version string, file_id string, format string, "
    "quality array<struct<name: string, value: string>>"
)
UCI_PAYLOAD = (
    "status int, data struct<uci_id: bigint, name: string, tasks: array<string>, num_instances: bigint, "
    "num_features: bigint, variables: array<struct<name: string>>, has_missing_values: string, "
    "abstract: string, data_url: string, repository_url: string, area: string, "
    "characteristics: array<string>, last_updated: string>"
)
GITHUB_PAYLOAD = (
    "full_name string, name string, description string, default_branch string, html_url string, "
    "updated_at string, stargazers_count bigint, size bigint, has_wiki boolean, "
    "license struct<name: string>, owner struct<login: string>"
)
KAGGLE_PAYLOAD = (
    "ref string, title string, size string, licenseName string, lastUpdated string, description string, "
    "downloadCount bigint, usabilityRating double"
)


def is_numeric(dtype: T.DataType) -> bool:
    """Integers, floats and decimals; booleans, dates and intervals are categorical."""
    return isinstance(dtype, T.NumericType)


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the other columns, in table order."""
    numeric = [f.name for f in df.schema if is_numeric(f.dataType)]
    other = [f.name for f in df.schema if not is_numeric(f.dataType)]
    return numeric, other


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def ident(name: str) -> Column:
    """Column by literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make NaN missing, as NULL is, once on entry."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(ident(c)), ident(c)).alias(c) if c in floats else ident(c)
            for c in df.columns
        ]
    )
