"""Hub payloads to catalog rows, their union, and the views over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datascout.functions import text
from datascout.schema import (
    CATALOG_SCHEMA,
    GITHUB_PAYLOAD,
    HF_PAYLOAD,
    KAGGLE_PAYLOAD,
    OPENML_PAYLOAD,
    POPULAR_DATASETS,
    PUBLIC_COLUMNS,
    UCI_PAYLOAD,
)

PROVIDERS = ["huggingface", "openml", "uci", "github", "kaggle"]


def _catalog_row(df: DataFrame, **columns: Column) -> DataFrame:
    """The catalog columns, cast; those a hub does not give take their default."""
    defaults = {
        "task": F.lit("Unknown"),
        "license": F.lit("Unknown"),
        "last_updated": F.lit("Unknown"),
        "popularity": F.lit(0.0),
        "quality_score": F.lit(0.0),
        "description": F.lit(""),
        "tags": F.array(),
    }
    return df.select(
        *[
            columns.get(f.name, defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
            for f in CATALOG_SCHEMA
        ]
    )


def _present(col: Column) -> Column:
    return col.isNotNull() & (col != "")


def _points(base: float, *awards: tuple[Column, float]) -> Column:
    total = F.lit(base)
    for condition, points in awards:
        total = total + F.when(condition, points).otherwise(0.0)
    return total


#: The field that names a dataset in each hub's payload, and the payload's schema.
IDENTITY = {
    "huggingface": ("id", HF_PAYLOAD),
    "openml": ("did", OPENML_PAYLOAD),
    "uci": ("data.uci_id", UCI_PAYLOAD),
    "github": ("full_name", GITHUB_PAYLOAD),
    "kaggle": ("ref", KAGGLE_PAYLOAD),
}


def _named(provider: str) -> Column:
    name = F.col(f"p.{IDENTITY[provider][0]}").cast("string")
    return F.coalesce(name != "", F.lit(False))


def _parsed(raw: DataFrame, provider: str, payload: str) -> DataFrame:
    """Payloads of the hub; one that is broken or of another hub names no dataset and is left out."""
    schema = IDENTITY[provider][1]
    return raw.select(F.from_json(payload, schema).alias("p"), F.col(payload).alias("raw")).where(_named(provider))


def rejected_payloads(raw: DataFrame, provider: str, payload: str = "payload") -> DataFrame:
    """``(provider, payloads)``: how many payloads name no dataset of the hub."""
    parsed = raw.select(F.from_json(payload, IDENTITY[provider][1]).alias("p"))
    return parsed.agg(F.count_if(~_named(provider)).alias("payloads")).select(F.lit(provider).alias("provider"), "payloads")


def normalize_hf(raw: DataFrame, payload: str = "payload") -> DataFrame:
    df = _parsed(raw, "huggingface", payload).select("p.*", "raw")
    df = df.withColumns(
        {
            "id": F.coalesce("id", F.lit("")),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "downloads": F.coalesce("downloads", F.lit(0)),
            "likes": F.coalesce("likes", F.lit(0)),
        }
    )

    def tagged(prefix: str) -> Column:
        last = F.try_element_at(F.filter("tags", lambda t: t.startswith(prefix)), F.lit(-1))
        return F.coalesce(F.replace(last, F.lit(prefix), F.lit("")), F.lit("Unknown"))

    df = df.withColumns({"task": tagged("task_categories:"), "license": tagged("license:")})
    return _catalog_row(
        df,
        id=F.concat(F.lit("hf/"), "id"),
        name=F.element_at(F.split("id", "/"), -1),
        provider=F.lit("huggingface"),
        task=F.col("task"),
        license=F.col("license"),
        last_updated=F.coalesce("lastModified", F.lit("Unknown")),
        downloads=F.col("downloads"),
        popularity=F.least(F.lit(100.0), F.log1p("downloads") * 5 + F.col("likes") * 0.5),
        quality_score=_points(
            30.0,
            (_present(F.col("description")), 20.0),
            (F.col("license") != "Unknown", 20.0),
            (F.col("task") != "Unknown", 15.0),
            (F.size("tags") > 5, 15.0),
        ),
        description=F.coalesce("description", F.lit("")),
        source_url=F.concat(F.lit("https://huggingface.co/datasets/"), "id"),
        tags=F.col("tags"),
        raw_metadata=F.col("raw"),
    )


def normalize_openml(raw: DataFrame, payload: str = "payload") -> DataFrame:
    df = _parsed(raw, "openml", payload).select("p.*", "raw")

    def quality(name: str) -> Column:
        """Last usable value of that name, truncated to a whole number."""
        usable = F.filter(
            "quality",
            lambda q: (q["name"] == name) & q["value"].try_cast("double").try_cast("bigint").isNotNull(),
        )
        last = F.try_element_at(usable, F.lit(-1))
        return last["value"].try_cast("double").try_cast("bigint")

    df = df.withColumns(
        {
            "n_rows": quality("NumberOfInstances"),
            "n_cols": quality("NumberOfFeatures"),
            "n_classes": quality("NumberOfClasses"),
            "name": F.coalesce("name", F.lit("Unknown")),
            "format": F.upper(F.coalesce("format", F.lit("ARFF"))),
        }
    )
    df = df.withColumn(
        "task",
        F.when(F.col("n_classes") > 2, "Multi-class Classification")
        .when(F.col("n_classes") == 2, "Binary Classification")
        .when(F.col("n_classes").isin(0, 1), "Regression / Clustering")
        .otherwise("Tabular"),
    )
    shaped = F.coalesce((F.col("n_rows") != 0) & (F.col("n_cols") != 0), F.lit(False))
    did = F.coalesce(F.col("did").cast("string"), F.lit("None"))
    shape_text = F.when(
        shaped,
        F.format_string("Contains %d instances and %d features. ", "n_rows", "n_cols"),
    ).otherwise("")
    return _catalog_row(
        df,
        id=F.concat(F.lit("openml/"), did),
        name=F.col("name"),
        provider=F.lit("openml"),
        task=F.col("task"),
        rows=F.col("n_rows"),
        columns=F.col("n_cols"),
        license=F.lit("Public / CC Attribution"),
        popularity=F.when(F.col("did") < 100, 90.0)
        .when(F.col("did") < 1000, 75.0)
        .when(F.col("did") < 10000, 60.0)
        .otherwise(50.0),
        quality_score=_points(60.0, (shaped, 20.0), (F.col("n_classes").isNotNull(), 10.0)),
        description=F.concat(
            F.lit("OpenML standard dataset '"),
            "name",
            F.lit("' (version "),
            F.coalesce("version", F.lit("1")),
            F.lit("). "),
            shape_text,
            F.lit("Format: "),
            "format",
            F.lit("."),
        ),
        data_url=F.when(
            _present(F.col("file_id")) & (F.col("file_id") != "0"),
            F.concat(F.lit("https://www.openml.org/data/v1/download/"), "file_id"),
        ),
        source_url=F.concat(F.lit("https://www.openml.org/d/"), did),
        tags=F.array("format", "task"),
        raw_metadata=F.col("raw"),
    )


def normalize_uci(
    raw: DataFrame, payload: str = "payload", popular: Sequence[str] = tuple(POPULAR_DATASETS)
) -> DataFrame:
    df = _parsed(raw, "uci", payload).where(F.col("p.status") == 200).select("p.data.*", "raw")
    number = F.coalesce(F.col("uci_id").cast("string"), F.lit("None"))
    df = df.withColumns(
        {
            "name": F.coalesce("name", F.lit("Unknown")),
            "task": F.coalesce(F.get("tasks", F.lit(0)), F.lit("Tabular")),
        }
    )
    area = F.when(_present(F.col("area")), F.array("area")).otherwise(F.array().cast("array<string>"))
    return _catalog_row(
        df,
        id=F.concat(F.lit("uci/"), number),
        name=F.col("name"),
        provider=F.lit("uci"),
        task=F.col("task"),
        rows=F.col("num_instances"),
        columns=F.col("num_features"),
        license=F.lit("Creative Commons Attribution 4.0 International (CC BY 4.0)"),
        last_updated=F.coalesce("last_updated", F.lit("Unknown")),
        popularity=F.when(F.lower("name").isin(list(popular)), 85.0).otherwise(60.0),
        quality_score=_points(
            70.0,
            (F.size(F.coalesce("variables", F.array())) > 0, 15.0),
            (F.coalesce(F.col("has_missing_values") != "unknown", F.lit(True)), 15.0),
        ),
        description=F.when(_present(F.col("abstract")), F.col("abstract")).otherwise(
            F.concat(F.lit("UCI Machine Learning Repository dataset: "), "name", F.lit("."))
        ),
        data_url=F.col("data_url"),
        source_url=F.when(_present(F.col("repository_url")), F.col("repository_url")).otherwise(
            F.concat(F.lit("https://archive.ics.uci.edu/dataset/"), number)
        ),
        tags=F.concat(
            F.array("task"), area, F.coalesce("characteristics", F.array().cast("array<string>"))
        ),
        raw_metadata=F.col("raw"),
    )


def normalize_github(raw: DataFrame, payload: str = "payload") -> DataFrame:
    df = _parsed(raw, "github", payload).select("p.*", "raw")
    df = df.withColumns(
        {
            "full_name": F.coalesce("full_name", F.lit("")),
            "name": F.coalesce("name", F.lit("")),
            "stars": F.coalesce("stargazers_count", F.lit(0)),
        }
    )
    described = _present(F.col("description"))
    repo = F.concat(F.lit("https://github.com/"), "full_name")
    return _catalog_row(
        df,
        id=F.concat(F.lit("github/"), "full_name"),
        name=F.col("name"),
        provider=F.lit("github"),
        task=F.lit("General / Git Repo"),
        size_bytes=F.coalesce("size", F.lit(0)) * 1024,
        license=F.coalesce("license.name", F.lit("Unknown")),
        last_updated=F.coalesce("updated_at", F.lit("Unknown")),
        downloads=F.col("stars"),
        popularity=F.when(
            F.col("stars") > 0, F.least(F.lit(100.0), F.col("stars") / 100.0 + 10.0)
        ).otherwise(10.0),
        quality_score=_points(
            40.0,
            (described, 20.0),
            (F.coalesce("has_wiki", F.lit(False)), 10.0),
            (F.col("license").isNotNull(), 20.0),
        ),
        description=F.when(described, F.col("description")).otherwise(
            F.concat(F.lit("GitHub dataset repository by "), F.coalesce("owner.login", F.lit("")), F.lit("."))
        ),
        data_url=F.concat(
            repo, F.lit("/archive/refs/heads/"), F.coalesce("default_branch", F.lit("main")), F.lit(".zip")
        ),
        source_url=F.coalesce("html_url", repo),
        tags=F.array(F.lit("github-repository"), F.lit("dataset")),
        raw_metadata=F.col("raw"),
    )


def normalize_kaggle(raw: DataFrame, payload: str = "payload") -> DataFrame:
    df = _parsed(raw, "kaggle", payload).select("p.*", "raw")
    df = df.withColumn("downloads", F.coalesce("downloadCount", F.lit(0)))
    return _catalog_row(
        df,
        id=F.concat(F.lit("kaggle/"), "ref"),
        name=F.coalesce("title", F.lit("")),
        provider=F.lit("kaggle"),
        task=F.lit("Kaggle Dataset"),
        size_bytes=text.parse_size(F.coalesce("size", F.lit("0 B"))),
        license=F.coalesce("licenseName", F.lit("Unknown")),
        last_updated=F.coalesce("lastUpdated", F.lit("Unknown")),
        downloads=F.col("downloads"),
        popularity=F.when(
            F.col("downloads") != 0, F.least(F.lit(100.0), F.col("downloads") / 1000.0 + 10.0)
        ).otherwise(10.0),
        quality_score=F.coalesce("usabilityRating", F.lit(0.0)) * 10.0,
        description=F.coalesce("description", F.concat(F.lit("Kaggle dataset: "), "ref")),
        data_url=F.col("ref"),
        source_url=F.concat(F.lit("https://www.kaggle.com/datasets/"), "ref"),
        tags=F.array(F.lit("kaggle")),
        raw_metadata=F.col("raw"),
    )


def build_catalog(*parts: DataFrame | None, enabled: Sequence[str] | None = tuple(PROVIDERS)) -> DataFrame:
    """All enabled providers' rows (``None``: every provider's); an absent one contributes nothing."""
    present = [p for p in parts if p is not None]
    if not present:
        raise ValueError("build_catalog needs at least one provider table")
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)
    return merged if enabled is None else merged.where(F.col("provider").isin(list(enabled)))


def public_view(cat: DataFrame) -> DataFrame:
    return cat.select(*PUBLIC_COLUMNS)


def card_view(cat: DataFrame) -> DataFrame:
    """Display columns of a catalog record."""
    rows = F.coalesce(F.format_number("rows", 0), F.lit("?"))
    cols = F.coalesce(F.col("columns").cast("string"), F.lit("?"))
    return cat.select(
        "id",
        F.upper("provider").alias("provider"),
        "task",
        F.concat(rows, F.lit(" rows x "), cols, F.lit(" cols")).alias("shape"),
        text.format_size(F.col("size_bytes")).alias("size"),
        "license",
        F.substring("last_updated", 1, 10).alias("updated"),
        text.band(F.col("popularity")).alias("popularity_band"),
        text.band(F.col("quality_score")).alias("quality_band"),
        text.card_description(F.col("description"), F.col("name")).alias("summary"),
        F.array_join(F.slice("tags", 1, 5), ", ").alias("tag_text"),
    )
