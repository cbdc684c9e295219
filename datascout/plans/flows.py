"""The three entry points as single plans: search, inspect, filter."""

from __future__ import annotations

import os
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datascout.operators.advice import model_findings, preprocess_findings, profile_digest
from datascout.operators.catalog import PROVIDERS, build_catalog
from datascout.operators.filters import filter_catalog, merge_conditions, with_conditions
from datascout.operators.ledger import ledger_as_catalog, recent_queries
from datascout.operators.prep import features_and_target
from datascout.operators.profile import profile
from datascout.operators.search import dedupe, limit_per_provider, resolve, scored, search_local
from datascout.runtime import written
from datascout.sources.files import detect_files, file_names, pick_data_file
from datascout.sources.readers import count_records, read_table
from datascout.schema import PUBLIC_COLUMNS, ident

CONDITION_ARGUMENTS = ["task", "size_cond", "rows_cond", "license_type"]


def search_datasets(
    providers: list[DataFrame],
    query: str,
    limit: int = 10,
    per_provider: int | None = None,
    enabled: Sequence[str] | None = tuple(PROVIDERS),
    ledger: DataFrame | None = None,
    **conditions: str | None,
) -> DataFrame:
    """Union, deduplicate, score, filter, rank, limit: in that order, since a filter before
    the deduplication would change which record stands for a name.

    Without providers (offline) the downloads of ``ledger`` whose name holds the query are filtered,
    each with score 100; without a ledger either, ValueError."""
    if not providers:
        if ledger is None:
            raise ValueError("neither providers nor a ledger to search")
        hits = ledger_as_catalog(search_local(ledger, query).drop("score"))
    else:
        cat = build_catalog(*providers, enabled=enabled)
        if per_provider:
            cat = limit_per_provider(cat, per_provider)
        hits = scored(dedupe(cat), query)
    return filter_catalog(hits, **conditions).orderBy(F.col("score").desc(), "id").limit(limit)


def search_session(spark: SparkSession, home: str, providers: list[DataFrame], query: str, ts: float, **options) -> DataFrame:
    """``search_datasets``, with the query added to the history and the hits to the saved records.

    Both are folders below ``home`` that only grow: ``saved_history`` and ``saved_hits`` read the
    latest of each. A query without hits is history too; a lost writer leaves no part of a write.
    """
    spark.createDataFrame([(query, float(ts))], "query string, ts double").write.mode("append").parquet(f"{home}/history")
    hits = written(search_datasets(providers, query, **options), "hits")
    if not hits.isEmpty():
        kept = hits.select(*[ident(c) for c in PUBLIC_COLUMNS if c in hits.columns], F.lit(float(ts)).alias("saved_at"))
        kept.write.mode("append").parquet(f"{home}/hits")
    return hits.orderBy(F.col("score").desc(), "id")


def saved_history(spark: SparkSession, home: str) -> DataFrame:
    """``recent_queries`` of all sessions below ``home``."""
    return recent_queries(spark.read.parquet(f"{home}/history"))


def saved_hits(spark: SparkSession, home: str) -> DataFrame:
    """The latest record of each id that a session below ``home`` found."""
    found = spark.read.option("mergeSchema", True).parquet(f"{home}/hits")
    row = F.struct(*[ident(c) for c in found.columns if c != "saved_at"])
    return found.groupBy("id").agg(F.max_by(row, "saved_at").alias("r")).select("r.*")


def source_file(spark: SparkSession, source: str, ledger: DataFrame) -> str | None:
    """The data file that ``source`` means: a path that exists, or the first data file of the download
    with that id or name (any case; the first by ``pos``). None where there is none."""
    if _files_of(spark, source):
        return _first_data_file(spark, source)
    hit = resolve(spark.createDataFrame([(source,)], "source string"), ledger).select("local_path").first()
    return _first_data_file(spark, hit["local_path"]) if hit and hit["local_path"] else None


def _files_of(spark: SparkSession, path: str) -> list[str]:
    try:
        return [r["uri"] for r in file_names(spark, path).collect()]  # one download's files
    except AnalysisException:  # no such path
        return []


def _first_data_file(spark: SparkSession, path: str) -> str | None:
    files = _files_of(spark, path)
    if len(files) == 1:
        return unquote(files[0])  # a file named as such need not look like data
    listed = spark.createDataFrame([("", f) for f in files], "dataset_id string, path string")
    picked = pick_data_file(listed).first()
    return unquote(picked["path"]) if picked else None


def work_on(spark: SparkSession, source: str, ledger: DataFrame, approx: bool = False) -> dict[str, DataFrame]:
    """From a source to what is known of it: the tables of ``inspect_file``, ``digest`` (one row for an
    assistant), ``findings`` and ``models`` (advice), and ``training`` (features and target).

    Of a source without a data file, ``file`` with the error is the only table; so with a file that
    cannot be read or holds no rows.
    """
    path = source_file(spark, source, ledger)
    if path is None:
        facts = "filename string, encoding string, delimiter string, error string"
        return {"file": spark.createDataFrame([(None, None, None, f"no data file for {source}")], facts)}
    report = inspect_file(spark, path, approx)
    if "table" not in report or report["table"].first()["error"]:
        return report
    facts = report["file"].first()
    df = read_table(spark, path)
    best = report["target_candidates"].orderBy(F.col("score").desc()).first()
    return report | {
        "digest": profile_digest(df, facts["filename"]),
        "findings": preprocess_findings(df, facts["encoding"], facts["delimiter"]),
        "models": model_findings(df),
        "training": features_and_target(df, best["column"] if best else "target"),
    }


def inspect_file(spark: SparkSession, path: str, approx: bool = False, **options) -> dict[str, DataFrame]:
    """The profile of one file, and ``file``: filename, encoding, delimiter and, for a file that
    cannot be read, the error; that is then the only table."""
    found = detect_files(spark, path).orderBy("path").first()
    report: dict[str, DataFrame] = {}
    error = None
    try:
        report = profile(read_table(spark, path, **options), approx)
    except (AnalysisException, SparkRuntimeException, ValueError) as e:
        error = str(e).splitlines()[0]
    facts = (os.path.basename(path.rstrip("/")), found and found["encoding"], found and found["delimiter_name"], error)
    return report | {"file": spark.createDataFrame([facts], "filename string, encoding string, delimiter string, error string")}


def inspect_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, delimiter, encoding, rows, columns, error)`` of every delimited file below ``path``.

    Files of one delimiter are read together, each in splits, whatever their headers; quoted values may
    hold line breaks. An empty file has the error of an empty table.
    """
    found = written(detect_files(spark, path), "files")
    counted = spark.createDataFrame([], "path string, rows bigint, columns bigint")
    for (delimiter,) in found.select("delimiter").distinct().collect():  # at most four
        same = found.where(F.col("delimiter") == delimiter).join(file_names(spark, path), "path")
        paths = [unquote(r["uri"]) for r in same.select("uri").collect()]  # the reader takes the list of files
        counted = counted.unionByName(count_records(spark, paths, delimiter))
    out = found.join(counted, "path", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return out.select(
        "path", F.col("delimiter_name").alias("delimiter"), "encoding", "rows", F.coalesce("columns", F.lit(0)).alias("columns"),
        F.when(F.col("rows") == 0, "Dataset is empty.").alias("error"),
    )


# What is searched for, and how much a provider gives, where nothing is downloaded.
FALLBACK_QUERY, FALLBACK_LIMIT = "data", 20


def filter_ledger(
    ledger: DataFrame, text: str | None = None, providers: list[DataFrame] | None = None, **explicit: str
) -> DataFrame:
    """Downloaded datasets that pass a plain-language request; what it says wins over ``explicit``.

    Where nothing is downloaded and there are ``providers``, their records found by a general search
    are filtered instead."""
    hits = ledger_as_catalog(ledger)
    if providers and ledger.isEmpty():
        hits = scored(dedupe(limit_per_provider(build_catalog(*providers), FALLBACK_LIMIT)), FALLBACK_QUERY)
    conditions = {k: v for k, v in explicit.items() if v is not None}
    if text:
        request = ledger.sparkSession.createDataFrame([(text,)], "query string")
        parsed = merge_conditions(with_conditions(request), conditions).first()
        conditions |= {c: parsed[c] for c in CONDITION_ARGUMENTS}
    return filter_catalog(hits, **conditions)
