"""Jobs over many files: detection, selection, sizes and checksums."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datascout.operators.groups import heavy_keys, spread_join
from datascout.operators.groups import top_n_per_group

# Delimiters in order of preference, and their display names.
DELIMITERS = {",": "Comma", ";": "Semicolon", "\t": "Tab", "|": "Pipe"}
DETECTED_EXTENSIONS = [".csv", ".tsv", ".txt"]
DATA_EXTENSIONS = [".csv", ".parquet", ".json", ".arff"]
REPO_EXTENSIONS = [".csv", ".parquet", ".json", ".tsv"]
SKIPPED_EXTENSIONS = [".md", ".txt", ".gitattributes"]
BINARY_EXTENSIONS = [".parquet"]


def text_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(path, block, line_id, value)`` of every line; (block, line_id) is its place in the file."""
    return spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
        "value",
    )


def list_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(path, size)`` of every file below ``path``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.col("length").alias("size"))
    )


def _ends_with(path: Column, endings: Sequence[str]) -> Column:
    out = F.lit(False)
    for ending in endings:
        out = out | path.endswith(ending)
    return out


HEAD_LINES = 5


def _first_lines(batches):
    """The first lines of each (path, block) that the task reads; their order is that of the scan."""
    taken: dict[tuple[str, int], int] = {}
    for batch in batches:
        kept = []
        for i, key in enumerate(zip(batch.column("path").to_pylist(), batch.column("block").to_pylist())):
            n = taken.get(key, 0)
            if n < HEAD_LINES:
                taken[key] = n + 1
                kept.append(i)
        yield batch.take(pa.array(kept, pa.int64()))


def detect_delimiter(lines: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """``(path, delimiter, delimiter_name)`` from the first five lines of each file.

    Each task passes on at most five lines of a file's block, and only those are ordered. Files that
    are not delimited text report a comma, and so do those of ``listing`` (path) without lines.
    """
    lines = lines.select("path", "block", "line_id", "value")
    head = top_n_per_group(lines.mapInArrow(_first_lines, lines.schema), ["path"], [F.col("block"), F.col("line_id")], HEAD_LINES)
    counts = [
        F.sum(F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))).alias(f"n{i}")
        for i, d in enumerate(DELIMITERS)
    ]
    totals = head.groupBy("path").agg(*counts)
    columns = [F.col(f"n{i}") for i in range(len(DELIMITERS))]
    most = F.greatest(*columns)
    best = F.lit(",")
    for d, n in reversed(list(zip(DELIMITERS, columns))):
        best = F.when(n == most, d).otherwise(best)
    usable = (most > 0) & _ends_with(F.lower("path"), DETECTED_EXTENSIONS)
    delimiter = F.when(usable, best).otherwise(",")
    if listing is not None:
        totals = listing.select("path").distinct().join(totals, "path", "left")
    return totals.select("path", delimiter.alias("delimiter"), delimiter_name(delimiter).alias("delimiter_name"))


def delimiter_name(delimiter: Column) -> Column:
    return F.coalesce(*[F.when(delimiter == d, name) for d, name in DELIMITERS.items()])


def detect_encoding(lines: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """``(path, encoding)``: utf-8 if every line of the file is valid UTF-8, else latin-1.

    No UTF-8 sequence spans a line break, so the lines of a file are checked where they lie
    and only one flag per task and file is shuffled. Binary formats have no encoding; files of
    ``listing`` (path) without lines are utf-8.
    """
    valid = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("valid"))
    if listing is not None:
        valid = listing.select("path").distinct().join(valid, "path", "left")
    encoding = F.when(F.coalesce("valid", F.lit(True)), "utf-8").otherwise("latin-1")
    return valid.select(
        "path", F.when(~_ends_with(F.lower("path"), BINARY_EXTENSIONS), encoding).alias("encoding")
    )


def file_names(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(path, uri)`` of every file, empty ones included, with paths written as in ``text_lines``. Spark
    lists files on the driver anyway; its scans leave empty files out."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles()
    rows = [(f"file:/{f[8:]}" if f.startswith("file:///") else f, f) for f in sorted(listed)]
    return spark.createDataFrame(rows, "path string, uri string")


def detect_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(path, delimiter, delimiter_name, encoding)`` of every file below ``path``."""
    lines, listing = text_lines(spark, path), file_names(spark, path)
    return detect_delimiter(lines, listing).join(detect_encoding(lines, listing), "path")


def pick_data_file(files: DataFrame) -> DataFrame:
    """First data file of each dataset: ``(dataset_id, path)``."""
    return (
        files.where(_ends_with(F.col("path"), DATA_EXTENSIONS))
        .groupBy("dataset_id")
        .agg(F.min("path").alias("path"))
    )


def path_sizes(files: DataFrame) -> DataFrame:
    """Total bytes of each dataset's files: ``(dataset_id, size_bytes)``."""
    return files.groupBy("dataset_id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"))


def file_digests(spark: SparkSession, path: str | Sequence[str], schemes: dict[str, str] | None = None) -> DataFrame:
    """``(path, sha256)`` of every file, each read in pieces so that memory stays constant.

    A digest is sequential: a file is one row of one task, and files are spread over all tasks.
    ``schemes`` renames schemes of paths to those that Arrow's file systems know. Paths are written
    as Spark's own listing of files writes them.
    """
    renamed = {"s3a": "s3", "s3n": "s3"} | (schemes or {})
    plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    listed = file_names(spark, path).select(plain.alias("path"), "uri")

    def digest(batches):
        for batch in batches:
            found = []
            for uri in batch.column("uri").to_pylist():
                scheme, _, rest = uri.partition(":")
                system, inner = fs.FileSystem.from_uri(f"{renamed.get(scheme, scheme)}:{rest}")
                total = hashlib.sha256()
                with system.open_input_stream(inner) as stream:
                    while piece := stream.read(1 << 20):
                        total.update(piece)
                found.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], ["path", "sha256"])

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(spread, "path").mapInArrow(digest, "path string, sha256 string")


def verify_checksums(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(path, status)`` for each manifest entry ``(path, expected_sha256)``: ok, mismatch or missing."""
    found = manifest.join(digests, "path", "left")
    status = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.lower("sha256") == F.lower("expected_sha256"), "ok")
        .otherwise("mismatch")
    )
    return found.select("path", status.alias("status"))


def _with_totals(files: DataFrame, totals: DataFrame) -> DataFrame:
    """Files with the totals of their dataset; one with very many files stays spread over the tasks."""
    return spread_join(files, totals, ["dataset_id"], heavy_keys(totals, ["dataset_id"], "n_files"))


def select_hub_files(listing: DataFrame) -> DataFrame:
    """Data files of each hub dataset; all its files where none looks like data.

    ``listing`` holds ``dataset_id, type, path, size``. ``total_size`` is that of the selection.
    """
    files = listing.where(F.col("type") == "file")
    is_data = ~F.col("path").startswith(".") & ~_ends_with(F.lower("path"), SKIPPED_EXTENSIONS)
    files = files.withColumn("is_data", is_data)
    # Totals are folded per task before the shuffle; a dataset with many files stays spread out.
    size = F.coalesce("size", F.lit(0))
    totals = files.groupBy("dataset_id").agg(
        F.count("*").alias("n_files"),
        F.bool_or("is_data").alias("any_data"),
        F.sum(F.when(F.col("is_data"), size)).alias("data_size"),
        F.sum(size).alias("all_size"),
    )
    chosen = _with_totals(files, totals).where(F.col("is_data") | ~F.col("any_data"))
    total = F.when(F.col("any_data"), F.col("data_size")).otherwise(F.col("all_size"))
    return chosen.select("dataset_id", "path", "size", total.alias("total_size"))


def select_repo_files(listing: DataFrame, cat: DataFrame) -> DataFrame:
    """Files to fetch for each repository dataset; its archive where no file is tabular data.

    ``listing`` holds ``dataset_id, type, path, size, download_url``; the archive address comes
    from the catalog.
    """
    files = listing.where((F.col("type") == "file") & _ends_with(F.lower("path"), REPO_EXTENSIONS))
    totals = files.groupBy("dataset_id").agg(
        F.count("*").alias("n_files"), F.sum(F.coalesce("size", F.lit(0))).alias("total_size")
    )
    chosen = _with_totals(files, totals).select(
        "dataset_id", "path", F.col("download_url").alias("url"), "size", "total_size"
    )
    archives = (
        cat.select(F.col("id").alias("dataset_id"), "name", "data_url")
        .join(totals, "dataset_id", "left_anti")
        .select(
            "dataset_id",
            F.concat("name", F.lit(".zip")).alias("path"),
            F.col("data_url").alias("url"),
            F.lit(None).cast("bigint").alias("size"),
            F.lit(None).cast("bigint").alias("total_size"),
        )
    )
    return chosen.unionByName(archives)
