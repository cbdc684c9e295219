"""Tabular files to DataFrames."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascout.schema import NA_TOKENS, ident
from datascout.runtime import scratch_path, written
from datascout.sources.files import detect_files, text_lines
from datascout.sources.records import ArrayElements, QuotedLines, block_states, split_records, text_units

#: Names of the detected encodings as Spark's reader knows them.
CHARSETS = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}

INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITE = r"^\s*[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
BOOLEANS = ["true", "True", "TRUE", "false", "False", "FALSE"]
OVERFLOW = "__overflow"
#: Encodings in which quotes, delimiters and line breaks are the bytes of ASCII, and no other character holds them.
ASCII_LIKE = {"utf-8", "us-ascii", "iso-8859-1", "iso-8859-15", "windows-1252"}


def _fits(c: Column) -> list[Column]:
    """Counts that decide a text column's type."""
    integer = F.coalesce(c.rlike(INTEGER) & F.trim(c).try_cast("bigint").isNotNull(), F.lit(False))
    number = F.coalesce(c.rlike(DECIMAL) | c.rlike(INFINITE), F.lit(False))
    return [F.count(c), F.count_if(integer), F.count_if(number), F.count_if(c.isin(BOOLEANS)), F.count("*")]


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns to bigint, double or boolean where every value allows it.

    Missing-value tokens become NULL first. One aggregate decides all columns. Booleans need a
    column without missing values; an all-missing column becomes double.
    """
    overflow = OVERFLOW in df.columns
    names = [c for c in df.columns if c != OVERFLOW]
    clean = df.select(
        *[F.when(~ident(c).isin(NA_TOKENS), ident(c)).alias(c) for c in names],
        *([F.col(OVERFLOW)] if overflow else []),
    )
    checks = [check for c in names for check in _fits(ident(c))]
    counts = clean.agg(F.count(F.col(OVERFLOW)) if overflow else F.lit(0), *checks).first()
    if counts[0]:
        raise ValueError(f"{counts[0]} lines have more fields than the header")
    out = []
    for i, name in enumerate(names):
        present, integers, numbers, booleans, total = counts[1 + 5 * i : 6 + 5 * i]
        c = ident(name)
        if present and integers == present and present == total:
            c = F.trim(c).cast("bigint")
        elif numbers == present:
            infinite = F.when(F.contains(c, F.lit("-")), float("-inf")).otherwise(float("inf"))
            c = F.when(c.rlike(INFINITE), infinite).otherwise(F.trim(c).try_cast("double"))
            if present and integers == present:
                # A whole-number column with gaps keeps whole numbers.
                c = F.trim(ident(name)).cast("bigint")
        elif booleans == present == total:
            c = F.lower(c).cast("boolean")
        out.append(c.alias(name))
    return clean.select(*out)


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ",",
    encoding: str = "UTF-8",
    infer: bool = True,
    multiline: bool = True,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Delimited text with a header line. Short lines are padded with NULL, longer ones raise.

    Quoted values may hold line breaks; a scan finds out whether they do and where records end, so
    that large files are split in either case (see `records`). ``multiline=False`` says that they do not,
    which saves that scan. Encodings that are not like ASCII (UTF-16) are read by one task a file.
    With ``schema`` the values are read as those types in one scan, missing-value tokens as NULL;
    otherwise a first scan infers them.
    """
    if multiline and encoding.lower() in ASCII_LIKE:
        raw = _raw_records(spark, path, sep, encoding)
    else:
        raw = _raw(spark, path, sep, encoding, multiLine=multiline)
    if schema is not None:
        return _typed(raw.drop(OVERFLOW), schema)
    return infer_types(raw) if infer else raw.drop(OVERFLOW)


def _raw(spark: SparkSession, path: str | Sequence[str], sep: str, encoding: str, **more) -> DataFrame:
    """Delimited text as strings, with OVERFLOW for what exceeds the header."""
    options = {"sep": sep, "encoding": encoding, "quote": '"', "escape": '"', **more}
    header = spark.read.options(**options, header=True).csv(path)  # reads the first record only
    names = header.columns
    texts = T.StructType([T.StructField(c, T.StringType()) for c in [*names, OVERFLOW]])
    return spark.read.options(**options, header=True, enforceSchema=True, mode="PERMISSIVE").schema(texts).csv(path)


def _raw_records(spark: SparkSession, path: str | Sequence[str], sep: str, encoding: str, **more) -> DataFrame:
    """As `_raw`, of files whose quoted values may hold line breaks, in splits."""
    kind = QuotedLines(sep.encode(encoding))
    states = written(block_states(text_units(spark, path, kind.separator), kind), "states")
    if states.where(~F.col("closed")).limit(1).count() == 0:
        return _raw(spark, path, sep, encoding, multiLine=False, **more)
    plain = _raw(spark, path, sep, encoding, multiLine=True, **more)
    if len(spark.read.text(path).columns) > 1:
        return plain  # folders named key=value are columns, which records do not have
    records = split_records(spark, path, kind, states).where(~F.col("first")).withColumn("text", F.decode("value", encoding))
    # In files of CR LF, both end a record, and a line break in a value is read as LF alone.
    whole = F.when(F.col("text").endswith("\r"), F.replace(F.expr("substring(text, 1, length(text) - 1)"), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    fields = ", ".join("`" + c.replace("`", "``") + "` string" for c in plain.columns)
    parsed = F.from_csv("text", fields, {"sep": sep, "quote": '"', "escape": '"'})
    return records.withColumn("text", whole).where("text != ''").select(parsed.alias("r")).select("r.*")


def count_records(spark: SparkSession, path: str | Sequence[str], sep: str) -> DataFrame:
    """``(path, rows, columns)`` of delimited files of one delimiter and an encoding like ASCII, whatever their
    headers: records without the header and empty lines, and the fields of the header."""
    records = split_records(spark, path, QuotedLines(sep.encode()))
    filled = ~F.col("first") & ~F.decode("value", "ISO-8859-1").isin("", "\r")
    header = F.max(F.when(F.col("first"), F.decode("value", "ISO-8859-1")))
    found = records.groupBy("path").agg(F.count_if(filled).alias("rows"), header.alias("header"))
    # A delimiter counts if the quotes before it are closed: quoted values become empty first.
    bare = F.regexp_replace("header", '"(?:[^"]|"")*+"', "")
    return found.select("path", "rows", (1 + F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))).cast("bigint").alias("columns"))


def _read_detected(spark: SparkSession, path: str, sep: str | None, encoding: str | None) -> DataFrame:
    """Delimited text below ``path``: files of one delimiter, encoding and header line are read
    together, the columns of all are matched by name, and types are inferred over all rows."""
    first = F.min_by("value", F.struct("block", "line_id"))
    headers = text_lines(spark, path).groupBy("path").agg(F.md5(first).alias("header"))
    plain = spark.read.text(path)
    listed = {f"file:/{f[8:]}" if f.startswith("file:///") else f for f in plain.inputFiles()}
    found = detect_files(spark, path).join(headers, "path", "left").orderBy("path").collect()  # one row a file, of those that the driver lists
    kinds: dict[tuple, list[str]] = {}
    for r in found:
        if r["path"] in listed and r["header"] is not None:  # empty files have no rows
            kinds.setdefault((sep or r["delimiter"], encoding or r["encoding"], r["header"]), []).append(unquote(r["path"]))
    if len(kinds) <= 1:
        told = next(iter(kinds), (sep or ",", encoding or "utf-8"))
        return read_delimited(spark, path, sep=told[0], encoding=CHARSETS.get(told[1], told[1]))
    base = {"basePath": path} if len(plain.columns) > 1 else {}  # folders named key=value are columns
    parts = [_raw(spark, paths, s, CHARSETS.get(e, e), multiLine=True, **base) for (s, e, _), paths in kinds.items()]
    return infer_types(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def _typed(raw: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The columns of ``schema`` by place, values that are no such type as NULL."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if len(wanted) != len(raw.columns):
        raise ValueError(f"the schema has {len(wanted)} columns, the file {len(raw.columns)}")
    return raw.select(
        *[
            F.when(~ident(c).isin(NA_TOKENS), ident(c)).try_cast(f.dataType).alias(f.name)
            for c, f in zip(raw.columns, wanted)
        ]
    )


def read_tsv(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8", multiline: bool = True) -> DataFrame:
    """``.tsv`` and ``.txt`` are tab-separated, whatever a detector says."""
    return read_delimited(spark, path, sep="\t", encoding=encoding, multiline=multiline)


def read_json_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.json(path)


def read_json_doc(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One document per file: an array of records, or columns ``{column: {row: value}}``.

    Arrays are cut into their records by many tasks (see `records`) if the files hold nothing else, and the
    types follow from all records. Files of columns are read by one task each.
    """
    units = text_units(spark, path, "}").withColumn("place", F.struct("block", F.monotonically_increasing_id()))
    starts = units.groupBy("path").agg(F.min_by("value", "place").alias("start"))
    first = F.substring(F.regexp_replace(F.decode("start", "UTF-8"), r"^\s+", ""), 1, 1)
    if not starts.where(~first.isin("[", "")).limit(1).count():
        return _read_json_arrays(spark, path)
    texts = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.ltrim("value").alias("value")
    )
    cells = F.from_json("value", "map<string, map<string, string>>")
    columns = (
        texts.where(F.col("value").startswith("{"))
        .select(F.posexplode(F.map_keys(cells)).alias("pos", "name"))
        .groupBy("name")
        .agg(F.min("pos").alias("pos"))
        .orderBy("pos", "name")
        .collect()  # one row for each column of the documents
    )
    if not columns:
        return spark.read.option("multiLine", True).json(path)
    names = [r["name"] for r in columns]
    # The row labels are data, so the cells are read as maps and turned into rows.
    long = (
        texts.select("file", F.explode(cells).alias("c", "by_row"))
        .select("file", "c", F.explode("by_row").alias("r", "v"))
    )
    wide = long.groupBy("file", "r").pivot("c", names).agg(F.first("v"))
    return infer_types(wide.drop("file", "r"))


def _read_json_arrays(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The objects of arrays, one array a file. Elements that are no objects hold no record; an array
    whose elements they are has none."""
    text = F.regexp_replace(F.decode("value", "UTF-8"), r"^[\s\[,]+", "")
    records = split_records(spark, path, ArrayElements()).select(F.concat(text, F.lit("}")).alias("value")).where(F.col("value").startswith("{"))
    # A line each: raw line breaks are white space in JSON, never part of a string.
    lines = scratch_path(spark, "records")
    records.select(F.translate("value", "\r\n", "  ").alias("value")).write.text(lines)
    return spark.read.json(lines)


def read_arff(spark: SparkSession, path: str | Sequence[str], legacy: bool = False) -> DataFrame:
    """Attribute-relation files: declared names, comma-separated rows, types inferred.

    Every file has its own header; the names of the first one hold for all. ``?`` is missing
    and quoted names are read whole, unless ``legacy``.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.trim(F.col("value")).alias("line"), place.alias("at")
    )
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("%"))
    starts = lines.where(F.lower("line").startswith("@data")).groupBy("file").agg(F.min("at").alias("start"))
    placed = lines.join(F.broadcast(starts), "file")  # one row a file, of those that the driver lists
    declared = placed.where(F.lower("line").startswith("@attribute") & (F.col("at") < F.col("start")))
    first_file = starts.agg(F.min("file").alias("file"))
    rows = declared.join(first_file, "file", "left_semi").orderBy("at").collect()  # one per column
    names = [n for n in (_attribute_name(r["line"], legacy) for r in rows) if n]
    if not names:
        raise ValueError(f"no attributes before @data in {path}")
    fields = ", ".join(f"`{c}` string" for c in [*names, OVERFLOW])
    options = {"quote": '"' if legacy else "'", "escape": "\\", "ignoreLeadingWhiteSpace": "true"}
    data = placed.where(F.col("at") > F.col("start")).select(F.from_csv("line", fields, options).alias("r"))
    data = data.select("r.*")
    if not legacy:
        data = data.select(*[F.when(ident(c) != "?", ident(c)).alias(c) for c in data.columns])
    return infer_types(data)


def _attribute_name(line: str, legacy: bool) -> str | None:
    if legacy:
        parts = line.split(None, 2)
        return parts[1].strip("'\"") if len(parts) >= 2 else None
    found = re.match(r"@attribute\s+('([^']*)'|\"([^\"]*)\"|(\S+))", line, re.IGNORECASE)
    return next((g for g in found.groups()[1:] if g is not None), None) if found else None


def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    sep: str | None = None,
    encoding: str | None = None,
) -> DataFrame:
    """A table by its extension; ``columns`` are pruned in the scan.

    Delimiter and encoding of delimited text are detected for each file of a folder unless given.
    Columns are then matched by name; where a file has no such column its values are NULL. If both
    are given, nothing is detected, and the first header holds for all files.
    """
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension == ".parquet":
        df = spark.read.parquet(path)
    elif extension == ".arff":
        df = read_arff(spark, path)
    elif extension == ".json":
        df = read_json_doc(spark, path)
    elif extension == ".jsonl":
        df = read_json_lines(spark, path)
    else:
        tabbed = extension in (".tsv", ".txt")
        if encoding is None or (sep is None and not tabbed):
            df = _read_detected(spark, path, "\t" if tabbed else sep, encoding)
        else:
            df = read_delimited(spark, path, sep="\t" if tabbed else sep, encoding=CHARSETS.get(encoding, encoding))
    return df.select(*[ident(c) for c in columns]) if columns else df
