"""Queries: sources and sinks. Files are written by Spark below the shared folder, then read back."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascout.plans.inputs import CATALOG_CTE, part_catalog, rounded, when_mod
from datascout.plans.flows import inspect_files
from datascout.plans.registry import Tables, query
from datascout.runtime import cut_lineage, scratch_path
from datascout.sources import files, readers, store

PART_SQL = "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part"
CHUNK = 50


@query("s1_read_csv", PART_SQL)
def s1(t: Tables):
    path = scratch_path(t.spark, "s1")
    t("part").write.option("header", True).option("sep", ";").csv(path)
    return readers.read_delimited(t.spark, path, sep=";")


@query("s2_read_tsv", "SELECT s_suppkey, s_name || ', ' || s_nationkey AS place, s_acctbal FROM supplier")
def s2(t: Tables):
    path = scratch_path(t.spark, "s2")
    place = F.concat_ws(", ", "s_name", F.col("s_nationkey").cast("string")).alias("place")
    t("supplier").select("s_suppkey", place, "s_acctbal").write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_tsv(t.spark, path)


@query("s1_quoted_line_breaks", "SELECT doc_id, text, lang FROM documents")
def s1_quoted(t: Tables):
    path = scratch_path(t.spark, "s1q")
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    t("documents").select("doc_id", "text", "lang").write.options(**plain).csv(path)
    return readers.read_delimited(t.spark, path)


KINDS = {"comma": (",", "UTF-8"), "semicolon": (";", "UTF-8"), "tab": ("\t", "UTF-8"), "pipe": ("|", "UTF-8"), "latin": (",", "ISO-8859-1")}


@query(
    "s1_inspect_files",
    """SELECT kind, name AS delimiter, encoding, (SELECT count(*) FROM supplier) AS "rows", 3::BIGINT AS "columns", NULL::VARCHAR AS error
    FROM (VALUES ('comma', 'Comma', 'utf-8'), ('semicolon', 'Semicolon', 'utf-8'), ('tab', 'Tab', 'utf-8'), ('pipe', 'Pipe', 'utf-8'),
      ('latin', 'Comma', 'latin-1')) v(kind, name, encoding)""",
)
def s1_inspect(t: Tables):
    path = scratch_path(t.spark, "s1i")
    rows = t("supplier").select("s_suppkey", F.concat(F.lit("caf\u00e9 "), "s_name").alias("place"), "s_acctbal")
    for kind, (sep, encoding) in KINDS.items():
        rows.coalesce(1).write.options(header=True, sep=sep, encoding=encoding).csv(f"{path}/{kind}")
    found = inspect_files(t.spark, [f"{path}/{kind}" for kind in KINDS])
    return found.select(F.regexp_extract("path", "/([a-z]+)/[^/]*$", 1).alias("kind"), "delimiter", "encoding", "rows", "columns", "error")


@query("s3_read_parquet", "SELECT * FROM customer")
def s3(t: Tables):
    return readers.read_table(t.spark, t.path("customer"))


def _supplier_chunks(t: Tables) -> DataFrame:
    """Suppliers in chunks of 50 by key."""
    return t("supplier").withColumn("chunk", F.floor(F.col("s_suppkey") / CHUNK))


def _written(docs: DataFrame, path: str) -> str:
    """One file per chunk below ``path``; returns the pattern of the files."""
    docs.repartition("chunk").select("chunk", "value").write.partitionBy("chunk").text(path)
    return f"{path}/chunk=*"


SUPPLIER_SQL = "SELECT s_suppkey, s_name, s_acctbal FROM supplier"


@query("s4_read_json_records", SUPPLIER_SQL)
def s4(t: Tables):
    record = F.struct("s_suppkey", "s_name", "s_acctbal")
    docs = _supplier_chunks(t).groupBy("chunk").agg(F.to_json(F.collect_list(record)).alias("value"))
    return readers.read_json_doc(t.spark, _written(docs, scratch_path(t.spark, "s4")))


@query("s4_read_json_columns", SUPPLIER_SQL)
def s4_columns(t: Tables):
    def column(name: str):
        cells = F.collect_list(F.struct(F.col("s_suppkey").cast("string"), name))
        return F.map_from_entries(cells).alias(name)

    docs = _supplier_chunks(t).groupBy("chunk").agg(*[column(c) for c in ("s_suppkey", "s_name", "s_acctbal")])
    docs = docs.select("chunk", F.to_json(F.struct("s_suppkey", "s_name", "s_acctbal")).alias("value"))
    return readers.read_json_doc(t.spark, _written(docs, scratch_path(t.spark, "s4c")))


@query("s4_read_json_texts", "SELECT doc_id, text, lang FROM documents")
def s4_texts(t: Tables):
    """All documents as arrays, a file for each writing task, which are read in splits; texts hold brackets and quotes."""
    path = scratch_path(t.spark, "s4t")
    record = F.to_json(F.struct("doc_id", "text", "lang"), {"ignoreNullFields": "false"})
    rows = t("documents").select(F.concat(record, F.lit(",")).alias("value"))
    # A task writes what four tasks read, so that a file of many documents is longer than a split.
    rows = rows.coalesce(-(-max(1, rows.rdd.getNumPartitions()) // 4))

    def as_array(batches):
        line = lambda text: pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["value"])
        yield line("[")
        yield from batches
        yield line("null]")

    rows.mapInArrow(as_array, "value string").write.text(path)
    return readers.read_json_doc(t.spark, path).select("doc_id", "text", "lang")


@query("s5_read_json_lines", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s5(t: Tables):
    path = scratch_path(t.spark, "s5")
    t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.json(path)
    return readers.read_json_lines(t.spark, path)


@query(
    "s6_read_arff",
    """SELECT s_suppkey, s_name AS "supplier name", CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS balance
    FROM supplier""",
)
def s6(t: Tables):
    header = [
        "% suppliers", "@relation suppliers", "@ATTRIBUTE s_suppkey numeric", "@attribute 'supplier name' string",
        "@attribute balance real", "", "@data", "% rows",
    ]
    balance = F.when(F.col("s_suppkey") % 7 == 0, "?").otherwise(F.col("s_acctbal").cast("string"))
    key = F.col("s_suppkey")
    rows = _supplier_chunks(t).select(
        "chunk", (key + len(header)).alias("place"), F.concat_ws(",", key.cast("string"), "s_name", balance).alias("value")
    )
    heads = (
        rows.select("chunk")
        .distinct()
        .select("chunk", F.posexplode(F.array(*[F.lit(h) for h in header])).alias("place", "value"))
    )
    path = scratch_path(t.spark, "s6")
    lines = rows.union(heads.select("chunk", F.col("place").cast("bigint"), "value"))
    lines = lines.repartition("chunk").sortWithinPartitions("chunk", "place")
    lines.select("chunk", "value").write.partitionBy("chunk").text(path)
    return readers.read_arff(t.spark, f"{path}/chunk=*")


@query(
    "s7_infer_types",
    """SELECT CASE WHEN p_partkey % 13 <> 0 THEN p_partkey END AS whole, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END
      AS price, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name, p_size > 20 AS flag,
    CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE 'x' || p_size END AS mixed FROM part""",
)
def s7(t: Tables):
    k = "p_partkey"
    return readers.infer_types(
        t("part").select(
            when_mod(k, 13, {0: "NA"}, F.col(k).cast("string")).alias("whole"),
            when_mod(k, 11, {0: "n/a"}, F.col("p_retailprice").cast("string")).alias("price"),
            when_mod(k, 5, {0: ""}, F.col("p_name")).alias("name"),
            (F.col("p_size") > 20).cast("string").alias("flag"),
            when_mod(k, 2, {0: F.col("p_size").cast("string")}, F.concat(F.lit("x"), F.col("p_size").cast("string"))).alias(
                "mixed"
            ),
        )
    )


_SEPARATORS = {0: ",", 1: ";", 2: "\t", 3: "|"}


@query(
    "s8_detect_delimiter",
    """SELECT DISTINCT s_suppkey // 50 AS chunk, CASE (s_suppkey // 50) % 4 WHEN 0 THEN 'Comma' WHEN 1 THEN 'Semicolon'
    WHEN 2 THEN 'Tab' ELSE 'Pipe' END AS delimiter_name FROM supplier""",
)
def s8(t: Tables):
    def line(separator: str):
        return F.concat_ws(separator, F.col("s_suppkey").cast("string"), "s_name", F.col("s_acctbal").cast("string"))

    rows = _supplier_chunks(t)
    value = when_mod("chunk", 4, {r: line(s) for r, s in _SEPARATORS.items()}).alias("value")
    pattern = _written(rows.select("chunk", value), scratch_path(t.spark, "s8"))
    found = files.detect_delimiter(files.text_lines(t.spark, pattern), files.file_names(t.spark, pattern))
    return found.select(F.regexp_extract("path", "chunk=([0-9]+)", 1).cast("bigint").alias("chunk"), "delimiter_name")


@query(
    "s9_detect_encoding",
    """SELECT lang, CASE WHEN bool_or(regexp_matches(text, '[\\x{80}-\\x{FF}]')) THEN 'latin-1' ELSE 'utf-8' END AS encoding
    FROM documents GROUP BY lang""",
)
def s9(t: Tables):
    path = scratch_path(t.spark, "s9")
    rows = t("documents").select("lang", F.regexp_replace("text", "[\r\n]", " ").alias("text"))
    # Every task writes a file for each language it meets, so that no task reads all of a language.
    rows.write.partitionBy("lang").option("encoding", "ISO-8859-1").csv(path)
    found = files.detect_encoding(files.text_lines(t.spark, f"{path}/lang=*"), files.file_names(t.spark, f"{path}/lang=*"))
    lang = F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang")
    # A language of many files is latin-1 if any of them is.
    return found.groupBy(lang).agg(F.min("encoding").alias("encoding"))


_EXTENSIONS = {0: ".csv", 1: ".txt", 2: ".md", 3: ".parquet", 4: ".gitattributes", 5: ".json"}
_EXTENSION_SQL = """CASE doc_id % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.txt' WHEN 2 THEN '.md' WHEN 3 THEN '.parquet'
  WHEN 4 THEN '.gitattributes' ELSE '.json' END"""

LISTING_CTE = f"""listing AS (SELECT source AS dataset_id, CASE WHEN doc_id % 17 = 0 THEN 'directory' ELSE 'file' END AS type,
  CASE WHEN doc_id % 19 = 0 THEN '.hidden' ELSE 'd' END || doc_id || CASE WHEN source IN ('src3', 'src7') THEN '.MD'
    ELSE {_EXTENSION_SQL} END AS path, CASE WHEN doc_id % 23 <> 0 THEN n_chars END AS size,
  'http://f.example/' || doc_id AS download_url FROM documents)"""


def _listing(t: Tables) -> DataFrame:
    """A file listing: one entry per document, its source as the dataset."""
    id = F.col("doc_id").cast("string")
    extension = F.when(F.col("source").isin("src3", "src7"), ".MD").otherwise(when_mod("doc_id", 6, _EXTENSIONS))
    return t("documents").select(
        F.col("source").alias("dataset_id"),
        when_mod("doc_id", 17, {0: "directory"}, F.lit("file")).alias("type"),
        F.concat(when_mod("doc_id", 19, {0: ".hidden"}, F.lit("d")), id, extension).alias("path"),
        F.when(F.col("doc_id") % 23 != 0, F.col("n_chars")).alias("size"),
        F.concat(F.lit("http://f.example/"), id).alias("download_url"),
    )


@query(
    "s10_pick_data_file",
    f"""WITH {LISTING_CTE} SELECT dataset_id, min(path) AS path FROM listing
    WHERE regexp_matches(path, '\\.(csv|parquet|json|arff)$') GROUP BY dataset_id""",
)
def s10(t: Tables):
    return files.pick_data_file(_listing(t))


@query(
    "s11_write_catalog",
    f"""WITH {CATALOG_CTE} SELECT id, replace(id, '/', '_') AS safe_id, provider, round(quality_score, 4) AS quality_score,
    CASE WHEN popularity > 40 THEN name || ' v1' ELSE name END AS name FROM cat""",
)
def s11(t: Tables):
    cat = part_catalog(t)
    first = store.write_catalog(cat.where("popularity <= 60"), scratch_path(t.spark, "s11a"))
    versions = cat.where("popularity > 40").withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1))))
    new = versions.withColumns(
        {
            "name": F.concat("name", F.lit(" v"), F.col("seq").cast("string")),
            "last_updated": F.concat(F.lit("2024-03-0"), (F.col("seq") + 1).cast("string")),
        }
    ).drop("seq")
    merged = store.write_catalog(new, scratch_path(t.spark, "s11b"), current=first)
    return merged.select("id", "safe_id", "provider", rounded("quality_score"), "name")


@query("s12_read_catalog", f"WITH {CATALOG_CTE} SELECT id, name, provider FROM cat WHERE id = 'part/77'")
def s12(t: Tables):
    path = scratch_path(t.spark, "s12")
    store.write_catalog(part_catalog(t), path)
    return store.read_record(t.spark, path, "part/77").select("id", "name", "provider")


@query(
    "s13_path_sizes",
    f"WITH {LISTING_CTE} SELECT dataset_id, coalesce(sum(size), 0)::BIGINT AS size_bytes FROM listing GROUP BY dataset_id",
)
def s13(t: Tables):
    return files.path_sizes(_listing(t))


@query(
    "s13_directory_sizes",
    "SELECT s_suppkey // 50 AS dataset_id, sum(strlen(s_name) + 1)::BIGINT AS size_bytes FROM supplier GROUP BY 1",
)
def s13_directories(t: Tables):
    rows = _supplier_chunks(t).select("chunk", F.col("s_name").alias("value"))
    listed = files.list_files(t.spark, _written(rows, scratch_path(t.spark, "s13")))
    number = F.regexp_extract("path", "chunk=([0-9]+)", 1).cast("bigint")
    return files.path_sizes(listed.withColumn("dataset_id", number))


@query(
    "s14_verify_checksums",
    """SELECT chunk, CASE chunk % 2 WHEN 0 THEN 'ok' ELSE 'mismatch' END AS status,
    sha256(string_agg(s_name, chr(10) ORDER BY s_suppkey) || chr(10)) AS sha256
    FROM (SELECT s_suppkey // 50 AS chunk, s_suppkey, s_name FROM supplier) GROUP BY chunk""",
)
def s14(t: Tables):
    rows = _supplier_chunks(t).select("chunk", "s_suppkey", F.col("s_name").alias("value"))
    path = scratch_path(t.spark, "s14") + "/50% of files"
    lines = rows.repartition("chunk").sortWithinPartitions("chunk", "s_suppkey").select("chunk", "value")
    lines.write.partitionBy("chunk").text(path)
    number = F.regexp_extract("path", "chunk=([0-9]+)", 1).cast("bigint")
    digests = cut_lineage(files.file_digests(t.spark, f"{path}/chunk=*"))  # read three times
    names = F.sort_array(F.collect_list(F.struct("s_suppkey", "value")))  # 50 of a chunk
    content = F.concat(F.array_join(F.transform(names, lambda r: r["value"]), "\n"), F.lit("\n"))
    expected = rows.groupBy("chunk").agg(F.upper(F.sha2(content, 256)).alias("expected"))
    manifest = digests.select("path", number.alias("chunk")).join(expected, "chunk")
    wrong = F.when(F.col("chunk") % 2 == 0, F.col("expected")).otherwise("0")
    manifest = manifest.select("path", wrong.alias("expected_sha256"))
    checked = files.verify_checksums(digests, manifest).join(digests, "path")
    return checked.select(number.alias("chunk"), "status", "sha256")


_HUB_SQL = f"""WITH {LISTING_CTE}, f AS (SELECT *, NOT starts_with(path, '.')
    AND NOT regexp_matches(lower(path), '\\.(md|txt|gitattributes)$') AS ok FROM listing WHERE type = 'file'),
  a AS (SELECT dataset_id, bool_or(ok) AS any_ok FROM f GROUP BY dataset_id),
  k AS (SELECT f.* FROM f JOIN a USING (dataset_id) WHERE ok OR NOT any_ok)
  SELECT dataset_id, path, size, (sum(coalesce(size, 0)) OVER (PARTITION BY dataset_id))::BIGINT AS total_size FROM k"""


@query("s15_select_hub_files", _HUB_SQL)
def s15(t: Tables):
    return files.select_hub_files(_listing(t))


@query(
    "s16_select_repo_files",
    f"""WITH {LISTING_CTE}, f AS (SELECT * FROM listing WHERE type = 'file'
      AND regexp_matches(lower(path), '\\.(csv|parquet|json|tsv)$'))
    SELECT dataset_id, path, download_url AS url, size,
      (sum(coalesce(size, 0)) OVER (PARTITION BY dataset_id))::BIGINT AS total_size FROM f
    UNION ALL SELECT source, 'n-' || source || '.zip', 'http://a.example/' || source, NULL, NULL
      FROM (SELECT DISTINCT source FROM documents) WHERE source NOT IN (SELECT dataset_id FROM f)""",
)
def s16(t: Tables):
    cat = t("documents").select("source").distinct()
    cat = cat.select(
        F.col("source").alias("id"),
        F.concat(F.lit("n-"), "source").alias("name"),
        F.concat(F.lit("http://a.example/"), "source").alias("data_url"),
    )
    return files.select_repo_files(_listing(t), cat)
