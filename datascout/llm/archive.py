"""Content-addressed web archive.

Payload bytes are stored once under their SHA-256; the exact header block of every record is kept
apart from them, and records are rebuilt by joining the two. Written with Spark's own writers, so a
lost executor costs its tasks and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CRLF = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits at a time, in base 32 and then in its alphabet."""
    digits = F.concat(*(F.lpad(F.conv(F.sha1(data).substr(i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(page: Column, key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), key.substr(1, 16), F.lit(">"))


def _header_value(name: str, value: Column) -> Column:
    """A header line; line breaks in the value are percent-coded, a null value gives no line."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def write_archive(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Writes `path`/payloads (key, payload) and `path`/records (page, key, header).

    A null payload is empty. Of the records with equal payloads of at least `min_bytes`, the one with
    the smallest id (null first, then by url) is a response and the others revisit it; smaller
    payloads are responses all. Equal rows are a record each, of which one can be the response.
    Two different payloads with one key (different length, CRC-32 or 64-bit hash) end the job.
    Other columns are not read. The copies of a payload are cut in the tasks that read them, and
    only narrow rows of them are shuffled. Record ids name page and payload: equal rows share one.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    read = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn(
        "key", F.sha2("payload", 256)
    )
    by_key = Window.partitionBy("key").orderBy(F.asc_nulls_first("page"), F.asc_nulls_first("url"))
    first = read.withColumn("nth", F.row_number().over(by_key)).where("nth = 1")
    first.select("key", "payload").write.parquet(f"{path}/payloads")

    narrow = read.select(
        "page", "url", "key", F.octet_length("payload").cast("long").alias("bytes"), sha1_base32(F.col("payload")).alias("sha1"),
        F.struct(F.octet_length("payload"), F.crc32("payload"), F.xxhash64("payload")).alias("check"),
    )
    firsts = narrow.groupBy("key").agg(
        F.min(F.struct("page", "url")).alias("first"), F.min("check").alias("least"), F.max("check").alias("most")
    )
    firsts = firsts.select(
        F.col("key").alias("of"),
        F.when(F.col("least") == F.col("most"), F.col("first")).otherwise(F.raise_error(F.lit("two payloads with one digest"))).alias("first"),
    )
    same = Window.partitionBy("key", "page", "url").orderBy("bytes")
    rows = narrow.withColumn("copy", F.row_number().over(same)).join(firsts, F.col("key") == F.col("of"))
    leads = F.col("page").eqNullSafe(F.col("first.page")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("copy") == 1)
    revisit = (F.col("bytes") >= min_bytes) & ~leads
    block_bytes = F.lit(len(HTTP_HEAD)) + F.when(revisit, 0).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header_value("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header_value("WARC-Record-ID", _urn(F.col("page"), F.col("key"))),
        _header_value("WARC-Target-URI", F.col("url")),
        _header_value("WARC-Date", F.lit(date)),
        _header_value("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, _header_value("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        F.when(revisit, _header_value("WARC-Refers-To", _urn(F.col("first.page"), F.col("key")))).otherwise(""),
        _header_value("Content-Type", F.lit("application/http; msgtype=response")),
        _header_value("Content-Length", block_bytes),
        F.lit(CRLF + HTTP_HEAD),
    )
    rows.select("page", "key", header.alias("header")).write.parquet(f"{path}/records")


def payloads_of(spark: SparkSession, path: str) -> DataFrame:
    """key, payload; a payload that does not have its digest ends the job."""
    stored = spark.read.parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("key")
    return stored.select("key", F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload is damaged"))).alias("payload"))


def _field(name: str) -> Column:
    found = F.regexp_extract(F.split("header", CRLF + CRLF, 2)[0], rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def _page_of(urn: Column, kind) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(.*):[0-9a-f]{16}>$", 1).try_cast(kind)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from its header block: page, key, header, record_type, url, digest,
    refers_to (null for a response), content_length."""
    records = spark.read.parquet(f"{path}/records")
    kind = records.schema["page"].dataType
    return records.select(
        _page_of(_field("WARC-Record-ID"), kind).alias("page"),
        "key",
        "header",
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("url"),
        F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("digest"),
        _page_of(_field("WARC-Refers-To"), kind).alias("refers_to"),
        _field("Content-Length").cast("long").alias("content_length"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records with the size and digest of their whole payloads, taken from the stored bytes."""
    facts = payloads_of(spark, path).select(
        F.col("key").alias("of"), F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest")
    )
    return read_records(spark, path).join(facts, F.col("key") == F.col("of")).drop("of")


def rebuild_records(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    """page, record: the bytes of each WARC record; with `full`, revisits carry their payload too."""
    records = read_records(spark, path)
    joined = records.join(payloads_of(spark, path), "key")
    body = F.when(F.lit(full) | (F.col("record_type") == "response"), F.col("payload")).otherwise(F.lit("").cast("binary"))
    return joined.select("page", F.concat(F.col("header").cast("binary"), body, F.lit(CRLF * 2).cast("binary")).alias("record"))
