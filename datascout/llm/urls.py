"""URL filters by a sort-merge range join.

A host is written with its labels reversed (`a.example.net` -> `net.example.a.`), so a rule's host
and all its subdomains are one interval of keys, and the intervals of two rules are nested or apart.
Urls and rules are dealt to the same key ranges (a rule to each range that its interval meets),
sorted, and swept once with a stack of the rules whose intervals are open.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascout.llm.stage import lower_ascii, shuffle_parts

#: Sampled keys for each range; they only place the bounds of the ranges.
SAMPLED_KEYS = 60


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each ended by a dot; empty for an empty host."""
    key = F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))
    return F.when(host == "", F.lit("")).otherwise(key)


def _bounds(keys: DataFrame, parts: int) -> list[str]:
    """Bounds of `parts` ranges, from about SAMPLED_KEYS keys a range chosen by hash."""
    total = keys.count()
    one_in = max(1, total // (SAMPLED_KEYS * parts))
    chosen = keys.where(F.pmod(F.xxhash64("place"), F.lit(one_in)) == 0)
    found = sorted(r[0] for r in chosen.select("place").collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows of (part, key, is_url, ...) in that order; yields the urls with rule and verdict."""
    stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
    now = None
    for batch in batches:
        parts, keys, kinds, paths, rules, verdicts = (
            batch.column(c).to_pylist() for c in ("part", "key", "is_url", "path", "rule", "verdict")
        )
        out_rule: list[str | None] = []
        out_verdict: list[str] = []
        for part, key, is_url, path, rule, verdict in zip(parts, keys, kinds, paths, rules, verdicts):
            if part != now:
                now, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                known = stack[-1]
                known[1].setdefault(path, (rule, verdict))
                known[2][:] = sorted({len(p) for p in known[1]}, reverse=True)
                continue
            found = None
            for _, by_path, lengths in reversed(stack):
                found = next((by_path[path[:n]] for n in lengths if path[:n] in by_path), None)
                if found:
                    break
            out_rule.append(found[0] if found else None)
            out_verdict.append(found[1] if found else default)
        urls = batch.filter(batch.column("is_url"))
        yield pa.RecordBatch.from_arrays(
            [urls.column(c) for c in ("id", "url", "host", "path")]
            + [pa.array(out_rule, pa.string()), pa.array(out_verdict, pa.string())],
            names=["id", "url", "host", "path", "rule", "verdict"],
        )


def judge_urls(
    urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per row of `urls`: id, url, host, path, rule, verdict.

    `rules` has host, path and verdict; a rule fits its host and all subdomains if the url's path
    starts with the rule's. The longest host wins, then the longest path; of equal rules that with
    the smaller verdict. `rule` is host and path of the winner, null if none fits; the verdict is
    then `default`. Null rule fields count as empty, an empty host fits every host. Null urls and
    those without `://` have empty host and path. Equal rows are judged each; other columns of
    either table are not read. A hot host is spread over ranges by a hash of id and url.
    """
    spark, parts = urls.sparkSession, shuffle_parts(urls)
    host, path = url_parts(F.col("url"))
    keyed = (
        urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
        .withColumns({"host": host, "path": path})
        .withColumn("key", host_key(F.col("host")))
        .withColumn("place", F.concat("key", F.lit("\0"), F.lpad(F.hex(F.xxhash64("id", "url")), 16, "0")))
    )
    bounds = _bounds(keyed.select("place"), parts)

    @F.pandas_udf(T.IntegerType())
    def part_of(place: pd.Series) -> pd.Series:
        return place.map(lambda s: bisect.bisect_right(bounds, s)).astype("int32")

    @F.pandas_udf(T.IntegerType())
    def last_part(end: pd.Series) -> pd.Series:
        return end.map(lambda s: len(bounds) if s is None else bisect.bisect_left(bounds, s)).astype("int32")

    ruled = rules.select(
        lower_ascii(F.coalesce(F.col("host"), F.lit(""))).alias("host"),
        F.coalesce(F.col("path"), F.lit("")).alias("path"),
        F.coalesce(F.col("verdict"), F.lit(default)).alias("verdict"),
    ).withColumns({"key": host_key(F.col("host")), "rule": F.concat("host", "path")})
    # The keys that start with "net." are those from "net." up to "net/", the next character.
    end = F.when(F.col("key") != "", F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")))
    ruled = (
        ruled.withColumn("end", end)
        .withColumn("part", F.explode(F.sequence(part_of("key"), last_part("end"))))
        .select(
            "part", "key", F.lit(False).alias("is_url"), F.lit("").alias("place"),
            F.lit(None).cast(urls.schema[id_col].dataType).alias("id"), F.lit(None).cast("string").alias("url"),
            "host", "path", "rule", "verdict",
        )
    )
    rows = keyed.select(
        part_of("place").alias("part"), "key", F.lit(True).alias("is_url"), "place", "id", "url", "host", "path",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    dealt = (
        rows.unionByName(ruled)
        .repartitionById(max(parts, len(bounds) + 1), F.col("part"))
        .sortWithinPartitions("part", "key", "is_url", "place", "path", "verdict")
    )
    kept = T.StructType(
        [
            T.StructField("id", urls.schema[id_col].dataType),
            *(T.StructField(c, T.StringType()) for c in ("url", "host", "path", "rule", "verdict")),
        ]
    )
    judged = dealt.mapInArrow(lambda batches: _sweep(batches, default), kept)
    return judged.withColumnRenamed("id", id_col)
