"""Search history, bookmarks and downloads, with the size-capped eviction plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datascout.operators.groups import running_sum
from datascout.schema import LEDGER_COLUMNS, PUBLIC_COLUMNS

HISTORY_LIMIT = 50
DEFAULT_CAP_BYTES = 10 * 1024**3
# Ranges of time whose totals are taken before any entry is sorted.
RANGES = 128


def recent_queries(events: DataFrame, n: int = HISTORY_LIMIT) -> DataFrame:
    """``(rank, query, ts)``: the latest spelling of the ``n`` latest queries, newest first.

    ``events`` holds ``query`` and ``ts``. A query asked often is folded inside the map tasks.
    """
    latest = events.groupBy(F.lower("query").alias("__key")).agg(
        F.max(F.struct("ts", "query")).alias("last")
    )
    newest = latest.select("last.query", "last.ts").orderBy(F.col("ts").desc(), "query").limit(n)
    numbered = F.row_number().over(Window.orderBy(F.col("ts").desc(), "query"))  # n rows
    return newest.select(numbered.alias("rank"), "query", "ts")


def add_bookmarks(current: DataFrame, new: DataFrame) -> DataFrame:
    """Append records whose id is not bookmarked; of several new versions the first by ``seq``."""
    row = F.struct(*[F.col(f"`{c}`") for c in current.columns])
    first = new.groupBy("id").agg(F.min_by(row, "seq").alias("r")).select("r.*")
    return current.unionByName(first.join(current.select("id"), "id", "left_anti"))


def remove_bookmarks(current: DataFrame, ids: DataFrame) -> DataFrame:
    return current.join(ids.select("id"), "id", "left_anti")


def list_bookmarks(current: DataFrame) -> DataFrame:
    return current.withColumn("score", F.lit(100.0))


def track_downloads(current: DataFrame, new: DataFrame) -> DataFrame:
    """Replace ledger rows by id; a download whose path is gone has time 0.

    ``new`` holds the ledger columns and ``seq`` (order of arrival), of which the last counts.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in current.columns])
    if "path_exists" in new.columns:
        new = new.withColumn("downloaded_at", F.when(F.col("path_exists"), F.col("downloaded_at")).otherwise(0.0))
    latest = new.groupBy("id").agg(F.max_by(row, "seq").alias("r")).select("r.*")
    return current.join(latest.select("id"), "id", "left_anti").unionByName(latest)


def list_downloads(ledger: DataFrame) -> DataFrame:
    return ledger.select("id", "name", "provider", "local_path")


def eviction_plan(ledger: DataFrame, max_bytes: int = DEFAULT_CAP_BYTES) -> DataFrame:
    """Add ``evict``: the oldest entries whose removal brings the total down to ``max_bytes``.

    ``ledger`` holds ``id``, ``downloaded_at``, ``actual_size`` and ``path_exists``. Entries
    without a path count nothing and stay; those without a time come first, ids break ties.

    The plan is a cut in (time, id) order. Totals of ranges of time, bounded by a sketch, tell which
    range holds the cut; only that one is summed row by row. All others are decided by comparison.
    """
    paths = F.coalesce("path_exists", F.lit(False))
    size = F.when(paths, F.coalesce("actual_size", F.lit(0))).otherwise(0).cast("bigint")
    at = F.col("downloaded_at").cast("double")
    sized = ledger.select(at.alias("at"), "id", size.alias("size"))
    marks = sized.agg(F.percentile_approx("at", [i / RANGES for i in range(1, RANGES)]).alias("m")).first()["m"]
    bounds = F.array(*[F.lit(float(m)) for m in sorted(set(marks or []))]).cast("array<double>")
    ranges = F.when(F.col("at").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda m: m < F.col("at"))))
    placed = sized.withColumn("part", ranges)
    totals = sorted(placed.groupBy("part").agg(F.sum("size").alias("size")).collect())  # RANGES + 1 rows at most
    excess = sum(t["size"] for t in totals) - max_bytes
    before, cut = 0, None
    for part, inside in totals:
        if before >= excess:
            break
        before, cut = before + inside, (part, before)
    if cut is None:
        return ledger.withColumn("evict", F.lit(False))
    part, offset = cut
    summed = running_sum(placed.where(F.col("part") == part), ["at", "id"], F.col("size"), "prior")
    # Entries before which less than the excess is freed go: the last of them is the cut.
    last = summed.where(F.col("prior") + offset < excess).agg(F.max(F.struct("at", "id")).alias("last")).first()["last"]
    stamp = F.lit(last["at"]).cast("double")
    early = F.lit(False) if last["at"] is None else at.isNull() | (at < stamp)
    same = at.eqNullSafe(stamp) & (F.col("id").isNull() | (F.col("id") <= F.lit(last["id"])))
    return ledger.withColumn("evict", paths & F.coalesce(early | same, F.lit(False)))


def ledger_as_catalog(ledger: DataFrame) -> DataFrame:
    """Ledger rows as search hits with score 100."""
    kept = [c for c in ledger.columns if c not in LEDGER_COLUMNS]
    return ledger.select(*[c for c in PUBLIC_COLUMNS if c in kept], F.lit(100.0).alias("score"))
