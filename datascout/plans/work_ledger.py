"""Queries: history, bookmarks, downloads."""

from pyspark.sql import functions as F

from datascout.operators import ledger
from datascout.plans.flows import filter_ledger
from datascout.plans.inputs import CATALOG_CTE, LEDGER_CTE, document_ledger, part_catalog, rounded
from datascout.plans.registry import Tables, query


@query(
    "l1_recent_queries",
    """WITH q AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || '_'
      || (user_id % 40) AS query, ts FROM events),
    latest AS (SELECT query, ts, row_number() OVER (PARTITION BY lower(query) ORDER BY ts DESC, query DESC) AS place FROM q)
    SELECT row_number() OVER (ORDER BY ts DESC, query) AS "rank", query FROM latest WHERE place = 1
    ORDER BY ts DESC, query LIMIT 50""",
)
def l1(t: Tables):
    kind = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    asked = t("events").select(
        F.concat(kind, F.lit("_"), (F.col("user_id") % 40).cast("string")).alias("query"), "ts"
    )
    return ledger.recent_queries(asked).select(F.col("rank").cast("bigint").alias("rank"), "query")


_BOOKMARKS = "SELECT id, name, popularity FROM cat WHERE popularity > 60"


def _bookmarks(t: Tables):
    return part_catalog(t).select("id", "name", "popularity")


@query(
    "l2_add_bookmarks",
    f"""WITH {CATALOG_CTE} {_BOOKMARKS}
    UNION ALL SELECT id, min(name) || ' v0', min(popularity) FROM cat WHERE popularity <= 60 AND popularity > 20 GROUP BY id""",
)
def l2(t: Tables):
    all_ = _bookmarks(t)
    versions = all_.where("popularity > 20").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(0))))
    new = versions.withColumn("name", F.concat("name", F.lit(" v"), F.col("seq").cast("string")))
    return ledger.add_bookmarks(all_.where("popularity > 60"), new)


@query(
    "l3_remove_bookmarks",
    f"WITH {CATALOG_CTE} SELECT id, name, popularity, 100.0::DOUBLE AS score FROM cat WHERE popularity > 60 AND license <> 'mit'",
)
def l3(t: Tables):
    gone = part_catalog(t).where("license = 'mit'").select("id")
    kept = ledger.remove_bookmarks(_bookmarks(t).where("popularity > 60"), gone)
    return ledger.list_bookmarks(kept)


@query(
    "l4_track_downloads",
    f"""WITH {LEDGER_CTE} SELECT id, name, provider, local_path, downloaded_at FROM ledger WHERE pos % 3 <> 0
    UNION ALL SELECT id, name, provider, '/new/' || pos, CASE WHEN pos % 2 = 0 THEN 5000.0 + pos ELSE 0.0 END::DOUBLE
    FROM ledger WHERE pos % 3 = 0""",
)
def l4(t: Tables):
    all_ = document_ledger(t).select("id", "name", "provider", "local_path", "downloaded_at", "pos")
    current = all_.where(F.col("pos") % 6 != 0).drop("pos")
    again = all_.where(F.col("pos") % 3 == 0).withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1))))
    new = again.withColumns(
        {
            "local_path": F.when(
                F.col("seq") == 1, F.concat(F.lit("/new/"), F.col("pos").cast("string"))
            ).otherwise("/old"),
            "downloaded_at": F.lit(5000.0) + F.col("pos"),
            "path_exists": F.col("pos") % 2 == 0,
        }
    )
    return ledger.track_downloads(current, new)


@query(
    "l5_eviction_plan",
    f"""WITH {LEDGER_CTE}, s AS (SELECT *, CASE WHEN path_exists THEN actual_size ELSE 0 END AS size FROM ledger),
    r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY downloaded_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS prior, sum(size) OVER () AS total FROM s)
    SELECT id, path_exists AND total - prior > 1000000 AS evict FROM r""",
)
def l5(t: Tables):
    return ledger.eviction_plan(document_ledger(t), 1_000_000).select("id", "evict")


@query(
    "l5_eviction_plan_ranged",
    f"""WITH {LEDGER_CTE}, s AS (SELECT *, CASE WHEN path_exists THEN actual_size ELSE 0 END AS size FROM ledger),
    r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY downloaded_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS prior, sum(size) OVER () AS total FROM s)
    SELECT id, path_exists AND total - prior > 500000 AS evict FROM r""",
)
def l5_ranged(t: Tables):
    return ledger.eviction_plan(document_ledger(t), 500_000).select("id", "evict")


@query(
    "l6_ledger_as_catalog",
    f"WITH {LEDGER_CTE} SELECT id, name, provider, 100.0::DOUBLE AS score FROM ledger",
)
def l6(t: Tables):
    return ledger.ledger_as_catalog(document_ledger(t))


@query(
    "l6_filter_ledger",
    f"""WITH {CATALOG_CTE} SELECT id, license, round(popularity, 4) AS popularity, 100.0::DOUBLE AS score FROM cat
    WHERE contains(lower(task), 'classification') AND size_bytes < 5 * 1048576 AND "rows" > 300 AND license = 'gpl'""",
)
def l6_filter(t: Tables):
    downloads = part_catalog(t).withColumns({"local_path": F.lit("/x"), "downloaded_at": F.lit(1.0)})
    hits = filter_ledger(downloads, "Classification smaller than 5 MB, more than 300 rows", license_type="gpl", task="nlp")
    return hits.select("id", "license", rounded("popularity"), "score")
