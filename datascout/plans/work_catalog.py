"""Queries: payload normalisation and catalog views."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datascout.operators import catalog
from datascout.plans.inputs import CATALOG_CTE, part_catalog, rounded, when_mod
from datascout.plans.registry import Tables, query

SHOWN = [
    "id", "name", "task", "rows", "columns", "size_bytes", "license", "last_updated", "downloads", "popularity",
    "quality_score", "description", "data_url", "source_url",
]


def _payloads(df: DataFrame, **fields: Column) -> DataFrame:
    """One JSON text per row; NULL fields are absent, as hubs leave them out."""
    return df.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("payload"))


def _shown(cat: DataFrame) -> DataFrame:
    columns = [rounded(c) if c in ("popularity", "quality_score") else F.col(c) for c in SHOWN]
    return cat.select(*columns, F.array_join("tags", "|").alias("tag_text"))


def _if(column: str, divisor: int, remainder: int, value) -> Column:
    return F.when(F.col(column) % divisor == remainder, value)


def _unless(column: str, divisor: int, remainder: int, value) -> Column:
    return F.when(F.col(column) % divisor != remainder, value)


def hf_payloads(t: Tables) -> DataFrame:
    p, k = t("part"), "p_partkey"
    tags = F.array_compact(
        F.array(
            _unless(k, 4, 0, F.concat(F.lit("task_categories:"), "p_type")),
            _unless(k, 5, 0, F.concat(F.lit("license:lic"), F.col("p_size").cast("string"))),
            _if(k, 2, 0, F.lit("format:csv")),
            *[_if(k, 6, 0, F.lit(f"extra{i}")) for i in range(4)],
            _if(k, 10, 1, F.lit("license:mit")),
        )
    )
    key = F.col(k).cast("string")
    return _payloads(
        p,
        id=F.when(F.col(k) % 3 == 0, F.concat("p_name", key)).otherwise(F.concat(F.lit("org/"), "p_name", key)),
        tags=tags,
        downloads=_unless(k, 8, 0, F.col(k) * 37),
        likes=_unless(k, 9, 0, F.col("p_size")),
        description=_unless(k, 4, 1, F.col("p_type")),
        lastModified=_unless(k, 3, 1, F.lit("2024-01-01")),
    )


HF_SQL = """SELECT 'hf/' || x AS id, p_name || p_partkey AS name,
    CASE WHEN p_partkey % 4 <> 0 THEN p_type ELSE 'Unknown' END AS task,
    NULL::BIGINT AS "rows", NULL::BIGINT AS "columns", NULL::BIGINT AS size_bytes, lic AS license,
    CASE WHEN p_partkey % 3 <> 1 THEN '2024-01-01' ELSE 'Unknown' END AS last_updated, downloads,
    round(least(100::DOUBLE, ln(1 + downloads::DOUBLE) * 5 + likes * 0.5::DOUBLE), 4) AS popularity,
    30.0::DOUBLE + CASE WHEN p_partkey % 4 <> 1 THEN 20 ELSE 0 END + CASE WHEN lic <> 'Unknown' THEN 20 ELSE 0 END
      + CASE WHEN p_partkey % 4 <> 0 THEN 15 ELSE 0 END + CASE WHEN n_tags > 5 THEN 15 ELSE 0 END AS quality_score,
    CASE WHEN p_partkey % 4 <> 1 THEN p_type ELSE '' END AS description, NULL::VARCHAR AS data_url,
    'https://huggingface.co/datasets/' || x AS source_url,
    concat_ws('|', CASE WHEN p_partkey % 4 <> 0 THEN 'task_categories:' || p_type END,
      CASE WHEN p_partkey % 5 <> 0 THEN 'license:lic' || p_size END, CASE WHEN p_partkey % 2 = 0 THEN 'format:csv' END,
      CASE WHEN p_partkey % 6 = 0 THEN 'extra0|extra1|extra2|extra3' END,
      CASE WHEN p_partkey % 10 = 1 THEN 'license:mit' END) AS tag_text
  FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_name || p_partkey ELSE 'org/' || p_name || p_partkey END AS x,
    CASE WHEN p_partkey % 10 = 1 THEN 'mit' WHEN p_partkey % 5 <> 0 THEN 'lic' || p_size ELSE 'Unknown' END AS lic,
    CASE WHEN p_partkey % 8 <> 0 THEN p_partkey * 37 ELSE 0 END AS downloads,
    CASE WHEN p_partkey % 9 <> 0 THEN p_size ELSE 0 END AS likes,
    (p_partkey % 4 <> 0)::INT + (p_partkey % 5 <> 0)::INT + (p_partkey % 2 = 0)::INT + 4 * (p_partkey % 6 = 0)::INT
      + (p_partkey % 10 = 1)::INT AS n_tags FROM part)"""


@query("c1_normalize_hf", HF_SQL)
def c1(t: Tables):
    return _shown(catalog.normalize_hf(hf_payloads(t)))


def openml_payloads(t: Tables) -> DataFrame:
    k = "o_orderkey"

    def quality(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    text = F.col(k).cast("string")
    qualities = F.array_compact(
        F.array(
            quality("NumberOfInstances", F.concat(text, F.lit(".0"))),
            _unless(k, 7, 0, quality("NumberOfFeatures", (F.col(k) % 40).cast("string"))),
            _if(k, 9, 2, quality("NumberOfFeatures", F.lit("many"))),
            _if(k, 11, 3, quality("NumberOfFeatures", F.lit("12.7"))),
            _unless(k, 3, 0, quality("NumberOfClasses", (F.col(k) % 5 - 1).cast("string"))),
            _if(k, 3, 0, quality("NumberOfClasses", F.lit(""))),
        )
    )
    return _payloads(
        t("orders"),
        did=F.col(k),
        name=_unless(k, 13, 0, F.col("o_orderpriority")),
        version=_unless(k, 4, 0, (F.col(k) % 4).cast("int")),
        file_id=when_mod(k, 5, {1: F.col(k) + 7, 2: F.lit(0).cast("bigint")}),
        format=_unless(k, 6, 0, F.lit("arff_x")),
        quality=qualities,
    )


@query(
    "c2_normalize_openml",
    """SELECT 'openml/' || o_orderkey AS id, name, task, o_orderkey AS "rows", cols AS "columns",
    NULL::BIGINT AS size_bytes, 'Public / CC Attribution' AS license, 'Unknown' AS last_updated,
    NULL::BIGINT AS downloads, CASE WHEN o_orderkey < 100 THEN 90 WHEN o_orderkey < 1000 THEN 75
      WHEN o_orderkey < 10000 THEN 60 ELSE 50 END::DOUBLE AS popularity,
    60.0::DOUBLE + CASE WHEN shaped THEN 20 ELSE 0 END + CASE WHEN classes IS NOT NULL THEN 10 ELSE 0 END AS quality_score,
    'OpenML standard dataset ''' || name || ''' (version ' || version || '). ' || CASE WHEN shaped THEN 'Contains '
      || o_orderkey || ' instances and ' || cols || ' features. ' ELSE '' END || 'Format: ' || format || '.' AS description,
    CASE WHEN o_orderkey % 5 = 1 THEN 'https://www.openml.org/data/v1/download/' || (o_orderkey + 7) END AS data_url,
    'https://www.openml.org/d/' || o_orderkey AS source_url, format || '|' || task AS tag_text
  FROM (SELECT *, coalesce(o_orderkey <> 0 AND cols <> 0, false) AS shaped, CASE WHEN classes > 2
      THEN 'Multi-class Classification' WHEN classes = 2 THEN 'Binary Classification'
      WHEN classes IN (0, 1) THEN 'Regression / Clustering' ELSE 'Tabular' END AS task
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority ELSE 'Unknown' END AS name,
      CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 4 ELSE 1 END AS version,
      CASE WHEN o_orderkey % 6 <> 0 THEN 'ARFF_X' ELSE 'ARFF' END AS format,
      CASE WHEN o_orderkey % 11 = 3 THEN 12 WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 40 END AS cols,
      CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 5 - 1 END AS classes FROM orders))""",
)
def c2(t: Tables):
    return _shown(catalog.normalize_openml(openml_payloads(t)))


def uci_payloads(t: Tables) -> DataFrame:
    k = "p_partkey"
    none = F.array().cast("array<string>")
    data = {
        "uci_id": F.col(k),
        "name": when_mod(k, 6, {0: F.lit("Iris"), 1: F.lit("Heart Disease")}, F.col("p_name")),
        "tasks": when_mod(k, 4, {0: none, 1: F.array("p_type", F.lit("Other"))}, F.array(F.lit("Regression"))),
        "num_instances": _unless(k, 5, 0, F.col(k) * 3),
        "num_features": _unless(k, 5, 1, F.col("p_size").cast("bigint")),
        "variables": _if(k, 2, 0, F.array(F.struct(F.lit("v").alias("name")))),
        "has_missing_values": when_mod(k, 3, {0: F.lit("unknown"), 1: F.lit("no")}),
        "abstract": when_mod(k, 7, {0: F.lit("")}, F.col("p_type")),
        "data_url": _if(k, 3, 2, F.lit("http://u.example/d")),
        "repository_url": _if(k, 8, 1, F.lit("http://u.example/r")),
        "area": when_mod(k, 5, {2: F.lit("Life"), 3: F.lit("")}),
        "characteristics": _unless(k, 9, 0, F.array(F.lit("Tabular"), F.lit("Mixed"))),
        "last_updated": _if(k, 2, 1, F.lit("2023-05-05")),
    }
    record = F.struct(*[c.alias(n) for n, c in data.items()])
    return _payloads(t("part"), status=F.when(F.col(k) % 17 == 0, 404).otherwise(200), data=record)


@query(
    "c3_normalize_uci",
    """SELECT 'uci/' || p_partkey AS id, name, task,
    CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 3 END AS "rows",
    CASE WHEN p_partkey % 5 <> 1 THEN p_size::BIGINT END AS "columns", NULL::BIGINT AS size_bytes,
    'Creative Commons Attribution 4.0 International (CC BY 4.0)' AS license,
    CASE WHEN p_partkey % 2 = 1 THEN '2023-05-05' ELSE 'Unknown' END AS last_updated, NULL::BIGINT AS downloads,
    CASE WHEN p_partkey % 6 < 2 THEN 85 ELSE 60 END::DOUBLE AS popularity,
    70.0::DOUBLE + CASE WHEN p_partkey % 2 = 0 THEN 15 ELSE 0 END + CASE WHEN p_partkey % 3 <> 0 THEN 15 ELSE 0 END
      AS quality_score,
    CASE WHEN p_partkey % 7 <> 0 THEN p_type ELSE 'UCI Machine Learning Repository dataset: ' || name || '.' END
      AS description,
    CASE WHEN p_partkey % 3 = 2 THEN 'http://u.example/d' END AS data_url,
    CASE WHEN p_partkey % 8 = 1 THEN 'http://u.example/r' ELSE 'https://archive.ics.uci.edu/dataset/' || p_partkey END
      AS source_url,
    concat_ws('|', task, CASE WHEN p_partkey % 5 = 2 THEN 'Life' END,
      CASE WHEN p_partkey % 9 <> 0 THEN 'Tabular|Mixed' END) AS tag_text
  FROM (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'Iris' WHEN 1 THEN 'Heart Disease' ELSE p_name END AS name,
    CASE p_partkey % 4 WHEN 0 THEN 'Tabular' WHEN 1 THEN p_type ELSE 'Regression' END AS task
    FROM part WHERE p_partkey % 17 <> 0)""",
)
def c3(t: Tables):
    return _shown(catalog.normalize_uci(uci_payloads(t)))


def github_payloads(t: Tables) -> DataFrame:
    k = "c_custkey"
    return _payloads(
        t("customer"),
        full_name=F.concat(F.lit("own/"), "c_name"),
        name=F.col("c_name"),
        description=when_mod(k, 4, {0: F.lit("")}, F.col("c_mktsegment")),
        default_branch=_if(k, 5, 0, F.lit("dev")),
        html_url=_if(k, 3, 0, F.lit("http://g.example/x")),
        updated_at=_unless(k, 6, 0, F.lit("2022-02-02")),
        stargazers_count=_unless(k, 7, 0, F.col(k) * 5),
        size=_unless(k, 8, 0, F.col(k) + 1),
        has_wiki=_unless(k, 3, 1, F.col(k) % 2 == 0),
        license=_if(k, 4, 1, F.struct(F.lit("MIT License").alias("name"))),
        owner=F.struct(F.col("c_mktsegment").alias("login")),
    )


GITHUB_SQL = """SELECT 'github/own/' || c_name AS id, c_name AS name, 'General / Git Repo' AS task,
    NULL::BIGINT AS "rows", NULL::BIGINT AS "columns",
    CASE WHEN c_custkey % 8 <> 0 THEN (c_custkey + 1) * 1024 ELSE 0 END AS size_bytes,
    CASE WHEN c_custkey % 4 = 1 THEN 'MIT License' ELSE 'Unknown' END AS license,
    CASE WHEN c_custkey % 6 <> 0 THEN '2022-02-02' ELSE 'Unknown' END AS last_updated, stars AS downloads,
    round(CASE WHEN stars > 0 THEN least(100::DOUBLE, stars / 100.0::DOUBLE + 10) ELSE 10 END, 4) AS popularity,
    40.0::DOUBLE + CASE WHEN c_custkey % 4 <> 0 THEN 20 ELSE 0 END
      + CASE WHEN c_custkey % 3 <> 1 AND c_custkey % 2 = 0 THEN 10 ELSE 0 END
      + CASE WHEN c_custkey % 4 = 1 THEN 20 ELSE 0 END AS quality_score,
    CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment ELSE 'GitHub dataset repository by ' || c_mktsegment || '.' END
      AS description,
    'https://github.com/own/' || c_name || '/archive/refs/heads/' || CASE WHEN c_custkey % 5 = 0 THEN 'dev' ELSE 'main' END
      || '.zip' AS data_url,
    CASE WHEN c_custkey % 3 = 0 THEN 'http://g.example/x' ELSE 'https://github.com/own/' || c_name END AS source_url,
    'github-repository|dataset' AS tag_text
  FROM (SELECT *, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 5 ELSE 0 END AS stars FROM customer)"""


@query("c4_normalize_github", GITHUB_SQL)
def c4(t: Tables):
    return _shown(catalog.normalize_github(github_payloads(t)))


def kaggle_payloads(t: Tables) -> DataFrame:
    k = "s_suppkey"
    text = F.col(k).cast("string")
    return _payloads(
        t("supplier"),
        ref=F.concat(F.lit("u/"), "s_name"),
        title=F.col("s_name"),
        size=when_mod(
            k, 5, {0: F.concat(text, F.lit(" MB")), 1: F.concat(text, F.lit("MB")), 2: text, 3: F.lit("x GB")}
        ),
        licenseName=_unless(k, 3, 0, F.lit("CC0")),
        lastUpdated=_unless(k, 4, 0, F.lit("2021-01-01")),
        description=_unless(k, 2, 0, F.lit("about")),
        downloadCount=_unless(k, 6, 0, F.col(k) * 1111),
        usabilityRating=_unless(k, 7, 0, F.col(k) % 11 / 10.0),
    )


@query(
    "c5_normalize_kaggle",
    """SELECT 'kaggle/u/' || s_name AS id, s_name AS name, 'Kaggle Dataset' AS task, NULL::BIGINT AS "rows",
    NULL::BIGINT AS "columns", CASE s_suppkey % 5 WHEN 0 THEN s_suppkey * 1048576 WHEN 2 THEN s_suppkey WHEN 4 THEN 0 END
      AS size_bytes,
    CASE WHEN s_suppkey % 3 <> 0 THEN 'CC0' ELSE 'Unknown' END AS license,
    CASE WHEN s_suppkey % 4 <> 0 THEN '2021-01-01' ELSE 'Unknown' END AS last_updated,
    CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey * 1111 ELSE 0 END AS downloads,
    round(CASE WHEN s_suppkey % 6 <> 0 THEN least(100::DOUBLE, s_suppkey * 1111 / 1000.0::DOUBLE + 10) ELSE 10 END, 4)
      AS popularity,
    round(CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 11 / 10.0::DOUBLE * 10 ELSE 0 END, 4) AS quality_score,
    CASE WHEN s_suppkey % 2 <> 0 THEN 'about' ELSE 'Kaggle dataset: u/' || s_name END AS description,
    'u/' || s_name AS data_url, 'https://www.kaggle.com/datasets/u/' || s_name AS source_url, 'kaggle' AS tag_text
  FROM supplier""",
)
def c5(t: Tables):
    return _shown(catalog.normalize_kaggle(kaggle_payloads(t)))


@query(
    "c6_build_catalog",
    f"""SELECT id, popularity, quality_score FROM ({HF_SQL})
    UNION ALL SELECT id, popularity, quality_score FROM ({GITHUB_SQL})""",
)
def c6(t: Tables):
    merged = catalog.build_catalog(
        catalog.normalize_hf(hf_payloads(t)),
        None,
        catalog.normalize_github(github_payloads(t)),
        catalog.normalize_kaggle(kaggle_payloads(t)),
        enabled=["huggingface", "github", "openml"],
    )
    return merged.select("id", rounded("popularity"), rounded("quality_score"))


@query(
    "c7_public_view",
    f"""WITH {CATALOG_CTE} SELECT id, name, provider, task, "rows", "columns", size_bytes, license, last_updated, downloads,
    popularity, round(quality_score, 4) AS quality_score, description, data_url, source_url, tag1 || '|' || tag2 AS tags
    FROM cat""",
)
def c7(t: Tables):
    cat = part_catalog(t).withColumn("raw_metadata", F.lit("{}"))
    shown = catalog.public_view(cat)
    return shown.withColumns({"tags": F.array_join("tags", "|"), "quality_score": F.round("quality_score", 4)})


@query(
    "c8_card_view",
    """WITH d AS (SELECT doc_id, n_chars, source, lang, CASE doc_id % 4 WHEN 0 THEN ' see https://x.example/' || doc_id
      || ' www.y.example ' WHEN 1 THEN 'at http://z.example/a ' || text ELSE text END AS described FROM documents),
    c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(described, 'https?://\\S+', '', 'g'),
      'www\\.\\S+', '', 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM d)
    SELECT 'd/' || doc_id AS id, upper(source) AS provider, lang AS task,
      CASE WHEN doc_id % 3 = 0 THEN '?' ELSE format('{:,}', n_chars) END || ' rows x '
        || CASE WHEN doc_id % 5 = 0 THEN '?' ELSE (doc_id % 90)::VARCHAR END || ' cols' AS shape,
      CASE WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE) ELSE printf('%.1f KB', n_chars / 1024.0::DOUBLE) END AS size,
      'mit' AS license, '2024-01-02' AS updated,
      CASE WHEN doc_id % 100 > 75 THEN 'high' WHEN doc_id % 100 > 40 THEN 'medium' ELSE 'low' END AS popularity_band,
      CASE WHEN n_chars % 100 > 75 THEN 'high' WHEN n_chars % 100 > 40 THEN 'medium' ELSE 'low' END AS quality_band,
      CASE WHEN clean = '' THEN 'Doc' || doc_id ELSE substr(clean, 1, 200) || '...' END AS summary,
      'a, b, c, d, e' AS tag_text FROM c""",
)
def c8(t: Tables):
    id, text = F.col("doc_id"), F.col("text")
    cat = t("documents").select(
        F.concat(F.lit("d/"), id.cast("string")).alias("id"),
        F.concat(F.lit("Doc"), id.cast("string")).alias("name"),
        F.col("source").alias("provider"),
        F.col("lang").alias("task"),
        _unless("doc_id", 3, 0, F.col("n_chars")).alias("rows"),
        _unless("doc_id", 5, 0, id % 90).alias("columns"),
        F.col("n_chars").alias("size_bytes"),
        F.lit("mit").alias("license"),
        F.lit("2024-01-02T03:04:05").alias("last_updated"),
        (id % 100).cast("double").alias("popularity"),
        (F.col("n_chars") % 100).cast("double").alias("quality_score"),
        when_mod(
            "doc_id",
            4,
            {
                0: F.concat(F.lit(" see https://x.example/"), id.cast("string"), F.lit(" www.y.example ")),
                1: F.concat(F.lit("at http://z.example/a "), text),
            },
            text,
        ).alias("description"),
        F.array(*[F.lit(c) for c in "abcdefg"]).alias("tags"),
    )
    return catalog.card_view(cat)
