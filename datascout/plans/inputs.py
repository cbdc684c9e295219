"""Inputs that Spark derives from the given tables, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datascout.plans.registry import Tables


def rounded(column: str, digits: int = 4) -> Column:
    return F.round(F.col(column), digits).alias(column)


def when_mod(column: str, divisor: int, cases: dict[int, Column | str], other: Column | str | None = None) -> Column:
    out = F.lit(None) if other is None else other
    for remainder, value in cases.items():
        out = F.when(F.col(column) % divisor == remainder, value).otherwise(out)
    return out


def part_catalog(t: Tables) -> DataFrame:
    """One catalog record per part."""
    key = F.col("p_partkey")
    return t("part").select(
        F.concat(F.lit("part/"), key.cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "").alias("provider"),
        when_mod(
            "p_partkey",
            5,
            {0: "Binary Classification", 1: "Regression", 2: "nlp", 3: "computer vision"},
            F.col("p_type"),
        ).alias("task"),
        F.when(key % 7 != 0, key * 10).alias("rows"),
        F.col("p_size").cast("bigint").alias("columns"),
        F.when(key % 11 != 0, key * 4096).alias("size_bytes"),
        when_mod("p_size", 5, {0: "mit", 1: "Apache-2.0", 2: "gpl", 3: "cc0"}, F.lit("Unknown")).alias("license"),
        F.lit("2024-03-01T10:00:00").alias("last_updated"),
        F.lit(None).cast("bigint").alias("downloads"),
        (F.col("p_size") * 2.0).alias("popularity"),
        (F.col("p_retailprice") % 100).alias("quality_score"),
        F.concat_ws(" ", "p_type", "p_brand").alias("description"),
        F.lit(None).cast("string").alias("data_url"),
        F.concat(F.lit("http://data.example/"), key.cast("string")).alias("source_url"),
        F.array("p_type", "p_brand").alias("tags"),
    )


CATALOG_CTE = """cat AS (
  SELECT 'part/' || p_partkey AS id, p_name AS name,
    regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS provider,
    CASE p_partkey % 5 WHEN 0 THEN 'Binary Classification' WHEN 1 THEN 'Regression' WHEN 2 THEN 'nlp'
      WHEN 3 THEN 'computer vision' ELSE p_type END AS task,
    CASE WHEN p_partkey % 7 <> 0 THEN p_partkey * 10 END AS "rows",
    CAST(p_size AS BIGINT) AS "columns",
    CASE WHEN p_partkey % 11 <> 0 THEN p_partkey * 4096 END AS size_bytes,
    CASE p_size % 5 WHEN 0 THEN 'mit' WHEN 1 THEN 'Apache-2.0' WHEN 2 THEN 'gpl' WHEN 3 THEN 'cc0'
      ELSE 'Unknown' END AS license,
    '2024-03-01T10:00:00' AS last_updated, CAST(NULL AS BIGINT) AS downloads,
    CAST(p_size AS DOUBLE) * 2 AS popularity, p_retailprice % 100 AS quality_score,
    p_type || ' ' || p_brand AS description, CAST(NULL AS VARCHAR) AS data_url,
    'http://data.example/' || p_partkey AS source_url, p_type AS tag1, p_brand AS tag2
  FROM part)"""

def named_catalog(t: Tables) -> DataFrame:
    """`part_catalog` with a name of its own for most parts; every eighth keeps one it shares."""
    own = F.concat("name", F.lit(" v"), F.regexp_extract("id", "([0-9]+)$", 1))
    shared = F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint") % 8 == 0
    return part_catalog(t).withColumn("name", F.when(shared, F.col("name")).otherwise(own))


NAMED_CTE = CATALOG_CTE.replace(
    "p_name AS name", "CASE WHEN p_partkey % 8 = 0 THEN p_name ELSE p_name || ' v' || p_partkey END AS name"
)

DEDUPED_CTE = (
    CATALOG_CTE
    + """, deduped AS (
  SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY regexp_replace(lower(name), '[^a-z0-9]', '', 'g')
    ORDER BY popularity + quality_score DESC, provider, id) AS place FROM cat) WHERE place = 1)"""
)


def score_sql(query: str, words: str) -> str:
    """Relevance of the columns name, id, description for a query text and its word list."""
    title = f"len(list_filter({words}, lambda w: contains(lower(name), w) OR contains(lower(id), w)))"
    desc = f"len(list_filter({words}, lambda w: contains(lower(description), w)))"
    bonus = (
        f"(CASE WHEN lower({query}) = lower(name) OR lower({query}) = lower(id) THEN 50.0 "
        f"WHEN contains(lower(name), lower({query})) OR contains(lower(id), lower({query})) THEN 30.0 "
        f"ELSE 0.0 END)::DOUBLE"
    )
    return f"""(CASE WHEN len({words}) = 0 THEN 0.0::DOUBLE
      WHEN {title} = 0 AND {desc} = 0 AND {bonus} = 0 THEN 0.0::DOUBLE
      ELSE least(100.0::DOUBLE, {title}::DOUBLE / len({words}) * 40 + {desc}::DOUBLE / len({words}) * 10 + {bonus}
        + popularity * 0.2::DOUBLE + quality_score * 0.1::DOUBLE) END)"""


def words_sql(query: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({query}), '\\s+'), lambda w: w <> ''))"


def documents_with_labels(t: Tables) -> DataFrame:
    """Documents with their labels; most have none."""
    return t("documents").join(t("labels"), "doc_id", "left").select(
        "doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"
    )


LABELLED_CTE = """labelled AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def document_ledger(t: Tables) -> DataFrame:
    """One download per document, some with lost paths and with equal times."""
    id = F.col("doc_id")
    return t("documents").select(
        F.concat(F.lit("hf/doc"), id.cast("string")).alias("id"),
        F.concat(F.lit("Doc "), F.col("lang"), F.lit(" "), (id % 50).cast("string")).alias("name"),
        F.col("source").alias("provider"),
        F.concat(F.lit("/data/"), id.cast("string")).alias("local_path"),
        F.floor(id / 3).cast("double").alias("downloaded_at"),
        F.col("n_chars").alias("actual_size"),
        (id % 9 != 0).alias("path_exists"),
        id.alias("pos"),
    )


LEDGER_CTE = """ledger AS (
  SELECT 'hf/doc' || doc_id AS id, 'Doc ' || lang || ' ' || (doc_id % 50) AS name, source AS provider,
    '/data/' || doc_id AS local_path, floor(doc_id / 3.0)::DOUBLE AS downloaded_at,
    n_chars AS actual_size, doc_id % 9 <> 0 AS path_exists, doc_id AS pos
  FROM documents)"""


def saved_filters(t: Tables) -> DataFrame:
    """One plain-language request per supplier."""
    key = F.col("s_suppkey")
    number = (key * 7 % 100 + 1).cast("string")
    text = F.concat_ws(
        " ",
        when_mod("s_suppkey", 4, {0: "Classification data", 1: "image sets", 2: "regression"}, F.lit("anything")),
        when_mod(
            "s_suppkey",
            3,
            {
                0: F.concat(F.lit("smaller than "), number, F.lit(" MB")),
                1: F.concat(F.lit("larger than "), number, F.lit("kb")),
            },
        ),
        when_mod(
            "s_suppkey",
            5,
            {
                0: F.concat(F.lit("with more than "), number, F.lit("00 rows")),
                1: F.concat(F.lit("fewer than "), number, F.lit("0 instances")),
            },
        ),
        when_mod("s_suppkey", 6, {0: "MIT license", 1: "under gpl", 2: "gplish permit"}),
    )
    return t("supplier").select(key.alias("filter_id"), text.alias("query"))


FILTERS_CTE = """requests AS (
  SELECT s_suppkey AS filter_id, concat_ws(' ',
    CASE s_suppkey % 4 WHEN 0 THEN 'Classification data' WHEN 1 THEN 'image sets' WHEN 2 THEN 'regression'
      ELSE 'anything' END,
    CASE s_suppkey % 3 WHEN 0 THEN 'smaller than ' || (s_suppkey * 7 % 100 + 1) || ' MB'
      WHEN 1 THEN 'larger than ' || (s_suppkey * 7 % 100 + 1) || 'kb' END,
    CASE s_suppkey % 5 WHEN 0 THEN 'with more than ' || (s_suppkey * 7 % 100 + 1) || '00 rows'
      WHEN 1 THEN 'fewer than ' || (s_suppkey * 7 % 100 + 1) || '0 instances' END,
    CASE s_suppkey % 6 WHEN 0 THEN 'MIT license' WHEN 1 THEN 'under gpl' WHEN 2 THEN 'gplish permit' END) AS query
  FROM supplier)"""


def conditions_sql(text: str) -> str:
    t = f"lower({text})"

    def found(phrases: str, units: str, group: int) -> str:
        return f"nullif(regexp_extract({t}, '({phrases})\\s*([0-9]+)\\s*({units})', {group}), '')"

    def condition(sign: str, phrases: str, units: str, unit: bool) -> str:
        tail = f" || upper({found(phrases, units, 3)})" if unit else ""
        return f"('{sign}' || {found(phrases, units, 2)}{tail})"

    size, rows = "kb|mb|gb|tb", "rows|instances|samples"
    license = " ".join(
        f"WHEN regexp_matches({t}, '(^|[^\\pL\\pN_]){w}($|[^\\pL\\pN_])') THEN '{w}'"
        for w in ["mit", "apache", "gpl", "creative commons", "cc0", "bsd"]
    )
    return f"""CASE WHEN contains({t}, 'classification') THEN 'classification'
      WHEN contains({t}, 'regression') THEN 'regression'
      WHEN contains({t}, 'nlp') OR contains({t}, 'text') THEN 'nlp'
      WHEN contains({t}, 'image') OR contains({t}, 'vision') THEN 'vision' END AS task,
    coalesce({condition('<', 'smaller than|less than|<', size, True)},
      {condition('>', 'larger than|greater than|>', size, True)}) AS size_cond,
    coalesce({condition('>', 'more than|greater than|>', rows, False)},
      {condition('<', 'less than|fewer than|<', rows, False)}) AS rows_cond,
    CASE {license} END AS license_type"""


NAMED_DEDUPED_CTE = NAMED_CTE + DEDUPED_CTE.removeprefix(CATALOG_CTE)
