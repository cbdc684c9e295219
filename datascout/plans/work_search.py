"""Queries: search, ranking and resolution."""

from pyspark.sql import functions as F

from datascout.operators import search
from datascout.plans.flows import search_datasets
from datascout.plans.inputs import (
    CATALOG_CTE,
    DEDUPED_CTE,
    LEDGER_CTE,
    NAMED_DEDUPED_CTE,
    document_ledger,
    named_catalog,
    part_catalog,
    rounded,
    score_sql,
    when_mod,
    words_sql,
)
from datascout.plans.registry import Tables, query
from datascout.runtime import cut_lineage
from datascout.schema import POPULAR_DATASETS

ASKED = "Small ring economy  SMALL"


@query("r1_dedupe", f"WITH {DEDUPED_CTE} SELECT id, name, provider FROM deduped")
def r1(t: Tables):
    return search.dedupe(part_catalog(t)).select("id", "name", "provider")


_LITERAL = f"'{ASKED}'"


@query(
    "r2_match_score",
    f"WITH {CATALOG_CTE} SELECT id, round({score_sql(_LITERAL, words_sql(_LITERAL))}, 4) AS score FROM cat",
)
def r2(t: Tables):
    return search.scored(part_catalog(t), ASKED).select("id", rounded("score"))


@query(
    "r3_search",
    f"""WITH {DEDUPED_CTE}, s AS (SELECT id, name, {score_sql(_LITERAL, words_sql(_LITERAL))} AS score FROM deduped)
    SELECT id, name, round(score, 4) AS score FROM s ORDER BY s.score DESC, id LIMIT 10""",
)
def r3(t: Tables):
    return search.search(search.dedupe(part_catalog(t)), ASKED, 10).select("id", "name", rounded("score"))


@query(
    "r3_search_many_names",
    f"""WITH {NAMED_DEDUPED_CTE}, s AS (SELECT id, name, {score_sql(_LITERAL, words_sql(_LITERAL))} AS score FROM deduped)
    SELECT id, name, round(score, 4) AS score FROM s ORDER BY s.score DESC, id LIMIT 10""",
)
def r3_many(t: Tables):
    return search.search(search.dedupe(named_catalog(t)), ASKED, 10).select("id", "name", rounded("score"))


@query(
    "r3_search_filtered",
    f"""WITH {DEDUPED_CTE}, s AS (
      SELECT id, name, {score_sql("'widget economy'", words_sql("'widget economy'"))} AS score
      FROM deduped WHERE license <> 'Unknown' AND contains(license, 'gpl') AND size_bytes < 4194304)
    SELECT id, name, round(score, 4) AS score FROM s ORDER BY s.score DESC, id LIMIT 10""",
)
def r3_filtered(t: Tables):
    cat = part_catalog(t)
    hits = search_datasets([cat], "widget economy", 10, enabled=None, license_type="GPL", size_cond="<4MB")
    return hits.select("id", "name", rounded("score"))


@query(
    "r4_search_offline",
    f"""WITH {LEDGER_CTE} SELECT id, name, 100.0::DOUBLE AS score FROM ledger
    WHERE contains(lower(name), 'doc fr 1') ORDER BY id LIMIT 10""",
)
def r4_offline(t: Tables):
    return search_datasets([], "DOC fr 1", ledger=document_ledger(t)).select("id", "name", "score")


@query(
    "r4_search_local",
    f"""WITH {LEDGER_CTE} SELECT id, name, 100.0::DOUBLE AS score FROM ledger WHERE contains(lower(name), 'doc fr 1')""",
)
def r4(t: Tables):
    return search.search_local(document_ledger(t), "DOC fr 1").select("id", "name", "score")


_ALIAS_ROWS = ", ".join(f"('{a}', {i}, {p})" for p, (a, i) in enumerate(POPULAR_DATASETS.items()))
_ALIAS_QUERY = """CASE p_partkey % 6 WHEN 0 THEN upper(substr(p_name, 1, 2)) WHEN 1 THEN 'my ' || p_name || ' wine iris set'
  WHEN 2 THEN p_partkey::VARCHAR WHEN 3 THEN 'ice' WHEN 4 THEN '' ELSE p_name END"""


@query(
    "r5_alias_lookup",
    f"""WITH aliases(alias, id, pos) AS (VALUES {_ALIAS_ROWS}),
    q AS (SELECT p_partkey AS query_id, lower({_ALIAS_QUERY}) AS t FROM part),
    found AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place
      FROM q, aliases WHERE contains(alias, t) OR contains(t, alias) OR t = ''),
    literal AS (SELECT query_id, CAST(t AS BIGINT) AS id, 1 AS place FROM q
      WHERE regexp_full_match(t, '[0-9]+') AND query_id NOT IN (SELECT query_id FROM found))
    SELECT query_id, id::BIGINT AS id, place::BIGINT AS "rank" FROM found WHERE place <= 3
    UNION ALL SELECT query_id, id, place FROM literal""",
)
def r5(t: Tables):
    key = F.col("p_partkey")
    texts = {
        0: F.upper(F.substring("p_name", 1, 2)),
        1: F.concat(F.lit("my "), "p_name", F.lit(" wine iris set")),
        2: key.cast("string"),
        3: F.lit("ice"),
        4: F.lit(""),
    }
    asked = t("part").select(
        key.alias("query_id"), when_mod("p_partkey", 6, texts, F.col("p_name")).alias("query")
    )
    rows = [(a, i, p) for p, (a, i) in enumerate(POPULAR_DATASETS.items())]
    aliases = t.spark.createDataFrame(rows, "alias string, id bigint, pos int")
    found = search.alias_lookup(asked, aliases, 3)
    return found.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"))


# Whole documents as queries; an alias of one letter lies in nearly all of them.
_LONG_ALIASES = [*POPULAR_DATASETS.items(), ("e", 1), ("q", 2), ("license", 3), ("the ", 4)]


@query(
    "r5_alias_in_documents",
    f"""WITH aliases(alias, id, pos) AS (VALUES {", ".join(f"('{a}', {i}, {p})" for p, (a, i) in enumerate(_LONG_ALIASES))}),
    q AS (SELECT doc_id AS query_id, lower(text) AS t FROM documents),
    found AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place
      FROM q, aliases WHERE contains(alias, t) OR contains(t, alias) OR t = '')
    SELECT query_id, id::BIGINT AS id, place::BIGINT AS "rank" FROM found WHERE place <= 5""",
)
def r5_long(t: Tables):
    rows = [(a, i, p) for p, (a, i) in enumerate(_LONG_ALIASES)]
    aliases = t.spark.createDataFrame(rows, "alias string, id bigint, pos int")
    asked = t("documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    found = search.alias_lookup(asked, aliases, 5)
    return found.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"))


_BATCH = "CASE WHEN p_partkey % 10 = 0 THEN 'nothing here' ELSE p_name || ' ' || p_brand || ' econ' END"


def _batch_queries(t: Tables):
    asked = F.when(F.col("p_partkey") % 10 == 0, "nothing here").otherwise(
        F.concat("p_name", F.lit(" "), "p_brand", F.lit(" econ"))
    )
    return t("part").select(F.col("p_partkey").alias("query_id"), asked.alias("query"))


def _batch_sql(deduped: str) -> str:
    return f"""WITH {deduped}, q AS (SELECT DISTINCT lower({_BATCH}) AS text FROM part),
    w AS (SELECT text, {words_sql('text')} AS words FROM q),
    s AS (SELECT text, id, {score_sql('text', 'words')} AS score FROM w, deduped),
    top AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, id) AS place FROM s)
    SELECT p_partkey AS query_id, id, round(score, 4) AS score, place::BIGINT AS "rank"
    FROM part JOIN top ON text = lower({_BATCH}) WHERE place <= 5"""


def _batch(t: Tables, catalog):
    cat = cut_lineage(search.dedupe(catalog))  # read several times
    found = search.search_batch(cat, _batch_queries(t), 5)
    return found.select("query_id", "id", rounded("score"), F.col("rank").cast("bigint").alias("rank"))


@query("r6_search_batch", _batch_sql(DEDUPED_CTE))
def r6(t: Tables):
    return _batch(t, part_catalog(t))


@query("r6_search_many_names", _batch_sql(NAMED_DEDUPED_CTE))
def r6_many(t: Tables):
    return _batch(t, named_catalog(t))


_REQUEST = """CASE c_custkey % 3 WHEN 0 THEN 'hf/doc' || (c_custkey % 700) WHEN 1 THEN 'DOC en ' || (c_custkey % 60)
  ELSE 'none ' || c_custkey END"""


@query(
    "r7_resolve",
    f"""WITH {LEDGER_CTE}, req AS (SELECT c_custkey AS request_id, {_REQUEST} AS source FROM customer)
    SELECT request_id, source, id, local_path FROM (
      SELECT r.request_id, r.source, l.id, l.local_path,
        row_number() OVER (PARTITION BY r.request_id ORDER BY l.pos) AS place
      FROM req r JOIN ledger l ON l.id = r.source OR lower(l.name) = lower(r.source)) WHERE place = 1""",
)
def r7(t: Tables):
    key = F.col("c_custkey")
    source = when_mod(
        "c_custkey",
        3,
        {
            0: F.concat(F.lit("hf/doc"), (key % 700).cast("string")),
            1: F.concat(F.lit("DOC en "), (key % 60).cast("string")),
        },
        F.concat(F.lit("none "), key.cast("string")),
    )
    requests = t("customer").select(key.alias("request_id"), source.alias("source"))
    return search.resolve(requests, document_ledger(t)).select("request_id", "source", "id", "local_path")


@query(
    "r8_resolve_metadata",
    f"""WITH {CATALOG_CTE}, hub AS (SELECT replace(id, 'part/', 'hf/') AS id, name, 'huggingface' AS provider,
      popularity, quality_score, description FROM cat),
    req AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'part/' || p_partkey WHEN 1 THEN 'uci/' || p_partkey
      ELSE 'hf/' || p_name END AS id FROM part),
    s AS (SELECT req, id, {score_sql('q', 'words')} AS score
      FROM (SELECT id AS req, regexp_replace(id, '^hf/', '') AS q, {words_sql("regexp_replace(id, '^hf/', '')")} AS words
        FROM req WHERE id LIKE 'hf/%') r,
      hub),
    top AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY score DESC, id) AS place FROM s)
    SELECT id, id AS resolved_id, 'cache' AS origin FROM req WHERE id LIKE 'part/%'
    UNION ALL SELECT req, id, 'provider' FROM top WHERE place = 1 AND score > 0
    UNION ALL SELECT id, id, 'provider' FROM req WHERE id IN (SELECT 'uci/' || p_partkey FROM part WHERE p_partkey % 2 = 0)""",
)
def r8(t: Tables):
    cat = part_catalog(t)
    hub = cat.withColumns({"id": F.replace("id", F.lit("part/"), F.lit("hf/")), "provider": F.lit("huggingface")})
    # Many ids are suffixes of others, and half of those asked for have no record.
    uci = cat.where(F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint") % 2 == 0)
    uci = uci.withColumns({"id": F.replace("id", F.lit("part/"), F.lit("uci/")), "provider": F.lit("uci")})
    key = F.col("p_partkey").cast("string")
    wanted = when_mod(
        "p_partkey", 3, {0: F.concat(F.lit("part/"), key), 1: F.concat(F.lit("uci/"), key)}, F.concat(F.lit("hf/"), "p_name")
    )
    return search.resolve_metadata(t("part").select(wanted.alias("id")), cat, hub.unionByName(uci))


@query(
    "r9_limit_per_provider",
    f"""WITH {CATALOG_CTE} SELECT id, provider FROM (SELECT *, row_number() OVER (
      PARTITION BY provider ORDER BY popularity DESC, id) AS place FROM cat) WHERE place <= 4""",
)
def r9(t: Tables):
    return search.limit_per_provider(part_catalog(t), 4).select("id", "provider")
