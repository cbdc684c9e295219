"""The registered queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datascout.llm import align, ann, archive, bpe, chat, decontaminate, jaccard, licenses, packing, quality, stage, tokens, urls, variants
from datascout.plans.registry import Tables, query
from datascout.runtime import scratch_path

ODD_TEXT = "\\### Assistant: </turn> ok"



def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_ids")
def op1(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "tokens")
    tokens.write_tokens(t("documents"), out, vocabulary_path())
    return tokens.read_tokens(t.spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def chat_events(t: Tables) -> DataFrame:
    """`conversations` as events, and conversation -7, whose texts look like the template."""
    odd = t.spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ODD_TEXT).alias("text"),
    )
    rows = t("conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return rows.withColumns({"seq": F.col("turn"), "kind": F.lit("message")})


@query(
    "op2_chat_format",
    """
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL
        SELECT -7, turn, role, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
    ), shown AS (
        SELECT *, length('### ' || replace(replace(replace(replace(role, '\\', '\\s'), '</turn>', '\\t'), '###', '\\h'), ':', '\\c')
            || ': ' || replace(replace(replace(text, '\\', '\\s'), '</turn>', '\\t'), '###', '\\h') || '</turn>' || chr(10)) AS size
        FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(size) AS BIGINT) AS formatted_chars
    FROM shown GROUP BY conv_id
    """,
)
def op2(t: Tables) -> DataFrame:
    chats = stage.staged(chat.render_chats(chat.fold_events(chat_events(t))), "chats")
    turns = chat.read_turns(F.col("formatted"))
    learned = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    told = F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n")))
    return chats.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", told), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: Host, path and verdict of each rule: fixed values.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query(
    "op7_url_filter",
    """
    WITH rules(h, p, v) AS (
        VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
    ), rest AS (
        SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parts AS (
        SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM rest
    ), judged AS (
        SELECT *, (SELECT max_by({'r': h || p, 'v': v}, length(h) * 100000 + length(p)) FROM rules
            WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS won
        FROM parts
    )
    SELECT page_id, host, path, won.r AS rule, coalesce(won.v, 'allow') AS verdict FROM judged
    """,
)
def op7(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(t("pages"), rules).drop("url")


@query(
    "op9_warc",
    """
    WITH paged AS (
        SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
            row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS FIRST) AS nth,
            first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS FIRST) AS first_id
        FROM pages
    )
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
        array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT)
            >> CAST(35 - 5 * (i % 8) AS INT)) & 31) AS INT), 1) FOR i IN range(32)], '') AS payload_digest,
        CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN nth > 1 THEN first_id END AS refers_to
    FROM paged
    """,
)
def op9(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "warc")
    archive.write_archive(t("pages"), path)
    return archive.read_archive(t.spark, path).select(
        F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op8_bpe")
def op8(t: Tables) -> DataFrame:
    path = vocabulary_path()
    return bpe.encode_texts(t("documents").select("doc_id", "text"), path, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_jaccard_join")
def op10(t: Tables) -> DataFrame:
    return jaccard.jaccard_components(t("documents"))


@query("op6_nearest")
def op6(t: Tables) -> DataFrame:
    return ann.nearest(t("embeddings"), lambda vec_id: vec_id % 100 == 0)


@query("op5_quality")
def op5(t: Tables) -> DataFrame:
    model = quality.fit_quality(t("documents"), t("labels"))
    scored = quality.score_quality(t("documents").select("doc_id", "text"), model)
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op3_licenses")
def op3(t: Tables) -> DataFrame:
    docs = t("documents")
    return licenses.scan_licenses(docs, licenses.fit_scanner(docs))


@query(
    "op4_decontaminate",
    r"""
    WITH items AS (
        SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark WHERE text IS NOT NULL
    ), widths AS (SELECT DISTINCT least(5, len(w)) AS k FROM items WHERE len(w) > 0
    ), item_grams AS (
        SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
        FROM (SELECT item_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
    ), docs AS (
        SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL
    ), doc_grams AS (
        SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, widths WHERE len(w) >= k)
    ), sizes AS (SELECT item_id, count(*) AS n FROM item_grams GROUP BY item_id)
    SELECT doc_id, item_id, any_value(n) AS item_shingles, count(*) AS shared_shingles
    FROM doc_grams JOIN item_grams USING (k, gram) JOIN sizes USING (item_id)
    GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n)
    """,
)
def op4(t: Tables) -> DataFrame:
    return decontaminate.find_contained(t("documents"), t("benchmark"))


@query("op11_packing")
def op11(t: Tables) -> DataFrame:
    return packing.pack_documents(t("documents"), vocabulary_path())


@query("op12_cross_tokenizer")
def op12(t: Tables) -> DataFrame:
    return align.align_documents(t("documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))


@query("op13_spelling")
def op13(t: Tables) -> DataFrame:
    return variants.variant_forms(variants.count_words(t("documents"), drop_one_in=97))
