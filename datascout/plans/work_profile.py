"""Queries: profiling and advice."""

from pyspark.sql import functions as F

from datascout.operators import advice, profile
from datascout.plans.inputs import LABELLED_CTE, documents_with_labels, rounded
from datascout.plans.registry import Tables, query

LINEITEM_NUMERIC = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINEITEM_OTHER = ["l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM = [*LINEITEM_NUMERIC, *LINEITEM_OTHER]
LINEITEM_TYPES = ["bigint"] * 3 + ["int"] + ["double"] * 4 + ["string"] * 2 + ["timestamp_ntz"]
LABELLED = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


@query("p1_shape", "SELECT count(*) AS \"rows\", 11::BIGINT AS \"columns\", NULL::VARCHAR AS error FROM lineitem")
def p1(t: Tables):
    return profile.shape(t("lineitem"))


@query(
    "p2_footprint",
    """SELECT sum(8 + 8 + strlen(text) + coalesce(strlen(text), 0) + strlen(lang) + strlen(source))::BIGINT AS memory_bytes,
    round(sum(8 + 8 + strlen(text) + coalesce(strlen(text), 0) + strlen(lang) + strlen(source))::DOUBLE / 1048576, 4) AS memory_mb FROM documents""",
)
def p2(t: Tables):
    return profile.footprint(t("documents")).withColumn("memory_mb", F.round("memory_mb", 4))


def _duplicates_sql(table: str, columns: str) -> str:
    return f"""SELECT sum(n)::BIGINT AS "rows", sum(n - 1)::BIGINT AS duplicate_rows,
      round(sum(n - 1)::DOUBLE * 100 / sum(n)::DOUBLE, 4) AS duplicate_pct
      FROM (SELECT count(*) AS n FROM {table} GROUP BY {columns})"""


@query("p3_duplicates", _duplicates_sql("part", "p_name, p_brand, p_type"))
def p3(t: Tables):
    df = t("part").select("p_name", "p_brand", "p_type")
    return profile.duplicate_stats(df).withColumn("duplicate_pct", F.round("duplicate_pct", 4))


@query("p3_duplicate_texts", _duplicates_sql("documents", "text, lang"))
def p3_texts(t: Tables):
    return profile.duplicate_stats(t("documents").select("text", "lang")).withColumn(
        "duplicate_pct", F.round("duplicate_pct", 4)
    )


@query(
    "p4_missing",
    f"WITH {LABELLED_CTE} "
    + union(
        [
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
            f"round((count(*) - count({c}))::DOUBLE * 100 / count(*), 4) AS missing_pct FROM labelled"
            for c in LABELLED
        ]
    ),
)
def p4(t: Tables):
    found = profile.missing(documents_with_labels(t))
    return found.select("column", "missing_count", rounded("missing_pct"))


@query(
    "p5_cardinality",
    union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS cardinality FROM lineitem" for c in LINEITEM]),
)
def p5(t: Tables):
    return profile.cardinality(t("lineitem"))


@query("p5_cardinality_approx", union([f"SELECT '{c}' AS \"column\", true AS close" for c in LINEITEM]))
def p5_approx(t: Tables):
    exact = profile.cardinality(t("lineitem")).withColumnRenamed("cardinality", "exact")
    found = profile.cardinality(t("lineitem"), approx=True).join(exact, "column")
    # Four times the sketch's standard error of 5 %.
    return found.select("column", (F.abs(F.col("cardinality") - F.col("exact")) <= 1 + F.col("exact") * 0.2).alias("close"))


@query(
    "p7_overall_missing",
    f"""WITH {LABELLED_CTE}, m AS (SELECT count(*) AS n, {' + '.join(f'(count(*) - count({c}))' for c in LABELLED)} AS m
    FROM labelled) SELECT m::BIGINT AS total_missing, round(m::DOUBLE * 100 / (n * 7), 4) AS overall_missing_pct FROM m""",
)
def p7(t: Tables):
    found = profile.overall_missing(documents_with_labels(t))
    return found.select("total_missing", rounded("overall_missing_pct"))


def _numeric_sql(column: str, table: str, keys: str = "", label: str | None = None) -> str:
    q = f"quantile_cont({column}::DOUBLE, %s)"
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}'{label or column}' AS "column", round(avg({column}), 4) AS mean,
      round(stddev_samp({column}::DOUBLE), 4) AS std, min({column})::DOUBLE AS min, round({q % 0.25}, 4) AS q25,
      round({q % 0.5}, 4) AS median, round({q % 0.75}, 4) AS q75, max({column})::DOUBLE AS max FROM {table} {group}"""


def _rounded_stats(df, *names):
    digits = ("mean", "std", "q25", "median", "q75")
    return df.select(*[rounded(c) if c in digits else F.col(c) for c in names])


@query("p9_numeric_summary", union([_numeric_sql(c, "lineitem") for c in LINEITEM_NUMERIC]))
def p9(t: Tables):
    found = profile.numeric_summary(t("lineitem"))
    return _rounded_stats(found, "column", "mean", "std", "min", "q25", "median", "q75", "max")


@query(
    "p10_quartiles",
    union(
        [
            f"SELECT '{c}' AS \"column\", round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, "
            f"round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, "
            f"round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75 FROM orders"
            for c in ["o_orderkey", "o_custkey", "o_totalprice"]
        ]
    ),
)
def p10(t: Tables):
    names = ["o_orderkey", "o_custkey", "o_totalprice"]
    found = profile.column_quantiles(t("orders"), names)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("ci") + 1)
    q = [F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(["q25", "median", "q75"])]
    return found.select(label.alias("column"), *q)


@query(
    "p10_quartiles_approx",
    union([f"SELECT '{c}' AS \"column\", true AS close" for c in ["o_orderkey", "o_custkey", "o_totalprice"]]),
)
def p10_approx(t: Tables):
    orders = t("orders")
    found = profile.numeric_summary(orders, approx=True)
    exact = profile.numeric_summary(orders).select("column", *[F.col(c).alias(f"x_{c}") for c in ("q25", "median", "q75")], F.col("max") - F.col("min"))
    both = found.join(exact, "column")
    off = F.greatest(*[F.abs(F.col(c) - F.col(f"x_{c}")) for c in ("q25", "median", "q75")])
    return both.select("column", (off <= F.col("(max - min)") * 0.01).alias("close"))


def _outlier_sql(column: str, table: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) FILTER (WHERE {column} < q1 - 1.5 * (q3 - q1)
        OR {column} > q3 + 1.5 * (q3 - q1)) AS outlier_count,
      round(count(*) FILTER (WHERE {column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1))::DOUBLE
        * 100 / count(*), 4) AS outlier_pct
      FROM {table}, (SELECT quantile_cont({column}::DOUBLE, 0.25) AS q1, quantile_cont({column}::DOUBLE, 0.75) AS q3
        FROM {table})"""


@query("p11_outliers", union([_outlier_sql(c, "documents") for c in ["doc_id", "n_chars"]]))
def p11(t: Tables):
    return profile.outliers(t("documents").select("doc_id", "n_chars")).select(
        "column", "outlier_count", rounded("outlier_pct")
    )


def _top_sql(column: str, table: str, text: str | None = None) -> str:
    text = text or column
    return f"""SELECT '{column}' AS "column", sum(n)::BIGINT AS count, count(*) AS "unique",
      (SELECT v FROM (SELECT {text} AS v, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1)
        ORDER BY n DESC, v LIMIT 1) AS top, max(n) AS freq
      FROM (SELECT {text} AS v, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1)"""


@query(
    "p12_categorical_summary",
    union(
        [
            _top_sql("l_returnflag", "lineitem"),
            _top_sql("l_linestatus", "lineitem"),
            _top_sql("l_shipdate", "lineitem", "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')"),
        ]
    ),
)
def p12(t: Tables):
    return profile.categorical_summary(t("lineitem"))


@query(
    "p12_long_text",
    """WITH c AS (SELECT text, count(*) AS n FROM documents GROUP BY text)
    SELECT 'text' AS "column", sum(n)::BIGINT AS count, count(*) AS "unique", (SELECT text FROM c
      ORDER BY n DESC, text LIMIT 1) AS top, max(n) AS freq FROM c""",
)
def p12_text(t: Tables):
    return profile.categorical_summary(t("documents"), ["text"])


def _corr_sql(a: str, b: str, table: str) -> str:
    r = f"corr({a}::DOUBLE, {b}::DOUBLE)"
    return f"""SELECT '{a}' AS column_a, '{b}' AS column_b,
      CASE WHEN {r} IS NULL OR isnan({r}) THEN 0.0::DOUBLE ELSE round({r}, 6) END AS r FROM {table}"""


PART_NUMERIC = ["p_partkey", "p_size", "p_retailprice", "one"]
PART_CTE = "WITH p AS (SELECT p_partkey, p_size, p_retailprice, 1 AS one FROM part) "


@query(
    "p13_correlation_matrix",
    PART_CTE + union([_corr_sql(a, b, "p") for a in PART_NUMERIC for b in PART_NUMERIC]),
)
def p13(t: Tables):
    df = t("part").select("p_partkey", "p_size", "p_retailprice", F.lit(1).alias("one"))
    return profile.correlation_matrix(df).select("column_a", "column_b", (F.round("r", 6) + 0.0).alias("r"))


@query(
    "p13_correlation_with_gaps",
    f"WITH {LABELLED_CTE} "
    + union([_corr_sql(a, b, "labelled") for a in ["doc_id", "n_chars", "quality", "toxic"] for b in ["doc_id", "n_chars", "quality", "toxic"]]),
)
def p13_gaps(t: Tables):
    found = profile.correlation_matrix(documents_with_labels(t))
    return found.select("column_a", "column_b", (F.round("r", 6) + 0.0).alias("r"))


_PAIRS = [(a, b) for i, a in enumerate(LINEITEM_NUMERIC) for b in LINEITEM_NUMERIC[i + 1 :]]


@query(
    "p14_top_correlations",
    f"SELECT * FROM ({union([_corr_sql(a, b, 'lineitem') for a, b in _PAIRS])}) ORDER BY abs(r) DESC LIMIT 10",
)
def p14(t: Tables):
    return profile.top_correlations(t("lineitem")).withColumn("r", F.round("r", 6))


def candidates_sql(table: str, columns: list[str], limit: int = 3) -> str:
    rows = union(
        [
            f"SELECT '{c}' AS \"column\", {i} AS ci, count(DISTINCT {c}) AS cardinality, count(*) AS n FROM {table}"
            for i, c in enumerate(columns)
        ]
    )
    return f"""SELECT "column", score, inferred_task, cardinality FROM (SELECT "column", ci, cardinality,
      (CASE WHEN regexp_matches(lower("column"), 'class|target|label|^y$|predict|outcome|species|diagnos')
        THEN 50 ELSE 0 END
      + CASE WHEN cardinality > 1 AND cardinality <= least(15, n * 0.1) THEN 30 ELSE 0 END
      + CASE WHEN ci = {len(columns) - 1} THEN 20 ELSE 0 END)::DOUBLE AS score,
      CASE WHEN cardinality <= 20 THEN 'Classification' ELSE 'Regression / High Cardinality' END AS inferred_task
      FROM ({rows})) WHERE score > 20 ORDER BY score DESC, ci LIMIT {limit}"""


@query("p15_target_candidates", candidates_sql("lineitem", LINEITEM))
def p15(t: Tables):
    return profile.target_candidates(t("lineitem"))


@query("p16_task_inference", candidates_sql("embeddings", ["vec_id", "embedding", "label"]))
def p16(t: Tables):
    return profile.target_candidates(t("embeddings"))


def _balance_sql(column: str, table: str) -> str:
    return f"""SELECT '{column}' AS "column", {column}::VARCHAR AS "value", count(*) AS count,
      round(count(*)::DOUBLE * 100 / (SELECT count(*) FROM {table}), 4) AS percentage
      FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}"""


@query("p17_class_balance", _balance_sql("label", "embeddings"))
def p17(t: Tables):
    return profile.class_balance(t("embeddings")).withColumn("percentage", F.round("percentage", 4))


@query("p17_class_balance_named", _balance_sql("event_type", "events"))
def p17_named(t: Tables):
    return profile.class_balance(t("events"), "event_type").withColumn("percentage", F.round("percentage", 4))


PROFILE_COLUMNS = [
    "position", "column", "dtype", "total", "missing_count", "missing_pct", "cardinality", "mean", "std", "min", "q25",
    "median", "q75", "max", "outlier_count", "outlier_pct", "top", "freq",
]


def _profile_sql(table: str, columns: list[str], types: list[str], numeric: list[str]) -> str:
    parts = []
    for i, (c, dtype) in enumerate(zip(columns, types)):
        lead = f"""SELECT {i} AS "position", '{c}' AS "column", '{dtype}' AS dtype, total, total - present AS missing_count,
          round((total - present)::DOUBLE * 100 / total, 4) AS missing_pct, cardinality"""
        base = f"(SELECT count(*) AS total, count({c}) AS present, count(DISTINCT {c}) AS cardinality FROM {table}) b"
        if c in numeric:
            parts.append(
                f"""{lead}, s.mean, s.std, s.min, s.q25, s.median, s.q75, s.max, o.outlier_count, o.outlier_pct,
                NULL::VARCHAR AS top, NULL::BIGINT AS freq
                FROM {base}, ({_numeric_sql(c, table)}) s, ({_outlier_sql(c, table)}) o"""
            )
        else:
            text = f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if dtype.startswith("timestamp") else c
            nulls = ", ".join(f"NULL::DOUBLE AS {n}" for n in PROFILE_COLUMNS[7:14])
            parts.append(
                f"""{lead}, {nulls}, NULL::BIGINT AS outlier_count, NULL::DOUBLE AS outlier_pct, k.top, k.freq
                FROM {base}, ({_top_sql(c, table, text)}) k"""
            )
    return union(parts)


def _flat_profile(df):
    digits = {"missing_pct", "mean", "std", "q25", "median", "q75", "outlier_pct"}
    return df.select(*[rounded(c) if c in digits else F.col(c) for c in PROFILE_COLUMNS])


@query("p18_profile_lineitem", _profile_sql("lineitem", LINEITEM, LINEITEM_TYPES, LINEITEM_NUMERIC))
def p18(t: Tables):
    return _flat_profile(profile.column_profile(t("lineitem")))


@query(
    "p18_profile_with_gaps",
    f"WITH {LABELLED_CTE} "
    + _profile_sql(
        "labelled",
        LABELLED,
        ["bigint", "string", "string", "string", "bigint", "int", "int"],
        ["doc_id", "n_chars", "quality", "toxic"],
    ),
)
def p18_gaps(t: Tables):
    return _flat_profile(profile.column_profile(documents_with_labels(t)))


@query(
    "p18_table_profile",
    f"""WITH {LABELLED_CTE}, m AS (SELECT count(*) AS n, {' + '.join(f'(count(*) - count({c}))' for c in LABELLED)} AS m,
      sum(8 + 8 + 4 + 4 + coalesce(strlen(text), 0) + strlen(lang) + strlen(source)) AS bytes FROM labelled)
    SELECT n AS "rows", 7::BIGINT AS "columns", 0::BIGINT AS duplicate_rows, m::BIGINT AS total_missing,
      round(m::DOUBLE * 100 / (n * 7), 4) AS overall_missing_pct, round(bytes::DOUBLE / 1048576, 4) AS memory_mb FROM m""",
)
def p18_table(t: Tables):
    found = profile.table_profile(documents_with_labels(t))
    return found.select(
        "rows", "columns", "duplicate_rows", "total_missing", rounded("overall_missing_pct"), rounded("memory_mb")
    )


@query(
    "p19_value_counts",
    union(
        [
            f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS \"value\", count(*) AS n FROM lineitem GROUP BY {c}"
            for c in LINEITEM
        ]
    ),
)
def p19(t: Tables):
    return profile.value_counts(t("lineitem"))


@query(
    "p20_profile_by",
    union(
        [
            *[_numeric_sql(c, "lineitem", "l_linestatus, l_returnflag") for c in LINEITEM_NUMERIC],
            """SELECT l_linestatus, l_returnflag, 'l_shipdate', NULL, NULL, NULL, NULL, NULL, NULL, NULL
      FROM lineitem GROUP BY l_linestatus, l_returnflag""",
        ]
    ),
)
def p20(t: Tables):
    found = profile.profile_by(t("lineitem"), ["l_linestatus", "l_returnflag"])
    return _rounded_stats(
        found, "l_linestatus", "l_returnflag", "column", "mean", "std", "min", "q25", "median", "q75", "max"
    )


@query(
    "p20_profile_by_user",
    """SELECT user_id, 'value' AS "column", count(*) AS total, count(DISTINCT value) AS cardinality,
      round(quantile_cont(value, 0.5), 4) AS median FROM events GROUP BY user_id""",
)
def p20_user(t: Tables):
    found = profile.profile_by(t("events").select("user_id", "value"), "user_id")
    return found.select("user_id", "column", "total", "cardinality", rounded("median"))


@query(
    "p18_profile_documents",
    _profile_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"], ["bigint", "string", "string", "string", "bigint"], ["doc_id", "n_chars"]),
)
def p18_documents(t: Tables):
    return _flat_profile(profile.column_profile(t("documents")))


@query(
    "p18_decimals",
    """WITH d AS (SELECT CAST(p_partkey AS HUGEINT) * 9007199254740993 AS d FROM part)
    SELECT 'd' AS "column", count(DISTINCT d) AS cardinality, count(*) AS total FROM d""",
)
def p18_decimals(t: Tables):
    d = (F.col("p_partkey").cast("decimal(18,0)") * F.lit(9007199254740993).cast("decimal(19,0)")).cast("decimal(38,0)")
    return profile.column_profile(t("part").select(d.alias("d"))).select("column", "cardinality", "total")


@query(
    "p19_long_values",
    "SELECT 'text' AS \"column\", text AS \"value\", count(*) AS n FROM documents GROUP BY text",
)
def p19_long(t: Tables):
    return profile.value_counts(t("documents"), ["text"])


NULL_KEY = "CASE WHEN l_linestatus = 'O' THEN 'O' END"


@query(
    "p20_null_key",
    f"""WITH d AS (SELECT {NULL_KEY} AS k, l_quantity AS q, NULL::DOUBLE AS gone FROM lineitem)
    SELECT k, 'q' AS "column", count(*) AS total, 0::BIGINT AS missing_count, round(avg(q), 4) AS mean,
      round(quantile_cont(q::DOUBLE, 0.5), 4) AS median FROM d GROUP BY k
    UNION ALL SELECT k, 'gone', count(*), count(*), NULL, NULL FROM d GROUP BY k""",
)
def p20_null_key(t: Tables):
    df = t("lineitem").select(
        F.when(F.col("l_linestatus") == "O", "O").alias("k"), F.col("l_quantity").alias("q"), F.lit(None).cast("double").alias("gone")
    )
    found = profile.profile_by(df, "k")
    return found.select("k", "column", "total", "missing_count", rounded("mean"), rounded("median"))


_CARDINALITIES = union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS cardinality FROM lineitem" for c in LINEITEM])


@query(
    "p18_full_report",
    f"""WITH target AS ({candidates_sql('lineitem', LINEITEM)}),
    pairs AS (SELECT * FROM ({union([_corr_sql(a, b, 'lineitem') for a, b in _PAIRS])}) ORDER BY abs(r) DESC LIMIT 10)
    SELECT 'table' AS part, 'rows' AS name, count(*)::DOUBLE AS figure FROM lineitem
    UNION ALL SELECT 'columns', "column", cardinality::DOUBLE FROM (
      {_CARDINALITIES})
    UNION ALL SELECT 'correlations', column_a || ',' || column_b, r FROM pairs
    UNION ALL SELECT 'targets', "column", score FROM target
    UNION ALL SELECT 'balance', l_linestatus::VARCHAR, count(*)::DOUBLE FROM lineitem
      WHERE (SELECT first("column") FROM target) = 'l_linestatus' GROUP BY l_linestatus
    UNION ALL SELECT 'balance', l_returnflag::VARCHAR, count(*)::DOUBLE FROM lineitem
      WHERE (SELECT first("column") FROM target) = 'l_returnflag' GROUP BY l_returnflag
    UNION ALL SELECT 'balance', l_linenumber::VARCHAR, count(*)::DOUBLE FROM lineitem
      WHERE (SELECT first("column") FROM target) = 'l_linenumber' GROUP BY l_linenumber""",
)
def p18_full(t: Tables):
    report = profile.profile(t("lineitem"))
    row = lambda part, name, figure: (F.lit(part).alias("part"), name.alias("name"), figure.cast("double").alias("figure"))
    pair = F.concat_ws(",", "column_a", "column_b")
    parts = [
        report["table"].select(*row("table", F.lit("rows"), F.col("rows"))),
        report["columns"].select(*row("columns", F.col("column"), F.col("cardinality"))),
        report["correlations"].select(*row("correlations", pair, F.round("r", 6))),
        report["target_candidates"].select(*row("targets", F.col("column"), F.col("score"))),
        report["class_balance"].select(*row("balance", F.col("value"), F.col("count"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- advice -------------------------------------------------------------------------------


@query(
    "q1_preprocess_findings",
    f"""WITH {LABELLED_CTE}, m AS (SELECT count(*) AS n, {', '.join(f'count({c}) AS n_{c}' for c in LABELLED)} FROM labelled),
    c AS ({union([f"SELECT '{c}' AS subject, (n - n_{c})::DOUBLE * 100 / n AS pct, {c in ('doc_id', 'n_chars', 'quality', 'toxic')} AS num FROM m" for c in LABELLED])})
    SELECT 'table' AS subject, 'missing_values' AS rule, CASE WHEN (SELECT avg(pct) FROM c) > 1
      THEN 'drop columns above 50% missing' ELSE 'impute mean or median, mode' END AS action
    UNION ALL SELECT subject, 'missing_values', CASE WHEN pct > 50 THEN 'drop column' WHEN num THEN 'impute median'
      ELSE 'impute mode' END FROM c WHERE pct > 0
    UNION ALL SELECT subject, 'feature_scaling', 'standard or min-max scale' FROM c WHERE num
    UNION ALL SELECT 'file', 'encoding', 'utf-8, Comma'""",
)
def q1(t: Tables):
    return advice.preprocess_findings(documents_with_labels(t), "utf-8", "Comma")


@query(
    "q2_model_findings",
    f"""WITH target AS ({candidates_sql('embeddings', ['vec_id', 'embedding', 'label'], 1)})
    SELECT "column" AS subject, unnest(['task', 'model', 'model', 'model', 'validation']) AS rule,
      unnest([inferred_task, 'linear baseline', 'gradient-boosted trees', 'random forest',
        CASE WHEN contains(lower(inferred_task), 'classification') THEN 'stratified k-fold' ELSE 'k-fold, k=5' END]) AS action
    FROM target""",
)
def q2(t: Tables):
    return advice.model_findings(t("embeddings"))


@query(
    "q3_leakage_findings",
    """WITH p AS (SELECT p_partkey AS id_part, p_size, p_retailprice, p_retailprice * 2 + 1 AS twice FROM part)
    SELECT 'id_part' AS subject, 'identifier_name' AS rule, 'exclude' AS action
    UNION ALL SELECT c, 'target_correlation', 'exclude' FROM (
      SELECT 'id_part' AS c, corr(id_part, p_retailprice) AS r FROM p
      UNION ALL SELECT 'p_size', corr(p_size, p_retailprice) FROM p
      UNION ALL SELECT 'twice', corr(twice, p_retailprice) FROM p) WHERE abs(r) >= 0.99""",
)
def q3(t: Tables):
    df = t("part").select(
        F.col("p_partkey").alias("id_part"),
        "p_size",
        "p_retailprice",
        (F.col("p_retailprice") * 2 + 1).alias("twice"),
        "p_name",
    )
    return advice.leakage_findings(df, "p_retailprice")


@query(
    "q4_summary_findings",
    f"""WITH {LABELLED_CTE}, target AS ({candidates_sql('labelled', LABELLED, 1)}),
    m AS (SELECT count(*) AS n, {' + '.join(f'(count(*) - count({c}))' for c in LABELLED)} AS m FROM labelled)
    SELECT n AS "rows", 7::BIGINT AS "columns", "column" AS target, inferred_task AS task, m::BIGINT AS total_missing,
      0::BIGINT AS duplicate_rows FROM m, target""",
)
def q4(t: Tables):
    found = advice.summary_findings(documents_with_labels(t))
    return found.select("rows", "columns", "target", "task", "total_missing", "duplicate_rows")


@query(
    "q5_profile_digest",
    f"""WITH target AS ({candidates_sql('embeddings', ['vec_id', 'embedding', 'label'])})
    SELECT 'embeddings.parquet' AS filename, (SELECT count(*) FROM embeddings) AS "rows", 3::BIGINT AS "columns",
      0::BIGINT AS duplicates, 'vec_id,embedding,label' AS columns_list,
      (SELECT string_agg("column" || ':' || inferred_task, ',' ORDER BY score DESC) FROM target) AS candidates,
      'label' AS balance_column, (SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM (
        SELECT label::VARCHAR AS v, count(*) AS n FROM embeddings GROUP BY label)) AS balance""",
)
def q5(t: Tables):
    found = advice.profile_digest(t("embeddings"), "embeddings.parquet")
    candidates = F.transform("target_candidates", lambda c: F.concat(c["column"], F.lit(":"), c["inferred_task"]))
    balance = F.transform("class_balance", lambda b: F.concat(b["value"], F.lit("="), b["count"].cast("string")))
    return found.select(
        "filename",
        "rows",
        "columns",
        "duplicates",
        F.array_join("columns_list", ",").alias("columns_list"),
        F.array_join(candidates, ",").alias("candidates"),
        "balance_column",
        F.array_join(balance, ",").alias("balance"),
    )


@query(
    "q6_clean",
    f"""WITH {LABELLED_CTE}, d AS (SELECT DISTINCT CASE WHEN doc_id % 4 <> 0 THEN lang END AS lang, source,
      CASE WHEN doc_id % 3 <> 0 THEN n_chars % 100 END AS n FROM labelled),
    mode AS (SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)
    SELECT coalesce(lang, (SELECT lang FROM mode)) AS lang, source,
      coalesce(n::DOUBLE, (SELECT quantile_cont(n::DOUBLE, 0.5) FROM d)) AS n FROM d""",
)
def q6(t: Tables):
    df = documents_with_labels(t).select(
        F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"),
        "source",
        F.when(F.col("doc_id") % 3 != 0, F.col("n_chars") % 100).alias("n"),
        "quality",
    )
    return advice.clean(df.withColumn("quality", F.when(F.col("n") == -1, F.col("quality"))))
