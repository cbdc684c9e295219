"""Queries: training-set preparation."""

from pyspark.sql import functions as F

from datascout.operators import prep, profile
from datascout.plans.inputs import LABELLED_CTE, documents_with_labels
from datascout.plans.registry import Tables, query
from datascout.plans.work_profile import LINEITEM, candidates_sql


@query(
    "m1_impute_median",
    f"""WITH {LABELLED_CTE} SELECT doc_id::DOUBLE AS doc_id, text, lang, source, n_chars::DOUBLE AS n_chars,
    coalesce(quality, (SELECT quantile_cont(quality::DOUBLE, 0.5) FROM labelled))::DOUBLE AS quality,
    coalesce(toxic, (SELECT quantile_cont(toxic::DOUBLE, 0.5) FROM labelled))::DOUBLE AS toxic FROM labelled""",
)
def m1(t: Tables):
    return prep.impute_median(documents_with_labels(t))


@query(
    "m2_features_and_target",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem",
)
def m2(t: Tables):
    return prep.features_and_target(t("lineitem"), "l_returnflag")


@query(
    "m3_standard_scale",
    """SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem))
      / (SELECT stddev_pop(l_quantity) FROM lineitem), 4) + 0.0::DOUBLE AS l_quantity,
    round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem))
      / (SELECT stddev_pop(l_extendedprice) FROM lineitem), 4) + 0.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS one FROM lineitem""",
)
def m3(t: Tables):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.lit(7).alias("one"))
    scaled = prep.standard_scale(df, ["l_quantity", "l_extendedprice", "one"])
    return scaled.withColumns({c: F.round(c, 4) + 0.0 for c in ("l_quantity", "l_extendedprice")})


_SHARE = "('0x' || substr(md5('42|' || {k}), 1, 8))::BIGINT::DOUBLE / 4294967296"


@query(
    "m4_train_test_split",
    f"SELECT o_orderkey, CASE WHEN {_SHARE.format(k='o_orderkey')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM orders",
)
def m4(t: Tables):
    return prep.train_test_split(t("orders"), "o_orderkey").select("o_orderkey", "split")


@query(
    "m4_train_test_split_exact",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey)
      <= ceil(0.2 * (SELECT count(*) FROM orders)) THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def m4_exact(t: Tables):
    return prep.train_test_split(t("orders"), "o_orderkey", exact=True).select("o_orderkey", "split")


@query(
    "m5_encode_categories",
    """SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority,
    dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus FROM orders""",
)
def m5(t: Tables):
    return prep.encode_categories(t("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"))


@query(
    "m5_encode_names",
    """SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name,
    dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment FROM customer""",
)
def m5_names(t: Tables):
    return prep.encode_categories(t("customer").select("c_custkey", "c_name", "c_mktsegment"))


@query(
    "m6_fill_missing",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE lang END AS lang, source,
    CASE WHEN doc_id % 2 = 0 THEN NULL ELSE n_chars END AS n_chars FROM documents""",
)
def m6(t: Tables):
    df = t("documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"),
        "source",
        F.when(F.col("doc_id") % 2 != 0, F.col("n_chars")).alias("n_chars"),
    )
    return prep.fill_missing_label(df)


@query(
    "m7_objective",
    """SELECT c AS "column", CASE WHEN n <= 2 THEN 'binary' ELSE 'multiclass' END AS objective FROM (
      SELECT 'l_linestatus' AS c, count(DISTINCT l_linestatus) AS n FROM lineitem
      UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem)""",
)
def m7(t: Tables):
    df = t("lineitem")
    return prep.objective(df, "l_linestatus").unionByName(prep.objective(df, "l_returnflag"))


def _learning_table(t: Tables):
    """Rows whose label, like a tree, asks for the sides of two thresholds."""
    many = (F.col("l_quantity") > 25) & (F.col("l_discount") > 0.02)
    df = t("lineitem").withColumn("label", F.when(many, "many").otherwise("few"))
    split = prep.train_test_split(df, ["l_orderkey", "l_linenumber"])
    return [split.where(F.col("split") == s).drop("split") for s in ("train", "test")]


# Who ignores the features has at most the share of the larger class right; the rule as such errs nowhere.
_LEARNT = f"""SELECT '%s' AS objective, '%s' AS metric, count(*) AS test_rows,
    avg((l_quantity > 25 AND l_discount > 0.02)::INT) BETWEEN 0.2 AND 0.8 AS learnt
    FROM lineitem WHERE {_SHARE.format(k="l_orderkey || '|' || l_linenumber")} < 0.2"""


def _learnt(test, found, good):
    return found.select("objective", "metric", F.lit(test.count()).cast("bigint").alias("test_rows"), good.alias("learnt"))


@query("m8_fit_baseline", _LEARNT % ("classification", "accuracy"))
def m8(t: Tables):
    train, test = _learning_table(t)
    return _learnt(test, prep.fit_baseline(train, test, "label", trees=20), F.col("value") > 0.95)


@query("m9_fit_boosted", _LEARNT % ("binary", "logLoss"))
def m9(t: Tables):
    train, test = _learning_table(t)
    # Log loss of the class shares alone would be above 0.6.
    return _learnt(test, prep.fit_boosted(train, test, "label", rounds=5, depth=3), F.col("value") < 0.3)


@query("m10_pruned_read", "SELECT o_orderkey, o_totalprice FROM orders")
def m10(t: Tables):
    from datascout.sources.readers import read_table

    return read_table(t.spark, t.path("orders"), columns=["o_orderkey", "o_totalprice"])


@query("m11_preview", "SELECT least(5, count(*)) AS shown, least(5, count(*)) AS known FROM orders")
def m11(t: Tables):
    orders = t("orders")
    shown = prep.preview(orders)
    known = orders.join(F.broadcast(shown.select("o_orderkey")), "o_orderkey", "left_semi")  # five rows
    parts = shown.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(known.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    return parts.agg(F.sum("a").alias("shown"), F.sum("b").alias("known"))


@query(
    "m11_summarize",
    """SELECT count(c_acctbal) AS "count", round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std,
    min(c_acctbal) AS min, max(c_acctbal) AS max, count(DISTINCT c_custkey) AS customers FROM customer""",
)
def m11_summary(t: Tables):
    found = prep.summarize(t("customer"))

    def figure(name: str, column: str = "c_acctbal"):
        return F.first(F.when(F.col("summary") == name, F.col(column)), ignorenulls=True).cast("double")

    return found.agg(
        figure("count").cast("bigint").alias("count"),
        F.round(figure("mean"), 4).alias("mean"),
        F.round(figure("stddev"), 4).alias("std"),
        figure("min").alias("min"),
        figure("max").alias("max"),
        figure("count", "c_custkey").cast("bigint").alias("customers"),
    )


@query(
    "m12_batches",
    """SELECT c_custkey, (row_number() OVER (ORDER BY md5('7|' || c_custkey), c_custkey) - 1) // 32 AS batch_id
    FROM customer""",
)
def m12(t: Tables):
    return prep.batches(t("customer"), "c_custkey", seed=7).select("c_custkey", "batch_id")


def _first_candidate(table: str, columns: list[str]) -> str:
    return f'coalesce((SELECT "column" FROM ({candidates_sql(table, columns, 1)})), \'target\')'


@query(
    "m13_default_target",
    f"""SELECT {_first_candidate('lineitem', LINEITEM)} AS lineitem_target,
    {_first_candidate('embeddings', ['vec_id', 'embedding', 'label'])} AS embeddings_target,
    {_first_candidate('part', ['p_partkey', 'p_name'])} AS part_target""",
)
def m13(t: Tables):
    tables = {"lineitem": t("lineitem"), "embeddings": t("embeddings"), "part": t("part").select("p_partkey", "p_name")}
    rows = [
        profile.default_target_row(df).select(F.lit(name).alias("name"), "column") for name, df in tables.items()
    ]
    found = rows[0].unionByName(rows[1]).unionByName(rows[2])  # one row a table
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("column"))).alias(f"{name}_target")
    return found.agg(*map(pick, tables))
