import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from datascout.operators import profile
from datascout.operators import quantiles as Q


def by_column(df, *keys):
    return {tuple(r[k] for k in (*keys, "column")) if keys else r["column"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def example(spark):
    rows = [(20, 50000, "no", 1), (21, 55000, "yes", 2), (22, 60000, "yes", 3), (23, 65000, "no", 4), (100, 70000, "yes", 5)]
    return spark.createDataFrame(rows, "age bigint, salary bigint, label string, ignored_id bigint")


def test_example_profile(example):
    report = profile.profile(example)
    table = report["table"].first()
    assert (table["rows"], table["columns"], table["error"]) == (5, 4, None)
    columns = by_column(report["columns"])
    assert columns["age"]["outlier_count"] == 1
    assert [r["column"] for r in report["target_candidates"].collect()] == ["label"]
    balance = {r["value"]: (r["column"], r["count"], r["percentage"]) for r in report["class_balance"].collect()}
    assert balance == {"no": ("label", 2, 40.0), "yes": ("label", 3, 60.0)}


def _frame(seed, n):
    rng = random.Random(seed)
    hole = lambda x, p=0.2: None if rng.random() < p else x
    return pd.DataFrame(
        {
            "a": [hole(rng.gauss(0, 10)) for _ in range(n)],
            "b": [rng.choice([1.0, 2.0, float("nan"), 1e9]) for _ in range(n)],
            "c": pd.array([hole(rng.randrange(5)) for _ in range(n)], dtype="Int64"),
            "const": [7] * n,
            "none": [None] * n,
            "s": [hole(rng.choice(["x", "y", "zz"])) for _ in range(n)],
        }
    )


DDL = "a double, b double, c bigint, const bigint, none double, s string"


def to_spark(spark, pdf):
    rows = [tuple(None if v is pd.NA else v for v in r) for r in pdf.astype(object).itertuples(index=False)]
    rows = [tuple(None if v is None or (isinstance(v, float) and math.isnan(v) and i != 1) else v for i, v in enumerate(r)) for r in rows]
    return spark.createDataFrame(rows, DDL)


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 2), (3, 40), (4, 300)])
def test_numeric_figures_match_pandas(spark, seed, n):
    pdf = _frame(seed, n)
    got = by_column(profile.column_profile(to_spark(spark, pdf)))
    for name in ["a", "b", "c", "const", "none"]:
        values = pd.to_numeric(pdf[name]).astype("float64")
        row = got[name]
        assert row["missing_count"] == int(values.isna().sum()) and row["cardinality"] == values.nunique()
        desc = values.describe()
        q1, q3 = desc["25%"], desc["75%"]
        expected = {
            "mean": desc["mean"], "std": desc["std"], "min": desc["min"], "q25": q1, "median": desc["50%"], "q75": q3,
            "max": desc["max"],
        }
        for k, e in expected.items():
            assert (row[k] is None) == bool(np.isnan(e)), (name, k)
            assert row[k] is None or row[k] == pytest.approx(e, rel=1e-9), (name, k)
        if values.notna().any():
            outside = ((values < q1 - 1.5 * (q3 - q1)) | (values > q3 + 1.5 * (q3 - q1))).sum()
            assert row["outlier_count"] == outside and row["outlier_pct"] == pytest.approx(outside / n * 100)
        else:
            assert row["outlier_count"] is None


@pytest.mark.parametrize("seed", [3, 4])
def test_missing_duplicates_and_correlations_match_pandas(spark, seed):
    pdf = _frame(seed, 60)
    pdf = pd.concat([pdf, pdf.head(7), pdf.head(3)])
    df = to_spark(spark, pdf)
    row = profile.duplicate_stats(df).first()
    assert row["duplicate_rows"] == pdf.astype(object).where(pdf.notna(), None).duplicated().sum()
    total = int(pdf.isna().sum().sum())
    overall = profile.overall_missing(df).first()
    assert overall["total_missing"] == total
    assert overall["overall_missing_pct"] == pytest.approx(total / pdf.size * 100)
    assert {k: r["missing_count"] for k, r in by_column(profile.missing(df)).items()} == pdf.isna().sum().to_dict()
    numbers = ["a", "b", "c", "const", "none"]
    corr = pdf[numbers].apply(lambda s: pd.to_numeric(s).astype("float64")).corr().fillna(0)
    got = {(r["column_a"], r["column_b"]): r["r"] for r in profile.correlation_matrix(df).collect()}
    assert set(got) == {(x, y) for x in numbers for y in numbers}
    for (x, y), r in got.items():
        assert r == pytest.approx(corr.loc[x, y], abs=1e-9), (x, y)
    top = profile.top_correlations(df, 3).collect()
    assert len(top) == 3 and abs(top[0]["r"]) >= abs(top[1]["r"])


def test_correlation_far_from_zero_and_shifted_constant(spark):
    df = spark.range(500).select(
        (F.col("id") + 1e9).alias("x"), (F.col("id") * -2 + 3e9).alias("y"), F.lit(1e15).alias("k"),
        F.when(F.col("id") < 10, 5e7).when(F.col("id") < 20, 1.0 * F.col("id")).alias("part"),
        F.when(F.col("id") < 10, 1.0 * F.col("id")).alias("head"),
    )
    got = {(r["column_a"], r["column_b"]): r["r"] for r in profile.correlation_matrix(df).collect()}
    assert got["x", "y"] == pytest.approx(-1.0, abs=1e-9)
    assert got["x", "k"] == 0.0 and got["k", "k"] == 0.0
    assert got["part", "head"] == 0.0  # constant where both are present


def test_single_numeric_column_has_no_matrix(spark):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    assert profile.correlation_matrix(df).count() == 0 and profile.top_correlations(df).count() == 0


def test_nulls_keep_columns_apart_in_duplicates(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, "a"), ("", "a"), ("a", "")], "x string, y string")
    assert profile.duplicate_stats(df).first()["duplicate_rows"] == 1


def test_nested_types(spark):
    df = spark.sql(
        "select * from values (1.50BD, timestamp'2020-01-01', true, array(1,2), map('a',1,'b',2)),"
        " (1.5BD, timestamp'2020-01-01', true, array(1,2), map('b',2,'a',1)),"
        " (2.5BD, null, false, array(2,1), null) as t(d, t, f, l, m)"
    )
    got = by_column(profile.column_profile(df))
    assert {k: r["cardinality"] for k, r in got.items()} == {"d": 2, "t": 1, "f": 2, "l": 2, "m": 1}
    assert got["d"]["mean"] == pytest.approx(11 / 6) and got["f"]["top"] == "true" and got["f"]["freq"] == 2
    assert got["t"]["top"] == "2020-01-01 00:00:00"
    assert profile.duplicate_stats(df.drop("m")).first()["duplicate_rows"] == 1
    assert profile.footprint(df).first()["memory_bytes"] > 0


def test_big_integers_stay_apart(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,)], "x bigint")
    assert profile.cardinality(df).first()["cardinality"] == 2


def test_long_text_is_counted_and_shown_whole(spark):
    base = "é" * 300
    rows = [(base + "a",), (base + "b",), (base + "b",), ("short",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    row = profile.categorical_summary(df).first()
    assert (row["count"], row["unique"], row["top"], row["freq"]) == (4, 3, base + "b", 2)


def test_all_missing_text_and_empty_table(spark):
    df = spark.createDataFrame([(None,), (None,)], "t string")
    row = profile.categorical_summary(df).first()
    assert (row["count"], row["unique"], row["top"], row["freq"]) == (0, 0, "N/A", 0)
    assert profile.shape(df.where("false")).first()["error"] == "Dataset is empty."


def test_target_rules(spark):
    df = spark.range(100).select(
        F.col("id").alias("y"), (F.col("id") % 3).alias("kind"), F.col("id").alias("subclass"), (F.col("id") % 16).alias("last")
    )
    rows = [(r["column"], r["score"], r["inferred_task"]) for r in profile.target_candidates(df, 10).collect()]
    assert rows == [
        ("y", 50.0, "Regression / High Cardinality"), ("subclass", 50.0, "Regression / High Cardinality"), ("kind", 30.0, "Classification"),
    ]
    assert profile.class_balance(df).count() == 0  # 100 values are too many
    assert profile.default_target(df) == "y"
    small = df.where("id < 19") if "id" in df.columns else df.where("y < 19")
    assert [r["column"] for r in profile.target_candidates(small, 10).collect()] == ["y", "subclass"]


def test_targets_count_no_more_values_than_they_need(spark, monkeypatch):
    n = 600
    df = spark.range(n, numPartitions=3).select(
        (F.col("id") % 30).alias("thirty"), (F.col("id") % 31).cast("string").alias("label"), F.col("id").alias("id_target"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 15).cast("decimal(9,2)")).alias("fifteen"),
        F.expr("case id % 4 when 0 then 0d when 1 then -0d when 2 then double('nan') end").alias("zero"),
        F.lit(None).cast("string").alias("class"), F.col("id").alias("last"),
    )
    counted = []
    plain = profile._typed_counts
    monkeypatch.setattr(profile, "_typed_counts", lambda df, names, keys=(): counted.append(list(names)) or plain(df, names, keys))
    figures = {r["ci"]: r for r in profile._bounded_counts(profile.nan_to_null(df), df.columns).collect()}
    assert counted == [["thirty", "fifteen", "zero", "class"]]
    assert [figures[i]["cardinality"] for i in (0, 3, 4, 5)] == [30, 12, 1, 0]
    assert all(figures[i]["cardinality"] >= profile.MANY for i in (1, 2, 6))
    assert [figures[i]["missing_count"] for i in range(7)] == [0, 0, 0, 120, 300, 600, 0]
    got = [tuple(r) for r in profile.target_candidates(df, 9).collect()]
    assert got == [
        ("label", 50.0, "Regression / High Cardinality", 31), ("id_target", 50.0, "Regression / High Cardinality", 600),
        ("class", 50.0, "Classification", 0), ("fifteen", 30.0, "Classification", 12),
    ]
    counted.clear()
    assert profile.default_target(df) == "label" and profile.class_balance(df).count() == 0
    assert profile.class_balance(df, "id_target").count() == 0
    assert not any({"label", "id_target", "last"} & set(names) for names in counted)
    assert {r["count"] for r in profile.class_balance(df, "thirty").collect()} == {20}
    assert profile.class_balance(df, "label", max_classes=31).count() == 31
    assert profile.target_candidates(df.limit(0)).count() == 0 and profile.class_balance(df.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["spread", "hot", "tiny", "powers"])
def test_quantiles_are_exact(spark, shape):
    n = 5000
    value = {
        "spread": F.rand(7) * 1e6 - 3e5,
        "hot": F.when(F.col("id") % 3 == 0, 42.0).otherwise(F.rand(8) * 100),
        "tiny": 5.0 + F.col("id") * 1e-12,
        "powers": F.pow(F.lit(10.0), (F.col("id") % 600) - 300.0),
    }[shape]
    long = spark.range(n).select((F.col("id") % 10 == 0).cast("int").alias("g"), value.alias("v")).cache()
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in Q.quantiles(long, ["g"], "v", probs).collect()}
    pdf = long.toPandas()
    for g, part in pdf.groupby("g"):
        expected = part["v"].quantile(probs).tolist()
        assert got[g] == pytest.approx(expected, rel=1e-12)


def test_quantiles_with_infinities(spark):
    rows = [(float("inf"),)] * 30 + [(float("-inf"),)] * 30 + [(float(i),) for i in range(100)]
    df = spark.createDataFrame(rows, "v double").withColumn("g", F.lit(1))
    q = Q.quantiles(df, ["g"], "v", [0.0, 0.5, 1.0]).first()["q"]
    assert q == [float("-inf"), 49.5, float("inf")]


def test_profile_by_matches_each_part(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), F.rand(1).alias("v"), (F.col("id") % 7).cast("string").alias("s"))
    df = df.cache()
    grouped = by_column(profile.profile_by(df, "k"), "k")
    for k in range(3):
        for name, row in by_column(profile.column_profile(df.where(F.col("k") == k).drop("k"))).items():
            other = grouped[k, name]
            for f in ("total", "cardinality", "mean", "std", "q25", "median", "q75", "outlier_count", "top", "freq"):
                assert other[f] == pytest.approx(row[f]) if isinstance(row[f], float) else other[f] == row[f]


def test_approximate_figures_are_close(spark):
    df = spark.range(20000).select(F.rand(3).alias("v"), (F.col("id") % 50).alias("m"))
    assert by_column(profile.cardinality(df, approx=True))["m"]["cardinality"] == pytest.approx(50, rel=0.1)
    assert by_column(profile.numeric_summary(df, approx=True))["v"]["median"] == pytest.approx(0.5, abs=0.02)


def test_null_keys_and_columns_without_values_keep_their_figures(spark):
    rows = [(None, 1.0, None), (None, 3.0, None), ("a", 5.0, None), ("a", None, None)]
    df = spark.createDataFrame(rows, "k string, v double, none double")
    got = by_column(profile.profile_by(df, "k"), "k")
    assert (got[None, "v"]["mean"], got[None, "v"]["median"], got[None, "v"]["outlier_count"]) == (2.0, 2.0, 0)
    assert (got["a", "v"]["median"], got["a", "v"]["missing_count"]) == (5.0, 1)
    assert got[None, "none"]["missing_count"] == 2 and got[None, "none"]["median"] is None
    assert by_column(profile.numeric_summary(df))["none"]["mean"] is None
    assert by_column(profile.outliers(df))["v"]["outlier_count"] == 0


def test_decimals_are_counted_exactly(spark):
    df = spark.sql("select cast(x as decimal(20,0)) d from values '9007199254740992', '9007199254740993', null t(x)")
    row = profile.column_profile(df).first()
    assert row["cardinality"] == profile.cardinality(df).first()["cardinality"] == 2
    assert row["missing_count"] == 1 and row["top"] is None and row["median"] == pytest.approx(9007199254740992.0)


def test_long_values_stay_whole(spark):
    long = ["x" * 170 + c for c in "aab"]
    df = spark.createDataFrame([(v,) for v in long], "s string")
    assert {(r["value"], r["n"]) for r in profile.value_counts(df).collect()} == {(long[0], 2), (long[2], 1)}
    assert {r["value"] for r in profile.class_balance(df, "s").collect()} == set(long)
    assert profile.categorical_summary(df).first()["top"] == long[0]


def test_one_sided_tables(spark):
    words, numbers = spark.createDataFrame([("a",)], "s string"), spark.createDataFrame([(1,)], "n int")
    assert profile.categorical_summary(numbers).count() == profile.numeric_summary(words).count() == profile.outliers(words).count() == 0
    assert profile.categorical_summary(numbers).columns == ["column", "count", "unique", "top", "freq"]
    from datascout.operators import advice, prep

    assert prep.impute_median(words).collect() == words.collect() and advice.clean(words).collect() == words.collect()
