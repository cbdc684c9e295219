import math

import pytest
from pyspark.sql import functions as F

from datascout.operators import advice, prep


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, 1.0, "b", None), (2, None, "a", True), (3, float("nan"), None, False), (4, 10.0, "b", True), (None, 3.0, "c", True)]
    return spark.createDataFrame(rows, "n bigint, x double, s string, f boolean")


def test_impute(table):
    rows = prep.impute_median(table).collect()
    assert [r["x"] for r in rows] == [1.0, 3.0, 3.0, 10.0, 3.0] and rows[4]["n"] == 2.5
    rows = prep.impute(table).collect()
    assert rows[2]["s"] == "b" and rows[0]["f"] is True


def test_scale_uses_population_deviation_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    assert [tuple(r) for r in prep.standard_scale(df, ["x", "k"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    fitted = prep.scaling(df, ["x"])
    other = spark.createDataFrame([(5.0, 1.0)], "x double, k double")
    assert prep.standard_scale(other, ["x"], fitted).first()["x"] == 3.0


def test_split_is_fixed_and_exact_on_request(spark):
    df = spark.range(101)
    a = {r["id"]: r["split"] for r in prep.train_test_split(df, "id").collect()}
    b = {r["id"]: r["split"] for r in prep.train_test_split(df.repartition(3), "id").collect()}
    assert a == b and 5 < sum(v == "test" for v in a.values()) < 40
    exact = prep.train_test_split(df, "id", exact=True).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in exact} == {"test": math.ceil(0.2 * 101), "train": 80}


def test_batches_are_full_but_the_last(spark):
    sizes = [r["count"] for r in prep.batches(spark.range(100), "id").groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [32, 32, 32, 4]


def test_encode_in_value_order(spark, table):
    assert [r["s"] for r in prep.encode_categories(table).collect()].count(None) == 1
    got = {r["s"]: r["c"] for r in prep.encode_categories(table.withColumn("c", F.col("s")), ["c"]).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, None: None}
    many = spark.range(200).select(F.format_string("v%03d", "id").alias("value"))
    ranged = {r["value"]: r["code"] for r in prep.category_codes(many, "value").collect()}
    assert ranged == {f"v{i:03d}": i for i in range(200)}


def test_features_fill_and_objective(table):
    assert prep.features_and_target(table, "s").columns == ["n", "x", "s"]
    assert prep.features_and_target(table, "absent").columns == ["n", "x"]
    filled = prep.fill_missing_label(table).collect()
    assert filled[2]["s"] == "missing" and filled[1]["x"] is None
    assert prep.choose_objective(table, "f") == "binary" and prep.choose_objective(table, "s") == "multiclass"
    assert prep.preview(table).count() == 5


def test_baselines_learn(spark):
    df = spark.range(300).select(
        (F.rand(1) * 10).alias("x"), F.rand(2).alias("noise"), F.col("id").alias("id")
    ).withColumn("y", (F.col("x") > 5).cast("int")).withColumn("z", F.floor(F.col("x") / 4).cast("int"))
    split = prep.train_test_split(df, "id").drop("id").cache()
    train, test = (split.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    forest = prep.fit_baseline(train.drop("z"), test.drop("z"), "y", trees=5).first()
    assert forest["metric"] == "accuracy" and forest["value"] > 0.9
    boosted = prep.fit_boosted(train.drop("z"), test.drop("z"), "y", rounds=3).first()
    assert boosted["metric"] == "logLoss" and boosted["value"] < 0.5
    three = prep.fit_boosted(train.drop("y"), test.drop("y"), "z", rounds=2).first()
    assert three["objective"] == "multiclass" and three["value"] > 0.9


def test_findings(spark, table):
    found = {tuple(r) for r in advice.preprocess_findings(table.withColumn("gone", F.lit(None).cast("double"))).collect()}
    assert ("table", "missing_values", "drop columns above 50% missing") in found
    assert ("gone", "missing_values", "drop column") in found and ("s", "missing_values", "impute mode") in found
    assert ("x", "missing_values", "impute median") in found and not any(f[1] == "duplicate_rows" for f in found)
    doubled = {tuple(r) for r in advice.preprocess_findings(table.select("n").union(table.select("n"))).collect()}
    assert ("table", "duplicate_rows", "drop duplicates") in doubled
    none = advice.model_findings(spark.createDataFrame([(1, 2.0)], "a int, b double")).collect()
    assert {(r["rule"], r["action"]) for r in none} >= {("task", "General Tabular"), ("validation", "k-fold, k=5")}
    assert none[0]["subject"] == "None detected"


def test_leakage_and_clean(spark, table):
    df = spark.range(30).select(F.col("id").alias("uuid_x"), (F.col("id") * 2.0).alias("twin"), F.rand(1).alias("r"), F.col("id").alias("y"))
    found = {(r["subject"], r["rule"]) for r in advice.leakage_findings(df, "y").collect()}
    assert found == {("uuid_x", "identifier_name"), ("uuid_x", "target_correlation"), ("twin", "target_correlation")}
    dirty = table.union(table).withColumn("gone", F.lit(None).cast("double"))
    cleaned = advice.clean(dirty)
    assert cleaned.columns == table.columns and cleaned.count() == 5
    assert cleaned.where("n is null or x is null or s is null or f is null").count() == 0


def test_baselines_take_gaps_and_any_two_labels(spark):
    df = spark.range(200).select(
        F.col("id"), F.when(F.col("id") % 10 != 0, F.col("id") % 7).alias("x"), (1 + (F.col("id") % 7 > 3).cast("int")).alias("y"),
        (F.col("id") % 7 * 10 + F.col("id") / 1000).alias("z"),
    )
    train, test = df.where("id % 4 > 0").drop("id"), df.where("id % 4 = 0").drop("id")
    forest = prep.fit_baseline(train.drop("z"), test.drop("z"), "y", trees=5).first()
    assert forest["objective"] == "classification" and forest["value"] > 0.8
    assert prep.fit_baseline(train.drop("y"), test.drop("y"), "z", trees=5).first()["objective"] == "regression"
    boosted = prep.fit_boosted(train.drop("z"), test.drop("z"), "y", rounds=3).first()
    assert boosted["objective"] == "binary" and boosted["value"] < 0.6


def test_training_rows_are_dealt_evenly(spark, monkeypatch):
    rows = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"), F.lit("x").alias("y")).coalesce(1)
    assert prep._dealt(rows, rows, "y").rdd.getNumPartitions() == 1
    monkeypatch.setattr(prep, "TASK_CELLS", 100)
    dealt = prep._dealt(rows, rows, "y")
    assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) <= 60
    assert sorted(r["a"] for r in dealt.collect()) == list(range(1000))
