from pyspark.sql import Window
from pyspark.sql import functions as F

from datascout.operators import groups


def test_running_sum_is_the_same_ranged(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("t"), (F.col("id") % 5).alias("n"), (F.col("id") % 2).alias("k"))
    for within in ([], ["k"]):
        window = Window.partitionBy(*within).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
        one = df.withColumn("s", F.coalesce(F.sum("n").over(window), F.lit(0))).collect()
        ranged = groups.running_sum(df, ["t", "id"], F.col("n"), "s", within).collect()
        assert sorted(map(tuple, one)) == sorted(map(tuple, ranged))
    expected, total = {}, 0
    for t, i, n in sorted((i % 7, i, i % 5) for i in range(500)):
        expected[i], total = total, total + n
    assert {r["id"]: r["s"] for r in groups.running_sum(df, ["t", "id"], F.col("n"), "s").collect()} == expected


def test_hash_index_is_a_fixed_permutation(spark):
    df = spark.range(300)
    a = {r["id"]: r["row_index"] for r in groups.hash_index(df, ["id"], seed=1, digits=1).collect()}
    b = {r["id"]: r["row_index"] for r in groups.hash_index(df.repartition(7), ["id"], seed=1).collect()}
    c = {r["id"]: r["row_index"] for r in groups.hash_index(df, ["id"], seed=2).collect()}
    assert a == b != c and sorted(a.values()) == list(range(300))


def test_shared_folder_comes_from_the_session(spark):
    from datascout import runtime

    path = runtime.scratch_path(spark, "x")
    assert path.startswith(runtime.shared_dir(spark)) and path != runtime.scratch_path(spark, "x")
