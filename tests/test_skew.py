"""Heavy keys, clashing names and exact selection, each against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from datascout.operators import groups, ledger, prep, profile
from datascout.operators import quantiles as Q


def test_narrowed_quantiles_equal_sorting(spark):
    rng = random.Random(5)
    inf = float("inf")
    kinds = {
        "skewed": [rng.lognormvariate(0, 6) * rng.choice([-1, 1]) for _ in range(700)],
        "tied": [rng.choice([1.0, 2.0, 2.5]) for _ in range(600)],
        "wide": [-1.7e308, 1.7e308, 0.0, 1.0, 5e-324] * 20,
        "endless": [-inf, inf, 3.0, 4.0, -inf] * 3,
        "one": [7.0],
    }
    rows = [(k, v, rng.randint(1, 3)) for k, vs in kinds.items() for v in vs] + [(None, 2.0, 1), (None, 4.0, 1), ("none", None, 9)]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    # The key is named like the columns of the computation.
    counts = spark.createDataFrame(rows, "__bin string, v double, n int")
    got = {r["__bin"]: r["q"] for r in Q.counted_quantiles(counts, ["__bin"], "v", probs).collect()}
    assert set(got) == {*kinds, None}
    for key in got:
        values = sorted(v for k, v, n in rows if k == key and v is not None for _ in range(n))
        for p, q in zip(probs, got[key]):
            at = p * (len(values) - 1)
            low, high, part = values[int(at)], values[int(np.ceil(at))], at - int(at)
            expected = low if part == 0 else (1 - part) * low + part * high
            assert q == expected or (np.isnan(q) and np.isnan(expected)), (key, p)


def test_keys_named_like_figures(spark):
    rows = [(i % 2, float(i), f"t{i % 3}") for i in range(12)]
    for name in ("n", "ci", "vl", "total", "Mean", "__key0", "__g0"):
        df = spark.createDataFrame(rows, f"`{name}` int, x double, s string")
        out = profile.profile_by(df, name)
        key = f"key_{name}" if name in ("total", "Mean") else name
        found = {(r[key], r["column"]): r for r in out.collect()}
        assert (found[0, "x"]["mean"], found[1, "x"]["median"], found[0, "s"]["total"]) == (5.0, 6.0, 6)
        assert len(found) == 4
    counts = profile.value_counts(spark.createDataFrame(rows, "n int, value double, s string"), ["value"], ["n"])
    assert counts.columns == ["key_n", "column", "value", "n"] and counts.count() == 12


def test_a_row_repeated_very_often(spark):
    hot = spark.range(20_000).select(F.lit("same " * 20).alias("h"), F.lit(None).cast("int").alias("n"))
    rest = spark.range(3_000).select((F.col("id") % 2_000).cast("string").alias("h"), F.lit(1).alias("n"))
    row = profile.duplicate_stats(hot.union(rest)).first()
    assert (row["rows"], row["duplicate_rows"]) == (23_000, 19_999 + 1_000)
    assert profile.duplicate_stats(rest.limit(0)).first()["duplicate_rows"] == 0


def test_codes_with_a_hot_value_gaps_and_clashing_names(spark):
    value = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("v"), F.col("id")))
    df = spark.range(3_000).repartition(5).select(value.alias("__v0"), F.col("id").alias("code0"), value.alias("c1"), F.lit("x").alias("value"))
    got = prep.encode_categories(df)
    assert got.columns == df.columns
    names = sorted({"hot"} | {f"v{i}" for i in range(3_000) if i % 3 == 2})
    code = {v: i for i, v in enumerate(names)}
    rows = got.collect()
    assert len(rows) == 3_000
    for r in rows:
        i = r["code0"]
        expected = None if i % 3 == 0 else code["hot" if i % 3 == 1 else f"v{i}"]
        assert (r["__v0"], r["c1"], r["value"]) == (expected, expected, 0)
    assert prep.encode_categories(df.limit(0)).count() == 0


def test_spread_join_equals_the_plain_join(spark):
    key = F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("k")
    left = spark.range(2_000).repartition(7).select(key, F.col("id").alias("a"))
    right = spark.range(0, 2_000, 3).select((F.col("id") + 1).alias("k"), F.col("id").alias("b"))
    right = right.union(right.where("k < 50"))  # partners may repeat
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    heavy = groups.heavy_keys(counts, ["k"])
    assert [r["k"] for r in heavy.collect()] == [1]
    for how in ("inner", "left"):
        plain = left.join(right, "k", how).select("k", "a", "b").collect()
        spread = groups.spread_join(left, right, ["k"], heavy, how).collect()
        order = lambda rows: sorted(map(str, rows))
        assert order(plain) == order(spread)


def test_batches_keep_columns_named_like_helpers(spark):
    df = spark.range(70).select("id", *[(F.col("id") * 2).alias(c) for c in ("__b", "__index", "__H", "__rn", "__n", "__offset")])
    got = prep.batches(df, "id")
    assert got.columns == [*df.columns, "batch_id"]
    assert all(r["__index"] == r["__b"] == r["__rn"] == 2 * r["id"] for r in got.collect())
    assert prep.train_test_split(df, "id", exact=True).columns == [*df.columns, "split"]


def test_eviction_equals_summing_all_in_order(spark):
    rng = random.Random(3)
    for cap in (0, 900, 2_500, 4_000, 10**9):
        rows = []
        for i in range(400):
            at = None if i % 50 == 0 else 5.0 if i % 3 == 0 else float(rng.randint(0, 300))
            rows.append((f"id{i:04d}", at, rng.choice([0, 5, 20, None]), rng.random() < 0.9))
        table = spark.createDataFrame(rows, "id string, downloaded_at double, actual_size bigint, path_exists boolean")
        size = lambda r: (r[2] or 0) if r[3] else 0
        total, prior, expected = sum(map(size, rows)), 0, set()
        for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0])):
            if r[3] and total - prior > cap:
                expected.add(r[0])
            prior += size(r)
        plan = ledger.eviction_plan(table, cap)
        assert {r["id"] for r in plan.where("evict").collect()} == expected and plan.count() == 400
    assert ledger.eviction_plan(table.limit(0), 0).count() == 0
