import random
from decimal import Decimal

from pyspark.sql import functions as F

from datascout.functions import text


def _python_size(n):
    if n is None or n < 0:
        return "Unknown"
    value = float(n)
    for unit in ["B", "KB", "MB", "GB", "TB"]:
        if value < 1024.0:
            return f"{value:.1f} {unit}"
        value /= 1024.0
    return f"{value:.1f} PB"


def test_format_size_matches_python(spark):
    rng = random.Random(3)
    sizes = [None, -1, 0, 1, 1023, 1024, 1280, 1331, 1792, 1048575, 1048576, 5 * 1024**5, 2**53]
    sizes += [rng.randrange(2 ** rng.randrange(1, 53)) for _ in range(500)]
    sizes += [1024 * k + 64 * j for k in range(1, 6) for j in range(16)]
    df = spark.createDataFrame([(s,) for s in sizes], "s bigint")
    got = [r[0] for r in df.select(text.format_size(F.col("s"))).collect()]
    assert got == [_python_size(s) for s in sizes]


def test_format_size_beyond_64_bits(spark):
    def exact(s):
        tenths, rest = divmod(10 * s, 1024**5)
        tenths += 2 * rest > 1024**5 or (2 * rest == 1024**5 and tenths % 2 == 1)
        return f"{tenths // 10}.{tenths % 10} PB"

    rng = random.Random(5)
    sizes = [2**63 - 1, 2**63, 2**63 + 2**46, 2**64 + 2**49, 3 * 2**70 + 2**49, 3 * 8_999_994**3, 10**37]
    sizes += [rng.randrange(2**60, 2 ** rng.randrange(62, 120)) for _ in range(300)]
    sizes += [1024**5 * k + 1024**5 // 20 * j for k in (10**4, 10**9) for j in range(20)]
    rows = [(Decimal(s),) for s in sizes] + [(Decimal(-(10**30)),), (None,), (Decimal(1536),)]
    df = spark.createDataFrame(rows, "s decimal(38,0)")
    got = [r[0] for r in df.select(text.format_size(F.col("s"))).collect()]
    assert got == [*map(exact, sizes), "Unknown", "Unknown", "1.5 KB"]
    longs = spark.createDataFrame([(2**63 - 1,), (-(2**63),)], "s bigint")
    assert [r[0] for r in longs.select(text.format_size(F.col("s"))).collect()] == ["8192.0 PB", "Unknown"]


def test_format_size_query_over_large_keys(spark, tmp_path):
    from datascout.plans import registry, work_filters  # noqa: F401

    keys = spark.createDataFrame([(0,), (7,), (9_000_000,), (None,)], "o_orderkey bigint")
    keys.write.parquet(f"{tmp_path}/orders.parquet")
    found = {r[0]: r[1] for r in registry.QUERIES["f11_format_size"](spark, str(tmp_path)).collect()}
    assert found == {0: "Unknown", 7: "24.0 B", 9_000_000: "1942443.0 PB", None: "Unknown"}


def test_parse_size(spark):
    cases = {
        "12 MB": 12 * 1024**2, "12MB": None, "7": 7, "x GB": None, "": None, "  ": None, "1.5 kb": 1536, "3 blocks": 3,
        "1e3 KB": 1024000, "2 TB more": 2 * 1024**4, ".5 KB": 512, "nan": None, "inf KB": None, "1_000 B": 1000, "-2 KB": -2048,
    }
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    assert [r[0] for r in df.select(text.parse_size(F.col("s"))).collect()] == list(cases.values())


def test_card_description(spark):
    df = spark.createDataFrame(
        [("see https://a.b/c now",), ("www.only.example",), (None,), ("x" * 300,)], "d string"
    )
    got = [r[0] for r in df.select(text.card_description(F.col("d"), F.lit("NAME"))).collect()]
    assert got == ["see  now...", "NAME", "NAME", "x" * 200 + "..."]


def _python_score(query, id, name, desc, pop, qual):
    words = set(query.lower().split())
    if not words:
        return 0.0
    name, id, desc, q = name.lower(), id.lower(), (desc or "").lower(), query.lower()
    bonus = 50.0 if q in (name, id) else 30.0 if q in name or q in id else 0.0
    title = sum(w in name or w in id for w in words)
    found = sum(w in desc for w in words)
    if not title and not found and not bonus:
        return 0.0
    return min(100.0, title / len(words) * 40 + found / len(words) * 10 + bonus + pop * 0.2 + qual * 0.1)


def test_match_score_literal_and_column(spark):
    records = [
        ("hf/x/iris-data", "Iris Data", "Flowers of Iris", 10.0, 20.0),
        ("a/1", "mnist", None, 0.0, 0.0),
        ("b/2", "Big  Data", "digits and text", 99.0, 100.0),
    ]
    df = spark.createDataFrame(records, "id string, name string, description string, popularity double, quality_score double")
    columns = [F.col(c) for c in df.columns]
    queries = ["", "  ", "iris", "IRIS data", "iris iris zebra", "mnist", "a/1", "data", "big data", "digits", " and"]
    for q in queries:
        expected = [_python_score(q, *r) for r in records]
        literal = [r[0] for r in df.select(text.match_score(q, *columns)).collect()]
        column = [r[0] for r in df.select(text.match_score(F.lit(q), *columns)).collect()]
        for got in (literal, column):
            assert all(abs(a - b) < 1e-9 for a, b in zip(got, expected)), q
