import json
import math

import pytest
from conftest import ids
from pyspark.sql import functions as F

from datascout.operators import catalog as C
from datascout.operators import ledger
from datascout.streaming import ingest


def raw(spark, *payloads):
    return spark.createDataFrame([(json.dumps(p),) for p in payloads], "payload string")


def test_hf_last_tag_wins_and_defaults(spark):
    rows = C.normalize_hf(
        raw(
            spark,
            {"id": "org/set", "tags": ["license:a", "task_categories:x", "license:b", "task_categories:y"], "downloads": 10, "likes": 4, "description": "d"},
            {"id": "plain"},
            {"id": "big", "downloads": 10**12, "likes": 1000},
        )
    ).collect()
    a, b, c = rows
    assert (a["id"], a["name"], a["task"], a["license"], a["quality_score"]) == ("hf/org/set", "set", "y", "b", 85.0)
    assert a["popularity"] == pytest.approx(math.log1p(10) * 5 + 2)
    assert (b["name"], b["task"], b["license"], b["quality_score"], b["popularity"], b["tags"]) == ("plain", "Unknown", "Unknown", 30.0, 0.0, [])
    assert c["popularity"] == 100.0


def test_openml_bad_and_repeated_qualities(spark):
    q = lambda *p: [{"name": n, "value": v} for n, v in p]
    rows = C.normalize_openml(
        raw(
            spark,
            {"did": 5, "name": "n", "quality": q(("NumberOfInstances", "10"), ("NumberOfInstances", "12.9"), ("NumberOfInstances", "x"), ("NumberOfFeatures", ""), ("NumberOfClasses", "-1"))},
            {"did": 20000, "quality": q(("NumberOfInstances", "3"), ("NumberOfFeatures", "2"), ("NumberOfClasses", "1"))},
        )
    ).collect()
    assert (rows[0]["rows"], rows[0]["columns"], rows[0]["task"], rows[0]["quality_score"]) == (12, None, "Tabular", 70.0)
    assert (rows[1]["name"], rows[1]["task"], rows[1]["popularity"], rows[1]["quality_score"]) == ("Unknown", "Regression / Clustering", 50.0, 90.0)
    assert rows[1]["description"].endswith("Contains 3 instances and 2 features. Format: ARFF.")


def test_uci_status_and_absent_flag(spark):
    rows = C.normalize_uci(
        raw(spark, {"status": 404, "data": {"uci_id": 1}}, {"status": 200, "data": {"uci_id": 2, "name": "IRIS"}})
    ).collect()
    assert [(r["id"], r["popularity"], r["quality_score"], r["task"]) for r in rows] == [("uci/2", 85.0, 85.0, "Tabular")]


def test_github_null_license_and_kaggle_sizes(spark):
    row = C.normalize_github(raw(spark, {"full_name": "o/r", "name": "r", "license": None, "owner": {"login": "o"}})).first()
    assert (row["license"], row["quality_score"], row["size_bytes"], row["popularity"]) == ("Unknown", 40.0, 0, 10.0)
    assert row["description"] == "GitHub dataset repository by o."
    rows = C.normalize_kaggle(raw(spark, {"ref": "a"}, {"ref": "b", "size": "12MB"}, {"ref": "c", "size": "1 KB", "downloadCount": 500})).collect()
    assert [r["size_bytes"] for r in rows] == [0, None, 1024] and rows[2]["popularity"] == 10.5


def test_union_of_enabled_providers(spark):
    hf = C.normalize_hf(raw(spark, {"id": "x"}))
    kaggle = C.normalize_kaggle(raw(spark, {"ref": "y"}))
    assert ids(C.build_catalog(hf, None, kaggle)) == ["hf/x", "kaggle/y"]
    assert ids(C.build_catalog(hf, kaggle, enabled=["kaggle"])) == ["kaggle/y"]


def test_payload_files_stream_into_the_catalog(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.json").write_text('{"id": "x"}\n{"id": "y"}\n')
    arguments = (C.normalize_hf, str(tmp_path / "out"), str(tmp_path / "state"))
    ingest.land_catalog(ingest.payload_stream(spark, str(landing)), *arguments).awaitTermination()
    (landing / "b.json").write_text('{"id": "z"}\n')
    ingest.land_catalog(ingest.payload_stream(spark, str(landing)), *arguments).awaitTermination()
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == ["hf/x", "hf/y", "hf/z"]


def test_history(spark):
    rows = [(f"q{i}", i) for i in range(60)] + [("Q3", 100), ("q3", 99)]
    got = ledger.recent_queries(spark.createDataFrame(rows, "query string, ts bigint")).collect()
    assert len(got) == 50 and (got[0]["rank"], got[0]["query"]) == (1, "Q3") and got[1]["query"] == "q59"
    assert [r["rank"] for r in got] == list(range(1, 51))


def test_bookmarks(spark):
    current = spark.createDataFrame([("a", "A")], "id string, name string")
    new = spark.createDataFrame([("a", "A2", 0), ("b", "B1", 1), ("b", "B2", 2)], "id string, name string, seq int")
    merged = ledger.add_bookmarks(current, new)
    assert sorted(map(tuple, merged.collect())) == [("a", "A"), ("b", "B1")]
    left = ledger.remove_bookmarks(merged, spark.createDataFrame([("a",)], "id string"))
    assert [r["score"] for r in ledger.list_bookmarks(left).collect()] == [100.0]


@pytest.mark.parametrize(
    "cap,expected", [(6, ["a", "b"]), (14, []), (13, ["a"]), (0, ["a", "b", "c", "d"]), (9, ["a"])]
)
def test_eviction(spark, cap, expected):
    rows = [("a", 1.0, 5, True), ("b", 2.0, 4, True), ("c", 2.0, 3, True), ("d", 4.0, 2, True), ("x", 0.0, 99, False)]
    table = spark.createDataFrame(rows, "id string, downloaded_at double, actual_size bigint, path_exists boolean")
    plan = ledger.eviction_plan(table, cap)
    assert ids(plan.where("evict")) == expected and plan.count() == 5


def test_downloads_and_rehydration(spark):
    current = spark.createDataFrame([("a", "A", "/a", 1.0)], "id string, name string, local_path string, downloaded_at double")
    new = current.select("*", F.lit(1).alias("seq"), F.lit(False).alias("path_exists"))
    row = ledger.track_downloads(current, new).first()
    assert row["downloaded_at"] == 0.0
    assert ledger.ledger_as_catalog(current).columns == ["id", "name", "score"]


def test_broken_and_foreign_payloads_name_nothing(spark):
    from datascout.operators import catalog

    good = {
        "huggingface": '{"id": "a/b"}', "openml": '{"did": 3}', "uci": '{"status": 200, "data": {"uci_id": 5, "name": "n"}}',
        "github": '{"full_name": "o/r", "name": "r"}', "kaggle": '{"ref": "u/d", "title": "t"}',
    }
    normalise = dict(zip(good, (catalog.normalize_hf, catalog.normalize_openml, catalog.normalize_uci, catalog.normalize_github, catalog.normalize_kaggle)))
    for provider, run in normalise.items():
        rows = [(p,) for k, p in good.items()] + [("not json",), ("{}",), (None,), ("[1]",)]
        raw = spark.createDataFrame(rows, "payload string")
        assert [r["provider"] for r in run(raw).collect()] == [provider]
        assert catalog.rejected_payloads(raw, provider).first()["payloads"] == 8


def test_uci_ids_mean_that_very_record(spark):
    from datascout.operators.search import resolve_metadata

    rows = [("uci/53", "iris", "uci", 10.0, 1.0, "d"), ("uci/153", "other", "uci", 90.0, 9.0, "d")]
    cat = spark.createDataFrame(rows, "id string, name string, provider string, popularity double, quality_score double, description string")
    asked = spark.createDataFrame([("uci/53",), ("uci/3",)], "id string")
    found = resolve_metadata(asked, cat.limit(0), cat).collect()
    assert [(r["id"], r["resolved_id"], r["origin"]) for r in found] == [("uci/53", "uci/53", "provider")]
