"""The entry points from end to end."""

import pytest
from conftest import CATALOG_DDL, ids

from datascout.plans import flows

ROWS = [
    ("openml/1", "wine data", "openml", "Classification", 10, 4, 5000, "mit", 1.0, 0.0, "", []),
    ("hf/2", "housing", "huggingface", "Regression", 10, 4, 5000, "gpl", 9.0, 0.0, "wine too", []),
]


@pytest.fixture(scope="module")
def downloads(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("wine set")
    (folder / "readme.md").write_text("about")
    (folder / "b.csv").write_text("x,label\n" + "\n".join(f"{i},{'ab'[i % 2]}" for i in range(40)))
    rows = [(*ROWS[0], str(folder), 1.0, 0), (*ROWS[1], str(folder / "none"), 2.0, 1)]
    return spark.createDataFrame(rows, CATALOG_DDL + ", local_path string, downloaded_at double, pos int")


def test_a_search_leaves_history_and_records(spark, tmp_path):
    cat, home = spark.createDataFrame(ROWS, CATALOG_DDL), str(tmp_path / "home")
    first = flows.search_session(spark, home, [cat], "wine", 1.0)
    assert [r["id"] for r in first.collect()] == ["openml/1", "hf/2"]
    renamed = cat.replace("wine data", "wine table", subset=["name"])
    flows.search_session(spark, home, [renamed], "WINE", 2.0, limit=1)
    flows.search_session(spark, home, [cat], "nothing", 3.0, license_type="cc0")
    assert [(r["rank"], r["query"]) for r in flows.saved_history(spark, home).collect()] == [(1, "nothing"), (2, "WINE")]
    assert {r["id"]: r["name"] for r in flows.saved_hits(spark, home).collect()} == {"openml/1": "wine table", "hf/2": "housing"}


def test_offline_search_and_filter_without_downloads(spark, downloads):
    hits = flows.search_datasets([], "WINE", ledger=downloads).collect()
    assert [(r["id"], r["score"]) for r in hits] == [("openml/1", 100.0)]
    assert flows.search_datasets([], "wine", ledger=downloads, license_type="gpl").count() == 0
    with pytest.raises(ValueError):
        flows.search_datasets([], "wine")
    cat, none = spark.createDataFrame(ROWS, CATALOG_DDL), downloads.limit(0)
    assert ids(flows.filter_ledger(none, "regression", [cat])) == ["hf/2"]
    assert ids(flows.filter_ledger(downloads, "classification", [cat])) == ["openml/1"]
    assert flows.filter_ledger(none, "regression").count() == 0


def test_from_a_source_to_its_advice(spark, downloads):
    for source in ("openml/1", "WINE Data"):
        assert flows.source_file(spark, source, downloads).endswith("/b.csv")
    report = flows.work_on(spark, "openml/1", downloads)
    assert report["digest"].first()["rows"] == 40 and report["file"].first()["filename"] == "b.csv"
    assert report["training"].columns == ["x", "label"] and report["training"].count() == 40
    assert {r["subject"] for r in report["models"].where("rule = 'task'").collect()} == {"label"}
    assert report["findings"].where("rule = 'encoding'").count() == 1
    for source in ("housing", "absent"):
        lost = flows.work_on(spark, source, downloads)
        assert set(lost) == {"file"} and "no data file" in lost["file"].first()["error"]
