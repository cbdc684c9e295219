"""Records cut from splits of a file."""

import json

import numpy as np
import pytest

from datascout.sources import readers
from datascout.sources.records import ArrayElements, QuotedLines, split_records


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def at(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield at
    for k, v in old.items():
        spark.conf.set(k, v)


def cells(rng, n):
    parts = ["a", '"', "\n", ",", "x y", "é", '""', "", "\n\n", " "]
    return ["".join(rng.choice(parts, rng.integers(0, 7))) for _ in range(n)]


def as_csv(rows, end="\n"):
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    return end.join(",".join(quote(v) for v in r) for r in rows) + end


@pytest.mark.parametrize("size", [64])
def test_quoted_breaks_across_splits(spark, small_splits, tmp_path, size):
    small_splits(size)
    rng = np.random.default_rng(size)
    want = []
    for k in range(3):
        rows = [[f"{k}-{i}", *cells(rng, 2)] for i in range(20)]
        (tmp_path / f"f{k}.csv").write_text(as_csv([["id", "a", "b"], *rows]))
        want += rows
    raw = readers.read_delimited(spark, str(tmp_path), infer=False)
    alone = spark.read.csv(str(tmp_path), header=True, multiLine=True, quote='"', escape='"')
    got = sorted(map(tuple, raw.collect()))
    assert got == sorted(map(tuple, alone.collect())) and len(got) == len(want)
    assert raw.rdd.getNumPartitions() > 3
    assert sorted(r[0] for r in got) == sorted(r[0] for r in want)
    assert dict((r[0], r[1]) for r in got) == {r[0]: r[1] or None for r in want}


def test_the_single_task_reader_agrees_on_odd_quotes(spark, small_splits, tmp_path):
    small_splits(40)
    lines = ['id,a,b', '1,5" pipe,x', '2,"a\nb",y', '3,"q"junk,z', '4,"two ""words""\n\n, end",', '5,,"', 'not closed', '6,"x"', '7,a"b"c,"d\n"', ""]
    (tmp_path / "odd.csv").write_text("\n".join(lines[:5] + lines[7:]))
    got = readers.read_delimited(spark, str(tmp_path), infer=False)
    alone = spark.read.csv(str(tmp_path), header=True, multiLine=True, quote='"', escape='"')
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(got.collect()) == key(alone.collect())
    (tmp_path / "odd.csv").write_bytes(as_csv([["id", "a"], *([str(i), "x\r\ny é" * (i % 3)] for i in range(40))], "\r\n").encode("latin-1"))
    read = readers.read_delimited(spark, str(tmp_path), encoding="ISO-8859-1").orderBy("id").collect()
    assert [(r.id, r.a) for r in read] == [(i, "x\ny é" * (i % 3) or None) for i in range(40)]


@pytest.mark.parametrize("size, indent", [(50, None), (300, 2)])
def test_json_arrays_across_splits(spark, small_splits, tmp_path, size, indent):
    small_splits(size)
    rng = np.random.default_rng(size)
    texts = ["a", '"', "\\", "}", "{", "]", "[", ",", "é", "\n", "} ,{", '\\"']
    want = [{"id": i, "t": "".join(rng.choice(texts, rng.integers(0, 9))), "in": {"k": [1, {"z": "}"}], "e": {}}} for i in range(30)]
    (tmp_path / "a.json").write_text(json.dumps(want[:20], indent=indent))
    (tmp_path / "b.json").write_text("\n " + json.dumps(want[20:], indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "c.json").write_text("[ ]")
    read = readers.read_json_doc(spark, str(tmp_path))
    assert sorted((r.id, r.t, json.loads(r["in"].k[1])["z"]) for r in read.collect()) == [(w["id"], w["t"], "}") for w in want]
    assert read.rdd.getNumPartitions() > 3


def test_units_change_the_state_as_they_should():
    lines = QuotedLines(b",")
    assert [lines.after(s, b)[0] for s, b in [(False, b'a,"b'), (False, b'a"b'), (False, b'"a""'), (True, b'a""'), (True, b'a",'), (True, b'a","'), (True, b'x"y"'), (False, b'"x"y,"z')]] == [
        True, False, True, True, False, True, False, True,
    ]
    array = ArrayElements()
    assert array.after(False, b'[{"a": "\\\\"') == (False, 1) and array.after(False, b'{"a\\"{') == (True, 1) and array.after(True, b'"') == (False, -1)


def test_no_records(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "h.csv").write_text('"a\nb",c\n')
    assert split_records(spark, str(tmp_path / "e.csv"), QuotedLines(b",")).count() == 0
    (row,) = split_records(spark, str(tmp_path / "h.csv"), QuotedLines(b",")).collect()
    assert bytes(row.value) == b'"a\nb",c' and row.first
    read = readers.read_delimited(spark, str(tmp_path / "h.csv"))
    assert read.columns == ["a\nb", "c"] and read.count() == 0
