import hashlib
import json

import pytest
from pyspark.sql import functions as F

from datascout.operators.profile import profile
from datascout.sources import files, readers, store


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_example_arff(spark, tmp_path):
    text = "% c\n@relation r\n\n@attribute 'feat1' numeric\n@ATTRIBUTE feat2 real\n@attribute class {yes,no}\n@data\n1.5,10.0,yes\n% mid\n2.5,20.0,no\n\n3.5,30.0,yes\n"
    df = readers.read_arff(spark, write(tmp_path / "a.arff", text))
    assert df.dtypes == [("feat1", "double"), ("feat2", "double"), ("class", "string")]
    assert [tuple(r) for r in df.orderBy("feat1").collect()] == [(1.5, 10.0, "yes"), (2.5, 20.0, "no"), (3.5, 30.0, "yes")]


def test_arff_gaps_quotes_and_at_signs(spark, tmp_path):
    text = "@attribute 'two words' string\n@attribute n integer\n@data\n'a, b',?\n@data,4\n@attribute,5\n"
    path = write(tmp_path / "b.arff", text)
    df = readers.read_arff(spark, path)
    assert df.columns == ["two words", "n"]
    assert sorted(map(tuple, df.collect()), key=str) == [("@attribute", 5), ("@data", 4), ("a, b", None)]
    assert readers.read_arff(spark, write(tmp_path / "c.arff", "@attribute x y\n@data\n?\n"), legacy=True).first()[0] == "?"
    with pytest.raises(ValueError):
        readers.read_arff(spark, write(tmp_path / "d.arff", "1,2\n"))


def test_example_csv(spark, tmp_path):
    text = "age,salary,label,ignored_id\n20,50000,no,1\n21,55000,yes,2\n22,60000,yes,3\n23,65000,no,4\n100,70000,yes,5\n"
    path = write(tmp_path / "e.csv", text)
    report = profile(readers.read_table(spark, path))
    assert report["table"].first()["rows"] == 5
    assert report["class_balance"].first()["column"] == "label"
    assert files.detect_delimiter(files.text_lines(spark, path)).first()["delimiter_name"] == "Comma"


def test_types_and_missing_tokens(spark, tmp_path):
    text = "i,gap,f,b,bn,t,n,z,inf\n1,NA,1.5,True,true,x,NA,007,inf\n 2,3,2,false,,1,,8,-inf\n-3,,1e3,TRUE,false,NULL,null,9,1\n"
    df = readers.read_delimited(spark, write(tmp_path / "t.csv", text))
    assert dict(df.dtypes) == {
        "i": "bigint", "gap": "bigint", "f": "double", "b": "boolean", "bn": "string", "t": "string", "n": "double", "z": "bigint", "inf": "double",
    }
    rows = df.collect()
    assert [r["i"] for r in rows] == [1, 2, -3] and [r["gap"] for r in rows] == [None, 3, None]
    assert rows[0]["inf"] == float("inf") and rows[1]["inf"] == float("-inf") and rows[2]["t"] is None


def test_ragged_lines(spark, tmp_path):
    short = readers.read_delimited(spark, write(tmp_path / "s.csv", "a,b\n1\n2,3\n"))
    assert sorted(map(tuple, short.collect())) == [(1, None), (2, 3)]
    with pytest.raises(ValueError, match="more fields"):
        readers.read_delimited(spark, write(tmp_path / "l.csv", "a,b\n1,2,3\n"))


def test_tabs_are_forced_for_tsv_and_txt(spark, tmp_path):
    for name in ("x.tsv", "x.txt"):
        df = readers.read_table(spark, write(tmp_path / name, "a,b\tc\n1,2\t3\n"))
        assert df.columns == ["a,b", "c"] and tuple(df.first()) == ("1,2", 3)


def test_quoted_delimiters_and_latin1(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'n;v\n"a;b";é\n', "latin-1")
    df = readers.read_delimited(spark, path, sep=";", encoding="ISO-8859-1")
    assert tuple(df.first()) == ("a;b", "é")
    assert files.detect_encoding(files.text_lines(spark, path)).first()["encoding"] == "latin-1"


def test_json_forms(spark, tmp_path):
    records = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    array = readers.read_table(spark, write(tmp_path / "r.json", json.dumps(records, indent=1)))
    assert sorted(map(tuple, array.collect())) == [(1, "x"), (2, "y")]
    columns = {"b": {"0": "x", "1": "y"}, "a": {"0": 1, "1": None}}
    by_column = readers.read_table(spark, write(tmp_path / "c.json", json.dumps(columns)))
    assert by_column.columns == ["b", "a"]
    assert sorted(map(tuple, by_column.collect())) == [("x", 1), ("y", None)]
    lines = readers.read_table(spark, write(tmp_path / "l.jsonl", "\n".join(json.dumps(r) for r in records)))
    assert lines.count() == 2


def test_detection_over_many_files(spark, tmp_path):
    write(tmp_path / "a.csv", "a;b\n1;2\n" + "x,y,z,w,v\n" * 3 + "|" * 50 + "\n")
    write(tmp_path / "b.tsv", "a\tb\n")
    write(tmp_path / "c.txt", "a|b,c\n")  # a tie: comma is listed first
    write(tmp_path / "d.csv", "plain\n")
    write(tmp_path / "e.log", "a|b|c\n")
    found = files.detect_delimiter(files.text_lines(spark, str(tmp_path))).collect()
    got = {r["path"].rsplit("/", 1)[1]: r["delimiter_name"] for r in found}
    assert got == {"a.csv": "Comma", "b.tsv": "Tab", "c.txt": "Comma", "d.csv": "Comma", "e.log": "Comma"}
    sizes = {r["path"].rsplit("/", 1)[1]: r["size"] for r in files.list_files(spark, str(tmp_path)).collect()}
    assert sizes["b.tsv"] == 4


def test_checksums(spark, tmp_path):
    contents = {"a.bin": b"hello", "b.bin": b"other" * 1000, "c.bin": b"x", "d e 50%20.bin": b"odd name", "f.bin": b""}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    digests = files.file_digests(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in digests.collect()}
    assert got == {n: hashlib.sha256(d).hexdigest() for n, d in contents.items()}
    base = digests.first()["path"].rsplit("/", 1)[0]
    manifest = spark.createDataFrame(
        [(f"{base}/a.bin", got["a.bin"].upper()), (f"{base}/b.bin", "0"), (f"{base}/zz", "1")], "path string, expected_sha256 string"
    )
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in files.verify_checksums(digests, manifest).collect()}
    assert status == {"a.bin": "ok", "b.bin": "mismatch", "zz": "missing"}


def test_catalog_round_trip(spark, tmp_path):
    from datascout.operators.catalog import normalize_kaggle, public_view

    raw = spark.createDataFrame([('{"ref":"u/a","title":"A"}',), ('{"ref":"u/b","title":"B"}',)], "payload string")
    cat = public_view(normalize_kaggle(raw))
    first = store.write_catalog(cat, str(tmp_path / "one"))
    newer = cat.where("name = 'B'").withColumn("task", F.lit("new"))
    second = store.write_catalog(newer, str(tmp_path / "two"), current=first)
    assert {r["id"]: r["task"] for r in second.collect()} == {"kaggle/u/a": "Kaggle Dataset", "kaggle/u/b": "new"}
    record = store.read_record(spark, str(tmp_path / "two"), "kaggle/u/b")
    assert record.first()["safe_id"] == "kaggle_u_b"
    assert "EqualTo(id,kaggle/u/b)" in record._jdf.queryExecution().executedPlan().toString()


def test_pruned_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.range(5).selectExpr("id", "id * 2 as twice", "id * 3 as thrice").write.parquet(path)
    df = readers.read_table(spark, path, columns=["twice"])
    assert "ReadSchema: struct<twice:bigint>" in df._jdf.queryExecution().executedPlan().toString()


def test_quoted_line_breaks(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'n,t\r\n1,"x\ny"\r\n2,"say ""hi"", you"\r\n3,plain\r\n')
    rows = readers.read_delimited(spark, path).orderBy("n").collect()
    assert [tuple(r) for r in rows] == [(1, "x\ny"), (2, 'say "hi", you'), (3, "plain")]
    typed = readers.read_delimited(spark, path, schema="k int, t string").orderBy("k").collect()
    assert [tuple(r) for r in typed] == [tuple(r) for r in rows]
    assert readers.read_delimited(spark, write(tmp_path / "p.csv", "a,b\n1,NA\n"), multiline=False, schema="a int, b int").first()[1] is None


def test_files_are_inspected_as_detected(spark, tmp_path):
    from datascout.plans.flows import inspect_file, inspect_files

    write(tmp_path / "a b.csv", "x;y\n1;2\n3;4\n")
    write(tmp_path / "latin.csv", "x,y\ncafé,2\n", "latin-1")
    write(tmp_path / "empty.csv", "")
    found = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in inspect_files(spark, str(tmp_path)).collect()}
    assert found == {
        "a%20b.csv": ("Semicolon", "utf-8", 2, 2, None), "latin.csv": ("Comma", "latin-1", 1, 2, None),
        "empty.csv": ("Comma", "utf-8", 0, 0, "Dataset is empty."),
    }
    one = inspect_file(spark, str(tmp_path / "a b.csv"))
    assert tuple(one["file"].first()) == ("a b.csv", "utf-8", "Semicolon", None)
    assert [r["column"] for r in one["columns"].orderBy("position").collect()] == ["x", "y"]
    assert readers.read_table(spark, str(tmp_path / "latin.csv")).first()["x"] == "café"
    bad = inspect_file(spark, write(tmp_path / "bad.csv", "a,b\n1,2,3\n"))
    assert list(bad) == ["file"] and "more fields" in bad["file"].first()["error"]


def test_files_of_a_mixed_folder_are_read_each_in_its_own_way(spark, tmp_path):
    from datascout.plans.flows import inspect_file

    write(tmp_path / "a.csv", "x,n\nplain,1\n")
    write(tmp_path / "b.csv", "x,n\ncafé,2\n", "latin-1")
    write(tmp_path / "c d.csv", "n;x\n3;naïve\n")
    write(tmp_path / "e.csv", "x,n,more\ny,4.5,z\n")
    write(tmp_path / "f.csv", "")
    df = readers.read_table(spark, str(tmp_path))
    assert df.dtypes == [("x", "string"), ("n", "double"), ("more", "string")]
    assert sorted(map(tuple, df.collect()), key=lambda r: r[1]) == [("plain", 1.0, None), ("café", 2.0, None), ("naïve", 3.0, None), ("y", 4.5, "z")]
    assert inspect_file(spark, str(tmp_path))["table"].first()["rows"] == 4
    write(tmp_path / "g.csv", "n;x\n3;a;b\n")
    with pytest.raises(ValueError, match="more fields"):
        readers.read_table(spark, str(tmp_path))


def _many_files(spark, folder):
    rows = [(i, f"t [{i}] \"q\" }} café" if i % 2 else f"plain {i}", "en" if i % 2 else "de") for i in range(80)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(8).write.parquet(f"{folder}/documents.parquet")
    return rows


def _query_over_small_splits(spark, name, folder):
    """The rows of a query, and the folder of the files that it wrote."""
    import glob

    from datascout.plans import registry, work_sources  # noqa: F401

    label = {"s4_read_json_texts": "s4t", "s9_detect_encoding": "s9"}[name]
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{shared}/{label}-*"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        found = [tuple(r) for r in registry.QUERIES[name](spark, str(folder)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (made,) = set(glob.glob(f"{shared}/{label}-*")) - before
    return found, made


def test_json_texts_are_written_by_several_tasks(spark, tmp_path):
    from pathlib import Path

    rows = _many_files(spark, tmp_path)
    found, made = _query_over_small_splits(spark, "s4_read_json_texts", tmp_path)
    assert sorted(found) == rows
    assert len(list(Path(made).glob("part-*"))) == 2


def test_a_language_is_written_by_several_tasks(spark, tmp_path):
    from pathlib import Path

    _many_files(spark, tmp_path)
    found, made = _query_over_small_splits(spark, "s9_detect_encoding", tmp_path)
    assert sorted(found) == [("de", "utf-8"), ("en", "latin-1")]
    assert len(list(Path(made).glob("lang=en/part-*"))) > 1
