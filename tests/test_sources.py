"""Scans and sinks on small folders."""

import json

from sparkloom.sources import files


def test_scan_and_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in {"a.txt": b"  one\xff two \n", "b.TXT": b"x", "in/c.txt": b" \n ", "in/d.csv": b"a,b\n1,2\n", "e.md": b"z"}.items():
        (tmp_path / name).write_bytes(content)
    found = {r["path"].rsplit("/", 1)[1]: (r["suffix"], r["length"]) for r in files.scan_directory(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": (".txt", 12), "b.TXT": (".txt", 1), "c.txt": (".txt", 3), "d.csv": (".csv", 8)}
    assert files.scan_directory(spark, str(tmp_path), None).count() == 5
    rows = files.read_texts(spark, str(tmp_path)).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["page"], r["text"]) for r in rows] == [("a.txt", 1, "one two")]


def test_delimiters(spark, tmp_path):
    for name, content in {"a.csv": 'k,v\n1,"x, y"\n\n2,z\n', "b.csv": "k;v\n3;4,5\n", "c.csv": "k\tv\n6\t7\n", "d.csv": "only\nrow\n"}.items():
        (tmp_path / name).write_text(content)
    rows = sorted((r["path"][-5], r["row"], r["columns"], r["cells"]) for r in files.read_delimited(spark, str(tmp_path)).collect())
    assert rows == [("a", 0, ["k", "v"], ["1", "x, y"]), ("a", 1, ["k", "v"], ["2", "z"]), ("b", 0, ["k", "v"], ["3", "4,5"]), ("c", 0, ["k", "v"], ["6", "7"]), ("d", 0, ["only"], ["row"])]


def test_golden_and_artefacts(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"id": 1, "question": "why"}, {"id": 2, "question": " "}, {"id": 3, "question": None}, {"id": 4, "question": "how"}]))
    assert sorted(r["id"] for r in files.read_golden(spark, str(tmp_path / "g.json")).collect()) == [1, 4]
    assert [r["id"] for r in files.read_golden(spark, str(tmp_path / "g.json"), ["4"]).collect()] == [4]
    for name in ("run_rep2.jsonl", "run.jsonl"):
        (tmp_path / name).write_text('{"x": 1}\n')
    assert sorted((r["repetition"] or 0) for r in files.read_artefacts(spark, str(tmp_path)).collect()) == [0, 2]


def test_sinks(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, nan, [1.0, inf], {"a": nan}, (2.0, -inf))], "i int, x double, l array<double>, m map<string, double>, s struct<p: double, q: double>")
    path = str(tmp_path / "out")
    for _ in range(2):
        files.write_swapped(files.without_nan(df), path)
    line = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert json.loads(line) == {"i": 1, "x": None, "l": [1.0, None], "m": {"a": None}, "s": {"p": 2.0, "q": None}}
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    store = str(tmp_path / "nodes")
    assert files.node_store(spark, store, df.select("i")).count() == 1 and files.node_store(spark, store).collect()[0]["i"] == 1
