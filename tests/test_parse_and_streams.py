"""Definitions, imports and calls of small sources; streams against the batch result."""

import datetime

import pytest

from treequarry.operators import parse
from treequarry.sources.tables import lines_of
from treequarry.streaming import history

SOURCES = {
    "a.rs": "use std::io;\n\npub async fn main() {\n    helper(1);\n    if x {\n        other();\n    }\n}\n\nfn helper(a: i32) { inner(a) }\n\npub struct Point {\n    x: i32,\n}\n",
    "b.py": "import os.path\nfrom sys import argv\n\nclass Box:\n    def get(self):\n        return load(self)\n\n    async def _put(self):\n        def deep():\n            pass\n        save()\n\ndef tail():\n    Box().get()\n",
    "c.ts": 'import { x } from "./lib";\nexport function run() {\n  start();\n}\nexport class App {\n}\n',
    "d.go": 'package main\nimport "fmt"\nfunc (s *S) Do() {\n\tfmt.Println(1)\n}\ntype S struct {\n}\n',
    "e.sh": "go() {\n  ls\n}\n",
    "f.md": "# fn x() {\n",
}


@pytest.fixture(scope="module")
def lines(spark):
    return lines_of(spark.createDataFrame(list(SOURCES.items()), "path string, content string"))


def test_definitions(lines):
    got = {(r["path"], r["name"]): (r["kind"], r["line_start"], r["line_end"], r["is_async"], r["visibility"]) for r in parse.definitions(lines).collect()}
    assert got == {
        ("a.rs", "main"): ("Function", 3, 8, True, "Public"),
        ("a.rs", "helper"): ("Function", 10, 10, False, "Private"),
        ("a.rs", "Point"): ("Struct", 12, 14, False, "Public"),
        ("b.py", "Box"): ("Class", 4, 11, False, "Public"),
        ("b.py", "get"): ("Function", 5, 6, False, "Public"),
        ("b.py", "_put"): ("Function", 8, 11, True, "Private"),
        ("b.py", "deep"): ("Function", 9, 10, False, "Public"),
        ("b.py", "tail"): ("Function", 13, 14, False, "Public"),
        ("c.ts", "run"): ("Function", 2, 4, False, "Public"),
        ("c.ts", "App"): ("Class", 5, 6, False, "Public"),
        ("d.go", "Do"): ("Function", 3, 5, False, "Private"),
        ("d.go", "S"): ("Struct", 6, 7, False, "Private"),
        ("e.sh", "go"): ("Function", 1, 3, False, "Private"),
    }


def test_imports_and_calls(lines):
    assert sorted(tuple(r) for r in parse.imports(lines).collect()) == [("a.rs", "std::io", 1), ("b.py", "os.path", 1), ("b.py", "sys", 2), ("c.ts", "./lib", 1), ("d.go", "fmt", 2)]
    got = {(r["path"], r["caller"], r["callee"], r["line_no"]) for r in parse.calls_with_callers(lines).collect()}
    assert got == {("a.rs", "main", "helper", 4), ("a.rs", "main", "other", 6), ("a.rs", "helper", "inner", 10), ("b.py", "get", "load", 6), ("b.py", "_put", "save", 11), ("b.py", "tail", "Box", 14), ("b.py", "tail", "get", 14), ("c.ts", "run", "start", 3), ("d.go", "Do", "Println", 4)}


def test_streams(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(minutes=17 * i), i % 3, "edit" if i % 2 else "view", float(i), "{}") for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], history.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = history.tallies(history.read_events(spark, str(tmp_path / "in" / "*")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tallies").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = history.tallies(spark.read.schema(history.EVENTS).parquet(str(tmp_path / "in" / "*")).withColumn("ts", __import__("pyspark.sql.functions", fromlist=["col"]).col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("tallies").collect())) == sorted(map(tuple, batch.collect()))
    contents = spark.readStream.schema(history.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).selectExpr("event_type as content")
    history.keep_objects(contents, str(tmp_path / "objects"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["content"] for r in spark.read.parquet(str(tmp_path / "objects")).collect()) == ["edit", "view"]
