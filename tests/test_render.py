"""Headers, levels and modes of showing, on files written by hand."""

import pytest
from pyspark.sql import functions as F

from treequarry.functions import text as T
from treequarry.operators import render

SYMBOLS = "file string, ordinal long, name string, kind string, line_start long, line_end long, body_start long, body_end long, signature string, owner string"
RUST = """use a::b;

fn one(
    x: i32,
) -> i32
{
    two()
}

struct Pair {
    a: i32,
}

fn two() { 2 }

// end
"""
PYTHON = '''import os

def three(x):
    """Three."""
    return x

class Four:
    def five(self):
        return 5
'''


@pytest.fixture(scope="module")
def files(spark):
    texts = {"a.rs": RUST, "b.py": PYTHON, "c.rs": "// nothing\n"}
    lines = [(f, i + 1, line) for f, t in texts.items() for i, line in enumerate(t.splitlines())]
    symbols = [
        ("a.rs", 0, "one", "Function", 3, 8, 6, 8, "fn one(x: i32) -> i32", None),
        ("a.rs", 1, "Pair", "Struct", 10, 12, None, None, "Struct Pair", None),
        ("a.rs", 2, "two", "Function", 14, 14, 14, 14, "fn two()", None),
        ("b.py", 0, "three", "Function", 3, 5, 4, 5, "fn three(x)", None),
        ("b.py", 1, "Four", "Class", 7, 9, None, None, "Class Four", None),
        ("b.py", 2, "five", "Function", 8, 9, 9, 9, "fn five()", "Four"),
    ]
    calls = spark.createDataFrame([("a.rs", "two"), ("b.py", "five")], "file string, callee string")
    return spark.createDataFrame(lines, "file string, line_no long, text string"), spark.createDataFrame(symbols, SYMBOLS), calls


def joined(rows, end=""):
    out = {}
    for r in rows.orderBy("file", "place", "part", "line_no").collect():
        out[r["file"]] = out.get(r["file"], "") + r["text"] + end
    return out


def test_headers(files):
    lines, symbols, _ = files
    got = joined(render.headers(lines, symbols))
    assert got["a.rs"] == "use a::b;\n\nfn one(\n    x: i32,\n) -> i32 { ... 3 lines ... }\nstruct Pair {\n    // ... 3 lines ...\n}\nfn two() { ... 1 lines ... }\n\n// end\n"
    assert got["b.py"] == "import os\n\ndef three(x):\n    ...  # 2 lines hidden\nclass Four:\n    fn five():\n        ...  # hidden\n    ...  # 3 lines hidden\n"
    assert got["c.rs"] == "// nothing\n"
    cut = joined(render.headers(lines, symbols, max_bytes=10, methods=False))
    assert cut["a.rs"] == "use a::b;\n\nfn one(...struct Pair {\n    // ... 3 lines ...\n}\nfn two() { ... 1 lines ... }\n\n// end\n"
    assert "five" not in cut["b.py"]


def test_levels(files):
    lines, symbols, calls = files
    level = lambda n: joined(render.level(lines, symbols, calls, n))
    assert level(0) == {}
    assert level(1) == joined(render.headers(lines, symbols))
    assert level(2) == {
        "a.rs": "fn one(\n    x: i32,\n) -> i32\n{\n// ...\nstruct Pair {\n// ...\nfn two() { 2 }\n",
        "b.py": 'def three(x):\n    """Three."""\n// ...\nclass Four:\n    def five(self):\n        return 5\n',
        "c.rs": "\n",
    }
    assert level(3)["a.rs"] == RUST
    with pytest.raises(ValueError):
        level(4)
    stored = lines.sparkSession.createDataFrame([("a.rs", "kept")], "file string, content string")
    of = lambda n: [tuple(r) for r in render.set_level("a.rs", n, lines, symbols, calls, stored).collect()]
    assert of(0) == [] and of(2) == [("a.rs", level(2)["a.rs"])] and of(3) == [("a.rs", "kept")]


def test_show(spark, files):
    lines, symbols, _ = files
    none = lines.limit(0)
    imports = spark.createDataFrame([("b.py", "os", 1)], "file string, import_path string, line_no long")
    show = lambda tracked=none, hidden=none, stored=none, **kw: joined(render.show(lines, symbols, imports, tracked, hidden, stored, **kw), "\n")
    got = show(with_imports=True, docs=True, expand="two")
    assert got["b.py"] == '# b.py\n# 1 functions · 1 classes · Python\n\nos\n\nfn three(x)    # line 3\n    """Three."""\n    ... 2 lines\n\nClass Four    # line 7\n    ... 2 lines\n\n'
    assert got["a.rs"] == "# a.rs\n# 2 functions · 1 classes · Rust\n\nfn one(x: i32) -> i32    # line 3\n    ... 5 lines\n\nStruct Pair    # line 10\n    ... 2 lines\n\n  14 | fn two() { 2 }\n\n"
    assert got["c.rs"] == "File: c.rs\n   1 | // nothing\n"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tracked = frame([("c.rs",), ("gone.rs",)], "file string")
    hidden = frame([("a.rs", 2)], "file string, line_no long")
    stored = frame([("gone.rs", 1, "was here")], "file string, line_no long, text string")
    got = show(tracked, hidden, stored, expand="*")
    assert got["gone.rs"] == "File: gone.rs [VEILED - not on disk]\n   1 | was here\n"
    assert got["c.rs"] == "File: c.rs [HEADERS VEILED]\n   1 | // nothing\n"
    assert got["a.rs"].startswith("File: a.rs\n   1 | use a::b;\n   2 | [veiled] ...\n   3 | fn one(\n")
    assert got["b.py"].startswith("File: b.py\n   1 | import os\n")


def test_prefixes_of_bytes(spark):
    text = "aé€😀b"
    cuts = spark.range(1).select(F.array(*[T.truncated(F.lit(text), n) for n in range(13)]).alias("c")).first()["c"]
    assert cuts == [text.encode()[:n].decode("utf-8", "ignore") for n in range(13)]
