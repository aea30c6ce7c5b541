"""Symbols of a project in many languages, and its index and metadata after changes."""

from treequarry.operators import analysis, state

FILES = {
    "a.rs": "pub fn one() {\n}\nstruct Two {\n}\n",
    "b.py": "def three():\n    pass\n",
    "c.go": "package c\nfunc Four() {}\n",
    "d.zig": "pub fn five() void {}\n",
    "e.tsx": "const Six = () => <p>x</p>;\n",
    "f.html": "<div>\n</div>\n",
    "g.css": ".seven { a: b }\n",
    "h.xml": "<eight>\n</eight>\n",
    "i.md": "# Nine\n",
    "j.sh": "ten() {\n}\n",
    "k.bin": "no language",
}
NAMES = {"a.rs": ["one", "Two"], "b.py": ["three"], "c.go": ["Four"], "d.zig": ["five"], "e.tsx": ["<p>", "Six"], "f.html": ["<element>"], "g.css": [".seven"], "h.xml": ["<eight>"], "i.md": ["# Nine"], "j.sh": ["ten"]}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def test_symbols_of_every_language(spark):
    files = frame(spark, FILES | {"null.go": None})
    got = {}
    for r in analysis.symbols(files).orderBy("path", "line_start", "name").collect():
        got.setdefault(r["path"], []).append(r["name"])
    assert got == NAMES
    records = {r["path"]: r["parsed"] for r in analysis.parsed(files).collect()}
    assert set(records) == {*FILES, "null.go"} and records["k.bin"] == records["null.go"] == "[]"
    assert records["d.zig"] == '[{"line_start":1,"line_end":1,"name":"five","kind":"Function","visibility":"Public"}]'


def test_update_is_a_rebuild(spark, tmp_path):
    index, records = state.Table(f"file://{tmp_path}/index", state.INDEX_CHANGES), state.Table(f"file://{tmp_path}/records", state.METADATA)
    before = frame(spark, FILES)
    analysis.update(before, before, index, records)
    now = FILES | {"a.rs": "fn other() {\n}\nfn one() {\n}\n", "new.go": "package n\nfunc one() {}\n"}
    del now["b.py"]
    changed = frame(spark, {p: None for p in ("a.rs", "b.py", "new.go")})
    assert analysis.update(frame(spark, now), changed, index, records) == 2
    whole = sorted((r["name"], r["path"], r["line_start"]) for r in analysis.symbols(frame(spark, now)).collect())
    for _ in range(2):
        got = state.index_entries(spark, index).collect()
        assert sorted((r["name"], r["file"], r["line_start"]) for r in got) == whole
        assert {r["n_entries"] for r in got if r["name"] == "one"} == {2}
        state.compact_index(spark, index)
    assert state.load(spark, records).select("hash").distinct().count() == len({*FILES.values(), *now.values()})


def test_places(spark):
    ids = [5, 100_000, 7, 99_999, 250_001, 100_001, -3]
    got = state.places(spark.createDataFrame([(i,) for i in ids], "id long"), "id").collect()
    assert {r["id"]: r["place"] for r in got} == {i: n for n, i in enumerate(sorted(ids), 1)}
