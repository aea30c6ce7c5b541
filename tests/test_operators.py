"""Operators on literal inputs, and against plain models."""

import hashlib
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from treequarry.functions import patterns
from treequarry.operators import budget, files, graph, patches, policy, store, symbols
from treequarry.sources import tables


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def plain_trace(edges, start, depth):
    seen, frontier, again, out = {start}, [start], False, []
    for d in range(1, depth + 1):
        new = []
        for a in frontier:
            for s, t in edges:
                if s == a:
                    if t in seen:
                        again = True
                    else:
                        seen.add(t)
                        new.append(t)
                        out.append((start, t, d))
        frontier = new
    return sorted(out), again


def test_traces_and_the_flag(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)] + [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("x", "y"), ("l0", "l1"), ("l1", "l2")]
    table = spark.createDataFrame(edges, "src string, dst string")
    names = sorted({e[0] for e in edges}) + ["nowhere"]
    levels, flags = graph.trace(table, spark.createDataFrame([(n,) for n in names], "seed string"), 3)
    want = [plain_trace(edges, n, 3) for n in names]
    assert rows(levels, "seed", "name", "depth") == sorted(r for w, _ in want for r in w)
    assert rows(flags, "seed", "revisits") == sorted((n, w[1]) for n, w in zip(names, want, strict=True))
    for depth in (0, 1, 3, 40):
        want = [r for n in names for r in plain_trace(edges, n, depth)[0]]
        assert rows(graph.reach(table, spark.createDataFrame([(n,) for n in names], "seed string"), depth), "seed", "name", "depth") == sorted(want)
    many = spark.createDataFrame([(f"seed {i}", f"n{i % 30}") for i in range(200)], "seed string, name string")
    assert rows(graph.reach(table, many.repartition(3), 5), "seed", "name", "depth") == rows(graph.trace(table, many, 5)[0], "seed", "name", "depth")
    none, flag = graph.trace(table, spark.createDataFrame([("a",)], "seed string"), 0)
    assert none.count() == 0 and rows(flag, "seed", "revisits") == [("a", False)]


def test_std_filter_closes_levels_up(spark):
    levels = spark.createDataFrame([("s", "unwrap", 1), ("s", "mine", 2), ("s", "test_0_x", 2), ("s", "other", 4)], "seed string, name string, depth long")
    assert rows(graph.without_std(levels), "name", "depth") == [("mine", 1), ("other", 2)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 40), max_size=8), min_size=1, max_size=6), st.integers(0, 90))
def test_greedy_budget(spark, plans, limit):
    table = spark.createDataFrame([(p, i, c) for p, items in enumerate(plans) for i, c in enumerate(items)], "plan long, ord long, cost long")
    want = []
    for p, items in enumerate(plans):
        used = 0
        for i, c in enumerate(items):
            taken = used + c <= limit
            used += c * taken
            want.append((p, i, c, taken))
    assert rows(budget.greedy(table, limit, ["ord"], ["plan"]), "plan", "ord", "cost", "taken") == sorted(want)


def test_long_plans_are_decided_by_halving(spark, monkeypatch):
    rng = random.Random(11)
    shapes = [[rng.randrange(0, 30) for _ in range(300)], [c for i in range(60) for c in (1, 200 - i)], [0] * 20 + [200] + [0] * 20, [201] * 40, [rng.choice((0, 1, 64, 65, 128, 200, None)) for _ in range(200)], [3]]
    table = spark.createDataFrame([(p if p else None, i, c) for p, items in enumerate(shapes) for i, c in enumerate(items)], "plan long, ord long, cost long")
    for limit in (200, 1, 0, 63, 64, 5000):
        want = []
        for p, items in enumerate(shapes):
            used = 0
            for i, c in enumerate(items):
                taken = used + (c or 0) <= limit
                used += (c or 0) * taken
                want.append((p, i, taken))
        for size in ((4096, 30) if limit == 200 else (30,)):
            monkeypatch.setattr(budget, "FOLDED", size)
            got = sorted(((r["plan"] or 0), r["ord"], r["taken"]) for r in budget.greedy(table.repartition(7), limit, ["ord"], ["plan"]).collect())
            assert got == want, (limit, size)


def test_lines(spark):
    table = spark.createDataFrame([("a", "x\ny\n"), ("b", ""), ("c", "\n"), ("d", "a\n\n"), ("e", "p\r\nq"), ("f", "last")], "path string, content string")
    assert rows(tables.lines_of(table), "path", "line_no", "text") == [("a", 1, "x"), ("a", 2, "y"), ("c", 1, ""), ("d", 1, "a"), ("d", 2, ""), ("e", 1, "p"), ("e", 2, "q"), ("f", 1, "last")]


def test_hide_and_restore(spark):
    lines = spark.createDataFrame([("f", i, f"line {i}") for i in range(1, 21)], "path string, line_no long, text string")
    ranges = spark.createDataFrame([("f", 3, 5), ("f", 9, 9), ("f", 20, 20)], "path string, s long, e long")
    shown = policy.rendered(lines, ranges)
    text = {r["line_no"]: r["text"] for r in shown.collect()}
    assert text[4] == text[5] == "" and text[3].startswith("...[") and text[3].endswith("]") and text[9].endswith("]...") and text[2] == "line 2"
    kept = policy.range_hashes(lines, ranges)
    assert rows(policy.restored(shown, kept), "line_no", "text") == rows(lines, "line_no", "text")
    assert policy.broken_markers(shown, kept).count() == 0


def test_first_entry_decides(spark):
    lines = spark.createDataFrame([("a.py", i) for i in range(1, 4)], "path string, line_no long")
    entries = spark.createDataFrame([("black", 1, "regex", "py$", [(2, 2)]), ("black", 2, "file", "a.py", None)], policy.POLICY)
    assert rows(policy.hidden_lines(lines, entries, whitelist=False), "line_no", "hidden") == [(1, False), (2, True), (3, False)]
    assert rows(policy.hidden_lines(lines, entries, whitelist=True), "line_no", "hidden") == [(1, True), (2, True), (3, True)]
    assert rows(policy.hidden_lines(lines, entries.limit(0), whitelist=True), "hidden") == [(True,)] * 3


def test_scan_honours_ignore_rules(spark, tmp_path):
    for name in ("a.py", "sub/b.rs", "sub/c.txt", "build/d.py", "keep/build.py", ".hidden.py", "_folder/f.go", ".git/x.py", ".secret.txt", "e.log.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    found = files.scan(spark, str(tmp_path), "build/\n*.log.py\n# note\n!keep/build.py\n")
    assert rows(found, "path", "content") == [(n, "x = 1\n") for n in (".hidden.py", "_folder/f.go", "a.py", "keep/build.py", "sub/b.rs")]


def test_regexes_filed_by_what_they_demand():
    demands = {r"\.py$": [".py"], r"a|b": [], r"^src/(x|y)+/main\.rs$": ["src/", "/main.rs"], r"ab?c*d": ["a", "d"], r"ab{0,2}c{2}d": ["a", "c", "d"], r"[a-z]+_test": ["_test"], r"(?i)abc": [], r"\Qa.b\E": [], r"x\d+y\w": ["x", "y"], r"[]x]q": ["q"], r"[a&&b]q": [], r"a+?b": ["a", "b"], r"(a": [], r"": [], r".*": []}
    assert {p: patterns.required_runs(p) for p in demands} == demands
    assert patterns.keys(r"main\.rs$") == [".rs", "ain", "in.", "mai", "n.r"] and patterns.keys("a|b") == [""] and patterns.keys(None) == [""] and patterns.keys("x.y") == ["x", "y"]


def test_many_entries_against_a_plain_model(spark, monkeypatch):
    rng = random.Random(5)
    names = [f"{rng.choice(('src', 'lib', 'a'))}/{rng.choice(('x', 'yy', 'zzz'))}{rng.randrange(9)}/{rng.choice(('main', 'f', 'util'))}.{rng.choice(('py', 'rs', 'c'))}" for _ in range(80)] + ["top.py", "x", ""]
    forms = [r"\.py$", r"^src/", r"x[0-4]/", r"(main|util)\.rs$", r"zzz?\d", r".*", r"main|f\.c", r"^$", r"a/yy\d/f", r"^.$", r"(?i)MAIN", r"q{0,1}x"]
    span = lambda: rng.choice((None, None, [(1, 1)], [(2, 3), (5, 5)], []))
    some = [(rng.choice(("black", "white")), i, *rng.choice((("regex", rng.choice(forms)), ("regex", rng.choice(forms)), ("file", rng.choice(names)), ("dir", rng.choice(names).rpartition("/")[0] + "/"))), span()) for i in range(60)]
    fits = {"file": lambda p, x: p == x, "dir": lambda p, x: p.startswith(x), "regex": lambda p, x: re.search(x, p) is not None}
    lines = spark.createDataFrame([(n, i) for n in dict.fromkeys(names) for i in range(1, 6)], "path string, line_no long")
    for few, bound, entries in ((32, 100_000, some), (100, 100_000, some), (32, 3, some), (32, 100_000, some[:20]), (2, 1, some[40:])):
        monkeypatch.setattr(policy, "FEW", few)
        monkeypatch.setattr(policy, "BROADCAST_ROWS", bound)
        table = spark.createDataFrame(entries, policy.POLICY)
        for whitelist in (False, True):
            want = []
            for name in dict.fromkeys(names):
                fit = [(w, r) for w, _, k, x, r in entries if fits[k](name, x)]
                for line in range(1, 6):
                    covers = lambda r: r is None or any(s <= line <= e for s, e in r)  # noqa: B023, E731
                    black, white = ([covers(r) for w, r in fit if w == c] for c in ("black", "white"))
                    hidden = any(black) or not (white and white[0]) if whitelist else bool(black and black[0])
                    want.append((name, line, hidden))
            assert rows(policy.hidden_lines(lines, table, whitelist), "path", "line_no", "hidden") == sorted(want), (few, bound, whitelist)


def test_nested_ignore_files_and_pruned_folders(spark, tmp_path):
    rules = {
        ".gitignore": "*.log\nout/\n/top.py\na/*/z.py\n\\#odd.py\n!important.log\n",
        "a/.gitignore": "!kept.log\nb/**\n!b/c\n*.py  \n",
        "a/.ignore": "!w.py\nimportant.log\n",
        "out/.gitignore": "!*\n",
    }
    names = ["top.py", "a/top.py", "x.log", "a/kept.log", "a/x.log", "important.log", "a/important.log", "out/x.py", "d/out/x.py", "d/out.py", "a/q/z.py", "a/w.py", "a/v.py", "a/b/n.rs", "a/b/c/n.rs", "#odd.py", ".git/h.py", "d/.git/h.py", "d/.hidden/h.py", "_x/CVS/h.py"]
    for name in [*names, *rules]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(rules.get(name, "x"))
    found = {r["path"] for r in files.walk(spark, str(tmp_path)).collect()}
    assert found == {".gitignore", "a/.gitignore", "a/.ignore", "a/kept.log", "important.log", "d/out.py", "a/w.py", "d/.hidden/h.py"}
    (tmp_path / "empty").mkdir()
    assert files.walk(spark, str(tmp_path / "empty")).count() == 0


def test_one_ignore_file_against_paths(spark):
    rules = files.ignore_rules("build/\n!x.py\n*.tmp\n/docs/*.md\nsrc/**/gen\n[ab]?.txt\n")
    cases = {"build/x.py": False, "build/y.py": True, "sub/build/y.py": True, "build": False, "a.tmp": True, "d.tmp/f": True, "docs/a.md": True, "x/docs/a.md": False, "src/gen/f": True, "src/p/q/gen": True, "a1.txt": True, "c1.txt": False, "": False}
    table = spark.createDataFrame([(c,) for c in cases], "path string")
    assert {r[0]: r[1] for r in table.select("path", files.is_ignored(table.path, rules)).collect()} == cases


PATCH = """diff --git a/f.txt b/f.txt
--- a/f.txt
+++ b/f.txt
@@ -1,3 +1,4 @@
 one
-two
+2
+2b
 three
@@ -6,2 +7,1 @@ tail
 six
-seven
--- /dev/null
+++ b/new.txt
@@ -0,0 +1,2 @@
+hello
+world
\\ No newline at end of file
--- a/gone.txt
+++ /dev/null
@@ -1 +0,0 @@
-bye
--- a/bad.txt
+++ b/bad.txt
@@ -1 +1 @@
-other
+thing
"""


def test_patches(spark):
    before = {"f.txt": "one\ntwo\nthree\nfour\nfive\nsix\nseven\n", "gone.txt": "bye\n", "bad.txt": "text\n", "same.txt": "same\n"}
    table = spark.createDataFrame(list(before.items()), "path string, content string")
    lines = patches.parse(spark.createDataFrame([(1, PATCH)], "patch_id long, text string"))
    done = {r["path"]: (r["status"], r["content"]) for r in patches.apply(table, lines).collect()}
    assert done == {"f.txt": ("applied", "one\n2\n2b\nthree\nfour\nfive\nsix\n"), "new.txt": ("created", "hello\nworld"), "gone.txt": ("deleted", None), "bad.txt": ("mismatch", "text\n")}
    after = spark.createDataFrame([("f.txt", done["f.txt"][1])], "path string, content string")
    back = {r["path"]: r["content"] for r in patches.apply(after, patches.reverse(lines.filter("file = 'f.txt'"))).collect()}
    assert back == {"f.txt": before["f.txt"]}


def test_patch_edges(spark):
    text = "--- a/x\n+++ b/x\n@@ -1,4 +1,3 @@\n--- old\n+++ new\n \n-c\n z\n--- a/y\n+++ b/y\n@@ -2,0 +3 @@\n+in\n@@ -4,2 +6,2 @@\n d\n-e\n+E\n\\ No newline at end of file\n--- a/z\n+++ b/z\n@@ -2 +2 @@\n-two\n+2\n@@ -2 +2 @@\n-two\n+3\n--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\n+one"
    lines = patches.parse(spark.createDataFrame([(1, text), (2, None), (3, "nothing here")], "patch_id long, text string"))
    assert {r["patch_id"] for r in lines.collect()} == {1}
    assert rows(lines.filter("file = 'x'"), "line_no", "op", "text") == [(1, "-", "-- old"), (2, "+", "++ new"), (3, " ", ""), (4, "-", "c"), (5, " ", "z")]
    table = spark.createDataFrame([("x", "-- old\n\nc\nz"), ("y", "a\nb\nc\nd\ne\n"), ("z", "one\ntwo\n"), ("far", "q")], "path string, content string")
    done = {r["path"]: (r["status"], r["content"]) for r in patches.apply(table, lines).collect()}
    assert done == {"x": ("applied", "++ new\n\nz"), "y": ("applied", "a\nb\nin\nc\nd\nE"), "z": ("mismatch", "one\ntwo\n"), "n": ("created", "one\n")}
    fine = lines.filter("file <> 'z'")
    after = patches.patched(table, patches.apply(table, fine))
    assert rows(patches.patched(after, patches.apply(after, patches.reverse(fine))), "path", "content") == [("far", "q"), ("x", "-- old\n\nc\nz"), ("y", "a\nb\nc\nd\ne\n"), ("z", "one\ntwo\n")]


def test_patch_queue(spark):
    one = lambda i, old, new, at: (i, f"--- a/f\n+++ b/f\n@@ -{at} +{at} @@\n-{old}\n+{new}\n")
    table = spark.createDataFrame([("f", "a\nb\nc\n")], "path string, content string")
    lines = patches.parse(spark.createDataFrame([one(7, "a", "A", 1), one(8, "b", "B", 2), one(9, "A", "AA", 1)], "patch_id long, text string"))
    queue, now, lines = spark.createDataFrame([], "patch_id long, place long"), table, graph.checkpointed(lines)
    for i in (7, 8, 9):
        now, queue = graph.checkpointed(patches.patched(now, patches.apply(now, lines.filter(f"patch_id = {i}")))), graph.checkpointed(patches.queued(queue, lines, i))
    assert rows(now, "content") == [("AA\nB\nc\n",)] and rows(queue, "patch_id", "place") == [(7, 1), (8, 2), (9, 3)]
    back, short = patches.unapply(now, queue, lines)
    assert rows(back, "content") == [("A\nB\nc\n",)] and rows(short, "patch_id") == [(7,), (8,)]
    left, rest, report = patches.yank(now, queue, lines, 8)
    assert rows(left, "content") == [("AA\nb\nc\n",)] and rows(rest, "patch_id", "place") == [(7, 1), (9, 2)] and rows(report, "patch_id", "status") == [(9, "applied")]
    left, rest, report = patches.yank(now, queue, lines, 7)
    assert rows(left, "content") == [("a\nB\nc\n",)] and rows(report, "patch_id", "status") == [(8, "applied"), (9, "mismatch")]


def test_store_appends_what_is_new(spark, tmp_path):
    path = str(tmp_path / "objects")
    store.append_objects(spark.createDataFrame([("a",), ("b",), ("a",)], "content string"), path)
    store.append_objects(spark.createDataFrame([("b",), ("c",)], "content string"), path)
    assert rows(spark.read.parquet(path), "content", "size") == [("a", 1), ("b", 1), ("c", 1)]


def test_method_owner_is_the_tightest(spark):
    f = spark.createDataFrame([("f", "m", 3, 4, 0), ("f", "out", 40, 41, 1)], "file string, name string, line_start long, line_end long, ordinal long")
    c = spark.createDataFrame([("f", "Outer", 1, 30), ("f", "Inner", 2, 10), ("g", "Other", 1, 99)], "file string, name string, line_start long, line_end long")
    assert rows(symbols.method_owners(f, c), "name", "owner") == [("m", "Inner"), ("out", None)]


def test_settings_and_ignore_block(spark):
    from treequarry.operators import project

    text = "mode: blacklist\nblacklist:\n- src/\n- a.py#1-2\n"
    settings_ = project.load_settings(text)
    assert settings_["mode"] == "blacklist" and settings_["whitelist"] == [] and project.load_settings(project.save_settings(settings_)) == settings_
    assert project.load_settings("")["mode"] == "whitelist"
    table = project.entries(spark, settings_)
    more = project.added(project.added(table, "black", "src/"), "black", "new")
    assert rows(more, "list", "ord", "entry") == [("black", 1, "src/"), ("black", 2, "a.py#1-2"), ("black", 3, "new")]
    assert rows(project.removed(more, "black", "src/"), "entry") == [("a.py#1-2",), ("new",)]
    once = project.ignore_block("x\n\n", ["/.data/"])
    assert once == "x\n\n# treequarry begin\n/.data/\n# treequarry end\n" and project.ignore_block(once, ["/.data/"]) == once
    assert project.ignore_block("a\r\n", ["b"]) == "a\r\n\r\n# treequarry begin\r\nb\r\n# treequarry end\r\n"


def test_hide_show_round_trip(spark):
    from treequarry.operators import project

    files_ = spark.createDataFrame([("a.rs", "one"), ("b.rs", "two\n...[abc1234]...\n"), ("c.png", "x"), (".git/h", "y"), ("d.rs", "one")], "path string, content string")
    tracked = spark.createDataFrame([], "key string, path string, hash string")
    wanted = spark.createDataFrame([("a.rs",), ("b.rs",), ("c.png",), (".git/h",), ("d.rs",), ("gone",)], "path string")
    errors = {r["path"]: r["error"] for r in project.checked(wanted, files_, tracked).collect()}
    assert errors == {"a.rs": None, "d.rs": None, "b.rs": "E014", "c.png": "E005", ".git/h": "E020", "gone": "E023"}
    left, known, objects = project.hide(wanted, files_, tracked)
    assert rows(left, "path") == [(".git/h",), ("b.rs",), ("c.png",)] and objects.count() == 1 and known.count() == 2
    back, still = project.show(wanted, left, known, objects)
    assert rows(back, "path", "content") == rows(files_, "path", "content") and still.count() == 0


def test_state_versions(spark, tmp_path):
    from treequarry.operators import state

    table = state.Table(f"file://{tmp_path}/t", "name string, n long")
    assert state.load(spark, table).count() == 0
    one = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], table.schema)
    assert state.save(one, table) == 1 and state.put(spark.createDataFrame([("b", 9)], table.schema), table, "name") == 2
    assert rows(state.load(spark, table), "name", "n") == [("a", 1), ("b", 9)] and state.load(spark, table, 1).count() == 3
    # rows of a writer that failed before its commit are not seen
    one.write.parquet(f"{table.path}/rows/lost")
    assert state.save(one.limit(0), table) == 3
    assert state.load(spark, table).count() == 0 and state.load(spark, table, 2).count() == 2 and state.load(spark, table, 7).count() == 0


def test_markup_blocks(spark):
    from treequarry.operators import markup

    page = spark.createDataFrame([("p", "<!doctype html>\n<div>\n<script>\nvar a = '<div>';\n</script></div>\n<style>b{}</style>\n<section>x</section>\n")], "path string, content string")
    assert rows(markup.html_blocks(page), "name", "line_start", "line_end") == [("<element>", 2, 5), ("<element>", 7, 7), ("<script>", 3, 5), ("<style>", 6, 6)]
    sheet = spark.createDataFrame([("s", "/* a { } */\n.a,\n.b { c: d; }\n@media x {\n  .y { z: 1 }\n}\n@apply foo;\n")], "path string, content string")
    assert rows(markup.css_blocks(sheet), "name", "line_start", "line_end") == [(".a,\n.b", 2, 3), ("@apply (Tailwind)", 7, 7), ("@media", 4, 6)]
    text = "# One\n\nTwo\n---\n```py\n# no\n```\n\n---\n####### seven\n## Three ##\n```\nopen"
    assert rows(markup.markdown_blocks(tables.lines_of(spark.createDataFrame([("m", text)], "path string, content string"))), "name", "line_start", "line_end") == [("# One", 1, 1), ("## Three", 11, 11), ("## Two", 3, 4), ("```code", 12, 13), ("```py", 5, 7)]


def test_parameters(spark):
    from pyspark.sql import functions as F

    from treequarry.operators import parse

    texts = ["", "self", "&mut self, a: u8", "a, b=1", "f: (i32, u8), g: Map<a, b>", "(x)", " "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse.parameters(F.col("t")).alias("p")).collect()
    assert {r["t"]: [tuple(p) for p in r["p"]] for r in got} == {"": [], "self": [], "&mut self, a: u8": [("a", "u8")], "a, b=1": [("a", None), ("b=1", None)], "f: (i32, u8), g: Map<a, b>": [("f", "(i32, u8)"), ("g", "Map<a, b>")], "(x)": [], " ": []}


def test_appending_reads_the_parts_that_it_falls_into(spark, tmp_path):
    contents = lambda *texts: spark.createDataFrame([(t,) for t in texts], "content string")
    path = str(tmp_path / "objects")
    texts = [f"text {i}" for i in range(40)]
    store.append_objects(contents(*texts[:30], texts[0], None), path)
    store.append_objects(contents(*texts[20:]), path)
    schema = "hash string, size long, content string, first string"
    rows = spark.read.schema(schema).parquet(path).collect()
    assert sorted(r["content"] for r in rows) == sorted(texts) and all(r["hash"].startswith(r["first"]) for r in rows)
    # a part that nothing new falls into is not opened, not even a broken one
    mine = hashlib.sha256(texts[0].encode()).hexdigest()[:2]
    other = next(r["first"] for r in rows if r["first"] != mine)
    (tmp_path / "objects" / f"first={other}" / "broken.parquet").write_bytes(b"no parquet")
    store.append_objects(contents(texts[0]), path)
    assert spark.read.schema(schema).parquet(path).filter(f"first = '{mine}'").count() == sum(r["first"] == mine for r in rows)


def test_patches_taken_back_move_contents_once(spark):
    text = "--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n-a\n+A\n+B\n b\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n-no\n+yes\n--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\n+one\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-bye\n--- a/long\n+++ b/long\n@@ -2,0 +3 @@\n+in\n@@ -40000 +40001 @@\n-l39999\n+end\n--- a/e\n+++ b/e\n@@ -1 +1 @@\n-v\n+w"
    lines = patches.parse(spark.createDataFrame([(1, text)], "patch_id long, text string"))
    table = spark.createDataFrame([("x", "a\nb"), ("y", "other\n"), ("g", "bye"), ("long", "\n".join(f"l{i}" for i in range(40000))), ("e", None), ("far", None), ("same", "s\n")], "path string, content string")
    changes = patches.apply(table, lines)
    assert rows(changes, "path", "status") == [("e", "mismatch"), ("g", "deleted"), ("long", "applied"), ("n", "created"), ("x", "applied"), ("y", "mismatch")]
    back = patches.taken_back(table, lines)
    got = {r["path"]: r["content"] for r in back.collect()}
    want = {r["path"]: r["content"] for r in table.collect()} | {"n": "one\n"}
    assert got == {p: c for p, c in want.items() if p not in ("g", "e")}
    assert patches.taken_back(table, lines)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [path") == 1


def test_folders_name_their_ignore_files_and_carry_no_rules(spark, tmp_path, monkeypatch):
    for name, text in {".gitignore": "*.log\n", "a/.ignore": "!k.log\n", "a/b/k.log": "", "a/b/x.log": "", "c/k.log": "", "c/d/y.py": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    levels, kept = [], files.checkpointed
    monkeypatch.setattr(files, "checkpointed", lambda df: levels.append(kept(df)) or levels[-1])
    found = {r["path"] for r in files.walk(spark, str(tmp_path), "y.*\n").collect()}
    assert found == {".gitignore", "a/.ignore", "a/b/k.log"}
    carried = {r["path"]: r["ignores"] for level in levels for r in level.collect() if r["folder"]}
    assert carried == {"a/": '[["", ".gitignore"]]', "c/": '[["", ".gitignore"]]', "a/b/": '[["", ".gitignore"], ["a/", ".ignore"]]', "c/d/": '[["", ".gitignore"]]'}
