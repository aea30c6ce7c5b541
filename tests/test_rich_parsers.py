"""Parsers that stand on tokens, on sources written by hand with their rows."""

import time

import pytest

from treequarry.operators import analysis, golang, lexed, markup, state, typescript, zig

GO = '''package main

import (
	"fmt"
	str "strings"
	. "math"
	_ "embed" // a comment with "quotes"
)
import alone "os"

const text = "func fake() {" + `func raw() {
`

// func comment() {}
type (
	Point struct{ X, Y int }
	shape interface {
		Area(scale float64) float64
	}
)

type Pair[K comparable, V any] struct {
	Key K
}

func init() {}

func Add(a, b int, more ...string) (sum int, err error) {
	if a > 0 { fmt.Println("{", str.ToUpper("x")) }
	f := func(x int) int { return helper(x) }
	return f(a), nil
}

func (p *Point) Move(dx, dy float64, m map[string][]int, c chan<- int, fn func(a, b int) bool) interface{ Area() float64 } {
	r := '}'
	return shapeOf(p, r)
}

func unnamed(int, List[int], ...string) {}
func arrays(a [4]int, b []List[int]) {}
func main() { Add(1, 2) }
func TestAdd(t *testing.T) { t.Run("x", nil) }
'''

ZIG = '''const std = @import("std");
const text = "fn fake() {";
// fn comment() void {}
pub const Point = struct {
    x: i32,
    pub fn init(x: i32) Point {
        return make(x);
    }
};
const Colour = enum { red, green };
pub const Value = union(enum) { a: u8, b: u16 };
const Raw = packed struct { a: u1 };
const lines =
    \\\\fn text() { }
;
pub extern "c" fn puts(s: [*:0]const u8) c_int;
pub fn main() error{Bad}!void {
    std.debug.print("{}", .{helper('}')});
    const T = struct { y: u8 };
    _ = @as(u8, 1);
}
inline fn helper(c: u8) u8 {
    return c;
}
test "a { brace" {
    main() catch {};
}
test helper {}
'''

TSX = '''import React, { useState } from "react";
// function comment() {
const re = /[{/]"/g, half = 4 / 2 / 1;
export default function App({ title, n = "}" }: Props, ...rest: Map<string, number>[]): JSX.Element {
  const [x, setX] = useState<number>(0);
  const label = `a ${x ? `in ${title}` : "{"} }`;
  return (
    <div className="x" on={() => { f("{"); }}>
      Don't <b>{label}</b> <Img.X src="a"/> <br/>
      {rest.map(r => <li key={r}>{r}</li>)}
      <div></div>
    </div>
  );
}
export const Widget: React.FC<P> = async (props?: P) => {
  await load();
};
const helper = (a: number, b?: string): { n: number } => ({ n: a });
const loose = <T,>(x: T) =>
  x
let id = (x) => x
async function load<T extends { a: number }>(f: (x: number, y: string) => void, g = { a: 1 }): Promise<Map<string, { b: T }>> {
  function inner() { return 1 < 2; }
}
function overloaded(a: string): void;
const notArrow = (1 + 2) * 3, other = x => x;
call(function expression() {});
function* generator() {}
'''


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a.go", GO), ("b.zig", ZIG), ("c.tsx", TSX), ("d.ts", "const f = (a) => { return <number>a; }\nfunction Big() {}\n"), ("empty.go", ""), ("none.go", None), ("broken.ts", "function f( { `${ <div"), ("broken.go", "func ( { } ) type ( struct {")]
    return spark.createDataFrame(rows, "path string, content string").repartition(3)


def of(files, end):
    return files.filter(f"path like '%{end}'")


def test_tokens_are_the_whole_text(files):
    for language, ends in (("go", ".go"), ("zig", ".zig"), ("typescript", ".ts%")):
        own = of(files, ends)
        got = {}
        for r in lexed.tokens(own, language).orderBy("path", "at").collect():
            assert r["start"] == len(got.get(r["path"], "")) and r["line_no"] == 1 + got.get(r["path"], "").count("\n")
            got[r["path"]] = got.get(r["path"], "") + r["text"]
        assert got == {r["path"]: r["content"] for r in own.collect() if r["content"]}


def test_lexer_on_cut_sources():
    for k in range(len(TSX)):
        for source in (TSX[:k], TSX[k:]):
            assert "".join(t for _, t in lexed.lex(source, True)) == source


def test_go_functions(files):
    got = {r["name"]: (r["receiver"], r["returns"], r["visibility"], r["attributes"], r["line_start"], r["line_end"]) for r in golang.functions(of(files, ".go")).filter("path = 'a.go'").collect()}
    assert got == {
        "init": (None, None, "Private", ["entrypoint", "init"], 26, 26),
        "Add": (None, "(sum int, err error)", "Public", [], 28, 32),
        "Move": ("p *Point", "interface{ Area() float64 }", "Public", [], 34, 37),
        "unnamed": (None, None, "Private", [], 39, 39),
        "arrays": (None, None, "Private", [], 40, 40),
        "main": (None, None, "Private", ["entrypoint"], 41, 41),
        "TestAdd": (None, None, "Public", ["entrypoint", "test"], 42, 42),
    }


def test_go_parameters(files):
    got = sorted((r["function"], r["pos"], r["param"], r["type"]) for r in golang.parameters(of(files, ".go")).filter("path = 'a.go'").collect())
    assert got == [
        ("Add", 0, "a", "int"), ("Add", 1, "b", "int"), ("Add", 2, "more", "...string"),
        ("Move", 0, "dx", "float64"), ("Move", 1, "dy", "float64"), ("Move", 2, "m", "map[string][]int"), ("Move", 3, "c", "chan<- int"), ("Move", 4, "fn", "func(a, b int) bool"),
        ("TestAdd", 0, "t", "*testing.T"), ("arrays", 0, "a", "[4]int"), ("arrays", 1, "b", "[]List[int]"),
    ]


def test_go_types_imports_and_calls(files):
    own = of(files, "a.go")
    assert sorted(map(tuple, golang.types(own).drop("path").collect())) == [("Pair", "Struct", "Public", 22, 24), ("Point", "Struct", "Public", 15, 20), ("shape", "Interface", "Private", 15, 20)]
    assert sorted(map(tuple, golang.imports(own).select("import_path", "line_no", "alias").collect()), key=str) == [("embed", 7, "_"), ("fmt", 4, None), ("math", 6, "."), ("os", 9, "alone"), ("strings", 5, "str")]
    assert sorted((r["caller"], r["callee"], r["line_no"]) for r in golang.calls(own).collect()) == [("Add", "Println", 29), ("Add", "ToUpper", 29), ("Add", "f", 31), ("Add", "helper", 30), ("Move", "shapeOf", 36), ("TestAdd", "Run", 42), ("main", "Add", 41)]


def test_zig(files):
    own = of(files, ".zig")
    got = {r["name"]: (r["visibility"], r["is_async"], r["attributes"], r["line_start"], r["line_end"]) for r in zig.functions(own).collect()}
    assert got == {
        "init": ("Public", False, [], 6, 8),
        "puts": ("Public", False, [], 16, 16),
        "main": ("Public", False, ["entrypoint"], 17, 21),
        "helper": ("Private", False, [], 22, 24),
        'test "a { brace"': ("Private", False, ["test", "entrypoint"], 25, 27),
    }
    assert sorted(map(tuple, zig.types(own).drop("path").collect())) == [("Colour", "Enum", "Private", 10, 10), ("Point", "Struct", "Public", 4, 9), ("Raw", "Struct", "Private", 12, 12), ("Value", "Class", "Public", 11, 11)]
    assert [tuple(r) for r in zig.imports(own).select("import_path", "line_no").collect()] == [("std", 1)]
    assert sorted((r["caller"], r["callee"], r["line_no"]) for r in zig.calls(own).collect()) == [("init", "make", 7), ("main", "helper", 18), ('test "a { brace"', "main", 26)]


def test_typescript_functions(files):
    got = {r["name"]: (r["returns"], r["is_async"], r["arrow"], r["attributes"], r["line_start"], r["line_end"]) for r in typescript.functions(of(files, ".tsx")).collect()}
    assert got == {
        "App": ("JSX.Element", False, False, ["component", "entrypoint"], 4, 14),
        "Widget": (None, True, True, ["component"], 15, 17),
        "helper": ("{ n: number }", False, True, [], 18, 18),
        "loose": (None, False, True, [], 19, 20),
        "id": (None, False, True, [], 21, 21),
        "load": ("Promise<Map<string, { b: T }>>", True, False, [], 22, 24),
        "inner": (None, False, False, [], 23, 23),
    }
    assert sorted((r["name"], r["attributes"], r["line_end"]) for r in typescript.functions(of(files, "d.ts")).collect()) == [("Big", [], 2), ("f", [], 1)]


def test_typescript_parameters_and_markup(files):
    own = of(files, ".tsx")
    assert sorted((r["function"], r["pos"], r["param"], r["type"]) for r in typescript.parameters(own).collect()) == [
        ("App", 0, '{ title, n = "}" }', "Props"), ("App", 1, "...rest", "Map<string, number>[]"), ("Widget", 0, "props", "P"), ("helper", 0, "a", "number"), ("helper", 1, "b", "string"),
        ("id", 0, "x", None), ("load", 0, "f", "(x: number, y: string) => void"), ("load", 1, "g", None), ("loose", 0, "x", "T"),
    ]
    assert sorted(map(tuple, typescript.markup(own).select("name", "line_no").collect())) == [("<b>", 9), ("<div>", 8), ("<li>", 10)]


def test_broken_sources(files):
    for f in (golang.functions, golang.parameters, golang.types, golang.imports, golang.calls):
        assert f(of(files, "n.go")).count() == 0
    for f in (typescript.functions, typescript.parameters, typescript.markup):
        assert f(of(files, "n.ts")).count() == 0


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_what_tokens_tell_of_each_other_needs_no_shuffle(files):
    own = of(files, ".go")
    assert exchanges(golang.types(own)) == 0 and exchanges(golang.imports(own)) == 0
    assert exchanges(golang.functions(own)) <= 3 and exchanges(golang.calls(own)) <= 2
    assert exchanges(zig.imports(of(files, ".zig"))) == 0 and exchanges(zig.types(of(files, ".zig"))) == 1
    assert exchanges(typescript.functions(of(files, ".tsx"))) <= 3


def test_nested_tokens_of_unmatched_brackets(spark):
    rows = lexed.nested(spark.createDataFrame([("a.go", ") a ( b [ c ) { d"), ("b.go", "")], "path string, content string"), "go").orderBy("at").collect()
    assert [(r["text"], r["level"], r["partner"] and r["partner"]["at"], r["inside"] and r["inside"]["text"]) for r in rows] == [
        (")", -1, None, None), ("a", -1, None, None), ("(", -1, None, None), ("b", 0, None, None), ("[", 0, 12, None), ("c", 1, None, "["), (")", 0, 8, None), ("{", 0, None, None), ("d", 1, None, "{"),
    ]


def test_an_arrow_function_at_the_end_of_a_file_ends_behind_its_call(spark):
    one = spark.createDataFrame([("a.ts", "const f = (x) => call(\n  x,\n)\n")], "path string, content string")
    assert [(r["name"], r["line_start"], r["line_end"]) for r in typescript.functions(one).collect()] == [("f", 1, 3)]


def test_long_texts_behind_the_last_script_are_searched_once(spark):
    page = spark.createDataFrame([("a.html", "x\n<script>1</script>\n" + "words " * 100_000)], "path string, content string")
    began = time.perf_counter()
    assert [(r["line_start"], r["line_end"]) for r in markup._blocks(page, markup.HTML_BLOCKS).collect()] == [(2, 2)]
    assert time.perf_counter() - began < 60


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_functions_of_zig_parse_a_file_once_and_modifiers_belong_to_their_own_run(spark):
    source = 'pub const a = 1;\nfn plain() void {}\npub\nextern "c" fn far() void;\nasync fn later() void {}\ntest "x" {}\n'
    found = zig.functions(spark.createDataFrame([("a.zig", source)], "path string, content string"))
    assert plan(found).count("MapInArrow") == 1
    assert sorted((r["name"], r["visibility"], r["is_async"], r["line_start"], r["line_end"]) for r in found.collect()) == [
        ("far", "Public", False, 3, 4), ("later", "Private", True, 5, 5), ("plain", "Private", False, 2, 2), ('test "x"', "Private", False, 6, 6),
    ]


def test_contents_and_what_is_parsed_are_never_broadcast(spark, tmp_path):
    # a table of one short row looks small to Spark, whatever is made of it
    spark.createDataFrame([(1,)], "k int").write.parquet(f"{tmp_path}/k")
    own = spark.read.parquet(f"{tmp_path}/k").selectExpr("concat('a', k, '.tsx') AS path", "'function f(a: T): R { g(a) }' AS content")
    assert "Broadcast" not in plan(typescript.functions(own)) and "Broadcast" not in plan(typescript.parameters(own))
    assert "Broadcast" not in plan(zig.calls(own)) and "Broadcast" not in plan(analysis.metadata(own)) and "Broadcast" not in plan(analysis.parsed(own))


def test_first_records_are_made_once_and_contents_do_not_move(spark, tmp_path):
    files = spark.createDataFrame([("a.zig", "fn f() void {}"), ("b.zig", "fn f() void {}"), ("c.zig", None)], "path string, content string")
    assert "min_by" not in plan(analysis.metadata(files))
    table = state.Table(str(tmp_path), state.METADATA)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    state.put(analysis.metadata(files).repartition(1).mapInPandas(count, "hash string, json string"), table, "hash")
    assert made.value == 1 and state.load(spark, table).count() == 1


def test_a_page_is_read_once_and_does_not_move(spark):
    page = "<p>a\n<SCRIPT x>\n1</script >\n<style>b</style><script>open\n"
    found = markup.html_blocks(spark.createDataFrame([("a.html", page), ("b.html", None), ("c.html", "")], "path string, content string"))
    assert plan(found).count("MapInPandas") == 1 and "Exchange" not in plan(found)
    assert sorted((r["name"], r["line_start"], r["line_end"]) for r in found.collect() if r["name"] != "<element>") == [("<script>", 2, 3), ("<style>", 4, 4)]


def test_parameters_of_typescript_cut_a_file_once_and_no_row_leaves_its_task(files, spark):
    own = of(files, ".ts%")
    assert exchanges(typescript.parameters(own)) == exchanges(typescript.functions(own)) == 0
    assert plan(typescript.parameters(own)).count("MapInArrow") == 1
    # Arrow batches are bounded by the session's settings, so that a worker holds few files
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
    odd = spark.createDataFrame([("a.ts", "function f(a: Map<b, c> = {}, ...d?) { }\nconst g = (h\n"), ("b.ts", "function i(")], "path string, content string")
    assert sorted((r["function"], r["pos"], r["param"], r["type"]) for r in typescript.parameters(odd).collect()) == [("f", 0, "a", "Map<b, c>"), ("f", 1, "...d", None)]


def test_symbols_of_go_and_zig_cut_a_file_once_and_no_row_leaves_its_task(files):
    columns = ["path", "name", "kind", "visibility", "line_start", "line_end"]
    for end, parser in ((".go", golang), (".zig", zig)):
        own = of(files, end)
        apart = parser.functions(own).selectExpr("path", "name", "'Function' AS kind", "visibility", "line_start", "line_end").unionByName(parser.types(own).select(*columns))
        found = parser.symbols(own)
        assert exchanges(found) == 0 and plan(found).count("MapInArrow") == 1
        assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(map(tuple, apart.collect()), key=str)
    # one for Go and one for Zig, two for TypeScript, one for style sheets
    assert plan(analysis.symbols(files)).count("MapInArrow") == 5


def test_what_a_cache_lacks_is_written_before_it_is_parsed(spark):
    files = spark.createDataFrame([("a", "known"), ("b", "new"), ("c", "new"), ("d", None)], "path string, content string")
    cache = files.filter("path = 'a'").selectExpr("path", "sha2(content, 256) AS hash", f"{state.FORMAT}L AS format", "'old' AS parsed")
    seen = []

    def parse(fresh):
        seen.append(plan(fresh))
        return fresh.selectExpr("path", "concat('of ', content) AS parsed")

    found = state.cached_or_parsed(files.filter("content is not null"), cache, parse)
    assert sorted((r["path"], r["parsed"], r["cached"]) for r in found.collect()) == [("a", "old", True), ("b", "of new", False), ("c", "of new", False)]
    assert "Join" not in seen[0] and "ExistingRDD" in seen[0]
