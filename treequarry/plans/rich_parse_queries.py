"""Queries over sources of Go, TypeScript and Zig, style sheets and pages, parsed from tokens. Each part is a file; its size says how many functions
it has, and its name stands in strings with braces, which must count for nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treequarry.operators import golang, markup, typescript, zig
from treequarry.plans.registry import query
from treequarry.sources import tables as S


def sources(spark: SparkSession, sf_dir: str, extension: str, head: str, function: str, tail: str) -> DataFrame:
    """path, content: `head`, 1 to 4 times `function`, `tail`, with K (key), N (name), I (number of the function) put in."""
    # a table of a few megabytes makes many times as much text: its rows are dealt out before, by a number that stays
    part = S.table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey").withColumn("n", F.col("p_size") % 4 + 1)
    put = lambda text: F.replace(F.replace(F.lit(text), F.lit("#K"), F.col("p_partkey").cast("string")), F.lit("#N"), F.col("p_name"))
    each = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.replace(put(function), F.lit("#I"), i.cast("string")))
    return part.select(F.concat(F.lit("p/"), "p_partkey", F.lit(f".{extension}")).alias("path"), F.concat(put(head), F.array_join(each, ""), put(tail)).alias("content"))


def each(path: str, first: int, lines: int) -> str:
    """SQL for every function: k, i, path and the line it begins on."""
    return f"f AS (SELECT p_partkey AS k, i, 'p/' || p_partkey || '.{path}' AS path, {first} + {lines} * (i - 1) AS line FROM part, generate_series(1, p_size % 4 + 1) AS g(i)), p AS (SELECT p_partkey AS k, 'p/' || p_partkey || '.{path}' AS path, {first} + {lines} * (p_size % 4 + 1) AS line FROM part)"


GO_HEAD = 'package main\nimport (\n\ts "a/b#K"\n\t"fmt" // "no"\n)\nconst text = "{ #N (" + `func x() {`\n'
GO_FUNCTION = 'func (r *T) F#I(a, b int, c ...string) map[string]int {\n\tr.Call#I("}", a) // none()\n}\n'
GO_TAIL = "func main() { f#K(1) }\ntype (\n\tT#K struct { X int }\n\ti interface {\n\t\tM(x int)\n\t}\n)\n"
GO = each("go", 7, 3)


def go_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir, "go", GO_HEAD, GO_FUNCTION, GO_TAIL)


@query(
    f"WITH {GO} SELECT path, 'F' || i AS name, 'r *T' AS receiver, 'map[string]int' AS returns, 'Public' AS visibility, '' AS attributes, line::BIGINT AS line_start, (line + 2)::BIGINT AS line_end FROM f "
    "UNION ALL SELECT path, 'main', NULL, NULL, 'Private', 'entrypoint', line, line FROM p"
)
def p11_go_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golang.functions(go_files(spark, sf_dir))
    return found.select("path", "name", "receiver", "returns", "visibility", F.array_join("attributes", ",").alias("attributes"), "line_start", "line_end")


@query(f"WITH {GO} SELECT path, 'F' || i AS function, line::BIGINT AS line_no, pos::BIGINT AS pos, param, type FROM f, (VALUES (0, 'a', 'int'), (1, 'b', 'int'), (2, 'c', '...string')) AS v(pos, param, type)")
def p11_go_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without a type have that of the next one."""
    return golang.parameters(go_files(spark, sf_dir))


@query(f"WITH {GO} SELECT path, name, kind, visibility, (line + 1)::BIGINT AS line_start, (line + 6)::BIGINT AS line_end FROM (SELECT path, line, 'T' || k AS name, 'Struct' AS kind, 'Public' AS visibility FROM p UNION ALL SELECT path, line, 'i', 'Interface', 'Private' FROM p)")
def p11_go_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golang.types(go_files(spark, sf_dir))


@query(f"WITH {GO} SELECT path, 'a/b' || k AS import_path, 's' AS alias, 3::BIGINT AS line_no FROM p UNION ALL SELECT path, 'fmt', NULL, 4 FROM p")
def p11_go_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golang.imports(go_files(spark, sf_dir))


@query(f"WITH {GO} SELECT path, 'F' || i AS caller, 'Call' || i AS callee, (line + 1)::BIGINT AS line_no FROM f UNION ALL SELECT path, 'main', 'f' || k, line FROM p")
def p11_go_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golang.calls(go_files(spark, sf_dir))


TS_HEAD = 'import React from "react";\nconst re = /[{/]"/g, half = 4 / 2 / 1; // function no() {\nconst text = `{ #N ${1 ? `(${"{"}` : 2}`;\n'
TS_FUNCTION = "export async function f#I(a: Map<string, number>, { b = '}' }: P, ...c: T[]): Promise<{ n: number }> {\n  return a < 1 ? b : c;\n}\nconst g#I = (x?: string) =>\n  x;\n"
TS_TAIL = 'export const App = (p) => {\n  return <ul className="a">\n    <li>Don\'t { p.a ? <b>#N</b> : "<i>" }</li> <br/>\n  </ul>;\n};\nfunction Part#K() { return <b>1</b>; }\n'
TS = each("tsx", 4, 5)


def ts_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir, "tsx", TS_HEAD, TS_FUNCTION, TS_TAIL)


@query(
    f"WITH {TS} SELECT path, 'f' || i AS name, 'Promise<{{ n: number }}>' AS returns, true AS is_async, false AS arrow, '' AS attributes, line::BIGINT AS line_start, (line + 2)::BIGINT AS line_end FROM f "
    "UNION ALL SELECT path, 'g' || i, NULL, false, true, '', line + 3, line + 4 FROM f UNION ALL SELECT path, 'App', NULL, false, true, 'component,entrypoint', line, line + 4 FROM p UNION ALL SELECT path, 'Part' || k, NULL, false, false, 'component', line + 5, line + 5 FROM p"
)
def p12_ts_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = typescript.functions(ts_files(spark, sf_dir))
    return found.withColumn("attributes", F.array_join("attributes", ","))


@query(
    f"WITH {TS} SELECT path, 'f' || i AS function, line::BIGINT AS line_no, pos::BIGINT AS pos, param, type FROM f, (VALUES (0, 'a', 'Map<string, number>'), (1, '{{ b = ''}}'' }}', 'P'), (2, '...c', 'T[]')) AS v(pos, param, type) "
    "UNION ALL SELECT path, 'g' || i, line + 3, 0, 'x', 'string' FROM f UNION ALL SELECT path, 'App', line, 0, 'p', NULL FROM p"
)
def p12_ts_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typescript.parameters(ts_files(spark, sf_dir))


@query(f"WITH {TS} SELECT path, name, (line + below)::BIGINT AS line_no FROM p, (VALUES ('<ul>', 1), ('<li>', 2), ('<b>', 2)) AS v(name, below)")
def p12_ts_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typescript.markup(ts_files(spark, sf_dir))


ZIG_HEAD = 'const std = @import("std#K");\nconst text = "{ #N (";\npub const Point = struct {\n    x: i32,\n'
ZIG_FUNCTION = "    pub fn f#I(c: u8) error{Bad}!u8 {\n        return call#I(c, '}'); // none()\n    }\n"
ZIG_TAIL = '};\nconst Kind#K = enum { a, b };\nextern "c" fn puts(s: [*]u8) c_int;\nfn main() void { std.debug.print("{", .{}); puts("x"); }\ntest "of { #N" {\n    main();\n}\n'
ZIG = each("zig", 5, 3)


def zig_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir, "zig", ZIG_HEAD, ZIG_FUNCTION, ZIG_TAIL)


_named = "named AS (SELECT p_partkey AS k, p_name FROM part)"


@query(
    f"WITH {ZIG}, {_named} SELECT path, 'f' || i AS name, 'Public' AS visibility, '' AS attributes, line::BIGINT AS line_start, (line + 2)::BIGINT AS line_end FROM f UNION ALL SELECT path, 'puts', 'Private', '', line + 2, line + 2 FROM p "
    "UNION ALL SELECT path, 'main', 'Private', 'entrypoint', line + 3, line + 3 FROM p UNION ALL SELECT path, 'test \"of { ' || p_name || '\"', 'Private', 'test,entrypoint', line + 4, line + 6 FROM p JOIN named USING (k)"
)
def p13_zig_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = zig.functions(zig_files(spark, sf_dir))
    return found.select("path", "name", "visibility", F.array_join("attributes", ",").alias("attributes"), "line_start", "line_end")


@query(f"WITH {ZIG} SELECT path, 'Point' AS name, 'Struct' AS kind, 'Public' AS visibility, 3::BIGINT AS line_start, line::BIGINT AS line_end FROM p UNION ALL SELECT path, 'Kind' || k, 'Enum', 'Private', line + 1, line + 1 FROM p")
def p13_zig_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zig.types(zig_files(spark, sf_dir))


@query(f"WITH {ZIG} SELECT path, 'std' || k AS import_path, 1::BIGINT AS line_no FROM p")
def p13_zig_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zig.imports(zig_files(spark, sf_dir))


@query(f"WITH {ZIG}, {_named} SELECT path, 'f' || i AS caller, 'call' || i AS callee, (line + 1)::BIGINT AS line_no FROM f UNION ALL SELECT path, 'main', 'puts', line + 3 FROM p UNION ALL SELECT path, 'test \"of {{ ' || p_name || '\"', 'main', line + 5 FROM p JOIN named USING (k)")
def p13_zig_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zig.calls(zig_files(spark, sf_dir))


HTML_HEAD = "<!doctype html>\n<!-- <i>#N</i> -->\n<p>#N\n<h1 title='>'>#N</h1>\n"
HTML_EACH = '<div a=">">\n<div>#I</div>\n</div><br>\n'
HTML_TAIL = "<script>\"<b>\"</script>\n<ul><li>x<li>y</ul>\n<section>open\n"
HTML = each("html", 5, 3)


@query(
    f"WITH {HTML} SELECT path, name, (line + a)::BIGINT AS line_start, (line + b)::BIGINT AS line_end FROM p, (VALUES ('<script>', 0, 0), ('<element>', 1, 1), ('<element>', 2, 2)) AS v(name, a, b) "
    "UNION ALL SELECT path, '<element>', n, n FROM p, (VALUES (3), (4)) AS v(n) UNION ALL SELECT path, '<element>', line, line + 2 FROM f UNION ALL SELECT path, '<element>', line + 2, line + 2 FROM f"
)
def p14_html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of several elements at the top, of any name, some without an end."""
    return markup.html_blocks(sources(spark, sf_dir, "html", HTML_HEAD, HTML_EACH, HTML_TAIL))


CSS_HEAD = '@charset "}";\n@import url(a/b;c.css);\n/* #N { */\n@media x {\n  @supports (y: z) {\n    .c { d: url(e/f) }\n  }\n}\n'
CSS_EACH = '#I > a[href="}"]:not(.b),\n.c#I {\n  d: "}" /* } */;\n}\n'
CSS_TAIL = "@layer base;\n.last { a: 1 / 2 }\n.broken {\n"
CSS = each("css", 9, 4)


@query(
    f"WITH {CSS} SELECT path, name, a::BIGINT AS line_start, b::BIGINT AS line_end FROM p, (VALUES ('@charset', 1, 1), ('@import', 2, 2), ('@media', 4, 8)) AS v(name, a, b) "
    "UNION ALL SELECT path, i || ' > a[href=\"}\"]:not(.b),' || chr(10) || '.c' || i, line, line + 3 FROM f UNION ALL SELECT path, '@layer (Tailwind)', line, line FROM p UNION ALL SELECT path, '.last', line + 1, line + 1 FROM p"
)
def p15_css_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slashes, addresses, braces in strings and comments, and blocks in blocks in blocks."""
    return markup.css_blocks(sources(spark, sf_dir, "css", CSS_HEAD, CSS_EACH, CSS_TAIL))
