"""Queries over the call graph, symbols and entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treequarry.functions.names import STD
from treequarry.operators import budget, entrypoints, graph, parse, symbols
from treequarry.plans.registry import query
from treequarry.sources import tables as S

std_names = "[" + ", ".join(f"'{n}'" for n in STD) + "]"


def seeds(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "seed string")


def located(edges: DataFrame) -> DataFrame:
    """name, file: every node lies in a file by its kind and the last digits of its number."""
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return names.select("name", F.concat(F.lit("f/"), F.substring("name", 1, 1), F.pmod(F.expr("substring(name, 2)").cast("long"), F.lit(50)).cast("string"), F.lit(".py")).alias("file"))


LOCATED = "located AS (SELECT name, 'f/' || name[1] || (substr(name, 2)::BIGINT % 50) || '.py' AS file FROM (SELECT src AS name FROM fx_edges UNION SELECT dst FROM fx_edges))"


def walk(start: str, depth: int, edges: str = "fx_edges", back: bool = False) -> str:
    """Recursive SQL: (seed, name, depth) of the nodes within `depth` steps of the rows of `start`, each at its least depth."""
    a, b = ("dst", "src") if back else ("src", "dst")
    return (
        f"once AS (SELECT DISTINCT {a} AS a, {b} AS b FROM {edges}), seeds AS ({start}), "
        f"walk(seed, name, depth) AS (SELECT seed, seed, 0::BIGINT FROM seeds UNION SELECT w.seed, e.b, w.depth + 1 FROM walk w JOIN once e ON w.name = e.a WHERE w.depth < {depth}), "
        "level AS (SELECT seed, name, min(depth) AS depth FROM walk GROUP BY ALL)"
    )


def reach(start: str, back: bool = False) -> str:
    """Recursive SQL: (seed, name) of all nodes that the rows of `start` reach, themselves included. The graph is so narrow
    that this is the same as within the depths of `graph.REACHABLE` and `graph.CALLERS`."""
    a, b = ("dst", "src") if back else ("src", "dst")
    return f"once AS (SELECT DISTINCT {a} AS a, {b} AS b FROM fx_edges), seeds AS ({start}), level(seed, name) AS (SELECT seed, seed FROM seeds UNION SELECT r.seed, e.b FROM level r JOIN once e ON r.name = e.a)"


def one(*names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in names) + ") AS v(seed)"


@query(f"WITH RECURSIVE {walk(one('R0'), 4)} SELECT seed, name, depth FROM level WHERE depth > 0")
def g1_trace_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(S.edges(spark, sf_dir), seeds(spark, "R0"), 4)


@query(f"WITH RECURSIVE {walk(one('S7', 'C5'), 3, back=True)} SELECT seed, name, depth FROM level WHERE depth > 0")
def g1_trace_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(graph.reversed_edges(S.edges(spark, sf_dir)), seeds(spark, "S7", "C5"), 3)


@query(
    f"WITH RECURSIVE {walk('SELECT ' + chr(39) + 'N' + chr(39) + ' || n_nationkey AS seed FROM nation', 2)}, scanned AS (SELECT seed, count(*) AS n FROM level JOIN fx_edges ON name = src WHERE depth < 2 GROUP BY seed) "
    "SELECT seed, coalesce(n, 0) > (SELECT count(*) FROM level l WHERE l.seed = seeds.seed AND depth > 0) AS revisits FROM seeds LEFT JOIN scanned USING (seed)"
)
def g2_cycle_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = S.table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("seed"))
    return graph.trace(S.edges(spark, sf_dir), starts, 2)[1]


@query(f"WITH RECURSIVE {walk(one('R1', 'R2'), 3)} SELECT name, min(depth) AS depth FROM level WHERE depth > 0 GROUP BY name")
def g3_all_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = graph.reach(S.edges(spark, sf_dir), seeds(spark, "R1", "R2"), 3)
    return levels.groupBy("name").agg(F.min("depth").alias("depth"))


@query("SELECT (SELECT count(*) FROM (SELECT src FROM fx_edges UNION SELECT dst FROM fx_edges)) AS n_nodes, (SELECT count(*) FROM fx_edges) AS n_edges")
def g5_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(S.edges(spark, sf_dir))


@query(f"WITH RECURSIVE {reach(one('C5'))}, {LOCATED} SELECT DISTINCT file FROM level JOIN located USING (name) WHERE name <> seed")
def g6_reachable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = S.edges(spark, sf_dir)
    return graph.reachable_files(edges, located(edges), "C5")


@query(f"WITH RECURSIVE {reach(one('C5'))}, {LOCATED} SELECT DISTINCT file FROM located WHERE file NOT IN (SELECT file FROM level JOIN located USING (name) WHERE name <> seed)")
def j8_unreachable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = S.edges(spark, sf_dir)
    return graph.unreachable_files(edges, located(edges), "C5")


@query(f"WITH RECURSIVE {reach(one('S3'), back=True)}, {LOCATED} SELECT DISTINCT file FROM level JOIN located USING (name) WHERE name <> seed")
def g7_callers_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = S.edges(spark, sf_dir)
    return graph.reachable_files(graph.reversed_edges(edges), located(edges), "S3", graph.CALLERS)


@query(f"WITH RECURSIVE {reach(one('O7'))}, {LOCATED} SELECT DISTINCT file FROM level JOIN located USING (name) WHERE name <> seed")
def g7_callees_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = S.edges(spark, sf_dir)
    return graph.reachable_files(edges, located(edges), "O7", graph.CALLERS)


@query(f"WITH RECURSIVE {walk(one('N4'), 2)}, {LOCATED} SELECT DISTINCT file FROM level JOIN located USING (name)")
def g8_context_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = S.edges(spark, sf_dir)
    return graph.context_files(edges, located(edges), "N4")


@query(f"WITH RECURSIVE {walk('SELECT ' + chr(39) + 'R' + chr(39) + ' || r_regionkey AS seed FROM region', 2)} SELECT seed, count(*) AS n_reached FROM level WHERE depth > 0 GROUP BY seed")
def g9_entrypoint_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = S.table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("seed"))
    return graph.reach(S.edges(spark, sf_dir), starts, 2).groupBy("seed").agg(F.count("*").alias("n_reached"))


@query(f"WITH RECURSIVE {LOCATED}, {walk('SELECT name AS seed FROM located WHERE file = ' + chr(39) + 'f/C7.py' + chr(39), 2)} SELECT seed, name, depth FROM level WHERE depth > 0")
def g10_focus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces from every function of one file."""
    edges = S.edges(spark, sf_dir)
    return graph.reach(edges, located(edges).filter("file = 'f/C7.py'").select(F.col("name").alias("seed")), 2)


@query(f"WITH RECURSIVE {walk('SELECT ' + chr(39) + 'R' + chr(39) + ' || r_regionkey AS seed FROM region', 3)} SELECT count(DISTINCT name) AS n_functions FROM level WHERE depth > 0")
def a8_total_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = S.table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("seed"))
    return graph.reach(S.edges(spark, sf_dir), starts, 3).agg(F.count_distinct("name").alias("n_functions"))


def std_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations get names of standard functions."""
    names = F.array(*map(F.lit, STD))
    renamed = lambda c: F.when(F.col(c).startswith("N"), F.element_at(names, F.expr(f"cast(substring({c}, 2) as int) + 1"))).otherwise(F.col(c))
    return S.edges(spark, sf_dir).select(renamed("src").alias("src"), renamed("dst").alias("dst"))


_std = f"std AS (SELECT CASE WHEN src[1] = 'N' THEN ({std_names})[substr(src, 2)::BIGINT + 1] ELSE src END AS src, CASE WHEN dst[1] = 'N' THEN ({std_names})[substr(dst, 2)::BIGINT + 1] ELSE dst END AS dst FROM fx_edges)"


@query(f"WITH RECURSIVE {_std}, {walk(one('R2'), 3, edges='std')} SELECT seed, name, dense_rank() OVER (PARTITION BY seed ORDER BY depth) AS depth FROM level WHERE depth > 0 AND NOT list_contains({std_names}, name)")
def f12_trace_without_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.without_std(graph.reach(std_edges(spark, sf_dir), seeds(spark, "R2"), 3))


@query(f"WITH {_std} SELECT src, dst FROM std WHERE NOT list_contains({std_names}, src) AND NOT list_contains({std_names}, dst)")
def f13_graph_without_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_without_std(std_edges(spark, sf_dir))


@query(f"SELECT doc_id, name, list_contains({std_names}, name) OR starts_with(name, 'test_0_') AS std FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ({std_names})[doc_id % {len(STD)} + 1] WHEN doc_id % 7 = 0 THEN 'test_0_' || doc_id ELSE 'fn_' || doc_id END AS name FROM documents)")
def f11_std_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treequarry.functions.names import is_std

    name = F.when(F.col("doc_id") % 3 == 0, F.element_at(F.array(*map(F.lit, STD)), F.pmod("doc_id", F.lit(len(STD))).cast("int") + 1)).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("test_0_"), "doc_id")).otherwise(F.concat(F.lit("fn_"), "doc_id"))
    return S.table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).withColumn("std", is_std(F.col("name")))


_again = "SELECT seed, 3, NULL, NULL, unnest(['', '(cycle detected - trace may be incomplete)']) FROM flag WHERE again"
_tree = f"{walk(one('R3', 'S5'), 2)}, flag AS (SELECT seed, coalesce((SELECT count(*) FROM level l JOIN fx_edges ON l.name = src WHERE l.depth < 2 AND l.seed = seeds.seed), 0) > (SELECT count(*) FROM level l WHERE l.seed = seeds.seed AND depth > 0) AS again FROM seeds)"


@query(
    f"WITH RECURSIVE {_tree} SELECT seed, 1::BIGINT AS section, NULL::BIGINT AS depth, NULL::VARCHAR AS name, seed || ' calls:' AS line FROM seeds UNION ALL "
    "SELECT seed, 2, depth, name, repeat('  ', depth::INT) || CASE WHEN depth = deepest AND NOT again THEN '└──' ELSE '├──' END || ' ' || name FROM (SELECT *, max(depth) OVER (PARTITION BY seed) AS deepest FROM level JOIN flag USING (seed) WHERE depth > 0) "
    f"UNION ALL {_again}"
)
def x1_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tree_lines(*graph.trace(S.edges(spark, sf_dir), seeds(spark, "R3", "S5"), 2))


@query(
    f"WITH RECURSIVE {_tree} SELECT seed, 1::BIGINT AS section, NULL::BIGINT AS depth, NULL::VARCHAR AS name, 'Called: ' || seed AS line FROM seeds UNION ALL SELECT DISTINCT seed, 2, depth, NULL, '[Depth ' || depth || ']' FROM level WHERE depth > 0 "
    f"UNION ALL SELECT seed, 2, depth, name, '  - ' || name FROM level WHERE depth > 0 UNION ALL {_again}"
)
def x2_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.list_lines(*graph.trace(S.edges(spark, sf_dir), seeds(spark, "R3", "S5"), 2))


@query("""SELECT 0::BIGINT AS section, '    "' || name || '" [label="' || name || '"];' AS line FROM (SELECT src AS name FROM fx_edges UNION SELECT dst FROM fx_edges) UNION ALL SELECT 1, '    "' || src || '" -> "' || dst || '";' FROM fx_edges""")
def x3_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dot_lines(S.edges(spark, sf_dir))


_first = "first AS (SELECT name, arg_min(file, (file, ordinal)) AS file, arg_min(line_start, (file, ordinal)) AS line FROM fx_symbols WHERE kind = 'Function' GROUP BY name)"


@query(f"WITH {_first}, named AS (SELECT caller AS name FROM fx_calls UNION SELECT callee FROM fx_calls) SELECT name, file, line FROM named FULL JOIN first USING (name)")
def j4_node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(S.symbols(spark, sf_dir), S.calls(spark, sf_dir))


@query("SELECT callee AS name FROM fx_calls WHERE caller = 'assistant_1'")
def j6_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(graph.call_edges(S.calls(spark, sf_dir)), "assistant_1")


@query("SELECT caller AS name FROM fx_calls WHERE callee = 'assistant_1'")
def j6_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(graph.call_edges(S.calls(spark, sf_dir)), "assistant_1", callers=True)


@query("SELECT name, arg_min(file, (file, ordinal)) AS file, arg_min(line_start, (file, ordinal)) AS line FROM fx_symbols GROUP BY name")
def w1_first_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.first_definitions(S.symbols(spark, sf_dir))


@query(
    "SELECT f.file, f.name, f.line_start, f.ordinal, arg_min(c.name, (c.line_end - c.line_start, c.line_start, c.name)) AS owner FROM fx_symbols f LEFT JOIN fx_classes c ON f.file = c.file AND f.line_start >= c.line_start AND f.line_end <= c.line_end WHERE f.kind = 'Function' GROUP BY ALL"
)
def j2_method_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.method_owners(S.symbols(spark, sf_dir).filter("kind = 'Function'"), S.classes(spark, sf_dir))


@query(
    "WITH points AS (SELECT DISTINCT file, line + turn % 3 AS line FROM (SELECT file, line, (row_number() OVER (PARTITION BY file ORDER BY line)) AS turn FROM fx_calls)) SELECT p.file, p.line, arg_max(s.name, s.ordinal) AS caller FROM points p LEFT JOIN fx_symbols s ON s.file = p.file AND s.kind = 'Function' AND p.line BETWEEN s.line_start AND s.line_end GROUP BY ALL"
)
def j3_call_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = S.calls(spark, sf_dir).selectExpr("file", "line + row_number() over (partition by file order by line) % 3 as line").distinct()
    return symbols.enclosing_symbol(points, S.symbols(spark, sf_dir))


@query(
    "WITH wanted AS (SELECT DISTINCT CASE WHEN line_start % 3 = 0 THEN 'crate::m::' || name ELSE name END AS name FROM fx_symbols UNION SELECT 'no::such'), exact AS (SELECT w.name, s.name AS found, file, line_start FROM wanted w JOIN fx_symbols s ON w.name = s.name) "
    "SELECT * FROM exact UNION ALL SELECT w.name, s.name, file, line_start FROM wanted w JOIN fx_symbols s ON split_part(w.name, '::', -1) = s.name WHERE w.name NOT IN (SELECT name FROM exact)"
)
def j1_symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.symbols(spark, sf_dir)
    wanted = s.select(F.when(F.col("line_start") % 3 == 0, F.concat(F.lit("crate::m::"), "name")).otherwise(F.col("name")).alias("name")).unionByName(spark.createDataFrame([("no::such",)], "name string")).distinct()
    return symbols.look_up(wanted, s)


@query("SELECT name, count(*) OVER (PARTITION BY name) AS n_entries, file, line_start FROM fx_symbols")
def a10_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.inverted_index(S.symbols(spark, sf_dir))


@query("SELECT s.file, count_if(kind = 'Function')::BIGINT AS n_functions, count_if(kind = 'Module')::BIGINT AS n_modules, coalesce((SELECT count(*) FROM fx_calls c WHERE c.file = s.file), 0) AS n_calls FROM fx_symbols s GROUP BY s.file")
def a2_counts_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.counts_by_file(S.symbols(spark, sf_dir), S.calls(spark, sf_dir))


@query("SELECT count(*) AS n_symbols, count(DISTINCT file) AS n_files, count(DISTINCT name) AS n_names FROM fx_symbols")
def a3_symbol_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.totals(S.symbols(spark, sf_dir))


@query("SELECT file, line_start, line_end, lag(line_end) OVER w AS prev_end, coalesce(line_start > lag(line_end) OVER w + 1, false) AS gap FROM fx_symbols WHERE kind = 'Function' WINDOW w AS (PARTITION BY file ORDER BY line_start, line_end)")
def w6_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.gaps(S.symbols(spark, sf_dir).filter("kind = 'Function'"))


@query(
    "WITH r AS (SELECT file, line_start + 1 AS s, line_start + 2 AS e FROM fx_symbols) SELECT file, s, e, coalesce(arg_min(line_start, (line_end - line_start, line_start, line_end)), s) AS from_line, coalesce(arg_min(line_end, (line_end - line_start, line_start, line_end)), e) AS to_line FROM (SELECT DISTINCT r.*, x.line_start, x.line_end FROM r LEFT JOIN fx_symbols x ON r.file = x.file AND x.line_start <= s AND e <= x.line_end) GROUP BY file, s, e"
)
def m11_symbol_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.symbols(spark, sf_dir)
    return symbols.aligned(s.select("file", (F.col("line_start") + 1).alias("s"), (F.col("line_start") + 2).alias("e")), s)


@query(
    "SELECT file, string_agg(CASE WHEN kind = 'Function' THEN 'fn ' || name || '() { ... ' || (line_end - line_start) || ' lines ... }' ELSE 'mod ' || name END, chr(10) ORDER BY line_start, ordinal) AS text FROM fx_symbols GROUP BY file"
)
def m8_header_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.outline(S.symbols(spark, sf_dir))


_conv_lines = "conv_lines AS (SELECT file, unnest(generate_series(line_start, line_end)) AS line_no FROM fx_symbols)"


@query(
    f"WITH {_conv_lines} SELECT file, line_no FROM conv_lines l WHERE EXISTS (SELECT 1 FROM fx_symbols s WHERE s.file = l.file AND line_no BETWEEN line_start AND CASE WHEN EXISTS (SELECT 1 FROM fx_calls c WHERE c.file = s.file AND c.callee = s.name) THEN line_end ELSE line_start END)"
)
def m9_level_two_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.symbols(spark, sf_dir)
    lines = s.select("file", F.explode(F.sequence("line_start", "line_end")).alias("line_no"))
    return symbols.level_lines(lines, s, S.calls(spark, sf_dir), 2)


@query(
    "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'async fn ' ELSE 'fn ' END || p_brand || '(' || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a: ' || p_type ELSE 'a: ' || p_type || ', b' END || ')' || CASE WHEN p_partkey % 5 = 0 THEN ' -> ' || p_name ELSE '' END WHEN 1 THEN 'mod ' || p_brand ELSE 'Struct ' || p_brand END AS signature FROM part"
)
def p20_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "Function").when(F.col("p_size") % 3 == 1, "Module").otherwise("Struct")
    a, b = F.struct(F.lit("a").alias("name"), F.col("p_type").alias("type")), F.struct(F.lit("b").alias("name"), F.lit(None).cast("string").alias("type"))
    params = F.slice(F.array(a, b), 1, (F.col("p_partkey") % 3).cast("int"))
    returns = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name"))
    return S.table(spark, sf_dir, "part").select("p_partkey", symbols.signature(kind, F.col("p_brand"), params, returns, F.col("p_partkey") % 2 == 0).alias("signature"))


#: Symbols of files in the project: names by which the rules of every language can be tried.
NAMES = ["main", "run", "cli", "start", "test_x", "x_test", "testCase", "TestX", "init", "App", "do_cmd", "user_route_cmd", "resource_a", "helper", 'test "a"', "it(works)"]
MODULES = ["<script>", "<style>", "@tailwind base", "# Title", "<App>", "other"]


def project_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two symbols in every file, a function and a module, chosen by the file's length."""
    at = lambda values, shift: F.element_at(F.array(*map(F.lit, values)), F.pmod(F.octet_length("content") + shift, F.lit(len(values))).cast("int") + 1)
    n = F.octet_length("content")
    attributes = F.when(n % 4 == 0, F.array(F.lit("tokio::main"))).when(n % 4 == 1, F.array(F.lit("entrypoint"))).when(n % 4 == 2, F.array(F.lit("test"))).otherwise(F.array().cast("array<string>"))
    files = S.files(spark, sf_dir)
    functions = files.select(F.col("path").alias("file"), at(NAMES, 0).alias("name"), F.lit("Function").alias("kind"), (n % 3 + 1).cast("long").alias("line_start"), attributes.alias("attributes"))
    modules = files.select(F.col("path").alias("file"), at(MODULES, 1).alias("name"), F.lit("Module").alias("kind"), (n % 2 + 1).cast("long").alias("line_start"), F.array().cast("array<string>").alias("attributes"))
    return functions.unionByName(modules)


def project_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Paths and symbols, computed once for all rules."""
    return S.files(spark, sf_dir).select("path"), graph.checkpointed(project_symbols(spark, sf_dir))


_q = lambda values: "[" + ", ".join("'" + v + "'" for v in values) + "]"
_b = "regexp_extract(path, '[^/]*$')"
_sym = f"""f AS (SELECT path, {_b} AS b, regexp_extract({_b}, '[^.]*$') AS ext, strlen(content) AS n FROM fx_files),
 s AS (SELECT path, b, ext, ({_q(NAMES)})[n % {len(NAMES)} + 1] AS name, (n % 3 + 1)::BIGINT AS line, CASE n % 4 WHEN 0 THEN 'tokio::main' WHEN 1 THEN 'entrypoint' WHEN 2 THEN 'test' ELSE '' END AS attr FROM f),
 m AS (SELECT path, b, ext, ({_q(MODULES)})[(n + 1) % {len(MODULES)} + 1] AS name, (n % 2 + 1)::BIGINT AS line FROM f)"""


def _rows(source: str, language: str, ext: str, cases: list[tuple[str, str, str | None]], name: str = "name", line: str = "line") -> str:
    kind = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, k, _ in cases) + " END"
    note = "CASE " + " ".join(f"WHEN {c} THEN {'NULL' if d is None else chr(39) + d + chr(39)}" for c, _, d in cases) + " END"
    return f"SELECT * FROM (SELECT {name} AS name, path AS file, {line} AS line, {kind} AS entry_type, '{language}' AS language, ({note})::VARCHAR AS description FROM {source} WHERE ext IN ({ext})) WHERE entry_type <> 'none'"


_f = lambda language, ext, cases, name="b": _rows("f", language, ext, cases, name, "1::BIGINT")
RULES = {
    "rust": [_rows("s", "rust", "'rs'", [("name = 'main'", "main", None), ("attr LIKE '%test%'", "test", None), ("starts_with(name, 'test_') OR name LIKE '%\\_test' ESCAPE '\\'", "test", None), ("attr LIKE '%main%'", "main", "async main")])],
    "typescript": [_rows("s", "typescript", "'ts'", [("name IN ('main', 'run', 'start')", "main", None), ("name = 'test' OR regexp_matches(name, '^test(_|[A-Z])') OR starts_with(name, 'it(')", "test", None)])],
    "python": [
        _rows("s", "python", "'py'", [("name IN ('main', 'run', 'cli')", "main", None), ("starts_with(name, 'test_')", "test", None), ("list_has_any(string_split(name, '_'), ['command', 'cmd'])", "cli", None)]),
        _rows("s", "python", "'py'", [("name IN ('main', 'run', 'cli') OR starts_with(name, 'test_')", "none", None), ("list_has_any(string_split(name, '_'), ['route', 'endpoint'])", "handler", None)]),
    ],
    "bash": [_f("bash", "'sh'", [("true", "main", "shell script")]), _rows("s", "bash", "'sh'", [("name IN ('main', 'run', 'start')", "main", "script function")])],
    "terraform": [_f("terraform", "'tf'", [("b = 'main.tf'", "main", "terraform config")]), _rows("s", "terraform", "'tf'", [("regexp_matches(name, '^(resource|module|data)')", "handler", "terraform block")], "b || ':' || name")],
    "helm": [_f("helm", "'yaml'", [("b = 'Chart.yaml'", "main", "helm chart metadata")]), _f("helm", "'yaml'", [("path LIKE '%/templates/%'", "handler", "helm template")])],
    "go": [
        _rows("s", "go", "'go'", [("name = 'main'", "main", "Go main function"), ("name = 'init'", "main", "Go init function"), ("attr = 'entrypoint'", "main", None)]),
        "SELECT b, path, 1::BIGINT, 'main', 'go', 'Go executable' FROM s WHERE ext = 'go' AND name = 'main'",
    ],
    "zig": [_rows("s", "zig", "'zig'", [("name = 'main'", "main", "Zig main function"), ("starts_with(name, 'test \"') OR attr = 'test'", "test", "Zig test"), ("attr = 'entrypoint'", "main", None)]), _f("zig", "'zig'", [("b = 'build.zig'", "main", "Zig build script")])],
    "html": [_f("html", "'html'", [("true", "main", "HTML document")]), _rows("m", "html", "'html'", [("name = '<script>'", "handler", "JavaScript block")], "'inline script'"), _rows("m", "html", "'html'", [("name = '<style>'", "handler", "CSS block")], "'inline style'")],
    "css": [_f("css", "'css'", [("b = 'styles.css'", "main", "Main stylesheet"), ("true", "handler", "CSS module")]), _rows("m", "css", "'css'", [("regexp_matches(name, '@(tailwind|apply|layer)')", "handler", "Tailwind directive")])],
    "xml": [_f("xml", "'xml'", [("true", "main", "XML document")]), _f("xml", "'xml'", [("b = 'pom.xml'", "main", "XML configuration")])],
    "markdown": [_f("markdown", "'md'", [("b = 'README.md'", "main", "Main documentation"), ("true", "handler", "Documentation")]), _rows("m", "markdown", "'md'", [("starts_with(name, '# ') AND line = 1", "main", "Document title")])],
}
_every = " UNION ALL ".join(p for parts in RULES.values() for p in parts)


def _detector(number: int, language: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entrypoints.entrypoints(*project_tables(spark, sf_dir), [language])

    run.__name__ = f"e{number}_{language}"
    query(f"WITH {_sym} " + " UNION ALL ".join(RULES[language]))(run)


for _number, _language in enumerate(RULES, 1):
    _detector(_number, _language)


@query(f"WITH {_sym}, every AS ({_every}) SELECT * FROM every WHERE entry_type <> 'test' AND language IN ('rust', 'typescript', 'python', 'go', 'zig')")
def f15_entrypoints_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entrypoints.shown(entrypoints.entrypoints(*project_tables(spark, sf_dir)))


@query(f"WITH {_sym}, every AS ({_every}) SELECT * FROM every WHERE entry_type = 'test' AND language = 'rust'")
def f14_entrypoints_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entrypoints.shown(entrypoints.entrypoints(*project_tables(spark, sf_dir)), entry_type="test", language="rust")


@query(f"WITH {_sym}, every AS ({_every}) SELECT entry_type, count(*) AS n, count(DISTINCT file) AS n_files FROM every GROUP BY entry_type")
def a1_group_entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entrypoints.grouped(entrypoints.entrypoints(*project_tables(spark, sf_dir)), "entry_type")


FOCUS = ["f/C7.py", "f/N2.py"]
_tiers = f"""{LOCATED}, focus(file, focus_ord) AS (VALUES ('f/C7.py', 1::BIGINT), ('f/N2.py', 2::BIGINT)), named AS (SELECT name, focus_ord FROM located JOIN focus USING (file)),
 once AS (SELECT DISTINCT src AS a, dst AS b FROM fx_edges), walk(focus_ord, name, depth) AS (SELECT focus_ord, name, 0 FROM named UNION SELECT w.focus_ord, b, w.depth + 1 FROM walk w JOIN once ON w.name = a WHERE w.depth < 5),
 found AS (SELECT focus_ord, name, CASE WHEN min(depth) = 1 THEN 2::BIGINT ELSE 1 END AS level FROM walk GROUP BY focus_ord, name HAVING min(depth) > 0),
 tier AS (SELECT file, 3::BIGINT AS level, focus_ord FROM focus UNION ALL SELECT file, -arg_min(-level, (focus_ord, -level)) AS level, min(focus_ord) FROM found JOIN located USING (name) WHERE file NOT IN (SELECT file FROM focus) GROUP BY file),
 cost AS (SELECT *, tokens * CASE level WHEN 3 THEN 100 WHEN 2 THEN 60 ELSE 20 END // 100 AS cost FROM (SELECT *, strlen(file) * 13 % 97 AS tokens FROM tier))"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = S.edges(spark, sf_dir)
    focus = spark.createDataFrame([(f, i + 1) for i, f in enumerate(FOCUS)], "file string, focus_ord long")
    tiers = budget.tiers(edges, located(edges), focus)
    return budget.charged(tiers.withColumn("tokens", (F.octet_length("file") * 13 % 97).cast("long")))


@query(f"WITH RECURSIVE {_tiers} SELECT file, level, focus_ord, tokens::BIGINT AS tokens, cost::BIGINT AS cost FROM cost")
def a12_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(f"WITH RECURSIVE {_tiers} SELECT file, level, focus_ord, row_number() OVER (ORDER BY level DESC, focus_ord, file) AS ord FROM cost")
def u3_ordered_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a level before the next."""
    return budget.ordered_tiers(_plan(spark, sf_dir)).select("file", "level", "focus_ord", "ord")


_fold = """numbered AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY ord) AS i FROM items),
 fold(plan, i, used, dropped, taken) AS (SELECT plan, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BOOLEAN FROM (SELECT DISTINCT plan FROM numbered) UNION ALL
 SELECT f.plan, n.i, f.used + CASE WHEN f.used + n.cost <= {budget} THEN n.cost ELSE 0 END, f.dropped + CASE WHEN f.used + n.cost <= {budget} THEN 0 ELSE n.cost END, f.used + n.cost <= {budget} FROM fold f JOIN numbered n ON n.plan = f.plan AND n.i = f.i + 1)"""
_items = "items AS (SELECT conv_id AS plan, turn AS ord, (strlen(text) // 4)::BIGINT AS cost FROM conversations)"


def _items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("plan"), F.col("turn").alias("ord"), F.floor(F.octet_length("text") / 4).cast("long").alias("cost"))


@query(f"WITH RECURSIVE {_items}, {_fold.format(budget=120)} SELECT n.plan, ord, cost, taken FROM fold f JOIN numbered n ON f.plan = n.plan AND f.i = n.i")
def a11_budget_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First fit in order under a budget, a plan for each conversation."""
    return budget.greedy(_items_of(spark, sf_dir), 120, ["ord"], ["plan"])


@query(f"WITH RECURSIVE {_items}, {_fold.format(budget=120)} SELECT plan, max(used)::BIGINT AS used_tokens, max(dropped)::BIGINT AS dropped_tokens, count_if(taken)::BIGINT AS n_entries FROM fold GROUP BY plan")
def m26_disclosure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.summary(budget.greedy(_items_of(spark, sf_dir), 120, ["ord"], ["plan"]), ["plan"])


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files whose functions are the symbols: a head, then a call of the symbol before in every further line."""
    s = S.symbols(spark, sf_dir).withColumn("before", F.lag("name").over(Window.partitionBy("file").orderBy("ordinal")))
    body = F.when(F.col("line_no") == F.col("line_start"), F.concat(F.lit("def "), "name", F.lit("():"))).otherwise(F.concat(F.lit("    "), F.coalesce("before", F.lit("print")), F.lit("(1)")))
    return s.select("file", "name", "before", "line_start", F.explode(F.sequence("line_start", "line_end")).alias("line_no")).select(F.col("file").alias("path"), "line_no", body.alias("text"))


@query("SELECT file AS path, name, line_start, line_end FROM fx_symbols")
def p4_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.definitions(source_lines(spark, sf_dir)).select("path", "name", "line_start", "line_end")


@query(
    "SELECT file AS path, name AS caller, coalesce(before, 'print') AS callee, unnest(generate_series(line_start + 1, line_end)) AS line_no FROM (SELECT *, lag(name) OVER (PARTITION BY file ORDER BY ordinal) AS before FROM fx_symbols)"
)
def p10_calls_with_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.calls_with_callers(source_lines(spark, sf_dir))
