"""Queries over parsed sources: definitions, parameters and imports in several languages, and blocks of markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treequarry.functions import names as N
from treequarry.operators import files as O
from treequarry.operators import markup, parse, symbols
from treequarry.plans.graph_queries import NAMES, project_symbols
from treequarry.plans.registry import query
from treequarry.sources import tables as S

#: Of each language: extension, how a function of a name begins, what begins it when public and when async, an import.
LANGUAGES = {
    "rust": ("rs", "fn {}(a: u32, b: Vec<(i32, u8)>) -> Result<A, B> {{", "pub ", "async ", "use a::b;"),
    "typescript": ("ts", "function {}(a: number, b?: string[]): Map<string, number> {{", "export ", "async ", 'import {{ x }} from "a/b";'.replace("{{", "{").replace("}}", "}")),
    "go": ("go", "func {}(a int, b []string) error {{", "", "", 'import "a/b"'),
    "zig": ("zig", "fn {}(a: u32, b: []const u8) !void {{", "pub ", "", 'const x = @import("a/b");'),
    "python": ("py", "def {}(self, a, b: int) -> str:", "", "async ", "import a.b"),
}
PARAMS = {
    "rust": ([("a", "u32"), ("b", "Vec<(i32, u8)>")], "Result<A, B>", "a::b"),
    "typescript": ([("a", "number"), ("b?", "string[]")], "Map<string, number>", "a/b"),
    "go": ([("a int", None), ("b []string", None)], "error", "a/b"),
    "zig": ([("a", "u32"), ("b", "[]const u8")], "!void", "a/b"),
    "python": ([("a", None), ("b", "int")], "str", "a.b"),
}
ORDER = list(LANGUAGES)


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line_no, text: conversations as sources in five languages. Turns of the system are imports, the others functions."""
    s = S.symbols(spark, sf_dir).withColumn("k", F.regexp_extract("file", "([0-9]+)", 1).cast("long") % len(ORDER))
    by = lambda f: F.element_at(F.array(*[f(LANGUAGES[n]) for n in ORDER]), (F.col("k") + 1).cast("int"))
    head = lambda x: F.concat(F.lit(x[1].split("{}")[0]), "name", F.lit(x[1].split("{}")[1].replace("{{", "{")))
    python = F.col("k") == ORDER.index("python")
    first = F.concat(F.when(F.col("ordinal") % 2 == 0, by(lambda x: F.lit(x[2]))).otherwise(""), F.when(F.col("ordinal") % 3 == 0, by(lambda x: F.lit(x[3]))).otherwise(""), by(head))
    alone = F.col("line_start") == F.col("line_end")
    n = F.col("line_no")
    body = F.when(python, "    pass").when(n == F.col("line_end"), "}").otherwise("    x = 1;")
    function = F.when(n > F.col("line_start"), body).otherwise(F.concat(first, F.when(alone & ~python, " }").otherwise("")))
    text = F.when(F.col("kind") == "Function", function).otherwise(F.when(n == F.col("line_start"), by(lambda x: F.lit(x[4]))).otherwise(""))
    path = F.concat(F.lit("code/"), F.regexp_extract("file", "(c[0-9]+)", 1), F.lit("."), by(lambda x: F.lit(x[0])))
    return s.withColumn("line_no", F.explode(F.sequence("line_start", "line_end"))).select(path.alias("path"), "line_no", text.alias("text"))


_list = lambda values: "[" + ", ".join("NULL" if v is None else "'" + v + "'" for v in values) + "]"
_code = f"""code AS (SELECT 'code/' || regexp_extract(file, '(c[0-9]+)', 1) || '.' || ({_list(LANGUAGES[n][0] for n in ORDER)})[k + 1] AS path, * FROM (SELECT *, regexp_extract(file, '([0-9]+)', 1)::BIGINT % {len(ORDER)} AS k FROM fx_symbols))"""


@query(
    f"WITH {_code} SELECT path, name, kind, line_start, line_end, ({_list(ORDER)})[k + 1] AS language, ordinal % 3 = 0 AND k IN (0, 1, 4) AS is_async, CASE WHEN k = 4 OR k IN (0, 1, 3) AND ordinal % 2 = 0 THEN 'Public' ELSE 'Private' END AS visibility FROM code WHERE kind = 'Function'"
)
def p2_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.definitions(code_lines(spark, sf_dir)).select("path", "name", "kind", "line_start", "line_end", "language", "is_async", "visibility")


_params = ", ".join(f"({k}, {i}::BIGINT, '{p}', {'NULL' if t is None else chr(39) + t + chr(39)}, '{PARAMS[n][1]}')" for k, n in enumerate(ORDER) for i, (p, t) in enumerate(PARAMS[n][0]))


@query(f"WITH {_code}, p(k, pos, param, type, returns) AS (VALUES {_params}) SELECT path, name, line_start AS line_no, pos, param, type, returns FROM code JOIN p USING (k) WHERE kind = 'Function'")
def p7_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse.signatures(code_lines(spark, sf_dir))
    rows = found.select("path", "name", "line_no", "returns", F.posexplode("params").alias("pos", "p"))
    return rows.select("path", "name", "line_no", F.col("pos").cast("long").alias("pos"), F.col("p.name").alias("param"), F.col("p.type").alias("type"), "returns")


@query(
    f"WITH {_code} SELECT path, line_start AS line_no, 'path' AS kind, ({_list(PARAMS[n][2] for n in ORDER)})[k + 1] AS import_path FROM code WHERE kind = 'Module' UNION ALL "
    f"SELECT path, line_start, 'statement', ({_list(LANGUAGES[n][4] for n in ORDER)})[k + 1] FROM code WHERE kind = 'Module'"
)
def p9_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.import_rows(code_lines(spark, sf_dir))


#: Sources of classes: extension, text, and what is found as (kind, visibility).
CLASSES = [
    ("rs", "pub struct {} {{", "Struct", "Public"),
    ("rs", "enum {} {{", "Enum", "Private"),
    ("rs", "pub(crate) trait {} {{", "Trait", "Internal"),
    ("ts", "export default class {} {{", "Class", "Public"),
    ("ts", "interface {} {{", "Interface", "Private"),
    ("py", "class {}:", "Class", "Public"),
]


@query(
    "SELECT p_partkey, 'K' || p_partkey AS name, kind, visibility, 2::BIGINT AS line_start, 4::BIGINT AS line_end FROM part JOIN (VALUES "
    + ", ".join(f"({i}, '{k}', '{v}')" for i, (_, _, k, v) in enumerate(CLASSES))
    + f") AS c(i, kind, visibility) ON p_partkey % {len(CLASSES)} = i"
)
def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class in every file, after a line of comment."""
    # a small table makes many lines: its rows are dealt out before, by a number that stays
    part = S.table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    classes = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(t.split("{}")[0]).alias("a"), F.lit(t.split("{}")[1].replace("{{", "{")).alias("b")) for e, t, _, _ in CLASSES])
    own = part.select("p_partkey", F.get(classes, (F.col("p_partkey") % len(CLASSES)).cast("int")).alias("c")).filter("c is not null")
    text = F.concat(F.lit("// or #\n"), F.col("c.a"), F.lit("K"), "p_partkey", F.col("c.b"), F.lit("\n    x\n"), F.when(F.col("c.e") == "py", "    y").otherwise("}"))
    files = own.select(F.concat(F.lit("k/"), "p_partkey", F.lit("."), F.col("c.e")).alias("path"), text.alias("content"))
    found = parse.definitions(S.lines_of(files))
    return found.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("p_partkey"), "name", "kind", "visibility", "line_start", "line_end")


_ends = lambda x: f"(length({x}) - length(replace({x}, chr(10), '')))"
_tag = lambda tag: f"SELECT path, '<{tag}>' AS name, 1 + {_ends(f'left(content, a - 1)')} AS line_start, 1 + {_ends('left(content, a + b)')} AS line_end FROM (SELECT *, strpos(content, '<{tag}>') AS a, strpos(substr(content, strpos(content, '<{tag}>')), '</{tag}>') AS b FROM web) WHERE a > 0"


@query(f"WITH web AS (SELECT * FROM fx_files WHERE path LIKE 'web/%') SELECT path, '<element>' AS name, 1::BIGINT AS line_start, 1 + {_ends('rtrim(content)')} AS line_end FROM web UNION ALL {_tag('script')} UNION ALL {_tag('style')}")
def p14_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.html_blocks(S.files(spark, sf_dir).filter("path like 'web/%'"))


def style_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a style sheet of each brand, with a rule of every part and now and then a query."""
    rule = F.concat("p_name", F.lit(", "), "p_type", F.lit(" {\n  a: b;\n}\n"), F.when(F.col("p_size") % 5 == 0, "@media x {\n  .a { b: c; }\n}\n").otherwise(""))
    rules = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", rule.alias("r")))), lambda x: x["r"])
    content = F.concat(F.lit('@import "a";\n@tailwind base;\n'), F.array_join(rules, ""))
    return S.table(spark, sf_dir, "part").groupBy("p_brand").agg(content.alias("content")).select(F.concat(F.lit("css/"), "p_brand", F.lit(".css")).alias("path"), "content")


_short = lambda x: f"CASE WHEN trim({x}) = '' THEN '<empty>' WHEN strlen(trim({x})) > 50 THEN left(trim({x}), 47) || '...' ELSE trim({x}) END"


@query(
    f"WITH b AS (SELECT p_brand, p_partkey, 0 AS m, {_short('p_name || chr(44) || chr(32) || p_type')} AS name FROM part UNION ALL SELECT p_brand, p_partkey, 1, '@media' FROM part WHERE p_size % 5 = 0), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, m) AS i FROM b) SELECT 'css/' || p_brand || '.css' AS path, name, 3 * i AS line_start, 3 * i + 2 AS line_end FROM n "
    "UNION ALL SELECT DISTINCT 'css/' || p_brand || '.css', '@import', 1, 1 FROM part UNION ALL SELECT DISTINCT 'css/' || p_brand || '.css', '@tailwind (Tailwind)', 2, 2 FROM part"
)
def p15_css_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.css_blocks(style_sheets(spark, sf_dir))


@query(f"SELECT 'x' || doc_id || '.xml' AS path, '<' || source || '>' AS name, 3::BIGINT AS line_start, 3 + {_ends('text')} AS line_end FROM documents")
def p16_xml_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit('<?xml version="1.0"?>\n<!-- a -->\n<'), "source", F.lit(' id="1">'), "text", F.lit("</"), "source", F.lit(">\n"))
    return markup.xml_roots(S.table(spark, sf_dir, "documents").select(F.concat(F.lit("x"), "doc_id", F.lit(".xml")).alias("path"), content.alias("content")))


_marked = "m AS (SELECT path, line_no, CASE line_no % 6 WHEN 1 THEN repeat('#', (line_no % 4 + 1)::INT) || ' ' || text WHEN 2 THEN '```' || CASE WHEN line_no % 12 = 2 THEN 'py' ELSE '' END WHEN 4 THEN '===' ELSE 'x ' || text END AS text FROM fx_lines WHERE path LIKE '%.md')"


@query(
    f"WITH {_marked}, f AS (SELECT *, starts_with(text, '```') AS fence, coalesce(sum(starts_with(text, '```')::INT) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fences, max(line_no) OVER (PARTITION BY path) AS last, min(CASE WHEN starts_with(text, '```') THEN line_no END) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next, lag(text) OVER (PARTITION BY path ORDER BY line_no) AS above FROM m) "
    f"SELECT path, regexp_extract(text, '^(#+)', 1) || ' ' || {_short(chr(34) + 't' + chr(34))} AS name, line_no AS line_start, line_no AS line_end FROM (SELECT *, regexp_extract(text, '^#+ (.*)', 1) AS t FROM f) WHERE NOT fence AND fences % 2 = 0 AND line_no % 6 = 1 "
    f"UNION ALL SELECT path, '# ' || {_short('above')}, line_no - 1, line_no FROM f WHERE NOT fence AND fences % 2 = 0 AND line_no % 6 = 4 AND starts_with(above, 'x ') "
    "UNION ALL SELECT path, '```' || CASE WHEN line_no % 12 = 2 THEN 'py' ELSE 'code' END, line_no, coalesce(next, last) FROM f WHERE fence AND fences % 2 = 0"
)
def p17_markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of Markdown files get heads, fences and underlines; heads inside of fences are none."""
    n = F.col("line_no")
    marked = F.when(n % 6 == 1, F.concat(F.repeat(F.lit("#"), (n % 4 + 1).cast("int")), F.lit(" "), "text")).when(n % 6 == 2, F.concat(F.lit("```"), F.when(n % 12 == 2, "py").otherwise(""))).when(n % 6 == 4, "===").otherwise(F.concat(F.lit("x "), "text"))
    return markup.markdown_blocks(S.lines(spark, sf_dir).filter("path like '%.md'").withColumn("text", marked))


#: Names and paths for the predicates, with the answers that hold for each.
ASKED = [
    ("TestX", "a_test.go", "go_test go_test_file component"),
    ("BenchmarkY", "a.go", "go_test component"),
    ("ExampleZ", "b/x_test.go", "go_test go_test_file component"),
    ("FuzzQ", "test.go", "component"),
    ("useState", "page.tsx", "hook tsx"),
    ("used", "a.ts", ""),
    ("test_a", "t.zig", "zig_test"),
    ("benchIt", "main.scss", "zig_test scss"),
    ("Button", "tailwind.config.css", "component tailwind"),
    ("main", "x.sass", "scss"),
]


@query("SELECT p_partkey, answers FROM part JOIN (VALUES " + ", ".join(f"({i}, '{a}')" for i, (_, _, a) in enumerate(ASKED)) + f") AS v(i, answers) ON p_partkey % {len(ASKED)} = i")
def p18_name_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: F.element_at(F.array(*[F.lit(x[c]) for x in ASKED]), (F.col("p_partkey") % len(ASKED) + 1).cast("int"))
    name, path = F.col("name"), F.col("path")
    tests = {"go_test": N.is_go_test(name), "go_test_file": N.is_go_test_file(path), "component": N.is_react_component(name), "hook": N.is_react_hook(name), "tsx": N.is_tsx(path), "zig_test": N.is_zig_test(name), "scss": N.is_scss(path), "tailwind": N.has_tailwind(path, F.lit("a{}"))}
    order = ["go_test", "go_test_file", "component", "hook", "tsx", "zig_test", "scss", "tailwind"]
    asked = S.table(spark, sf_dir, "part").select("p_partkey", at(0).alias("name"), at(1).alias("path"))
    return asked.select("p_partkey", F.concat_ws(" ", *[F.when(tests[k], k) for k in order]).alias("answers"))


@query(f"SELECT path AS file, ({_list(NAMES)})[strlen(content) % {len(NAMES)} + 1] AS name FROM fx_files WHERE strlen(content) % 4 = 0")
def p21_symbol_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of which an attribute speaks of main."""
    return symbols.with_attribute(project_symbols(spark, sf_dir), "main").select("file", "name")


@query("SELECT file, callee, line FROM fx_calls WHERE caller = 'assistant_3'")
def p21_calls_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.called_by(S.calls(spark, sf_dir), "assistant_3").select("file", "callee", "line")


@query("SELECT file, name, kind, line_start, line_end, ordinal FROM fx_symbols")
def p22_metadata_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.from_meta(symbols.to_meta(S.symbols(spark, sf_dir)))


@query("SELECT split_part(path, '/', 1) AS folder, min(path) AS first FROM (SELECT CASE WHEN path LIKE '%.zig' THEN regexp_replace(path, 'zig$', 'PNG') ELSE path END AS path FROM fx_files) WHERE path LIKE '%.PNG' GROUP BY 1")
def s18_first_binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extension is taken for a binary one."""
    odd = S.files(spark, sf_dir).withColumn("path", F.regexp_replace("path", r"\.zig$", ".PNG"))
    return O.first_binaries(odd)
