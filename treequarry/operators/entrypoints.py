"""Entry points of programs: twelve sets of rules over files and their symbols, as expressions.

files: path. symbols: file, name, kind, line_start, attributes (an array of strings). Each result row has name, file,
line, entry_type, language, description. Where the rules of a language are a chain, the first that holds counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treequarry.functions import paths as P

COLUMNS = ["name", "file", "line", "entry_type", "language", "description"]
Rule = tuple[Column, str, str | None]


@dataclass(frozen=True)
class Rules:
    """Rules of a language over files or symbols, the first of which that holds gives a row; `none` gives none."""

    language: str
    rules: list[Rule]
    where: Column
    name: Column


def _name() -> Column:
    return F.col("name")


def _attr(test) -> Column:
    return F.exists("attributes", test)


def _token(*words: str) -> Column:
    return F.arrays_overlap(F.split("name", "_"), F.array(*map(F.lit, words)))


def _file_rows(language: str, rules: list[Rule], name: str | None = None, where: Column | None = None) -> Rules:
    """The first rule that holds for a file's name gives a row at line 1."""
    return Rules(language, rules, F.lit(True) if where is None else where, F.lit(name) if name else F.col("base"))


def _symbol_rows(language: str, rules: list[Rule], kind: str = "Function", name: Column | None = None) -> Rules:
    """The first rule that holds for a symbol of the language gives a row."""
    return Rules(language, rules, (F.col("kind") == kind) & (F.col("own") == language), name if name is not None else _name())


def _found(rows: DataFrame, every: list[Rules], line: Column) -> DataFrame:
    """One pass over files or symbols (file, base and what rules ask for) with the rules of all languages."""
    structs = []
    for r in every:
        kind = note = F.lit(None).cast("string")
        for test, entry_type, description in reversed(r.rules):
            kind, note = F.when(test, entry_type).otherwise(kind), F.when(test, description).otherwise(note)
        structs.append(F.struct(r.name.alias("name"), F.when(r.where, kind).alias("entry_type"), F.lit(r.language).alias("language"), note.alias("description")))
    out = rows.select("file", line.cast("long").alias("line"), F.explode(F.filter(F.array(*structs), lambda x: x["entry_type"].isNotNull() & (x["entry_type"] != "none"))).alias("e"))
    return out.select("e.name", "file", "line", "e.entry_type", "e.language", "e.description")


def _base(*names: str) -> Column:
    return F.col("base").isin(*names)


def _ends(*ends: str) -> Column:
    return F.col("base").rlike("(" + "|".join(e.replace(".", r"\.") for e in ends) + ")$")


def rust() -> tuple[list[Rules], list[Rules]]:
    return [], [
        _symbol_rows(
            "rust",
            [
                (_name() == "main", "main", None),
                (_attr(lambda a: F.contains(a, F.lit("test"))), "test", None),
                (_name().startswith("test_") | _name().endswith("_test"), "test", None),
                (_attr(lambda a: F.contains(a, F.lit("main"))), "main", "async main"),
                (_attr(lambda a: F.contains(a, F.lit("derive")) & F.contains(a, F.lit("Parser"))), "cli", "clap CLI"),
            ],
        )
    ]


def typescript() -> tuple[list[Rules], list[Rules]]:
    tsx = _ends(".tsx")
    pascal = _name().rlike(r"^\p{Lu}")
    own = F.col("own") == "typescript"
    pages = [
        _file_rows("typescript", [(_base("page.tsx", "layout.tsx"), "main", "Next.js page/layout")], where=own),
        _file_rows("typescript", [(_base("App.tsx"), "main", "React App component")], "App", own),
    ]
    functions = _symbol_rows(
        "typescript",
        [
            (tsx & pascal & (_name().isin("App", "Main") | F.array_contains("attributes", "entrypoint")), "main", "React component"),
            (tsx & pascal, "none", None),
            (_name().isin("main", "run", "start"), "main", None),
            ((_name() == "test") | _name().rlike(r"^test(_|\p{Lu})") | _name().startswith("it(") | _name().startswith("describe("), "test", None),
        ],
    )
    return pages, [functions, _symbol_rows("typescript", [(tsx & _name().startswith("<") & _name().endswith(">"), "handler", "JSX element")], "Module")]


def python() -> tuple[list[Rules], list[Rules]]:
    """A name may be a command and an endpoint at once."""
    first = [(_name().isin("main", "cli", "run"), "main", None), (_name().startswith("test_"), "test", None)]
    command = _symbol_rows("python", [*first, (_token("command", "cmd"), "cli", None)])
    return [], [command, _symbol_rows("python", [(first[0][0] | first[1][0], "none", None), (_token("route", "endpoint"), "handler", None)])]


def bash() -> tuple[list[Rules], list[Rules]]:
    return [_file_rows("bash", [(_ends(".sh", ".bash"), "main", "shell script")])], [_symbol_rows("bash", [(_name().isin("main", "run", "start"), "main", "script function")])]


def terraform() -> tuple[list[Rules], list[Rules]]:
    blocks = _symbol_rows("terraform", [(_ends(".tf") & _name().rlike("^(resource|module|data)"), "handler", "terraform block")], name=F.concat("base", F.lit(":"), "name"))
    return [_file_rows("terraform", [(_base("main.tf", "variables.tf", "outputs.tf"), "main", "terraform config")])], [blocks]


def helm() -> tuple[list[Rules], list[Rules]]:
    main = _file_rows("helm", [(_base("Chart.yaml"), "main", "helm chart metadata"), (_base("values.yaml"), "main", "helm values")])
    return [main, _file_rows("helm", [(F.contains("file", F.lit("/templates/")) & _ends(".yaml"), "handler", "helm template")])], []


def go() -> tuple[list[Rules], list[Rules]]:
    """Besides, a file with a main function is a program, see `_programs`."""
    functions = _symbol_rows(
        "go",
        [
            (_name() == "main", "main", "Go main function"),
            (_name() == "init", "main", "Go init function"),
            (_ends("_test.go") & _name().rlike("^(Test|Benchmark|Example|Fuzz)"), "test", "Go test/benchmark/example"),
            (F.array_contains("attributes", "entrypoint"), "main", None),
        ],
    )
    return [], [functions]


def _programs(symbols: DataFrame) -> DataFrame:
    """A row for each file of Go, but for tests, that has a main function."""
    found = symbols.filter((F.col("kind") == "Function") & (F.col("own") == "go") & (_name() == "main") & ~_ends("_test.go")).select("base", "file").distinct()
    return found.select(F.col("base").alias("name"), "file", F.lit(1).cast("long").alias("line"), F.lit("main").alias("entry_type"), F.lit("go").alias("language"), F.lit("Go executable").alias("description"))


def zig() -> tuple[list[Rules], list[Rules]]:
    functions = _symbol_rows(
        "zig", [(_name() == "main", "main", "Zig main function"), (_name().startswith('test "') | F.array_contains("attributes", "test"), "test", "Zig test"), (F.array_contains("attributes", "entrypoint"), "main", None)]
    )
    return [_file_rows("zig", [(_base("build.zig"), "main", "Zig build script")])], [functions]


def html() -> tuple[list[Rules], list[Rules]]:
    blocks = (("<script>", "inline script", "JavaScript block"), ("<style>", "inline style", "CSS block"))
    return [_file_rows("html", [(_ends(".html", ".htm"), "main", "HTML document")])], [_symbol_rows("html", [(_name() == tag, "handler", note)], "Module", F.lit(name)) for tag, name, note in blocks]


def css() -> tuple[list[Rules], list[Rules]]:
    sheet = _ends(".css", ".scss", ".sass")
    main = _base("main.css", "index.css", "styles.css", "app.css", "main.scss", "index.scss") | F.contains("base", F.lit("tailwind"))
    directive = _symbol_rows("css", [(_name().rlike("@(tailwind|apply|layer)"), "handler", "Tailwind directive")], "Module")
    return [_file_rows("css", [(sheet & main, "main", "Main stylesheet"), (sheet, "handler", "CSS module")])], [directive]


def xml() -> tuple[list[Rules], list[Rules]]:
    config = _base("pom.xml", "AndroidManifest.xml", "web.xml", "settings.xml") | _ends(".config.xml")
    return [_file_rows("xml", [(_ends(".xml"), "main", "XML document")]), _file_rows("xml", [(config, "main", "XML configuration")])], []


def markdown() -> tuple[list[Rules], list[Rules]]:
    page = _ends(".md", ".markdown")
    main = _base("README.md", "CONTRIBUTING.md", "CHANGELOG.md", "LICENSE.md", "INSTALL.md", "API.md") | F.col("base").startswith("README")
    title = _symbol_rows("markdown", [(_name().startswith("# ") & (F.col("line_start") == 1), "main", "Document title")], "Module")
    return [_file_rows("markdown", [(page & main, "main", "Main documentation"), (page, "handler", "Documentation")])], [title]


LANGUAGES = {f.__name__: f for f in (rust, typescript, python, bash, terraform, helm, go, zig, html, css, xml, markdown)}


def entrypoints(files: DataFrame, symbols: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Of some languages or all, in one pass over the files and one over the symbols."""
    wanted = list(LANGUAGES) if languages is None else languages
    rules = [LANGUAGES[name]() for name in wanted]
    own = lambda rows: rows.withColumn("base", P.file_name(F.col("file"))).withColumn("own", P.language(F.col("file")))
    named, known = own(files.select(F.col("path").alias("file"))), own(symbols)
    rows = []
    for every, source, line in (([r for f, _ in rules for r in f], named, F.lit(1)), ([r for _, s in rules for r in s], known, F.col("line_start"))):
        if every:
            rows.append(_found(source, every, line))
    if "go" in wanted:
        rows.append(_programs(known))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def shown(rows: DataFrame, entry_type: str | None = None, language: str | None = None, tests: bool = False, every: bool = False) -> DataFrame:
    """With a type, that type alone; else no tests unless asked for, and code alone unless all is asked for."""
    if language:
        rows = rows.filter(F.col("language") == language)
    if entry_type:
        return rows.filter(F.col("entry_type") == entry_type)
    if not tests:
        rows = rows.filter("entry_type <> 'test'")
    return rows if every else rows.filter(F.col("language").isin(P.CODE))


def grouped(rows: DataFrame, by: str) -> DataFrame:
    """`by`, n, names: by type or language."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct("file").alias("n_files"))


def first_in_file(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("file").orderBy("line", "name", "entry_type")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
