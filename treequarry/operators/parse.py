"""Functions, classes, imports and calls of source files, read line by line with window functions.

No grammar is at hand, so this is an approximation, per language, by patterns: a definition is found by its first line,
and it ends where its braces close or, in Python, before the next line that is indented no deeper. Braces and calls
inside of strings and comments count like others. A place that leaves nesting levels gives one row per level it
leaves, and every definition finds the next such row of its own level, so the work is linear in the lines.

Lines have path, line_no, text (as sources.tables.lines_of gives them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treequarry.functions import paths as P
from treequarry.operators import intervals

#: language -> kind -> a pattern whose first group is the name.
DEFINITIONS = {
    "rust": {"Function": r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)", "Struct": r"^\s*(?:pub(?:\([a-z]+\))?\s+)?struct\s+(\w+)", "Enum": r"^\s*(?:pub(?:\([a-z]+\))?\s+)?enum\s+(\w+)", "Trait": r"^\s*(?:pub(?:\([a-z]+\))?\s+)?trait\s+(\w+)"},
    "python": {"Function": r"^\s*(?:async\s+)?def\s+(\w+)", "Class": r"^\s*class\s+(\w+)"},
    "typescript": {"Function": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)", "Class": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "Interface": r"^\s*(?:export\s+)?interface\s+(\w+)"},
    "go": {"Function": r"^func\s+(?:\([^)]*\)\s*)?(\w+)", "Struct": r"^type\s+(\w+)\s+struct", "Interface": r"^type\s+(\w+)\s+interface"},
    "zig": {"Function": r"^\s*(?:pub\s+)?(?:export\s+)?fn\s+(\w+)", "Struct": r"^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*(?:extern\s+|packed\s+)?struct"},
    "bash": {"Function": r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{"},
}
IMPORTS = {
    "rust": r"^\s*(?:pub\s+)?use\s+([^;]+);",
    "python": r"^\s*(?:from\s+(\S+)\s+)?import\s+",
    "typescript": r"""^\s*import\s+.*?["']([^"']+)["']""",
    "go": r"""^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$""",
    "zig": r"""@import\("([^"]+)"\)""",
}
#: What stands in the parentheses of a definition, and what it returns.
PARAMS = r"\(((?:[^()]|\([^()]*\))*)\)"
RETURNS = {"rust": r"\)\s*->\s*([^{;]+)", "python": r"\)\s*->\s*([^:]+):", "typescript": r"\)\s*:\s*([^{;]+)", "go": r"\)\s*([^(){]*[^(){\s])\s*\{", "zig": r"\)\s*([^(){;]*[^(){;\s])\s*\{"}
#: A parameter: no comma but in brackets, one level of them.
PARAM = r"((?:[^,()<>\[\]{}]|\([^()]*\)|<[^<>]*>|\[[^\[\]]*\]|\{[^{}]*\})+)"
CALL = r"([A-Za-z_]\w*)\s*\("
NO_CALLS = "if for while switch match return fn func def function class elif and or not in catch async await struct".split()


def with_language(lines: DataFrame) -> DataFrame:
    return lines.withColumn("language", P.language(F.col("path")))


def visibility(language: Column, text: Column, name: Column) -> Column:
    """Public by `pub`, `export`, or the lack of an underscore in front; else Private; crates and parents stand between."""
    rust = F.when(text.rlike(r"^\s*pub\(crate\)"), "Internal").when(text.rlike(r"^\s*pub\(super\)"), "Protected").when(text.rlike(r"^\s*pub\s"), "Public")
    found = F.when(language == "rust", rust).when(language == "python", F.when(~name.startswith("_"), "Public")).when(language == "typescript", F.when(text.rlike(r"^\s*export\s"), "Public")).otherwise(F.when(text.rlike(r"^\s*pub\s"), "Public"))
    return F.coalesce(found, F.lit("Private"))


def _starts(lines: DataFrame) -> DataFrame:
    """Lines with name, kind, is_async, visibility, language: those that are the first of a definition."""
    return _marked(lines).filter("kind is not null")


def _marked(lines: DataFrame) -> DataFrame:
    """Lines with name, kind, is_async, visibility, language; the kind is null where no definition begins."""
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for language, patterns in DEFINITIONS.items():
        for k, pattern in patterns.items():
            here = (F.col("language") == language) & F.col("text").rlike(pattern)
            kind, name = F.when(here, k).otherwise(kind), F.when(here, F.regexp_extract("text", pattern, 1)).otherwise(name)
    found = with_language(lines).withColumn("kind", kind).withColumn("name", name)
    is_async = F.col("text").rlike(r"^\s*(?:pub(?:\([a-z]+\))?\s+|export\s+|default\s+)*async\s")
    return found.withColumn("is_async", is_async).withColumn("visibility", visibility(F.col("language"), F.col("text"), F.col("name")))


def _levels(lines: DataFrame) -> DataFrame:
    """Lines with `level` (nesting where the line begins) and `left`: the levels that it leaves, each with its last line; with `d`, the
    definition that begins there, or null, and `n`, the last line of the file."""
    order = Window.partitionBy("path").orderBy("line_no")
    python = F.col("language") == "python"
    blank = F.trim("text") == ""
    indent = F.when(~blank, F.length("text") - F.length(F.ltrim("text")))
    opened = F.length("text") - F.length(F.replace("text", F.lit("{"), F.lit("")))
    closed = F.length("text") - F.length(F.replace("text", F.lit("}"), F.lit("")))
    rows = _marked(lines).withColumn("indent", indent).withColumn("step", opened - closed).withColumn("closes", closed)
    after = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("after", after).withColumn("before", F.col("after") - F.col("step"))
    rows = rows.withColumn("prev_indent", F.last("indent", True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("prev_line", F.max(F.when(~blank, F.col("line_no"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("n", F.max("line_no").over(Window.partitionBy("path")))
    begins = F.when(F.col("kind").isNotNull(), F.struct("name", "kind", F.col("line_no").alias("line_start"), "is_async", "visibility", "language"))
    none = F.array().cast("array<int>")
    by_brace = F.when(F.col("closes") > 0, F.sequence(F.greatest(F.col("after"), F.lit(0)), F.greatest(F.col("before") + F.col("step") + F.col("closes") - 1, F.col("after"), F.lit(0)))).otherwise(none)
    by_indent = F.when(F.col("indent") <= F.col("prev_indent"), F.sequence("indent", "prev_indent")).otherwise(none)
    level = F.when(python, F.col("indent")).otherwise(F.col("before"))
    return rows.select("path", "line_no", "n", "language", begins.alias("d"), level.cast("int").alias("level"), F.when(python, by_indent).otherwise(by_brace).alias("left"), F.when(python, F.col("prev_line")).otherwise(F.col("line_no")).alias("last"))


def definitions(lines: DataFrame) -> DataFrame:
    """path, name, kind, line_start, line_end, is_async, visibility, language."""
    # lines move once, by path: what begins and what ends are rows of one explode, and meet in the place where their file is
    python = F.col("language") == "python"
    event = lambda level, at, d, end: F.struct(level.cast("int").alias("level"), at.cast("long").alias("at"), d.alias("d"), end.cast("long").alias("end"))
    levels = _levels(lines)
    kind = levels.schema["d"].dataType
    begun = F.when(F.col("d").isNotNull(), F.array(event(F.col("level"), F.col("line_no") + F.when(python, 1).otherwise(0), F.col("d"), F.lit(None))))
    ends = F.transform("left", lambda level: event(level, F.col("line_no"), F.lit(None).cast(kind), F.col("last")))
    none = F.array().cast(f"array<struct<level:int,at:bigint,d:{kind.simpleString()},end:bigint>>")
    both = levels.select("path", "n", F.inline(F.concat(F.coalesce(begun, none), F.coalesce(ends, none))))
    # backwards, so that each row looks at what was seen and none is looked for again
    later = Window.partitionBy("path", "level").orderBy(F.desc("at"), F.col("d").isNull().desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("line_end", F.last("end", True).over(later)).filter("d is not null")
    closed = found.select("path", "d.*", F.coalesce("line_end", "n").alias("line_end"))
    return closed.select("path", "name", "kind", "line_start", F.greatest("line_start", "line_end").cast("long").alias("line_end"), "is_async", "visibility", "language")


def parameters(text: Column) -> Column:
    """What stands in the parentheses of a definition as an array of (name, type): the type after the first colon, or null.

    A receiver of its own (self) is none, nor is text without a type that has parentheses.
    """
    plain = F.transform(F.regexp_extract_all(text, F.lit(PARAM), 1), lambda p: F.btrim(p, F.lit(" \t")))
    split = F.transform(plain, lambda p: F.struct(F.btrim(F.when(F.contains(p, F.lit(":")), F.substring_index(p, ":", 1)).otherwise(p)).alias("name"), F.when(F.contains(p, F.lit(":")), F.btrim(F.regexp_replace(p, "^[^:]*:", ""))).alias("type")))
    return F.filter(split, lambda p: (p["name"] != "") & ~p["name"].isin("self", "&self", "&mut self") & (p["type"].isNotNull() | ~p["name"].rlike("[()]")))


def signatures(lines: DataFrame) -> DataFrame:
    """path, name, kind, line_no, is_async, visibility, params (an array of name and type), returns (null without one).

    Read from the first line of each definition.
    """
    found = _starts(lines)
    returns = F.lit(None).cast("string")
    for language, pattern in RETURNS.items():
        returns = F.when((F.col("language") == language) & F.col("text").rlike(pattern), F.btrim(F.regexp_extract("text", pattern, 1))).otherwise(returns)
    # a method of Go names its receiver first
    text = F.when(F.col("language") == "go", F.regexp_replace("text", r"^func\s+\([^)]*\)", "func ")).otherwise(F.col("text"))
    function = F.col("kind") == "Function"
    params = F.when(function, parameters(F.regexp_extract(text, PARAMS, 1)))
    return found.select("path", "name", "kind", "line_no", "is_async", "visibility", params.alias("params"), F.when(function, returns).alias("returns"))


def import_rows(lines: DataFrame) -> DataFrame:
    """path, import_path, kind, line_no: two rows for each import, its path and its whole statement."""
    both = imports(lines).join(lines.select("path", "line_no", "text"), ["path", "line_no"])
    rows = F.array(F.struct(F.lit("path").alias("kind"), F.col("import_path")), F.struct(F.lit("statement").alias("kind"), F.btrim(F.col("text"), F.lit(" \t\r")).alias("import_path")))
    return both.select("path", "line_no", F.inline(rows)).select("path", "import_path", "kind", "line_no")


def imports(lines: DataFrame) -> DataFrame:
    """path, import_path, line_no; Python's plain imports give the first module they name."""
    found = F.lit(None).cast("string")
    for language, pattern in IMPORTS.items():
        name = F.regexp_extract("text", pattern, 1)
        if language == "python":
            name = F.when(name == "", F.regexp_extract("text", r"import\s+([\w.]+)", 1)).otherwise(name)
        found = F.when((F.col("language") == language) & F.col("text").rlike(pattern), F.trim(name)).otherwise(found)
    return with_language(lines).withColumn("import_path", found).filter("import_path is not null").select("path", "import_path", "line_no")


def calls(lines: DataFrame) -> DataFrame:
    """path, callee, line_no of names before a parenthesis that are neither keywords nor defined on that line."""
    named = with_language(lines).filter(F.col("language").isin(P.CODE)).select("path", "line_no", "text", "language", F.explode(F.regexp_extract_all("text", F.lit(CALL), 1)).alias("callee"))
    defined = _starts(lines).select("path", "line_no", F.col("name").alias("callee"))
    return named.filter(~F.col("callee").isin(NO_CALLS)).join(defined, ["path", "line_no", "callee"], "left_anti").select("path", "callee", "line_no")


def calls_with_callers(lines: DataFrame) -> DataFrame:
    """path, caller, callee, line_no; caller is the innermost function around the call, null outside of all."""
    found = calls(lines)
    functions = definitions(lines).filter("kind = 'Function'").select("path", F.col("name").alias("caller"), "line_start", "line_end")
    times = found.groupBy("path", "callee", "line_no").agg(F.count("*").alias("times"))
    around = intervals.held(found.select("path", "line_no").distinct(), functions, "path", "line_no", "line_start", "line_end").groupBy("path", "line_no").agg(F.max(F.struct("line_start", "caller")).alias("best"))
    best = times.join(around, ["path", "line_no"], "left")
    return best.select("path", F.col("best.caller").alias("caller"), "callee", "line_no", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_n")).drop("_n")
