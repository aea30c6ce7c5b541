"""Symbols of files: owners of methods, callers of calls, lookups, index, signatures, renderings of outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treequarry.operators import intervals


def method_owners(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """file, name, line_start, ordinal, owner: the tightest class that holds a function, the first of equals; else null.

    functions: file, name, line_start, line_end, ordinal; classes: file, name, line_start, line_end.
    """
    c = classes.select("file", F.col("name").alias("c_name"), F.col("line_start").alias("c_start"), F.col("line_end").alias("c_end"))
    rank = F.struct((F.col("c_end") - F.col("c_start")).alias("span"), "c_start", "c_name")
    key = ["file", "name", "line_start", "ordinal"]
    found = intervals.held(functions.select(*key, "line_end").distinct(), c, "file", "line_start", "c_start", "c_end").filter("line_end <= c_end")
    best = found.select(*key, rank.alias("rank")).unionByName(functions.select(*key, F.lit(None).cast("struct<span:bigint,c_start:bigint,c_name:string>").alias("rank")))
    return best.groupBy(*key).agg(F.min("rank").alias("best")).select(*key, F.col("best.c_name").alias("owner"))


def enclosing_symbol(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """Points (file, line) with the function around them; of several, the last in the file's list; null outside of all."""
    s = symbols.filter("kind = 'Function'").select("file", F.col("name").alias("s_name"), "line_start", "line_end", "ordinal")
    wanted = points.select("file", "line").distinct()
    found = intervals.held(wanted, s, "file", "line", "line_start", "line_end").select("file", "line", "ordinal", "s_name")
    both = found.unionByName(wanted.select("file", "line", F.lit(None).cast(found.schema["ordinal"].dataType).alias("ordinal"), F.lit(None).cast("string").alias("s_name")))
    best = F.max(F.when(F.col("s_name").isNotNull(), F.struct("ordinal", "s_name")))
    return both.groupBy("file", "line").agg(best.alias("best")).select("file", "line", F.col("best.s_name").alias("caller"))


def look_up(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names with the symbols they mean: exactly, or by what follows the last :: where nothing has the whole name."""
    known = symbols.select("name", "file", "line_start")
    exact = names.join(known.withColumnRenamed("name", "found"), F.col("name") == F.col("found"))
    rest = names.join(exact.select("name").distinct(), "name", "left_anti")
    tail = rest.join(known.withColumnRenamed("name", "found"), F.element_at(F.split("name", "::"), -1) == F.col("found"))
    return exact.unionByName(tail)


def first_definitions(symbols: DataFrame) -> DataFrame:
    """name, file, line: the first by file and place."""
    best = symbols.groupBy("name").agg(F.min(F.struct("file", "ordinal", "line_start")).alias("first"))
    return best.select("name", F.col("first.file").alias("file"), F.col("first.line_start").alias("line"))


def inverted_index(symbols: DataFrame) -> DataFrame:
    """name, n_entries, file, line_start: a row for each place of a name, so that a frequent name is no single row."""
    counts = symbols.groupBy("name").agg(F.count("*").alias("n_entries"))
    return symbols.select("name", "file", "line_start").join(counts, "name").select("name", "n_entries", "file", "line_start")


def counts_by_file(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """file, n_functions, n_modules, n_calls"""
    s = symbols.groupBy("file").agg(F.count_if(F.col("kind") == "Function").alias("n_functions"), F.count_if(F.col("kind") == "Module").alias("n_modules"))
    return s.join(calls.groupBy("file").agg(F.count("*").alias("n_calls")), "file", "left").fillna(0, ["n_calls"])


def signature(kind: Column, name: Column, params: Column, returns: Column, is_async: Column) -> Column:
    """`async fn n(p: T) -> R`, `mod Name`; params: an array of (name, type), types may be null."""
    listed = F.array_join(F.transform(params, lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["type"]), F.lit("")))), ", ")
    function = F.concat(F.when(is_async, "async fn ").otherwise("fn "), name, F.lit("("), listed, F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), returns), F.lit("")))
    return F.when(kind == "Function", function).when(kind == "Module", F.concat(F.lit("mod "), name)).otherwise(F.concat(kind, F.lit(" "), name))


def gaps(ranges: DataFrame) -> DataFrame:
    """Ranges (file, line_start, line_end) with prev_end and gap: whether lines are missing since the range just before."""
    order = Window.partitionBy("file").orderBy("line_start", "line_end")
    prev = F.lag("line_end").over(order)
    return ranges.select("file", "line_start", "line_end", prev.alias("prev_end"), F.coalesce(F.col("line_start") > prev + 1, F.lit(False)).alias("gap"))


def aligned(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Ranges (file, s, e) widened to the tightest symbol around them, where there is one."""
    wanted = ranges.select("file", "s", "e").distinct()
    found = intervals.held(wanted, symbols.select("file", "line_start", "line_end"), "file", "s", "line_start", "line_end").filter("e <= line_end")
    tightest = found.groupBy("file", "s", "e").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "line_start", "line_end")).alias("b"))
    # an equi join on the whole range, so that ranges without a symbol stay
    return wanted.join(tightest, ["file", "s", "e"], "left").select("file", "s", "e", F.coalesce("b.line_start", "s").alias("from_line"), F.coalesce("b.line_end", "e").alias("to_line"))


def with_attribute(symbols: DataFrame, part: str) -> DataFrame:
    """Symbols of which an attribute holds a text."""
    return symbols.filter(F.exists("attributes", lambda a: F.contains(a, F.lit(part))))


def called_by(calls: DataFrame, caller: str) -> DataFrame:
    """Calls (file, caller, callee, line) that a function makes."""
    return calls.filter(F.col("caller") == caller)


def listed(symbols: DataFrame) -> DataFrame:
    """file, names: the names of a file in order of their lines."""
    rows = F.array_sort(F.collect_list(F.struct("line_start", "name")))
    return symbols.groupBy("file").agg(F.array_join(F.transform(rows, lambda x: x["name"]), ",").alias("names"))


def call_counts(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """file, name, n_calls of functions: how often their own file calls them."""
    made = calls.select("file", F.col("callee").alias("name"), F.lit(1).alias("one"))
    return symbols.filter("kind = 'Function'").join(made, ["file", "name"], "left").groupBy("file", "name").agg(F.count("one").alias("n_calls"))


META = "name string, kind string, line_start long, line_end long, ordinal long"


def to_meta(symbols: DataFrame) -> DataFrame:
    """file, json: each symbol as metadata keep it."""
    return symbols.select("file", F.to_json(F.struct("name", "kind", "line_start", "line_end", "ordinal")).alias("json"))


def from_meta(rows: DataFrame) -> DataFrame:
    """Symbols from their metadata."""
    return rows.select("file", F.from_json("json", META).alias("m")).select("file", "m.*")


def totals(symbols: DataFrame) -> DataFrame:
    """n_symbols, n_files, n_names"""
    return symbols.agg(F.count("*").alias("n_symbols"), F.count_distinct("file").alias("n_files"), F.count_distinct("name").alias("n_names"))


def outline(symbols: DataFrame) -> DataFrame:
    """file, text: what headers show of a file, signature by signature with the number of hidden lines."""
    hidden = F.col("line_end") - F.col("line_start")
    line = F.when(F.col("kind") == "Function", F.concat(F.lit("fn "), "name", F.lit("() { ... "), hidden.cast("string"), F.lit(" lines ... }"))).otherwise(F.concat(F.lit("mod "), "name"))
    return symbols.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "ordinal", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def level_lines(lines: DataFrame, symbols: DataFrame, calls: DataFrame, level: int) -> DataFrame:
    """Lines (file, line_no) that a level shows: 0 none, 1 first lines of symbols, 2 also bodies of functions called in
    the same file, 3 all."""
    if level >= 3:
        return lines.select("file", "line_no")
    if level <= 0:
        return lines.select("file", "line_no").limit(0)
    called = calls.select("file", F.col("callee").alias("name"), F.lit(True).alias("called")).distinct()
    shown = symbols.join(called, ["file", "name"], "left")
    last = F.when(F.col("called") & F.lit(level == 2), F.col("line_end")).otherwise(F.col("line_start"))
    spans = shown.select(F.col("file").alias("s_file"), "line_start", last.alias("last"))
    held = (F.col("file") == F.col("s_file")) & F.col("line_no").between(F.col("line_start"), F.col("last"))
    return lines.join(spans, held, "left_semi").select("file", "line_no")
