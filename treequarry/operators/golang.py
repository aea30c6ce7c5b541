"""Functions, parameters, types, imports and calls of Go, from rows of tokens (see `lexed`).

A list of parameters is named if one of them is; then a name without a type has that of the next one with a type, which
is a fill from behind within the brackets. Names with a capital are Public.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treequarry.operators import lexed
from treequarry.operators.lexed import told

NO_CALLS = "func if for switch select return go defer range case interface struct map chan type var const import package".split()
#: A type that begins with one of these words has no name before it.
TYPE_WORDS = "func map chan interface struct".split()
#: A brace after one of these belongs to a type.
TYPE_BRACES = ["interface", "struct"]


def parsed(files: DataFrame, *only: str) -> DataFrame:
    """The tokens of Go files, nested, or only those of some kinds or texts; everything else here takes this."""
    return lexed.nested(files, "go", ["ahead2", "ahead3", "ahead4", "final"], only)


def visibility(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{Lu}"), "Public").otherwise("Private")


def _made(run: lexed.Run) -> dict[str, list]:
    """Declarations of functions, with places and offsets; in Go they stand outside of all brackets."""
    c, top = run.columns, run.columns["level"] == 0
    at, line_no, start, stop = (c[x] for x in ("at", "line_no", "start", "stop"))
    before, after, word = run.beside(-1), run.beside(1), run.are(kind="word")
    func, package, paren = (top & run.are(t, kind=k) for t, k in (("func", "word"), ("package", "word"), ("(", "sign")))
    body = top & run.are("{", kind="sign") & ~told(run.are(*TYPE_BRACES), before)
    next_paren, next_body, next_func = (run.following(x) for x in (paren, body, func))
    # the brackets after the first ones, which are a method's parameters
    second = told(next_paren, next_paren, -1)
    begins = (before < 0) | (told(line_no, before, 0) < line_no) | told(run.are(";", "}"), before)
    whole = (next_body >= 0) & ((next_func < 0) | (told(at, next_func, 0) > told(at, next_body, 0)))
    # a method names its receiver in the first brackets; its name is the token after them
    method = told(run.are("("), after)
    end = np.where(method, told(run.partner, next_paren, -1), -1)
    name = np.where(method, told(after, end, -1), after)
    params = np.where(method, second, next_paren)
    heads = np.flatnonzero(func & whole & begins & told(word, name) & (params >= 0) & (told(at, params, 0) < told(at, next_body, 0))).tolist()
    packages: dict[int, str | None] = {}
    for n in np.flatnonzero(package).tolist():
        packages.setdefault(int(run.file[n]), run.text(after[n]))
    of = lambda values, n: int(values[n]) if n >= 0 else None
    rows = [(n, int(name[n]), int(params[n]), int(next_body[n]), int(next_paren[n]) if method[n] else -1, int(end[n])) for n in heads]
    out = {"n": heads, "package": [packages.get(int(run.file[n])) for n in heads], "line_no": [int(line_no[n]) for n in heads]}
    out |= {"name": [run.text(r[1]) for r in rows], "name_at": [int(at[r[1]]) for r in rows], "opened": [int(at[r[2]]) for r in rows]}
    out |= {"from": [of(stop, r[4]) for r in rows], "to": [of(start, r[5]) for r in rows], "result_from": [of(stop, run.partner[r[2]]) for r in rows], "result_to": [int(start[r[3]]) for r in rows]}
    return out | {"body_start": [int(line_no[r[3]]) for r in rows], "body_end": [of(line_no, run.partner[r[3]]) for r in rows]}


#: What is made of a declaration.
HEAD = "package string, name string, line_no long, name_at long, opened long, body_start long, body_end long"


def _heads(files: DataFrame, texts: bool = False) -> DataFrame:
    """path and the columns of `HEAD` of each declaration of a function, with `texts` its receiver and returns too; no row leaves its task."""
    spans = {"receiver": ("from", "to"), "returns": ("result_from", "result_to")} if texts else {}
    return lexed.made(files, "go", _made, HEAD + "".join(f", {name} string" for name in spans), **spans)


def functions(files: DataFrame) -> DataFrame:
    """path, name, receiver, returns, visibility, attributes, line_start, line_end, body_start, body_end.

    receiver and returns are as written, or null. Functions without a body give no row. Attributes: `entrypoint` of main in
    package main, of init and of tests; `test`; `init`.
    """
    found = _heads(files, True)
    test, init = F.col("name").rlike("^(Test|Benchmark|Example)"), F.col("name") == "init"
    entry = test | init | ((F.col("name") == "main") & (F.coalesce("package", F.lit("")) == "main"))
    attributes = F.array_compact(F.array(F.when(entry, "entrypoint"), F.when(test, "test"), F.when(init, "init")))
    return found.select("path", "name", "receiver", F.nullif("returns", F.lit("")).alias("returns"), visibility(F.col("name")).alias("visibility"), attributes.alias("attributes"), F.col("line_no").alias("line_start"), F.col("body_end").alias("line_end"), "body_start", "body_end")


def parameters(files: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """path, function, line_no (of the function), pos, param, type; unnamed parameters give no rows, receivers neither."""
    tokens = parsed(files) if tokens is None else tokens
    heads = _heads(files).select("path", "opened", F.col("name").alias("function"), "line_no")
    # functions stand outside of all brackets, so their parameters are one level deep
    inner = tokens.filter((F.col("level") == 1) & (F.col("inside.text") == "(")).select("path", F.col("inside.at").alias("opened"), "at", "text", "kind", "start", "stop", F.struct("partner.at").alias("partner")).join(heads.hint("merge"), ["path", "opened"])
    order = Window.partitionBy("path", "opened").orderBy("at")
    comma = (F.col("kind") == "sign") & (F.col("text") == ",")
    inner = inner.withColumn("field", F.sum(comma.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(~comma)
    own = F.struct("at", "text", "kind", "start", "stop", "partner")
    fields = inner.groupBy("path", "opened", "function", "line_no", "field").agg(F.sort_array(F.collect_list(own)).alias("all"))
    first, second, last = F.get("all", F.lit(0)), F.get("all", F.lit(1)), F.element_at("all", -1)
    # `List[int]` is a type alone, `a []int` and `a [4]int` are a name and a type
    bracket = (second["text"] == "[") & (second["partner"]["at"] == last["at"])
    name = (first["kind"] == "word") & ~first["text"].isin(TYPE_WORDS)
    fields = fields.withColumn("named", name & (F.size("all") > 1) & (second["text"] != ".") & ~bracket)
    fields = fields.withColumn("any_named", F.max("named").over(Window.partitionBy("path", "opened"))).filter("any_named")
    fields = fields.select("path", "opened", "function", "line_no", "field", first["text"].alias("param"), F.when(F.col("named"), first["stop"]).alias("from"), F.when(F.col("named"), last["stop"]).alias("to"))
    typed = lexed.sliced(fields, files, own_type=(F.col("from"), F.col("to")))
    behind = Window.partitionBy("path", "opened").orderBy("field").rowsBetween(0, Window.unboundedFollowing)
    return typed.select("path", "function", "line_no", F.col("field").cast("long").alias("pos"), "param", F.first("own_type", True).over(behind).alias("type"))


def _types(run: lexed.Run) -> dict[str, list]:
    line_no, words = run.columns["line_no"], run.are(kind="word")
    before, after, earlier = run.beside(-1), run.beside(1), run.beside(-2)
    # parameters of a type stand between its name and its body; then what is before the body is their bracket
    generic = told(run.are("]", kind="sign"), before)
    bracket = told(run.partner, before, -1)
    name, word = (np.where(generic, told(x, bracket, -1), y) for x, y in ((before, before), (earlier, earlier)))
    around = told(before, run.inside, -1)
    is_type = run.are("type")
    alone, grouped = told(is_type, word), told(run.are("("), run.inside) & told(is_type, around)
    found = np.flatnonzero(words & run.are(*TYPE_BRACES) & told(run.are("{"), after) & told(words, name) & (alone | grouped)).tolist()
    closed = np.where(alone, -1, told(run.partner, run.inside, -1))
    closed = np.where(closed >= 0, closed, told(run.partner, after, -1))
    out = {"n": found, "name": [run.text(name[n]) for n in found], "kind": [run.text(n).capitalize() for n in found]}
    return out | {"line_start": [int(line_no[(word if alone[n] else around)[n]]) for n in found], "line_end": [int(line_no[closed[n]]) if closed[n] >= 0 else None for n in found]}


def _symbols(run: lexed.Run) -> dict[str, list]:
    heads, types = _made(run), _types(run)
    both = {"n": heads["n"], "name": heads["name"], "kind": ["Function"] * len(heads["n"]), "line_start": heads["line_no"], "line_end": heads["body_end"]}
    return {name: both[name] + types[name] for name in both}


SYMBOLS = "name string, kind string, line_start long, line_end long"


def types(files: DataFrame) -> DataFrame:
    """path, name, kind (Struct or Interface), visibility, line_start, line_end; types of one group have the group's lines."""
    return lexed.made(files, "go", _types, SYMBOLS).select("path", "name", "kind", visibility(F.col("name")).alias("visibility"), "line_start", "line_end")


def symbols(files: DataFrame) -> DataFrame:
    """The columns of `types`, of functions and types alike: a file is cut once for both."""
    return lexed.made(files, "go", _symbols, SYMBOLS).select("path", "name", "kind", visibility(F.col("name")).alias("visibility"), "line_start", "line_end")


def imports(files: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """path, import_path, alias (null without one), line_no; single and grouped imports."""
    tokens = parsed(files, "string") if tokens is None else tokens
    before, inside = F.col("before"), F.col("inside")
    found = tokens.filter((F.col("kind") == "string") & F.col("text").startswith('"'))
    grouped = (inside["text"] == "(") & (inside["before"]["text"] == "import")
    named = (before["kind"] == "word") & (before["text"] != "import") | before["text"].isin(".", "_")
    alias = F.when(named & (before["line_no"] == F.col("line_no")), before["text"])
    single = (F.col("level") == 0) & ((before["text"] == "import") | (named & (F.col("earlier.text") == "import")))
    return found.filter(F.coalesce(grouped, F.lit(False)) | F.coalesce(single, F.lit(False))).select("path", F.btrim("text", F.lit('"')).alias("import_path"), alias.alias("alias"), "line_no")


def calls(files: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """path, caller (null outside of functions), callee, line_no: names and fields before brackets, conversions of plain types too."""
    tokens = parsed(files, "word") if tokens is None else tokens
    heads = _heads(files).select("path", "name_at", "name", "line_no", F.col("body_end").alias("line_end"))
    held = "struct<line_no: long, line_end: long, name: string>"
    method = (F.col("inside.text") == "{") & (F.col("inside.before.text") == "interface")
    found = tokens.filter((F.col("kind") == "word") & (F.col("after.text") == "(") & ~F.col("text").isin(NO_CALLS)).filter(~F.coalesce(F.col("before.text").isin("func", "]"), F.lit(False)) & ~F.coalesce(method, F.lit(False)))
    found = found.select("path", "at", F.col("text").alias("callee"), "line_no")
    # the name of a head is no call: it stands beside what would be one, in the same place
    kept = Window.partitionBy("path", "at")
    heads = heads.withColumn("at", F.col("name_at"))
    both = found.withColumns({"held": F.lit(None).cast(held), "named": F.lit(False)}).unionByName(heads.select("path", "at", F.lit(None).cast("string").alias("callee"), "line_no", F.struct("line_no", "line_end", "name").alias("held"), F.lit(True).alias("named"))).repartition("path")
    both = both.withColumn("named", F.max("named").over(kept)).filter("held is not null or not named")
    # functions do not nest: the last one begun on or before the line holds it, or none does
    so_far = Window.partitionBy("path").orderBy("line_no", F.col("held").isNull(), "at").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("held", F.last("held", True).over(so_far))
    return both.filter("callee is not null").select("path", F.when(F.col("held.line_end") >= F.col("line_no"), F.col("held.name")).alias("caller"), "callee", "line_no")
