"""Functions, tests, types, imports and calls of Zig, from rows of tokens (see `lexed`)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treequarry.operators import intervals, lexed
from treequarry.operators.graph import checkpointed
from treequarry.operators.lexed import told

#: Kinds of containers by their words; a word before them may say how they are laid out.
CONTAINERS = {"struct": "Struct", "enum": "Enum", "union": "Class"}
LAYOUTS = ["extern", "packed"]
MODIFIERS = ["pub", "export", "extern", "inline", "noinline", "async"]
#: What is asked of the tokens of types, imports and calls.
OF_TYPES = "path at text kind line_no level nth before.text after.text after.kind ahead2.text ahead3.text ahead4.text inside.at"
OF_IMPORTS = "path text kind inside.text inside.before.text inside.before.line_no"
OF_CALLS = "path at text kind line_no before.text after.text"
NO_CALLS = "fn if while for switch catch orelse return try and or struct enum union error test align linksection callconv".split()


def parsed(files: DataFrame, *only: str, leaves: str = "", top: bool = False) -> DataFrame:
    """The tokens of Zig files, nested, or only those of some kinds or texts; everything else here takes this."""
    return lexed.nested(files, "zig", ["earlier", "before_partner", "final"], only, top=top, leaves=leaves)


def _word(text: str) -> Column:
    return (F.col("kind") == "word") & (F.col("text") == text)


def _begun(tokens: DataFrame, wanted: Column) -> DataFrame:
    """The tokens wanted, and modifiers, with `begun`: where the modifiers before them begin (line_no, and whether one is `pub` or `async`)."""
    order = Window.partitionBy("path").orderBy("at")
    modifier = F.col("kind").isin("word", "string") & (F.col("text").isin(MODIFIERS) | ((F.col("kind") == "string") & (F.col("before.text") == "extern")))
    rows = tokens.withColumn("modifier", F.coalesce(modifier, F.lit(False))).filter(wanted | F.col("modifier")).repartition("path")
    goes_on = F.lag("modifier").over(order) & (F.lag("nth").over(order) == F.col("nth") - 1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda wanted, told: F.last(F.when(wanted, F.col(told)), True).over(so_far)
    # one window over a file: a window for each run of modifiers would be one for nearly each token
    rows = rows.withColumn("first", ~F.coalesce(goes_on, F.lit(False)))
    rows = rows.withColumns({"_from": last(F.col("first"), "at"), "_line": last(F.col("first"), "line_no"), "_pub": last(F.col("text") == "pub", "at"), "_async": last(F.col("text") == "async", "at")})
    since = lambda name: F.coalesce(F.col(name) >= F.col("_from"), F.lit(False))
    begun = F.struct(F.col("_line").alias("line_no"), since("_pub").alias("is_pub"), since("_async").alias("is_async"))
    return rows.withColumn("begun", begun).drop("first", "_from", "_line", "_pub", "_async")


def _run_begins(run: lexed.Run, before: np.ndarray, words: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the run of modifiers right before a token begins, or the token itself, and whether one of them is `pub`, and `async`."""
    modifier = words & run.are(*MODIFIERS) | strings & (run.are(*MODIFIERS) | told(run.are("extern"), before))
    first = np.maximum.accumulate(np.where(told(modifier, before), -1, run.here))
    since = lambda text: np.maximum.accumulate(np.where(modifier & run.are(text), run.here, -1)) >= first
    return first, since("pub"), since("async")


def _made(run: lexed.Run) -> dict[str, list]:
    """Functions, prototypes and tests. Modifiers before one begin it: a run of them right before."""
    c = run.columns
    before, after = run.beside(-1), run.beside(1)
    words, strings = run.are(kind="word"), run.are(kind="string")
    first, is_pub, is_async = _run_begins(run, before, words, strings)
    operand = told(run.are("error", "struct", "enum", "union", "opaque"), before)
    body, halt = run.following(run.are("{", kind="sign") & ~operand), run.following(run.are(";", kind="sign"))
    body_first = (body >= 0) & ((halt < 0) | (body < halt))
    ends = np.where(body_first, told(run.partner, body, -1), halt)
    is_fn = words & run.are("fn") & told(words, after)
    is_test = words & run.are("test") & (c["level"] == 0) & told(strings, after) & body_first
    found = np.flatnonzero(is_fn | is_test).tolist()
    out = {"n": found, "told": [run.text(after[n]) for n in found], "is_fn": is_fn[found].tolist(), "is_pub": is_pub[found].tolist(), "begun_async": is_async[found].tolist()}
    return out | {"line_start": c["line_no"][first[found]].tolist(), "line_end": [int(c["line_no"][ends[n]]) if ends[n] >= 0 else None for n in found]}


def functions(files: DataFrame) -> DataFrame:
    """path, name, visibility, is_async, attributes, line_start, line_end: functions at any depth, and tests with a string for a name.

    A function begins with its modifiers and ends with its body, or the `;` of a prototype. A test is named `test "name"`. No row leaves its task.
    """
    rows = lexed.made(files, "zig", _made, "told string, is_fn boolean, is_pub boolean, begun_async boolean, line_start long, line_end long")
    is_fn = F.col("is_fn")
    attributes = F.array_compact(F.array(F.when(~is_fn, "test"), F.when(~is_fn | (F.col("told") == "main"), "entrypoint")))
    name = F.concat(F.when(is_fn, "").otherwise("test "), "told")
    visibility = F.when(is_fn & F.col("is_pub"), "Public").otherwise("Private")
    return rows.select("path", name.alias("name"), visibility.alias("visibility"), (is_fn & F.col("begun_async")).alias("is_async"), attributes.alias("attributes"), "line_start", "line_end")


def types(files: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """path, name, kind, visibility, line_start, line_end of containers that are declared outside of all others."""
    tokens = parsed(files, "const", "var", ";", "string", *MODIFIERS, leaves=OF_TYPES, top=True) if tokens is None else tokens
    end, declared = (F.col("kind") == "sign") & (F.col("text") == ";"), _word("const") | _word("var")
    rows = lexed.following(_begun(tokens.filter("level = 0"), declared | end), ["line_no"], end=end)
    rows = rows.withColumnsRenamed({"after": "named", "ahead2": "equals", "ahead3": "first", "ahead4": "second"})
    what = F.when(F.col("first.text").isin(LAYOUTS), F.col("second.text")).otherwise(F.col("first.text"))
    found = rows.filter(declared & (F.col("named.kind") == "word") & (F.col("equals.text") == "=") & what.isin(list(CONTAINERS)))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in CONTAINERS.items() for x in pair]), what)
    return found.select("path", F.col("named.text").alias("name"), kind.alias("kind"), F.when(F.col("begun.is_pub"), "Public").otherwise("Private").alias("visibility"), F.col("begun.line_no").alias("line_start"), F.col("end.line_no").alias("line_end"))


def _symbols(run: lexed.Run) -> dict[str, list]:
    """Functions and tests, and containers that are declared outside of all others: what `functions` and `types` find, of a file that is cut once."""
    c, words, strings = run.columns, run.are(kind="word"), run.are(kind="string")
    first, is_pub, _ = _run_begins(run, run.beside(-1), words, strings)
    named, equals, third, fourth = (run.beside(k) for k in (1, 2, 3, 4))
    what = np.where(told(run.are(*LAYOUTS), third), fourth, third)
    end = run.following((c["level"] == 0) & run.are(";", kind="sign"))
    declared = (c["level"] == 0) & words & run.are("const", "var") & told(words, named) & told(run.are("="), equals) & told(run.are(*CONTAINERS), what)
    found, own = np.flatnonzero(declared).tolist(), _made(run)
    names = [told if is_fn else f"test {told}" for told, is_fn in zip(own["told"], own["is_fn"], strict=True)]
    out = {"n": own["n"] + found, "name": names + [run.text(named[n]) for n in found], "kind": ["Function"] * len(names) + [CONTAINERS[run.text(what[n])] for n in found]}
    out["visibility"] = ["Public" if p and fn else "Private" for p, fn in zip(own["is_pub"], own["is_fn"], strict=True)] + ["Public" if is_pub[n] else "Private" for n in found]
    out["line_start"] = own["line_start"] + c["line_no"][first[found]].tolist()
    return out | {"line_end": own["line_end"] + [int(c["line_no"][end[n]]) if end[n] >= 0 else None for n in found]}


def symbols(files: DataFrame) -> DataFrame:
    """path, name, kind, visibility, line_start, line_end of functions, tests and types; no row leaves its task."""
    return lexed.made(files, "zig", _symbols, "name string, kind string, visibility string, line_start long, line_end long")


def imports(files: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """path, import_path, line_no of each @import of a string."""
    tokens = parsed(files, "string", leaves=OF_IMPORTS) if tokens is None else tokens
    found = tokens.filter((F.col("kind") == "string") & (F.col("inside.text") == "(") & (F.col("inside.before.text") == "@import"))
    return found.select("path", F.btrim("text", F.lit('"')).alias("import_path"), F.col("inside.before.line_no").alias("line_no"))


def calls(files: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """path, caller (the innermost function or test around, null outside of all), callee, line_no; fields and builtins are no calls."""
    # what is held is asked for twice: written once, files are parsed for it once
    held = checkpointed(functions(files).select("path", "name", "line_start", "line_end"))
    tokens = parsed(files, "word", leaves=OF_CALLS) if tokens is None else tokens
    found = tokens.filter((F.col("kind") == "word") & (F.col("after.text") == "(") & ~F.col("text").isin(NO_CALLS) & ~F.col("text").startswith("@")).filter(~F.coalesce(F.col("before.text").isin(".", "fn"), F.lit(False)))
    found = found.select("path", "at", F.col("text").alias("callee"), "line_no")
    around = intervals.held(found.select("path", "line_no").distinct(), held, "path", "line_no", "line_start", "line_end").groupBy("path", "line_no").agg(F.max(F.struct("line_start", "name"))["name"].alias("caller"))
    return found.join(around.hint("merge"), ["path", "line_no"], "left").select("path", "caller", "callee", "line_no")
