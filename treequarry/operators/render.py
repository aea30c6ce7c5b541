"""What a file shows: headers, the levels 0 to 3, and the modes of showing it. Every form is rows of lines in order, never one string a file.

symbols: file, ordinal, name, kind (Function, Class, Struct, Trait, Interface, Enum, Module), line_start, line_end, body_start,
body_end, signature (as `symbols.signature` builds it), owner (null, or the name of the class that a method is of). Methods are
shown by their class. lines: file, line_no, text. Which lines a range holds is an equi join over blocks (`intervals`), so a file
of very many symbols makes no pairs.

Where symbols stand in each other, text between two of them is told from the one before, so lines can be shown twice, as lists of
symbols with functions in functions have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treequarry.functions import paths as P
from treequarry.functions import text as T
from treequarry.operators import intervals

#: Fixed words of the output.
STORED, HEADERS, HIDDEN = "[VEILED - not on disk]", "[HEADERS VEILED]", "[veiled]"
MARKER = r"^\.\.\.\[[a-f0-9]{7}\]"
CLASSES = ["Class", "Struct", "Trait", "Interface", "Enum"]
DOC_SIGNS = ['"""', "///", "/**", "#"]
ROW = ["file", "place", "part", "line_no", "text"]


def numbered(line_no: Column, text: Column) -> Column:
    n = line_no.cast("string")
    return F.concat(F.when(F.length(n) < 4, F.lpad(n, 4, " ")).otherwise(n), F.lit(" | "), text)


def _top(symbols: DataFrame) -> DataFrame:
    """Symbols that no class shows, with their place in the file and the line after the one before them."""
    order = Window.partitionBy("file").orderBy("line_start", "ordinal")
    return symbols.filter("owner is null").withColumns({"place": F.row_number().over(order).cast("long"), "after": F.coalesce(F.lag("line_end").over(order), F.lit(0)) + 1})


def _lines_of(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """file, place, line_no, text of the lines that spans (file, place, first, last) hold."""
    return intervals.held(lines.select("file", "line_no", "text"), spans.select("file", "place", "first", "last"), "file", "line_no", "first", "last").select("file", "place", "line_no", "text")


def _between(top: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines before each symbol and after the last one, where one of them is not blank."""
    ends = top.groupBy("file").agg(F.max_by("line_end", "place").alias("line_end"), F.max("place").alias("place"))
    rest = lines.groupBy("file").agg(F.max("line_no").alias("last")).join(ends, "file", "left")
    spans = top.select("file", "place", F.col("after").alias("first"), (F.col("line_start") - 1).alias("last"))
    spans = spans.unionByName(rest.select("file", (F.coalesce("place", F.lit(0)) + 1).alias("place"), (F.coalesce("line_end", F.lit(0)) + 1).alias("first"), "last"))
    found = _lines_of(spans.filter("first <= last"), lines)
    told = found.filter(F.col("text").rlike(r"\S")).select("file", "place").distinct()
    return found.join(told, ["file", "place"], "left_semi").select("file", "place", F.lit(0).alias("part"), "line_no", F.concat("text", F.lit("\n")).alias("text"))


def headers(lines: DataFrame, symbols: DataFrame, max_bytes: int | None = None, methods: bool = True) -> DataFrame:
    """file, place, part, line_no, text: signatures with the number of lines they hide, and what stands between them.

    In order of place, part and line_no the texts, which have their own line ends, make up the header of a file. A signature is what
    stands before the body's first line, or is built where the body begins on the same line. One of more than `max_bytes`
    (3 at least) is cut before a broken character and ends in three dots, without a line end. Modules show nothing.
    """
    top = _top(symbols)
    python = P.language(F.col("file")) == "python"
    apart = F.coalesce(F.col("body_start") > F.col("line_start"), F.lit(False))
    functions = top.filter("kind = 'Function'")
    source = _lines_of(functions.filter(apart).select("file", "place", F.col("line_start").alias("first"), (F.col("body_start") - 1).alias("last")), lines)
    source = source.groupBy("file", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("source"))
    given = F.when(apart, F.coalesce("source", F.lit(""))).otherwise(F.col("signature"))
    hidden = (F.col("body_end") - F.col("body_start") + 1).cast("string")
    form = F.when(python, F.concat(F.lit("\n    ...  # "), hidden, F.lit(" lines hidden\n"))).otherwise(F.concat(F.lit(" { ... "), hidden, F.lit(" lines ... }\n")))
    text = F.concat(F.regexp_replace(given, r"(?U)\s+\z", ""), form)
    if max_bytes is not None:
        most = max(max_bytes, 3)
        text = F.when(F.octet_length(given) > most, F.concat(T.truncated(given, most - 3), F.lit("..."))).otherwise(text)
    shown = functions.join(source, ["file", "place"], "left").select("file", "place", F.lit(1).alias("part"), F.col("line_start").alias("line_no"), text.alias("text"))

    own = symbols.filter("owner is not null and kind = 'Function'").groupBy("file", F.col("owner").alias("name")).agg(F.array_sort(F.collect_list(F.struct("line_start", "ordinal", "signature"))).alias("methods"))
    classes = top.filter(F.col("kind").isin(CLASSES)).join(own, ["file", "name"], "left")
    listed = F.coalesce("methods", F.array().cast(own.schema["methods"].dataType)) if methods else F.array().cast(own.schema["methods"].dataType)
    size = (F.col("line_end") - F.col("line_start") + 1).cast("string")
    head = F.concat(F.lower("kind"), F.lit(" "), "name", F.when(python, ":\n").otherwise(" {\n"))
    each = F.array_join(F.transform(listed, lambda m: F.concat(F.lit("    "), m["signature"], F.when(python, ":\n        ...  # hidden\n").otherwise(" { ... }\n"))), "")
    tail = F.when(python, F.concat(F.lit("    ...  # "), size, F.lit(" lines hidden\n"))).otherwise(F.concat(F.lit("    // ... "), size, F.lit(" lines ...\n}\n")))
    of_classes = classes.select("file", "place", F.lit(1).alias("part"), F.col("line_start").alias("line_no"), F.concat(head, each, tail).alias("text"))
    return _between(top, lines).unionByName(shown).unionByName(of_classes).select(ROW)


def called_bodies(lines: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """As `headers`, for level 2: functions that their own file calls (file, callee) are whole, others end where their body begins.

    Of classes and modules the first line shows. A mark stands where lines are missing since the range before. A file of no
    symbols is one empty line.
    """
    called = calls.select("file", F.col("callee").alias("name"), F.lit(True).alias("called")).distinct()
    function = F.col("kind") == "Function"
    last = F.when(function & F.col("called"), F.col("line_end")).when(function, F.least("body_start", "line_end")).otherwise(F.col("line_start"))
    order = Window.partitionBy("file").orderBy("first", "ordinal")
    spans = symbols.join(called, ["file", "name"], "left").select("file", "ordinal", F.col("line_start").alias("first"), last.alias("last"))
    spans = spans.withColumns({"place": F.row_number().over(order).cast("long"), "before": F.lag("last").over(order)})
    marks = spans.filter("first > before + 1").select("file", "place", F.lit(0).alias("part"), F.col("first").alias("line_no"), F.lit("// ...\n").alias("text"))
    shown = _lines_of(spans, lines).select("file", "place", F.lit(1).alias("part"), "line_no", F.concat("text", F.lit("\n")).alias("text"))
    bare = lines.select("file").distinct().join(symbols.select("file").distinct(), "file", "left_anti")
    return marks.unionByName(shown).unionByName(bare.select("file", F.lit(0).cast("long").alias("place"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("line_no"), F.lit("\n").alias("text"))).select(ROW)


def level(lines: DataFrame, symbols: DataFrame, calls: DataFrame, n: int) -> DataFrame:
    """Rows as of `headers`: 0 nothing, 1 headers, 2 also the bodies of functions called in the file, 3 the source."""
    if n == 1:
        return headers(lines, symbols)
    if n == 2:
        return called_bodies(lines, symbols, calls)
    if n not in (0, 3):
        raise ValueError(f"a level is 0 to 3, not {n}")
    whole = lines.select("file", F.lit(0).cast("long").alias("place"), F.lit(0).alias("part"), "line_no", F.concat("text", F.lit("\n")).alias("text"))
    return whole if n else whole.filter(F.lit(False))


def set_level(file: str, n: int, lines: DataFrame, symbols: DataFrame, calls: DataFrame, stored: DataFrame) -> DataFrame:
    """path, content of one file after it is set to a level: none at 0, its stored source (file, content) at 3 if it is hidden."""
    of = lambda df: df.filter(F.col("file") == file)
    rows = level(of(lines), of(symbols), of(calls), n)
    text = rows.groupBy(F.col("file").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part", "line_no", "text"))), lambda x: x["text"]), "").alias("content"))
    if n < 3:
        return text
    kept = of(stored).select(F.col("file").alias("path"), F.col("content").alias("kept"))
    return text.join(kept, "path", "full").select("path", F.coalesce("kept", "content").alias("content"))


def modes(lines: DataFrame, symbols: DataFrame, tracked: DataFrame, hidden: DataFrame, whole: bool = False) -> DataFrame:
    """file, mode of every file on disk or tracked (file): stored, headers, partial, outline or full."""
    flag = lambda df, name: df.select("file").distinct().withColumn(name, F.lit(True))
    both = flag(lines, "there").join(flag(tracked, "kept"), "file", "full").join(flag(hidden, "ranged"), "file", "left").join(flag(symbols, "known"), "file", "left")
    kept, ranged = F.col("kept").isNotNull(), F.col("ranged").isNotNull()
    mode = F.when(F.col("there").isNull(), "stored").when(kept & ~ranged, "headers").when(ranged, "partial").when(F.lit(whole) | F.col("known").isNull(), "full").otherwise("outline")
    return both.select("file", mode.alias("mode"))


def show(lines: DataFrame, symbols: DataFrame, imports: DataFrame, tracked: DataFrame, hidden: DataFrame, stored: DataFrame, expand: str = "", with_imports: bool = False, docs: bool = False) -> DataFrame:
    """file, mode, place, part, line_no, text: what showing each file prints, in order of place, part and line_no.

    tracked: file, hidden as a whole; stored: their lines; hidden: file, line_no hidden by ranges; imports: file, import_path,
    line_no. `expand`: a name whose body is shown, or `*` for whole files. With `docs` comments at the head of a symbol show.
    """
    mode = modes(lines, symbols, tracked, hidden, expand == "*")
    zero = F.lit(0).cast("long")
    row = lambda df, place, part, line, text: df.select("file", "mode", place.cast("long").alias("place"), F.lit(part).alias("part"), line.cast("long").alias("line_no"), text.alias("text"))
    plain = mode.filter("mode <> 'outline'")
    end = F.when(F.col("mode") == "stored", f" {STORED}").when(F.col("mode") == "headers", f" {HEADERS}").otherwise("")
    out = row(plain, zero, 0, zero, F.concat(F.lit("File: "), "file", end))

    texts = lines.select("file", "line_no", "text", F.lit(True).alias("there")).unionByName(stored.select("file", "line_no", "text", F.lit(False).alias("there")))
    texts = texts.join(plain, "file").filter(F.col("there") == (F.col("mode") != "stored"))
    texts = texts.join(hidden.select("file", "line_no", F.lit(True).alias("is_hidden")).distinct(), ["file", "line_no"], "left")
    partial = F.col("mode") == "partial"
    text = F.when(partial & F.col("text").rlike(MARKER), F.concat(F.lit(f"{HIDDEN} "), "text")).when(partial & F.col("is_hidden"), F.lit(f"{HIDDEN} ...")).otherwise(F.col("text"))
    out = out.unionByName(row(texts, F.lit(1), 0, F.col("line_no"), numbered(F.col("line_no"), text)))

    outlined = mode.filter("mode = 'outline'")
    top = _top(symbols).join(outlined, "file").withColumn("place", F.col("ordinal") + 10)
    counts = top.groupBy("file", "mode").agg(F.count_if(F.col("kind") == "Function").cast("string").alias("f"), F.count_if(F.col("kind").isin(CLASSES)).cast("string").alias("c"))
    heads = F.array(F.concat(F.lit("# "), "file"), F.concat(F.lit("# "), "f", F.lit(" functions · "), "c", F.lit(" classes · "), P.language_name(P.language(F.col("file")))), F.lit(""))
    heads = counts.select("file", "mode", F.posexplode(heads).alias("n", "text"))
    out = out.unionByName(row(heads, zero, 1, F.col("n"), F.col("text")))
    if with_imports:
        listed = imports.join(outlined, "file")
        out = out.unionByName(row(listed, F.lit(2), 0, F.col("line_no"), F.col("import_path")))
        out = out.unionByName(row(listed.select("file", "mode").distinct(), F.lit(2), 1, zero, F.lit("")))
    opened = F.col("name") == expand
    closed = top.filter(~opened)
    start = F.col("line_start")
    sign = F.when(F.col("signature") == "", F.concat("name", F.lit(" (line "), start.cast("string"), F.lit(")"))).otherwise(F.concat("signature", F.lit("    # line "), start.cast("string")))
    out = out.unionByName(row(closed, F.col("place"), 0, start, sign))
    held = lambda df, last: _lines_of(df.select("file", "place", start.alias("first"), last.alias("last")), lines).join(outlined, "file")
    if docs:
        size = lines.groupBy("file").agg(F.max("line_no").alias("n"))
        bare = F.trim("text")
        starts = [F.startswith(bare, F.lit(s)) for s in DOC_SIGNS]
        found = held(closed.join(size, "file").filter("line_start < n"), F.least(start + 2, F.col("line_end"))).filter(starts[0] | starts[1] | starts[2] | starts[3])
        out = out.unionByName(row(found, F.col("place"), 1, F.col("line_no"), F.concat(F.lit("    "), bare)))
    out = out.unionByName(row(closed.filter("line_end > line_start"), F.col("place"), 2, start, F.concat(F.lit("    ... "), (F.col("line_end") - start).cast("string"), F.lit(" lines"))))
    if expand and expand != "*":
        found = held(top.filter(opened), F.col("line_end"))
        out = out.unionByName(row(found, F.col("place"), 0, F.col("line_no"), numbered(F.col("line_no"), F.col("text"))))
    return out.unionByName(row(top, F.col("place"), 3, start, F.lit("")))
