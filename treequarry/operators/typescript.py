"""Functions, arrow functions, components, parameters and markup of TypeScript, from rows of tokens (see `lexed`).

A statement begins with its first word where one may begin: at the start, after `;` and braces, or on a new line after
what can end a statement. All functions are Public. In .tsx files those with a capital are components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treequarry.operators import lexed
from treequarry.operators.lexed import told

#: A brace after one of these begins a type or a value, not a body.
BEFORE_TYPE = [":", "|", "&", ",", "<", "=>", "=", "extends", "is", "keyof", "readonly"]
#: After one of these a new line goes on with the statement.
GOES_ON = ["=", "(", "[", ",", ":", "?", "+", "-", "*", "/", "%", "&&", "||", "??", "=>", ".", "?.", "<", ">", "<=", "==", "===", "!=", "!==", "!", "&", "|", "^", "~", "...", "return", "typeof", "await", "new", "extends", "in", "of"]
#: What is asked of the tokens of markup.
OF_MARKUP = "path text kind line_no"
ENTRYPOINTS = ["App", "Main", "Page"]


def parsed(files: DataFrame, *only: str, leaves: str = "") -> DataFrame:
    """The tokens of TypeScript files, nested, or only those of some kinds or texts."""
    return lexed.nested(files, "typescript", ["earlier", "ahead3", "ahead4", "before_partner"], only, leaves=leaves)


def _starts(run: lexed.Run) -> np.ndarray:
    """Whether a token can begin a statement; in round and square brackets nothing does."""
    before, line_no = run.beside(-1), run.columns["line_no"]
    fresh = (before < 0) | told(run.are(";", "{", "}", "export", "default"), before) | ((told(line_no, before, 0) < line_no) & ~told(run.are(*GOES_ON), before))
    return run.are(kind="word") & fresh & told(run.are("{", "${"), run.inside, True)


def _heads(run: lexed.Run) -> dict[str, list]:
    """Declarations and arrow functions: places n and params, name, line_start, line_end, and offsets: of the result, and of the whole."""
    c = run.columns
    line_no, end_line, start, stop = (c[x] for x in ("line_no", "end_line", "start", "stop"))
    before, a1, a2 = run.beside(-1), run.beside(1), run.beside(2)
    word, starts = run.are(kind="word"), _starts(run)
    sign = lambda text: run.are(text, kind="sign")
    typed = told(run.are(*BEFORE_TYPE), before)
    paren, body, brace, semicolon = (run.following(x) for x in (sign("("), sign("{") & ~typed, sign("{"), sign(";")))
    next_start, arrow, equals = run.following(starts | sign(";")), run.following(sign("=>")), run.following(sign("="))
    first_of = lambda place: (place >= 0) & ((next_start < 0) | (place < next_start))
    # function declarations; `async` begins the statement, and the word after it would begin none
    is_async = run.are("async")
    name = np.where(is_async, a2, a1)
    declared = np.where(is_async, told(run.are("function"), a1), run.are("function"))
    plain = starts & declared & told(word, name) & first_of(body) & first_of(paren)
    # const name = async? <T>? ( ... ) : type => : the arrow comes after the brackets, with nothing but a type between
    own_paren, own_arrow, b1, b2 = (told(x, equals, -1) for x in (paren, arrow, a1, a2))
    # what stands right after `=` must be the brackets, but for `async` and type parameters
    opened = np.where(told(is_async, b1), b2, b1)
    closed = told(run.partner, own_paren, -1)
    valued = (told(run.are("<"), opened) | (told(run.are("("), opened) & (opened == own_paren))) & (closed >= 0) & (closed < own_arrow) & told(run.are("=>", ":"), told(a1, closed, -1))
    arrows = ~plain & starts & run.are("const", "let") & told(word, a1) & first_of(equals) & valued & (run.final >= 0)
    # the whole ends with the brace that closes its body, or with the last token of its statement; without a later
    # statement beside it, the statement ends where its surroundings or the file end
    last = told(before, next_start, -1)
    last = np.where(last >= 0, last, run.final)
    braced = told(run.are("{"), told(a1, own_arrow, -1))
    own_body = told(run.partner, told(brace, own_arrow, -1), -1)
    ended = (semicolon >= 0) & (semicolon == next_start)
    of = lambda values, n: int(values[n]) if n >= 0 else None
    rows = []
    for n in np.flatnonzero(plain | arrows).tolist():
        if plain[n]:
            params, till, end, named = int(paren[n]), int(body[n]), int(run.partner[body[n]]), int(name[n])
            line_end = of(line_no, end)
        else:
            params, till, end, named = int(own_paren[n]), int(own_arrow[n]), int(own_body[n] if braced[n] else last[n]), int(a1[n])
            line_end = int(line_no[semicolon[n]]) if ended[n] else of(line_no if braced[n] else end_line, end)
        rows.append((n, params, run.text(named), of(stop, run.partner[params]), int(start[till]), int(line_no[n]), line_end, int(start[n]), of(stop, end), bool(arrows[n])))
    columns = ("n", "params", "name", "result_from", "result_to", "line_start", "line_end", "from", "to", "arrow")
    return {name: [r[k] for r in rows] for k, name in enumerate(columns)}


def functions(files: DataFrame) -> DataFrame:
    """path, name, returns (null without), is_async, arrow, attributes, line_start, line_end.

    Declarations with a body, and const or let with a name and an arrow function with brackets for a value. `is_async` says that
    the word stands in the text of the whole. Attributes, in .tsx files only: `component`, and `entrypoint` of App, Main and Page.
    No row leaves its task.
    """
    found = lexed.made(files, "typescript", _heads, "name string, arrow boolean, line_start long, line_end long, result string, whole string", result=("result_from", "result_to"), whole=("from", "to"))
    component = F.col("path").endswith(".tsx") & F.col("name").rlike(r"^\p{Lu}")
    attributes = F.array_compact(F.array(F.when(component, "component"), F.when(component & F.col("name").isin(ENTRYPOINTS), "entrypoint")))
    returns = F.nullif(F.btrim(F.regexp_replace("result", "^:+", "")), F.lit(""))
    is_async = F.col("whole").startswith("async ") | F.contains("whole", F.lit(" async "))
    return found.select("path", "name", returns.alias("returns"), is_async.alias("is_async"), "arrow", attributes.alias("attributes"), "line_start", "line_end")


def _fields(run: lexed.Run) -> dict[str, list]:
    """The parts between commas of each function's parameters, with offsets of the pattern and of the type; angle brackets of types hold commas back."""
    start, stop = run.columns["start"], run.columns["stop"]
    heads, sign = _heads(run), run.are(kind="sign")
    out: dict[str, list] = {name: [] for name in ("n", "function", "line_no", "pos", "from", "to", "type_from", "type_to")}
    for n, params, function, line_no in zip(heads["n"], heads["params"], heads["name"], heads["line_start"], strict=True):
        parts: dict[int, dict] = {}
        angle = field = 0
        for at in run.within(params):
            text = run.text(at) if sign[at] else ""
            angle += (text == "<") - (text == ">")
            if text == "," and angle == 0:
                field += 1
                continue
            part = parts.setdefault(field, {"from": int(start[at])})
            part["to"] = int(stop[at])
            if angle == 0 and text in (":", "=", "?"):
                part.setdefault(text, at)
        for pos, part in parts.items():
            colon, equals, optional = (part.get(x) for x in (":", "=", "?"))
            if colon is not None and equals is not None and colon > equals:
                colon = None
            if optional is not None and colon is not None and optional > colon:
                optional = None
            ends = [int(start[x]) for x in (optional, colon, equals) if x is not None]
            row = (n, function, line_no, pos, part["from"], min(ends, default=part["to"]))
            row += (None, None) if colon is None else (int(stop[colon]), part["to"] if equals is None else int(start[equals]))
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
    return out


def parameters(files: DataFrame) -> DataFrame:
    """path, function, line_no (of the function), pos, param (its pattern as written, `...` too), type (null without).

    Commas in angle brackets of types part nothing; a default value belongs to neither. A file is cut once, and no row leaves its task.
    """
    found = lexed.made(files, "typescript", _fields, "function string, line_no long, pos long, param string, type string", param=("from", "to"), type=("type_from", "type_to"))
    return found.withColumn("type", F.nullif("type", F.lit("")))


def markup(files: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """path, name (`<tag>`), line_no of the first element of each tag that has a closing tag, in .tsx files."""
    tokens = parsed(files, "opening", leaves=OF_MARKUP) if tokens is None else tokens
    return tokens.filter("kind = 'opening'").groupBy("path", F.concat(F.lit("<"), "text", F.lit(">")).alias("name")).agg(F.min("line_no").alias("line_no"))
