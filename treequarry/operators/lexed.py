"""Sources as rows of tokens, with their brackets matched: what the parsers of `typescript`, `golang`, `zig` and of style sheets stand on.

A file is cut into tokens, which become rows. Brackets are matched by a stack in the task that cuts the file, which also
tells of each token what stands beside and around it; what asks further is filtered first, then goes through window functions. Braces in strings, comments, templates and
expressions of markup are parts of their tokens, or belong to their own level, and do not count.

Files have path and content. Null contents have no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from treequarry.session import small_batches

OPEN, CLOSE = ["(", "[", "{", "${"], [")", "]", "}"]
WORD = r"[\p{L}_$][\p{L}\p{N}_$]*"
#: Patterns of all tokens, in Java's syntax; what none of them takes is a sign of one character.
PATTERNS = {
    "go": rf"""\s+|//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|"(?:[^"\\\n]|\\.)*"?|`[^`]*`?|'(?:[^'\\\n]|\\.)*'?|{WORD}|\d[\w.]*|\.\.\.|:=|<-|(?s:.)""",
    "css": r"""\s+|/\*(?s:.*?)(?:\*/|\z)|"(?:[^"\\\n]|\\(?s:.))*"?|'(?:[^'\\\n]|\\(?s:.))*'?|(?i:url)\(\s*[^\s"'()][^"'()]*\)|\\(?s:.)|[^\s{};"'/\\]+|(?s:.)""",
    "zig": rf"""\s+|//[^\n]*|\\\\[^\n]*|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|@?{WORD}|@"(?:[^"\\\n]|\\.)*"?|\d\w*|=>|(?s:.)""",
}


def kind_of(text: Column) -> Column:
    """space, comment, string, word, number or sign, by how a token begins."""
    begins = lambda *signs: text.rlike("^(?:" + "|".join(signs) + ")")
    return F.when(begins(r"\s"), "space").when(begins("//", r"/\*"), "comment").when(begins('"', "'", "`", '@"', r"\\\\"), "string").when(begins(rf"@?{WORD}"), "word").when(begins(r"\d"), "number").otherwise("sign")


def _rows(cut: DataFrame) -> DataFrame:
    """Rows (path, at, text, kind) with line_no, end_line and offsets (start, stop) in characters."""
    so_far = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = cut.withColumn("stop", F.sum(F.length("text")).over(so_far)).withColumn("end_line", 1 + F.sum(breaks).over(so_far))
    return rows.select("path", F.col("at").cast("long"), "text", "kind", (F.col("end_line") - breaks).cast("long").alias("line_no"), F.col("end_line").cast("long"), (F.col("stop") - F.length("text")).cast("long").alias("start"), F.col("stop").cast("long"))


def tokens(files: DataFrame, language: str) -> DataFrame:
    """path, at, text, kind, line_no, end_line, start, stop of all tokens, white space and comments among them."""
    if language == "typescript":
        return _rows(files.filter("content is not null").select("path", "content").mapInPandas(_lexed, "path string, at long, text string, kind string"))
    cut = files.filter("content is not null").select("path", F.posexplode(F.regexp_extract_all("content", F.lit(PATTERNS[language]), 0)).alias("at", "text"))
    return _rows(cut.withColumn("kind", kind_of(F.col("text"))))


#: What is told of a token beside another one, of a bracket's partner, and of the bracket around.
BESIDE = pa.struct({"text": pa.string(), "kind": pa.string(), "line_no": pa.int64(), "at": pa.int64(), "end_line": pa.int64(), "stop": pa.int64(), "partner_line": pa.int64()})
PARTNER = pa.struct({"at": pa.int64(), "line_no": pa.int64(), "start": pa.int64(), "stop": pa.int64(), "after": BESIDE})
INSIDE = pa.struct({"at": pa.int64(), "text": pa.string(), "before": BESIDE, "partner_line": pa.int64()})
#: The columns of `nested`.
NESTED = pa.schema(
    {"path": pa.string(), "at": pa.int64(), "text": pa.string(), "kind": pa.string()}
    | dict.fromkeys(("line_no", "end_line", "start", "stop", "level", "nth"), pa.int64())
    | dict.fromkeys(("opens", "closes"), pa.bool_())
    | dict.fromkeys(("earlier", "before", "after", "ahead2", "ahead3", "ahead4"), BESIDE)
    | {"partner": PARTNER, "before_partner": pa.struct({"before": BESIDE, "earlier": BESIDE}), "inside": INSIDE, "final": pa.struct({"end_line": pa.int64(), "stop": pa.int64()})}
)
#: What `following` tells of a token, unless asked for other columns.
FOUND = ("at", "line_no", "start", "stop", "partner")
#: Pieces of files that a task holds before it hands them on; one file stays whole.
HELD = 50_000
#: Of pieces these are no tokens.
BLANK = ("space", "comment")
#: Where a token stands from the one that tells of it.
PLACES = {"earlier": -2, "before": -1, "after": 1, "ahead2": 2, "ahead3": 3, "ahead4": 4}


def _kind(text: str) -> str:
    """As `kind_of`, by the first characters."""
    first = text[0]
    if first in " \t\n\x0b\f\r":
        return "space"
    if first == "/" and text[1:2] in ("/", "*"):
        return "comment"
    if first in "\"'`" or text[:2] in ('@"', "\\\\"):
        return "string"
    if first.isalpha() or first in "_$" or (first == "@" and (text[1:2].isalpha() or text[1:2] in ("_", "$"))):
        return "word"
    return "number" if "0" <= first <= "9" else "sign"


def _matched(brackets: list[int], opens: list[bool], files: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each bracket its partner, the bracket around it, and the innermost one open behind it, by a stack for each file; else -1."""
    partners, around, behind, stack, current = dict.fromkeys(brackets, -1), [], [], [], -1
    for n, opening, file in zip(brackets, opens, files, strict=True):
        if file != current:
            stack, current = [], file
        if not opening and stack:
            partners[n] = stack.pop()
            partners[partners[n]] = n
        around.append(stack[-1] if stack else -1)
        if opening:
            stack.append(n)
        behind.append(stack[-1] if stack else -1)
    return [partners[n] for n in brackets], around, behind


class Run:
    """The tokens of whole files without white space and comments, as arrays of one place a token: columns, places of others (-1: none), texts by code.

    counts: the pieces of each file; kinds: of each different piece. What a text says of itself is looked up once for each different one.
    """

    def __init__(self, counts: np.ndarray, pieces: pa.DictionaryArray, kinds: list[str], opening: list[str], closing: list[str]) -> None:
        own, codes = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        of = lambda values, kind: np.array(values, dtype=kind)[codes] if own else np.empty(0, kind)
        sums = lambda values: np.cumsum(values, dtype=np.int64)
        file = np.repeat(np.arange(len(counts)), counts)
        first_piece = (np.cumsum(counts) - counts)[file]

        def running(values: np.ndarray) -> np.ndarray:
            """The sum within a file up to each piece."""
            total = np.append(0, sums(values))
            return total[1:] - total[first_piece]

        length, breaks = of([len(t) for t in own], np.int64), of([t.count("\n") for t in own], np.int64)
        solid = np.flatnonzero(~of([k in BLANK for k in kinds], bool))
        stop, end_line = running(length), 1 + running(breaks)
        columns = {"at": np.arange(len(codes)) - first_piece, "line_no": end_line - breaks, "end_line": end_line, "start": stop - length, "stop": stop}
        opens = of([k == "sign" and t in opening for k, t in zip(kinds, own, strict=True)], bool)
        closes = of([k == "sign" and t in closing for k, t in zip(kinds, own, strict=True)], bool)
        columns["level"] = running(opens.astype(np.int64) - closes) - opens
        columns = {name: values[solid] for name, values in columns.items()} | {"opens": opens[solid], "closes": closes[solid]}
        file, here = file[solid], np.arange(len(solid))
        size = np.bincount(file, minlength=len(counts))
        first = (np.cumsum(size) - size)[file]
        last, level = first + size[file] - 1, columns["level"]
        columns["nth"] = here - first + 1
        # between two brackets the same one is around
        brackets = np.flatnonzero(columns["opens"] | columns["closes"])
        partners, around, behind = _matched(brackets.tolist(), columns["opens"][brackets].tolist(), file[brackets].tolist())
        partner, inside = np.full(len(here), -1), np.full(len(here), -1)
        partner[brackets] = partners
        before = np.searchsorted(brackets, here) - 1
        known = np.flatnonzero((before >= 0) & (file[brackets[before]] == file)) if len(brackets) else brackets
        inside[known] = np.array(behind, dtype=np.int64)[before[known]] if len(brackets) else -1
        inside[brackets] = around
        inside[level <= 0] = -1
        held, outside = np.flatnonzero(inside >= 0), np.flatnonzero((inside < 0) & (level == 0))
        final_in, final_out = np.full(len(here), -1), np.full(len(counts), -1)
        final_in[inside[held]], final_out[file[outside]] = held, outside
        self.columns, self.file, self.here, self.first, self.last = columns, file, here, first, last
        self.partner, self.inside = partner, inside
        self.final = np.where(inside >= 0, final_in[inside], final_out[file]) if len(here) else inside
        self.texts, self.kinds, self.pieces, self.solid, self.codes = own, kinds, pieces, solid, codes[solid]
        self._order: tuple[np.ndarray, np.ndarray] | None = None
        self._place: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.here)

    def beside(self, gap: int) -> np.ndarray:
        """The places of the tokens so many further on, in the order of the file."""
        other = self.here + gap
        return np.where((other < self.first) | (other > self.last), -1, other)

    def are(self, *texts: str, kind: str = "") -> np.ndarray:
        """Whether a token has one of these texts, or any if none is given, and this kind."""
        return np.array([(not texts or t in texts) and kind in ("", k) for k, t in zip(self.kinds, self.texts, strict=True)], dtype=bool)[self.codes]

    def text(self, n: int) -> str | None:
        return self.texts[self.codes[n]] if n >= 0 else None

    def _grouped(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in an order that puts those with the same brackets around together, and the number of each one's group in that order."""
        if self._order is None:
            level = self.columns["level"]
            order = np.lexsort((level, self.inside, self.file))
            new = [np.diff(x[order]) != 0 for x in (level, self.inside, self.file)]
            self._order = order, np.append(0, np.cumsum(new[0] | new[1] | new[2])) if len(order) else order
        return self._order

    def following(self, wanted: np.ndarray) -> np.ndarray:
        """For each token the place of the first one wanted after it with the same brackets around."""
        order, group = self._grouped()
        n = len(order)
        at = np.where(wanted[order], np.arange(n), n)
        after = np.append(np.minimum.accumulate(at[::-1])[::-1][1:], n)[:n]
        same = after < n
        same[same] = group[after[same]] == group[same]
        out = np.full(n, -1)
        out[order[same]] = order[after[same]]
        return out

    def within(self, bracket: int) -> list[int]:
        """The places of the tokens right inside of a bracket, in order."""
        inner = bracket + 1
        if inner > self.last[bracket] or self.inside[inner] != bracket:
            return []
        order, group = self._grouped()
        if self._place is None:
            self._place = np.argsort(order)
        a = int(self._place[inner])
        return order[a : np.searchsorted(group, group[a], "right")].tolist()


def told(values: np.ndarray, places: np.ndarray, none: object = False) -> np.ndarray:
    """The values at some places, and `none` where there is no place."""
    return np.where(places >= 0, values[places], none) if len(values) else np.zeros(len(places), values.dtype)


def _nested_batch(paths: pa.Array, contents: pa.Array, run: Run, schema: pa.Schema, only: frozenset[str], top: bool) -> pa.RecordBatch:
    """The tokens of whole files in the columns of `nested`."""
    here, first, last, level = run.here, run.first, run.last, run.columns["level"]
    index = lambda values: pa.array(values, mask=values < 0)
    places = {name: pa.array(here + gap, mask=(here + gap < first) | (here + gap > last)) for name, gap in PLACES.items()}
    places |= {"partner": index(run.partner), "inside": index(run.inside), "final": index(run.final)}
    places["before_partner"] = places["partner"].take(places["before"])
    c = {name: pa.array(values) for name, values in run.columns.items()}
    c["path"], c["partner_line"] = paths.take(pa.array(run.file)), c["line_no"].take(places["partner"])
    each = run.pieces.indices.take(pa.array(run.solid))
    c["text"], c["kind"] = run.pieces.dictionary.take(each), pa.array(run.kinds, pa.string()).take(each)

    def told(kind: pa.StructType, of: pa.Array) -> pa.Array:
        parts = [told(f.type, places[f.name].take(of)) if pa.types.is_struct(f.type) else c[f.name].take(of) for f in kind]
        return pa.StructArray.from_arrays(parts, fields=list(kind), mask=of.is_null())

    wanted = np.full(len(here), True) if not only else np.array([k in only or t in only for k, t in zip(run.kinds, run.texts, strict=True)], dtype=bool)[run.codes]
    kept = pa.array(np.flatnonzero(wanted & (level == 0) if top else wanted))
    return pa.RecordBatch.from_arrays([told(f.type, places[f.name].take(kept)) if f.name in places else c[f.name].take(kept) for f in schema], schema=schema)


def _coded(sources: list[str], paths: list[str]) -> tuple[pa.DictionaryArray, list[str], list[int]]:
    """The tokens of TypeScript: each different (kind, text) once, the kinds of those, and how many tokens each file has."""
    seen: dict[tuple[str, str], int] = {}
    codes, counts = [], []
    for source, path in zip(sources, paths, strict=True):
        found = [seen.setdefault(piece, len(seen)) for piece in lex(source, path.endswith(".tsx"))]
        codes.append(np.array(found, dtype=np.int32))
        counts.append(len(found))
    indices = np.concatenate(codes) if codes else np.empty(0, np.int32)
    return pa.DictionaryArray.from_arrays(pa.array(indices), pa.array([t for _, t in seen], pa.string())), [k for k, _ in seen], counts


def _runs(language: str, opening: list[str], closing: list[str], make: Callable[[pa.Array, pa.Array, Run], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: of (path, content) in TypeScript, else of (path, content or null, pieces). A batch goes on in runs of whole files."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            # a token of TypeScript has about three characters
            sizes = np.array(pc.binary_length(lists).to_numpy(zero_copy_only=False) // 3 if language == "typescript" else lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            run = (np.cumsum(sizes) - sizes) // HELD
            edges = np.flatnonzero(np.diff(run)) + 1
            for a, b in zip([0, *edges], [*edges, len(sizes)], strict=True):
                paths, contents, own = (x.slice(a, b - a) for x in (batch.column(0), batch.column(1), lists))
                if language == "typescript":
                    pieces, kinds, counts = _coded(own.to_pylist(), paths.to_pylist())
                else:
                    pieces, counts = own.flatten().dictionary_encode(), sizes[a:b]
                    kinds = [_kind(text) for text in pieces.dictionary.to_pylist()]
                if len(pieces):
                    yield make(paths, contents, Run(np.array(counts, dtype=np.int64), pieces, kinds, opening, closing))

    return of


def _pieces(files: DataFrame, language: str, with_content: bool = False) -> DataFrame:
    """path, content, and its pieces for languages that the JVM cuts; the content is null where it is not asked for."""
    small_batches(files.sparkSession)
    own = files.filter("content is not null")
    if language == "typescript":
        return own.select("path", "content")
    content = F.col("content") if with_content else F.lit(None).cast("string").alias("content")
    return own.select("path", content, F.regexp_extract_all("content", F.lit(PATTERNS[language]), 0).alias("pieces"))


def made(files: DataFrame, language: str, make: Callable[[Run], dict[str, list]], schema: str, **spans: tuple[str, str]) -> DataFrame:
    """Rows that a function makes of the tokens of some whole files, in the task that reads them: columns of the schema, with `n`, a token of
    the row's file, which gives the path. spans: columns that hold the text between two offsets, which are columns that are made, without white space around; null where an offset is."""
    out = files.sparkSession.createDataFrame([], f"path string, {schema}").schema
    arrow = to_arrow_schema(out)

    def of(paths: pa.Array, contents: pa.Array, run: Run) -> pa.RecordBatch:
        found = make(run)
        file = [int(run.file[n]) for n in found["n"]]
        # a file's text is made once, not for each of its rows
        texts = {x: contents[x].as_py() for x in set(file)} if spans else {}
        for name, (a, b) in spans.items():
            found[name] = [texts[x][p:q].strip(" \t\r\n") if p is not None and q is not None else None for x, p, q in zip(file, found[a], found[b], strict=True)]
        columns = [paths.take(pa.array(file, pa.int64())), *(pa.array(found[f.name], f.type) for f in arrow if f.name != "path")]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    return _pieces(files, language, bool(spans)).mapInArrow(_runs(language, OPEN, CLOSE, of), out)


def _pruned(fields: Iterable[pa.Field], leaves: list[str], above: str = "") -> list[pa.Field]:
    """Fields of which only the leaves named stay, and the structs around them."""
    cut = [pa.field(f.name, pa.struct(_pruned(f.type, leaves, f"{above}{f.name}."))) if pa.types.is_struct(f.type) else f for f in fields]
    return [f for f in cut if (f.type.num_fields if pa.types.is_struct(f.type) else above + f.name in leaves)]


def nested(files: DataFrame, language: str, without: Sequence[str] = (), only: Iterable[str] = (), opening: list[str] = OPEN, closing: list[str] = CLOSE, top: bool = False, leaves: str = "") -> DataFrame:
    """Tokens of files without white space and comments, with what stands around them; no row leaves its task.

    level (brackets around the token), inside (the innermost of them, and the token before it), partner (of a bracket, with the token
    after it), before_partner (of the token before: what stands before its partner), earlier, before, after, ahead2 to ahead4 (the tokens around in the order of the file), nth (place among the rest), final
(end of the last token with the same bracket around). See `NESTED`, of which the columns `without` are left out, or all but
    the `leaves` (`text before.text`): what windows and shuffles carry along; and of the rows all but those whose kind or text is among `only`, if that is given, and with `top` those in brackets; places of files are as in `tokens`.
    """
    schema = pa.schema(_pruned(NESTED, leaves.split()) if leaves else [f for f in NESTED if f.name not in without])
    wanted = frozenset(only)
    make = lambda paths, contents, run: _nested_batch(paths, contents, run, schema, wanted, top)
    return _pieces(files, language).mapInArrow(_runs(language, opening, closing, make), from_arrow_schema(schema))


def following(rows: DataFrame, tell: Sequence[str] = FOUND, **wanted: Column) -> DataFrame:
    """For each token, of each kind wanted the first one after it with the same brackets around, as a struct of the columns to tell.

    Rows that neither ask nor are wanted can be left out before. A column of an earlier call can be told too: what follows what follows.
    """
    later = Window.partitionBy("path", "level", "inside.at").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("*", *(F.last(F.when(c, F.struct(*tell)), True).over(later).alias(name) for name, c in wanted.items()))


def _cut(spans: int) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """Of each content a list of texts for each row, between pairs of offsets, without white space around; null where one is below zero."""

    def of(contents: pd.Series, offsets: pd.Series) -> pd.Series:
        out = []
        for content, flat in zip(contents, offsets, strict=True):
            flat = flat.tolist()
            texts = [content[a:b].strip(" \t\r\n") if a >= 0 and b >= 0 else None for a, b in zip(flat[::2], flat[1::2], strict=True)]
            out.append([texts[n : n + spans] for n in range(0, len(texts), spans)])
        return pd.Series(out)

    return of


def sliced(rows: DataFrame, files: DataFrame, **spans: tuple[Column, Column]) -> DataFrame:
    """Rows with texts of their files between two offsets, without white space around; null where an offset is null.

    A file meets all its rows at once, so that its text is copied and read once, however many they are. Texts are never broadcast.
    """
    small_batches(files.sparkSession)
    offset = lambda x: F.coalesce(x.cast("long"), F.lit(-1))
    pairs = F.array(*(offset(x) for span in spans.values() for x in span))
    packed = rows.groupBy("path").agg(F.collect_list(F.struct(F.struct(*rows.columns).alias("row"), pairs.alias("pairs"))).alias("all"))
    cut = F.pandas_udf(_cut(len(spans)), "array<array<string>>")
    # sizes of texts are not known before they are made, and Spark would take them for small
    texts = packed.join(files.select("path", "content").hint("merge"), "path").select(F.arrays_zip(F.col("all.row").alias("row"), cut("content", F.flatten("all.pairs")).alias("texts")).alias("z"))
    return texts.select(F.inline("z")).select("row.*", *(F.col("texts")[k].alias(name) for k, name in enumerate(spans)))


#: White space, comments, strings, numbers, words and signs of TypeScript.
CODE = re.compile(r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|(?P<number>\d[\w.]*)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<sign>=>|\.\.\.|\?\.|\?\?|[=!]==?|<=|&&|\|\||\+\+|--|(?s:.))""")
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))+")
TAG = re.compile(r"(?P<space>\s+)|(?P<string>\"[^\"]*\"?|'[^']*'?)|(?P<word>[^\s\"'<>/={}]+)|(?P<jsx>/>|(?s:.))")
CHILDREN = re.compile(r"[^<{]+")
#: Markup begins where an operand may stand; a name and a comma, or `extends`, are type parameters.
MARKUP = re.compile(r"<(?:>|[^\W\d](?![\w$]*\s*(?:,|extends\b)))")
#: After these words an operand follows, after other words and closing brackets an operator.
BEFORE_OPERAND = "return typeof case in of delete void throw new else do await yield default instanceof".split()


def lex(source: str, markup: bool) -> Iterator[tuple[str, str]]:
    """(kind, text) of all tokens of TypeScript, with a stack of modes: code, template, tag and children of markup.

    Names of opening tags are `opening`, those of tags that close themselves `alone`, other parts of markup `jsx`.
    """
    out: list[list[str]] = []
    modes, braces, names = ["code"], [0], []
    at, operand = 0, True
    while at < len(source):
        mode, sign = modes[-1], source[at]
        if mode == "template":
            text = m[0] if (m := TEMPLATE.match(source, at)) else "${" if sign == "$" else sign
            out.append(["sign" if text == "${" else "template", text])
            if text == "${":
                modes.append("code")
                braces.append(0)
                operand = True
            elif not m:
                modes.pop()
                operand = False
        elif mode == "children":
            if m := CHILDREN.match(source, at):
                text = m[0]
                out.append(["jsx", text])
            else:
                text = "</" if source.startswith("</", at) else sign
                out.append(["sign" if text == "{" else "jsx", text])
                modes.append("code" if text == "{" else "closing" if text == "</" else "tag")
                braces.append(0)
                operand = True
                names.append(None)
        elif mode in ("tag", "closing"):
            m = TAG.match(source, at)
            kind, text = m.lastgroup, m[0]
            if kind == "word":
                kind = "jsx"
                if names[-1] is None and mode == "tag":
                    names[-1], kind = len(out), "alone"
            if text == "{":
                kind = "sign"
            out.append([kind, text])
            if text == "{":
                modes.append("code")
                braces.append(0)
                names.append(None)
                operand = True
            elif text in (">", "/>"):
                name = names.pop()
                modes.pop()
                braces.pop()
                if mode == "tag" and text == ">":
                    if name is not None and re.fullmatch(r"[\w$]+", out[name][1]):
                        out[name][0] = "opening"
                    modes.append("children")
                    braces.append(0)
                elif mode == "closing" and modes[-1] == "children":
                    modes.pop()
                    braces.pop()
                operand = False
        else:
            if sign == "/" and operand and (m := REGEX.match(source, at)):
                kind, text = "regex", m[0]
            elif sign == "<" and markup and operand and MARKUP.match(source, at):
                kind, text = "jsx", "<"
                modes.append("tag")
                braces.append(0)
                names.append(None)
            elif sign == "`":
                kind, text = "template", sign
                modes.append("template")
                braces.append(0)
            else:
                m = CODE.match(source, at)
                kind, text = m.lastgroup, m[0]
            out.append([kind, text])
            if kind == "sign" and text == "{":
                braces[-1] += 1
            elif kind == "sign" and text == "}":
                if braces[-1] == 0 and len(modes) > 1:
                    modes.pop()
                    braces.pop()
                    if modes[-1] != "template" and names:
                        names.pop()
                else:
                    braces[-1] = max(0, braces[-1] - 1)
            if kind not in ("space", "comment"):
                operand = text in BEFORE_OPERAND if kind == "word" else kind == "sign" and text not in (")", "]", "}", "++", "--")
        at += len(text)
        if mode == "template" and text == "`":
            braces.pop()
    return map(tuple, out)


def _lexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens of each file; markup is looked for in files of its own extension."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            found = list(lex(content, path.endswith(".tsx")))
            yield pd.DataFrame({"path": path, "at": range(len(found)), "text": [t for _, t in found], "kind": [k for k, _ in found]})
