"""Removal of passages that repeat, by hashing units of text (operator 5).

Lines alone would miss a passage that stands inside another paragraph. So a unit ends at a line end, and within a
line after `SHORTEST` words or more at a word that says so itself: one whose hash falls in one of `CUT` residues.
Equal passages are soon cut alike wherever they stand, apart from the words before their first common cut and after
their last.

A unit is normalised (lower case, single spaces) and hashed to 128 bits. The least (doc_id, unit) of each hash is
found by aggregation, which combines on the map side, and so the first occurrence in rank order stays. Later ones
are marked. Marked units that follow one another form a run; a run of `min_words` words or more goes, with its
offsets in the original text on record. Short lines that many documents share by chance or as a formula stay.

Rows carry hashes and positions, not text. Joins are keyed by hash or by document, so Spark can split hot ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treequarry.llm.common import checkpointed, small_batches, with_text

#: One word in so many may end a unit.
CUT = 6
#: Words of a unit, but for lines that have fewer.
SHORTEST = 5
WORD = re.compile(r"\S+")


@lru_cache(maxsize=1 << 18)
def ends_unit(word: str) -> bool:
    return crc32(word.encode()) % CUT == 0


def unit_words(text: str) -> list[list[str]]:
    """Normalised words of each unit; what is left at the end of a line, if short, goes with the unit before it."""
    units = []
    for line in text.lower().split("\n"):
        first, unit = len(units), []
        for word in line.split():
            unit.append(word)
            if len(unit) >= SHORTEST and ends_unit(word):
                units.append(unit)
                unit = []
        if unit and len(unit) < SHORTEST and len(units) > first:
            units[-1] = units[-1] + unit
        elif unit:
            units.append(unit)
    return units


def unit_spans(text: str, counts: list[int]) -> list[tuple[int, int]]:
    """Offsets [start, end) in the text of units of so many words."""
    words = [m.span() for m in WORD.finditer(text)]
    spans, at = [], 0
    for n in counts:
        spans.append((words[at][0], words[at + n - 1][1]))
        at += n
    return spans


def runs(counts: list[int], marked: set[int], min_words: int) -> list[tuple[int, int]]:
    """Stretches [first, last] of units to remove; counts: words of each unit."""
    out, first, words = [], 0, 0
    for i, n in enumerate([*counts, 0]):
        if i in marked:
            words += n
            continue
        if words >= min_words:
            out.append((first, i - 1))
        first, words = i + 1, 0
    return out


def removed_spans(text: str, marked: set[int], min_words: int) -> list[tuple[int, int]]:
    """Offsets [start, end) of what goes from a text whose units `marked` occur earlier."""
    counts = [len(u) for u in unit_words(text)]
    found = runs(counts, marked, min_words)
    if not found:
        return []
    spans = unit_spans(text, counts)
    return [(spans[a][0], spans[b][1]) for a, b in found]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; what then is white space at a cut becomes one line end if it has one, else a space."""
    if not spans:
        return text
    parts, at = [], 0
    for a, b in [*spans, (len(text), len(text))]:
        parts.append(text[at:a])
        at = b
    out = parts[0]
    for part in parts[1:]:
        left, right = out.rstrip(), part.lstrip()
        gap = out[len(left) :] + part[: len(part) - len(right)]
        out = left + ("\n" if "\n" in gap else " " if left and right else "") * bool(left and right) + right
    return out


def _units(documents: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), n (the unit's number), h1 and h2 (the unit's hash)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            doc, key, number, hashes = [], [], [], []
            for doc_id, text_key, text in zip(ids, keys, texts, strict=True):
                units = unit_words(text)
                doc += [doc_id] * len(units)
                key += [text_key] * len(units)
                number += range(len(units))
                hashes += [digest(" ".join(u)) for u in units]
            pair = pa.py_buffer(b"".join(hashes))
            both = pa.Array.from_buffers(pa.int64(), 2 * len(hashes), [None, pair]).to_numpy(zero_copy_only=False) if hashes else []
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(number, pa.int32()), pa.array(both[0::2], pa.int64()), pa.array(both[1::2], pa.int64())], names=["doc_id", "key", "n", "h1", "h2"])

    texts = documents.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return texts.mapInArrow(cut, "doc_id long, key long, n int, h1 long, h2 long")


def marks(documents: DataFrame) -> DataFrame:
    """(doc_id, key, marked): the numbers of a document's units that occur earlier, for documents that have some.

    A document is its doc_id and the hash of its text. Rank is doc_id (null last), that hash, the unit's number.
    """
    units = _units(documents)
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key", "n")
    first = units.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1")
    first = checkpointed(first.select("h1", "h2", F.col("first.doc_id").alias("first_id"), F.col("first.key").alias("first_key"), F.col("first.n").alias("first_n")))
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")) & (F.col("n") == F.col("first_n"))
    later = units.join(first, ["h1", "h2"]).filter(~same)
    return later.groupBy("doc_id", "key").agg(F.collect_set("n").alias("marked"))


def deduplicated(documents: DataFrame, min_words: int = 16) -> DataFrame:
    """The input's rows and columns with `text` cut, and a column `removed_spans`, an array of (start, end) in the original.

    Rows that repeat both doc_id and text share their fate: they count as one document. A null text stays null, and
    a null doc_id ranks last. An empty table gives an empty result. An input column named removed_spans is replaced.
    """
    with_text(documents)
    small_batches(documents.sparkSession)

    @F.pandas_udf("struct<text:string,spans:array<struct<start:bigint,end:bigint>>>")
    def cut(texts: pd.Series, marked: pd.Series) -> pd.DataFrame:
        rows = []
        for text, units in zip(texts, marked, strict=True):
            spans = removed_spans(text, set(units), min_words) if text is not None and units is not None else []
            rows.append((without(text, spans) if text is not None else None, [{"start": a, "end": b} for a, b in spans]))
        return pd.DataFrame(rows, columns=["text", "spans"])

    found = marks(documents).select(F.struct("doc_id", "key").alias("m"), "marked")
    row = documents.select(F.struct("*").alias("row"))
    on = F.col("row.doc_id").cast("long").eqNullSafe(F.col("m.doc_id")) & (F.xxhash64("row.text") == F.col("m.key"))
    out = row.join(found, on, "left").select("row", cut("row.text", "marked").alias("cut"))
    columns = [F.col("cut.text").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in documents.columns if c != "removed_spans"]
    return out.select(*columns, F.col("cut.spans").alias("removed_spans"))


def passages(documents: DataFrame, min_words: int = 16) -> DataFrame:
    """One row per input row: doc_id, text (cut), n_removed (passages), removed_chars, removed_spans ("start-end", comma-joined)."""
    out = deduplicated(documents.select("doc_id", "text"), min_words)
    chars = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    shown = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "text", F.size("removed_spans").cast("long").alias("n_removed"), chars.alias("removed_chars"), shown.alias("removed_spans"))
