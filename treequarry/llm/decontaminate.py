"""Benchmark decontamination by Wu-Manber search over words (operator 4).

Patterns are windows of consecutive item words. They are grouped by length: those of the full window, and those of
items too short for one. For each length m there is a shift table over blocks of two words (of one word where m is
1): how far the search may jump when the block ends at the current word. A block that ends no pattern jumps; one
that does selects the patterns of its bucket, keyed by the hash of the pattern's last words, and their words are
compared directly.

Spark cuts the items into windows and deals pairs of window and item by hash into blocks of about `block_windows`,
which are broadcast one after another, so what the driver and a worker hold is bounded however large the benchmark or
an item is. With one block, its findings stand beside the documents at once; with several, each pass leaves only the
hit stretches and items of texts with hits, by a hash of the text, and these meet the documents at the end. Pairs of
documents and windows are never kept.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treequarry.llm.common import checkpointed, small_batches, with_text

#: Over UTF-8 bytes: every byte from 0x80 up is a word character, as is every code point outside ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
Windows = dict[tuple[bytes, ...], set[str]]


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8").lower())


def windows_of(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    """The windows of an item; one of all its words if they are fewer, none of none."""
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


class WuManber:
    """Patterns of one length in words."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.m = len(patterns[0])
        self.block = min(2, self.m)
        self.most = self.m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for p in patterns:
            for end in range(self.block, self.m + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.most), self.m - end)
            self.bucket[hash(p[-self.block :])].append(p)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """Positions of first words, with the pattern that occurs there."""
        m, block, most, shift, bucket = self.m, self.block, self.most, self.shift.get, self.bucket
        at, n = m - 1, len(words)
        while at < n:
            key = tuple(words[at - block + 1 : at + 1])
            jump = shift(key, most)
            if jump:
                at += jump
                continue
            found = tuple(words[at - m + 1 : at + 1])
            for p in bucket.get(hash(key), ()):
                if p == found:
                    yield at - m + 1, p
                    break
            at += 1


class Matcher:
    """A block of windows with their items."""

    def __init__(self, windows: Windows):
        self.items = windows
        by_length = defaultdict(list)
        for w in windows:
            by_length[len(w)].append(w)
        self.searches = [WuManber(p) for _, p in sorted(by_length.items())]

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches [start, end) of the words, and the items whose windows occur."""
        spans, items = [], set()
        for search in self.searches:
            for start, window in search.search(words):
                spans.append((start, start + search.m))
                items |= self.items[window]
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(window, item), each pair once: the words of a window joined by spaces."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[b" ".join(w).decode() for w in windows_of(words_of(t), width)] for t in texts], dtype=object)

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").filter(F.col("text").isNotNull())
    return rows.select("item", F.explode(cut("text")).alias("window")).select("window", "item").distinct()


def pattern_blocks(benchmark: DataFrame, width: int, block_windows: int) -> list[DataFrame]:
    """The windows of a benchmark in blocks; none if it has no window."""
    table = checkpointed(item_windows(benchmark, width))
    blocks = -(-table.count() // block_windows)
    return [table.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k) for k in range(blocks)]


def windows_in(block: DataFrame) -> Windows:
    found: Windows = {}
    for row in block.toLocalIterator():
        found.setdefault(tuple(row["window"].encode().split(b" ")), set()).add(row["item"])
    return found


FOUND = "struct<n_words:bigint,starts:array<bigint>,ends:array<bigint>,items:array<string>>"
COLUMNS = ["n_words", "starts", "ends", "items"]
#: The last block of windows that this worker has seen, and its matcher.
_built: list[tuple[Windows, Matcher]] = []


def _matcher(windows: Windows) -> Matcher:
    if not _built or _built[0][0] is not windows:
        _built[:] = [(windows, Matcher(windows))]
    return _built[0][1]


def search_column(table):
    """A Pandas UDF of a text: what a broadcast block of windows finds in it."""

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        match = _matcher(table.value)
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                spans, own = match(words)
                spans = merged(spans)
                rows.append((len(words), [a for a, _ in spans], [b for _, b in spans], sorted(own)))
            yield pd.DataFrame(rows, columns=COLUMNS)

    return search


def _gathered(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
    """What all blocks found in each text: `found` has a struct for each that found something, or is null."""
    rows = []
    for text, blocks in zip(texts, found, strict=True):
        blocks = list(blocks) if blocks is not None else []
        spans = merged([x for b in blocks for x in zip(b["starts"], b["ends"], strict=True)])
        rows.append((len(words_of(text)), [a for a, _ in spans], [b for _, b in spans], sorted({i for b in blocks for i in b["items"]})))
    return pd.DataFrame(rows, columns=COLUMNS)


def searched(documents: DataFrame, benchmark: DataFrame, width: int = 10, block_windows: int = 200_000) -> DataFrame:
    """(row, found): each document row as a struct, and what occurs in it."""
    with_text(documents)
    with_text(benchmark)
    spark = documents.sparkSession
    small_batches(spark)
    blocks = pattern_blocks(benchmark, width, block_windows)
    rows = documents.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    gathered = F.pandas_udf(_gathered, FOUND)
    if len(blocks) == 1:
        return rows.select("row", search_column(spark.sparkContext.broadcast(windows_in(blocks[0])))("text").alias("found"))
    keys = [F.xxhash64(F.lit(k), "text").alias(f"key{k}") for k in (1, 2)]
    parts = None
    for block in blocks:
        table = spark.sparkContext.broadcast(windows_in(block))
        part = documents.select(*keys, search_column(table)("text").alias("f")).filter(F.size("f.starts") > 0)
        part = checkpointed(part.dropDuplicates(["key1", "key2"]))
        table.unpersist()
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return rows.select("row", gathered("text", F.lit(None).cast(f"array<{FOUND}>")).alias("found"))
    all_found = parts.groupBy("key1", "key2").agg(F.collect_list("f").alias("f"))  # a row a block at most
    return rows.select("*", *keys).join(all_found, ["key1", "key2"], "left").select("row", gathered("text", "f").alias("found"))


def hits(documents: DataFrame, benchmark: DataFrame, width: int = 10, block_windows: int = 200_000) -> DataFrame:
    """The documents' rows and columns with a struct `found`: n_words, hit stretches (starts, ends, in words) and item ids.

    The stretches are disjoint and in order. Nulls, repeats and empty tables are as in `contamination`; a text of any
    length is searched whole, by one worker. An input column named found is replaced.
    """
    out = searched(documents, benchmark, width, block_windows)
    return out.select(*[F.col("row")[c].alias(c) for c in documents.columns if c != "found"], "found")


def uncontaminated(documents: DataFrame, benchmark: DataFrame, width: int = 10, block_windows: int = 200_000) -> DataFrame:
    """The documents' rows, with their columns whatever their names, in which no window occurs."""
    return searched(documents, benchmark, width, block_windows).filter(F.size("found.starts") == 0).select("row.*")


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = 10, block_windows: int = 200_000) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words, so no hit. Benchmark rows without text give no window; those without an id
    count under the empty id; several rows of one id are one item. Repeated documents each get their row. Without
    documents the result is empty, without a benchmark nothing is contaminated. Other columns play no part.
    """
    found = hits(documents.select("doc_id", "text"), benchmark, width, block_windows)
    n_hit = F.aggregate(F.arrays_zip(F.col("found.starts").alias("s"), F.col("found.ends").alias("e")), F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    out = found.select("doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
