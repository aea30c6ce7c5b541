"""Best-fit packing into sequences of several permitted lengths (operator 6).

What matters to a packing is how many pieces there are of each length, and lengths are bounded by the largest
sequence. So documents are cut into pieces of at most that length, the pieces are counted by length with map-side
aggregation, and the driver plans on that histogram, whose size is bounded by the sequence length and not by the
corpus. The plan is a list of patterns: a multiset of lengths, a sequence length, and how many bins are filled so.

A bin starts with the longest length that is left. For each permitted sequence length it is filled with the best
fit, the longest left that the room takes, again and again; the sequence length of the least cost per token opens.
As many bins are opened by the pattern as the histogram allows. Each pattern uses up a length or leaves less than half
of what a bin took of it, so a length limits the pattern at most as often as its first count in a bin can be halved. At the end each bin is downsized to the least permitted length that holds its contents.

Pieces get their ranks within their length from counts per length and salt, so that no length, however frequent, is
ranked in one task. The plan is broadcast as sorted ranges of ranks, in which a piece's place is found by bisection. Its size is
bounded by the largest capacity C alone: a length L limits at most 2 + log2(C / L) patterns, so there are fewer than
3.5 C of them, and a pattern has no more different lengths than sum to C.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treequarry.llm import token_counts
from treequarry.llm.common import checkpointed

CAPACITIES = (1024, 2048, 4096, 8192)
#: What opening a bin costs beside its length, in tokens.
BIN_COST = 64


@dataclass(frozen=True)
class Pattern:
    """`bins` bins of `capacity`, each with `counts[length]` pieces of each length."""

    capacity: int
    bins: int
    counts: dict[int, int]

    @property
    def used(self) -> int:
        return sum(length * n for length, n in self.counts.items())


def fill(capacity: int, lengths: list[int], left: dict[int, int]) -> dict[int, int]:
    """The longest length first, then the best fit until nothing fits."""
    room, counts = capacity, {}
    limit = len(lengths)
    while limit and room:
        limit = bisect_right(lengths, room, 0, limit)
        if not limit:
            break
        length = lengths[limit - 1]
        n = min(room // length, left[length])
        counts[length] = n
        room -= n * length
        limit -= 1
    return counts


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST) -> list[Pattern]:
    """Patterns that use up the histogram of lengths, each from 1 to the largest capacity."""
    capacities = tuple(sorted(set(capacities)))
    if any(not 0 < length <= capacities[-1] for length in histogram):
        raise ValueError("lengths must lie between 1 and the largest capacity")
    left = {length: n for length, n in histogram.items() if n > 0}
    lengths: list[int] = []
    for length in left:
        insort(lengths, length)
    patterns = []
    while lengths:
        best = None
        for capacity in capacities[bisect_right(capacities, lengths[-1] - 1) :]:
            counts = fill(capacity, lengths, left)
            cost = (capacity + bin_cost) / sum(length * n for length, n in counts.items())
            if best is None or cost < best[0]:
                best = cost, counts
        counts = best[1]
        bins = min(left[length] // n for length, n in counts.items())
        used = sum(length * n for length, n in counts.items())
        patterns.append(Pattern(next(c for c in capacities if c >= used), bins, counts))
        for length, n in counts.items():
            left[length] -= bins * n
            if not left[length]:
                del left[length], lengths[bisect_right(lengths, length) - 1]
    return patterns


def ranges(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int, int]]:
    """For each pattern and length: length, ranks [low, high), pieces per bin, the first bin, capacity, the first offset."""
    rows, taken, first = [], {}, 0
    for p in patterns:
        offset = 0
        for length, n in sorted(p.counts.items(), reverse=True):
            low = taken.get(length, 0)
            taken[length] = low + n * p.bins
            rows.append((length, low, taken[length], n, first, p.capacity, offset))
            offset += n * length
        first += p.bins
    return rows


def pieces_of(documents: DataFrame, length: str, largest: int) -> DataFrame:
    """The rows cut into pieces of at most `largest`: with piece (from 0), piece_start and piece_length. Rows of length 0 go."""
    n = F.ceil(F.col(length) / F.lit(largest)).cast("long")
    cut = documents.filter(F.col(length) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    return cut.withColumn("piece_start", F.col("piece") * largest).withColumn("piece_length", F.least(F.col(length) - F.col("piece_start"), F.lit(largest)).cast("long"))


class Places:
    """The ranges of a plan in order of length and rank, for look-ups of many pieces at once."""

    def __init__(self, rows: list[tuple[int, int, int, int, int, int, int]]):
        self.table = np.array(sorted(rows), np.int64).reshape(-1, 7)
        lengths = self.table[:, 0]
        self.first = np.searchsorted(lengths, np.arange((lengths[-1] if len(lengths) else 0) + 2))

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
        """bin_id, bin_capacity and bin_offset of pieces of these lengths and ranks."""
        row = np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(part):
                a, b = self.first[length[part[0]]], self.first[length[part[0]] + 1]
                row[part] = a + np.searchsorted(self.table[a:b, 1], rank[part], side="right") - 1
        _, low, _, per_bin, first_bin, capacity, offset = self.table[row].T
        at = rank - low
        return pd.DataFrame({"bin_id": first_bin + at // per_bin, "bin_capacity": capacity, "bin_offset": offset + at % per_bin * length})


def pack(pieces: DataFrame, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST, salt_rows: int = 200_000) -> DataFrame:
    """Rows with doc_id, piece and piece_length get bin_id, bin_capacity and bin_offset; every row goes to one bin.

    Rows that repeat are different pieces. An empty table gives an empty result. All other columns come back as they were,
    whatever their names; columns of the results' names are replaced.
    """
    spark = pieces.sparkSession
    # the row travels as one column, so no name of it meets one of these
    own = [c for c in pieces.columns if c not in ("bin_id", "bin_capacity", "bin_offset")]
    pieces = pieces.select(F.struct(*own).alias("row"), "doc_id", "piece", "piece_length")
    total = pieces.groupBy("piece_length").count().collect()  # no more rows than the largest capacity
    histogram = {r["piece_length"]: r["count"] for r in total}
    salts = max(8, -(-max(histogram.values(), default=1) // salt_rows))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("piece_length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("piece_length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("piece_length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("piece_length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank_in", F.row_number().over(within) - 1).join(starts, ["piece_length", "salt"]).withColumn("rank", F.col("base") + F.col("rank_in"))
    places = spark.sparkContext.broadcast(Places(ranges(plan(histogram, capacities, bin_cost))))

    @F.pandas_udf("bin_id long, bin_capacity long, bin_offset long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for length, rank in batches:
            yield places.value(length.to_numpy(np.int64), rank.to_numpy(np.int64))

    return ranked.withColumn("place", place("piece_length", "rank")).select("row.*", "place.*")


def packed_documents(documents: DataFrame, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST, tokenizer: str = token_counts.TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, piece, piece_start, piece_length, bin_id, bin_capacity, bin_offset.

    A document's length is its tokens and one end token, so a null or empty text is a piece of length 1. Documents
    longer than the largest capacity are cut into pieces; nothing is dropped. Repeated rows are packed each for
    itself. Pieces of equal length are alike to the plan; ties go by doc_id and piece. An empty table gives an empty
    result. Columns beside doc_id and text play no part.
    """
    counted = token_counts.token_counts(documents, tokenizer).select("doc_id", (F.col("n_tokens") + 1).alias("length"))
    pieces = pieces_of(checkpointed(counted), "length", max(capacities)).select("doc_id", "piece", "piece_start", "piece_length")
    return pack(pieces, capacities, bin_cost)
