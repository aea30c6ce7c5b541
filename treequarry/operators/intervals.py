"""Which ranges hold a point, as an equi join whose work follows points, ranges and matches, however many share a file.

A range of whole numbers is cut into dyadic blocks: of each width 2^k at most one at its left and one at its right end, and
none overlap. A point lies in one block of each width. So a range holds a point exactly where one of its blocks is one of the
point's, and a match is found once. A file of very many ranges is spread over the blocks that they have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks(start: Column, end: Column) -> Column:
    """The blocks of a range, both ends included, as an array of (width, block): the block times 2^width is its first number.

    An empty range (end before start), or one with a null end, has none.
    """
    a, b = start.cast("long"), end.cast("long") + 1
    down = lambda x, k: F.call_function("shiftright", x, k)
    ends = lambda k: (-down(-a, k), down(b, k))  # noqa: E731  up from the start, down from the end

    def of(k: Column) -> Column:
        left, right = ends(k)
        block = lambda wanted, n: F.when((left < right) & wanted, F.struct(k.cast("int").alias("width"), n.alias("block")))
        return F.array_compact(F.array(block(left.bitwiseAND(F.lit(1)) == 1, left), block(right.bitwiseAND(F.lit(1)) == 1, right - 1)))

    widths = F.sequence(F.lit(0), F.length(F.bin(F.greatest(b - a, F.lit(1).cast("long")))) - 1)
    return F.when(a < b, F.flatten(F.transform(widths, of)))


def held(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points joined with each range of the same key that holds them. Columns beside the key must have different names.

    points: key, `at`; ranges: key, `start`, `end`. Points outside of all ranges, and nulls, give no row.
    """
    cut = ranges.withColumn("_b", F.explode(blocks(F.col(start), F.col(end)))).select("*", F.col("_b.width").alias("_width"), F.col("_b.block").alias("_block")).drop("_b")
    widths = [r["_width"] for r in cut.select("_width").distinct().collect()]  # 63 at most
    if not widths:
        return points.join(ranges, key).limit(0)
    own = F.explode(F.array(*[F.struct(F.lit(w).alias("_width"), F.shiftright(F.col(at).cast("long"), w).alias("_block")) for w in sorted(widths)]))
    laid_out = points.withColumn("_b", own).select("*", F.col("_b._width").alias("_width"), F.col("_b._block").alias("_block")).drop("_b")
    # neither side is bounded, and what was parsed looks small before it is made: nothing here is broadcast
    return laid_out.join(cut.hint("merge"), [key, "_width", "_block"]).drop("_width", "_block")


def numbers(ranges: DataFrame, lines: DataFrame, key: str, start: str, end: str, line: str) -> DataFrame:
    """A row for each number of a range, as `line`; ranges are cut to the first and last line that their key has in `lines`."""
    size = lines.groupBy(key).agg(F.min(line).alias("_first"), F.max(line).alias("_last"))
    cut = ranges.join(size, key).withColumn("_first", F.greatest(F.col(start), "_first")).withColumn("_last", F.least(F.col(end), "_last")).filter("_first <= _last")
    return cut.withColumn(line, F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
