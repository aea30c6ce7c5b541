"""Connected components of an edge table by alternating stars, each round a few shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treequarry.llm.common import checkpointed

#: Edges that a task joins at once.
CHUNK = 16_384


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _joined(edges: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The edges that close no circle with those before them, and an edge from the smallest node of each component to each other one."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kept = []
    for a, b in edges:
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept, [(top(x), x) for x in up if top(x) != x]


def spanning_edges(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The edges that close no circle with those before them."""
    return _joined(edges)[0]


def smallest_edges(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As many edges with the same components: (a, b) from the smallest node a of each to every other one."""
    return _joined(edges)[1]


def thinned(pairs: DataFrame, n_pairs: int, chunk: int = CHUNK, kept: Callable = spanning_edges) -> DataFrame:
    """Edges with the same components: each chunk of about `chunk` edges keeps a spanning forest, fewer than it has nodes.
    Up to `chunk` edges are one chunk."""

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []

        def rows() -> pa.RecordBatch:
            found = kept(edges)
            return pa.record_batch([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            edges += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(edges) >= chunk:
                yield rows()
                edges = []
        yield rows()

    return pairs.coalesce(max(1, -(-n_pairs // chunk))).mapInArrow(forests, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to rows (node, root): root is the smallest node of the component; one row per node with an edge.

    Edges become stars around their smallest nodes, chunk by chunk, as long as that halves them or leaves one chunk; so edges that close circles go, and a
    dense group costs little more than its nodes. Edges of one chunk are done with that. The others go in rounds: every node first
    hangs its larger neighbours on the smallest node it knows, then its smaller ones. Rounds grow with the logarithm of the longest
    chain of stars. Rows are pre-aggregated before they are shuffled, joins are keyed by node, and the edges of each round go to a
    reliable checkpoint.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    pairs = checkpointed(pairs)
    n, before = pairs.count(), None
    while before is None or before > CHUNK and (n <= CHUNK or 2 * n <= before):
        pairs = checkpointed(thinned(pairs, n, CHUNK, smallest_edges))
        n, before = pairs.count(), n
    seen = _signature(pairs) if before > CHUNK else (0,)
    while seen[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("low").alias("a"), "b").distinct()
        lowest = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(lowest, "b")
        pairs = small.select(F.col("low").alias("a"), "b").unionByName(small.select(F.col("low").alias("a"), F.col("a").alias("b"))).filter("a < b").distinct()
        pairs = checkpointed(pairs)
        now = _signature(pairs)
        if now == seen:
            break
        seen = now
    stars = pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
