"""SimHash near-duplicates by a byte-position inverted index with count filtering (operator 7).

A fingerprint has 64 bits in 8 bytes. Two fingerprints with at most k differing bits differ in at most k bytes, so
they share at least 8 - k bytes at their positions: that is the guaranteed minimum of matches. Posting lists of
single bytes would pair every fingerprint with a 256th of all others, so a list of the index stands for several
positions and the bytes there, one fewer than the minimum: a pair that reaches the minimum meets in a list, and none
is missed. Pairs in a list tally their shared bytes, those below the minimum are dropped, and the rest are verified
bit by bit.

Equal fingerprints are one entry of the index, however many documents have it. Lists are counted with map-side
aggregation, and only entries of lists with company are shuffled again. Long lists are cut into blocks of at most
`block` entries and every two blocks meet in a row of their own; a row gives the edges of a spanning forest, never
all its pairs. Joins on hot lists can be split by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treequarry.llm.common import checkpointed, small_batches, with_text
from treequarry.llm.components import connected_components

BYTES = 8
#: Parts among which the members of a component are dealt when they get its name.
SALTS = 32


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of unsigned hashes: the bits that more than half of them have; 0 without hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text, unsigned; 0 for a text without words."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z alone is lowered, ASCII white space alone splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)
    return majority(hashes)


def fingerprint_column(width: int, seed: int):
    """A Pandas UDF of a text: its fingerprint's bits as a long."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, width, seed) for t in texts], np.uint64).view(np.int64))

    return fingerprint


def _byte(x: Column, position: int) -> Column:
    return F.shiftrightunsigned(x, 8 * position).bitwiseAND(F.lit(255))


def _postings(nodes: DataFrame, places: int) -> DataFrame:
    """A row (list, fp) for each set of `places` byte positions. The list is the set's number and the bytes there."""
    keys = []
    for number, positions in enumerate(combinations(range(BYTES), places)):
        mask = sum(255 << (8 * p) for p in positions)
        masked = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))
        keys.append(F.struct(F.lit(number).cast("byte").alias("positions"), masked.alias("bytes")))
    return nodes.select("fp", F.explode(F.array(*keys)).alias("list")).select("fp", "list.*")


def forest(fps: np.ndarray, shared: int, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the fingerprints that share enough bytes and differ in few enough bits."""
    edges: list[tuple[int, int]] = []
    todo = np.ones(len(fps), bool)
    for root in range(len(fps)):
        if not todo[root]:
            continue
        todo[root], frontier = False, [root]
        while frontier:
            at = frontier.pop()
            rest = np.flatnonzero(todo)
            if not len(rest):
                return edges
            differ = fps[rest] ^ fps[at]
            tally = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            near = rest[(tally >= shared) & (np.bitwise_count(differ) <= bits)]
            todo[near] = False
            edges += [(at, int(x)) for x in near]
            frontier += near.tolist()
    return edges


def fingerprint_edges(nodes: DataFrame, bits: int = 4, block: int = 1024) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) whose components are those of all pairs within `bits` bits."""
    shared = BYTES - bits
    if not 0 < shared < BYTES:
        raise ValueError("the index needs 1 to 7 differing bits")
    postings = _postings(nodes, max(1, shared - 1))
    lists = postings.groupBy("positions", "bytes").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    lists = checkpointed(lists)
    differ = F.col("a").bitwiseXOR(F.col("b"))
    tally = sum((F.when(_byte(differ, p) == 0, 1).otherwise(0) for p in range(BYTES)), F.lit(0))
    pairs = lists.filter("n = 2").filter((tally >= shared) & (F.bit_count(differ) <= bits)).select("a", "b")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps in batch.column(0):
                values = fps.values.to_numpy(zero_copy_only=False)
                for x, y in forest(values.view(np.uint64), shared, bits):
                    a.append(values[x])
                    b.append(values[y])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    crowded = lists.filter("n > 2").select("positions", "bytes", F.ceil(F.col("n") / block).alias("blocks"))
    members = postings.join(crowded, ["positions", "bytes"]).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != F.col("own")))
    dealt = members.withColumn("other", F.explode(other)).groupBy("positions", "bytes", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    edges = dealt.agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(link, "a long, b long")
    return pairs.unionByName(edges)


def fingerprint_components(documents: DataFrame, width: int = 4, seed: int = 42, bits: int = 4) -> DataFrame:
    """One row per input row: doc_id, fp (a long), component_id."""
    with_text(documents)
    small_batches(documents.sparkSession)
    found = checkpointed(documents.select("doc_id", fingerprint_column(width, seed)("text").alias("fp")))
    # each entry becomes many postings, so the entries keep as many partitions as a shuffle has
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = checkpointed(found.groupBy("fp").agg(F.min("doc_id").alias("first")).repartition(parts, "fp"))
    roots = connected_components(fingerprint_edges(nodes.select("fp"), bits))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    # a component can be large, so its lowest doc_id is laid out under several salts, and its members are dealt among them
    linked = checkpointed(labelled.filter("root is not null").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS))))
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    component = linked.join(lowest, ["root", "salt"]).select("fp", "component_id")
    component = component.unionByName(labelled.filter("root is null").select("fp", F.col("first").alias("component_id")))
    return found.join(component, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(documents: DataFrame, width: int = 4, seed: int = 42, bits: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    A null or empty text has fingerprint zero and is linked like any other. Texts of fewer than `width` words have
    one shingle of them all. Repeated rows share fingerprint and component. A null doc_id never names a component
    that has another. An empty table gives an empty result; columns beside doc_id and text play no part.
    """
    found = fingerprint_components(documents, width, seed, bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
