"""Ranges that hold points, against a plain search of all pairs."""

import random

from pyspark.sql import functions as F

from treequarry.operators import intervals, symbols


def test_blocks_cover_each_number_once(spark):
    pairs = [(a, b) for a in range(-3, 40) for b in range(a - 1, 45)] + [(7, 1 << 40), (0, (1 << 62) - 1), (None, 3), (3, None)]
    for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", intervals.blocks(F.col("a"), F.col("b")).alias("blocks")).collect():
        spans = sorted((x["block"] << x["width"], (x["block"] + 1 << x["width"]) - 1) for x in r["blocks"] or ())
        if r["a"] is None or r["b"] is None or r["a"] > r["b"]:
            assert not spans
        else:
            assert spans[0][0] == r["a"] and spans[-1][1] == r["b"] and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:], strict=False))
            assert len(spans) <= 2 * (r["b"] - r["a"] + 1).bit_length()


def test_held(spark):
    rng = random.Random(2)
    ranges = [("ab"[rng.randrange(2)], i, s := rng.randrange(60), s + rng.choice([-1, 0, 1, 5, 40])) for i in range(200)] + [("a", 999, None, 4), (None, 998, 0, 50)]
    points = [("abc"[rng.randrange(3)], rng.randrange(110)) for _ in range(150)] + [("a", None), (None, 3)]
    got = intervals.held(spark.createDataFrame(points, "key string, at long"), spark.createDataFrame(ranges, "key string, i long, s long, e long"), "key", "at", "s", "e")
    want = [(k, p, i, s, e) for k, p in points for r, i, s, e in ranges if k is not None and k == r and None not in (p, s, e) and s <= p <= e]
    assert sorted(tuple(r) for r in got.select("key", "at", "i", "s", "e").collect()) == sorted(want)
    nothing = spark.createDataFrame([], "key string, i long, s long, e long")
    assert intervals.held(spark.createDataFrame(points, "key string, at long"), nothing, "key", "at", "s", "e").count() == 0


def test_one_file_of_many_symbols(spark):
    """200 000 functions of one file, ten lines each, two classes around each hundred: work that pairs would make quadratic."""
    n = 200_000
    functions = spark.range(n).select(F.lit("f").alias("file"), F.concat(F.lit("m"), "id").alias("name"), (F.col("id") * 10 + 1).alias("line_start"), (F.col("id") * 10 + 10).alias("line_end"), F.col("id").alias("ordinal"), F.lit("Function").alias("kind"))
    classes = spark.range(n // 100).select(F.lit("f").alias("file"), F.concat(F.lit("C"), "id").alias("name"), (F.col("id") * 1000 + 1).alias("line_start"), (F.col("id") * 1000 + 1000).alias("line_end"))
    classes = classes.unionByName(classes.select("file", F.concat(F.lit("wide"), "name").alias("name"), "line_start", (F.col("line_end") + 5).alias("line_end")))
    owners = symbols.method_owners(functions, classes)
    assert owners.count() == n and owners.filter(F.col("owner") != F.concat(F.lit("C"), F.floor(F.col("ordinal") / 100))).count() == 0
    points = functions.select("file", (F.col("line_start") + 3).alias("line"))
    found = symbols.enclosing_symbol(points, functions)
    assert found.count() == n and found.filter(F.col("caller") != F.concat(F.lit("m"), ((F.col("line") - 4) / 10).cast("long"))).count() == 0
