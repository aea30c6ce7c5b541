"""The call graph: nodes and edges by function name, traces level by level, and what is reachable.

Edges stay a multigraph, names are global, and a trace goes through standard functions even where it leaves them out
afterwards. A level is one join of the frontier with the edges, keyed by name; the frontier is aggregated before it
meets what was seen, and each level goes to a reliable checkpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treequarry.functions.names import is_std
from treequarry.session import shared_root

#: Depths that the commands of the engine use.
REACHABLE, CALLERS, CONTEXT, DISCLOSE = 100, 10, 2, 5
#: A frontier of at most so many rows of two names is broadcast to the edges; a larger one meets them by shuffle.
BROADCAST_ROWS = 100_000


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the cluster names; local sessions without one get a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def nodes(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """name, file, line: defined functions by their first definition, and whatever else calls or is called.

    symbols: file, name, kind, line_start, ordinal; calls: caller (may be null), callee.
    """
    first = symbols.filter("kind = 'Function'").groupBy("name").agg(F.min(F.struct("file", "ordinal", "line_start")).alias("first"))
    named = calls.select(F.explode(F.array("caller", "callee")).alias("name")).filter("name is not null").distinct()
    return named.join(first, "name", "full").select("name", F.col("first.file").alias("file"), F.col("first.line_start").alias("line"))


def call_edges(calls: DataFrame) -> DataFrame:
    """src, dst of every call with a caller; repeated calls stay."""
    return calls.filter("caller is not null").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def trace(edges: DataFrame, seeds: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Breadth-first traces from many seeds at once.

    seeds: a column seed, the function to start from; or seed, a label, and name, the functions that start under it.
    Returns (seed, name, depth) without the start itself, and (seed, revisits): whether an edge scanned on the way led
    to something already seen, which is more than a cycle: diamonds and repeated edges count too. Seeds that are on no
    edge have no rows in the first and false in the second.

    Edges are counted, dealt by source and written once; a level joins them with the frontier and is written in turn.
    """
    named = seeds.select("seed", F.col("name") if "name" in seeds.columns else F.col("seed").alias("name")).distinct()
    frontier = checkpointed(named.select("seed", "name", F.lit(0).cast("long").alias("depth")))
    size = total = frontier.count()
    labels, seen, scanned = frontier.select("seed").distinct(), frontier, []
    if size and max_depth > 1:
        edges = checkpointed(edges.groupBy("src", "dst").agg(F.count("*").alias("times")))
    elif size:
        edges = edges.select("src", "dst", F.lit(1).cast("long").alias("times"))
    for depth in range(1, max_depth + 1):
        if not size:
            break
        near, known = (F.broadcast(t) if n <= BROADCAST_ROWS else t for t, n in ((frontier, size), (seen, total)))
        step = edges.join(near, F.col("src") == F.col("name")).groupBy("seed", F.col("dst").alias("name")).agg(F.sum("times").alias("times"))
        step = checkpointed(step.join(known.select("seed", "name", F.lit(True).alias("old")), ["seed", "name"], "left"))
        scanned.append(step.groupBy("seed").agg((F.sum("times") > F.count(F.when(F.col("old").isNull(), 1))).alias("again")))
        frontier = step.filter("old is null").select("seed", "name", F.lit(depth).cast("long").alias("depth"))
        size = frontier.count()
        total, seen = total + size, seen.unionByName(frontier)
    again = scanned[0] if scanned else labels.select("seed", F.lit(False).alias("again"))
    for more in scanned[1:]:
        again = again.unionByName(more)
    flags = labels.join(again.groupBy("seed").agg(F.bool_or("again").alias("again")), "seed", "left").select("seed", F.coalesce("again", F.lit(False)).alias("revisits"))
    return seen.filter("depth > 0"), flags


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(seed, name, depth) of what seeds reach within so many steps, each at its least depth and without the start itself: the
    levels of `trace` without its flag. Seeds are given as there.

    Seeds are numbered, and up to 64 of them share a row of a node: a mask with a bit for each. What is seen is one table with
    a row for a node and 64 seeds; a level is merged into it by one aggregation, which combines on the map side, and written.
    """
    named = seeds.select("seed", F.col("name") if "name" in seeds.columns else F.col("seed").alias("name")).distinct()
    labels = checkpointed(named.select("seed").distinct().select("seed", F.monotonically_increasing_id().alias("id")))
    labels = labels.select("seed", F.shiftright("id", 6).alias("block"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bit"))
    start = named.join(labels, "seed").groupBy("block", "name").agg(F.bit_or("bit").alias("mask"))
    none = F.lit(0).cast("long")
    seen = checkpointed(start.select("block", "name", "mask", F.col("mask").alias("fresh")))
    levels = []
    if max_depth > 1:
        edges = checkpointed(edges.select("src", "dst"))
    for depth in range(1, max_depth + 1):
        frontier = seen.filter("fresh <> 0").select("block", "name", F.col("fresh").alias("bits"))
        size = frontier.count()
        if not size:
            break
        near = F.broadcast(frontier) if size <= BROADCAST_ROWS else frontier
        came = edges.join(near, F.col("src") == F.col("name")).select("block", F.col("dst").alias("name"), none.alias("old"), F.col("bits").alias("new"))
        both = seen.select("block", "name", F.col("mask").alias("old"), none.alias("new")).unionByName(came)
        merged = both.groupBy("block", "name").agg(F.bit_or("old").alias("old"), F.bit_or("new").alias("new"))
        seen = checkpointed(merged.select("block", "name", F.expr("old | new").alias("mask"), F.expr("new & ~old").alias("fresh")))
        levels.append(seen.filter("fresh <> 0").select("block", "name", F.lit(depth).cast("long").alias("depth"), F.col("fresh").alias("mask")))
    rows = reduce(DataFrame.unionByName, levels) if levels else seen.limit(0).select("block", "name", none.alias("depth"), "mask")
    held = labels.groupBy("block").agg(F.collect_list(F.struct("seed", "bit")).alias("members"))  # 64 at most
    held = F.broadcast(held) if held.count() * 64 <= BROADCAST_ROWS else held
    each = rows.join(held, "block").select("name", "depth", "mask", F.inline("members"))
    return each.filter(F.col("mask").bitwiseAND(F.col("bit")) != 0).select("seed", "name", "depth")


def without_std(levels: DataFrame, std: Column | None = None) -> DataFrame:
    """Levels without standard functions; levels that become empty close up."""
    std = is_std(F.col("name")) if std is None else std
    order = Window.partitionBy("seed").orderBy("depth")
    return levels.filter(~std).withColumn("depth", F.dense_rank().over(order).cast("long"))


def edges_without_std(edges: DataFrame) -> DataFrame:
    """The graph without standard functions and every edge at one."""
    return edges.filter(~is_std(F.col("src")) & ~is_std(F.col("dst")))


def neighbours(edges: DataFrame, name: str, callers: bool = False) -> DataFrame:
    """Callees, or callers, one step away; as often as there are calls."""
    here, there = ("dst", "src") if callers else ("src", "dst")
    return edges.filter(F.col(here) == name).select(F.col(there).alias("name"))


def stats(edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges"""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct().agg(F.count("*").alias("n_nodes"))
    return edges.agg(F.count("*").alias("n_edges")).crossJoin(ends).select("n_nodes", "n_edges")


def files_of(names: DataFrame, located: DataFrame) -> DataFrame:
    """Distinct files of names; located: name, file."""
    return located.join(names.select("name").distinct(), "name", "left_semi").select("file").filter("file is not null").distinct()


def reachable_files(edges: DataFrame, located: DataFrame, start: str, depth: int = REACHABLE) -> DataFrame:
    """Files of what start reaches; its own only if another function in it is reached."""
    seeds = edges.sparkSession.createDataFrame([(start,)], "seed string")
    return files_of(reach(edges, seeds, depth), located)


def unreachable_files(edges: DataFrame, located: DataFrame, start: str, depth: int = REACHABLE) -> DataFrame:
    """All other files; with an unknown start, all."""
    return located.select("file").filter("file is not null").distinct().join(reachable_files(edges, located, start, depth), "file", "left_anti")


def context_files(edges: DataFrame, located: DataFrame, start: str, depth: int = CONTEXT) -> DataFrame:
    """Files of what a function reaches in few steps, and those that define it."""
    own = located.filter((F.col("name") == start) & F.col("file").isNotNull()).select("file")
    return reachable_files(edges, located, start, depth).unionByName(own).distinct()


def _framed(head: DataFrame, body: DataFrame, flags: DataFrame) -> DataFrame:
    """(seed, section, depth, name, line): the head, the lines of the levels, and what a trace with revisits ends in."""
    end = flags.filter("revisits").select("seed", F.lit(3).cast("long").alias("section"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("name"), F.explode(F.array(F.lit(""), F.lit("(cycle detected - trace may be incomplete)"))).alias("line"))
    return head.unionByName(body).unionByName(end)


def tree_lines(levels: DataFrame, flags: DataFrame, forward: bool = True) -> DataFrame:
    """(seed, section, depth, name, line): a trace as a tree, a row for each line; in order of section, depth and name.

    Branches of the deepest level are last ones, where the trace came to an end.
    """
    deepest = levels.groupBy("seed").agg(F.max("depth").alias("deepest")).join(flags, "seed")
    rows = levels.join(deepest, "seed")
    mark = F.when((F.col("depth") == F.col("deepest")) & ~F.col("revisits"), "└──").otherwise("├──")
    body = rows.select("seed", F.lit(2).cast("long").alias("section"), "depth", "name", F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), mark, F.lit(" "), "name").alias("line"))
    none = [F.lit(1).cast("long").alias("section"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("name")]
    head = flags.select("seed", *none, F.concat("seed", F.lit(" calls:" if forward else " is called by:")).alias("line"))
    return _framed(head, body, flags)


def list_lines(levels: DataFrame, flags: DataFrame, forward: bool = True) -> DataFrame:
    """(seed, section, depth, name, line): a trace as a list by depth, a row for each line; a level's own line has no name
    and comes first."""
    body = levels.select("seed", F.lit(2).cast("long").alias("section"), "depth", "name", F.concat(F.lit("  - "), "name").alias("line"))
    tops = levels.select("seed", "depth").distinct().select("seed", F.lit(2).cast("long").alias("section"), "depth", F.lit(None).cast("string").alias("name"), F.concat(F.lit("[Depth "), F.col("depth").cast("string"), F.lit("]")).alias("line"))
    none = [F.lit(1).cast("long").alias("section"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("name")]
    head = flags.select("seed", *none, F.concat(F.lit("Called: " if forward else "Called by: "), "seed").alias("line"))
    return _framed(head, body.unionByName(tops), flags)


def dot_lines(edges: DataFrame) -> DataFrame:
    """Lines of a DOT file but for its frame: section 0 has the nodes, 1 the edges."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    shown = ends.select(F.lit(0).cast("long").alias("section"), F.concat(F.lit("    "), quoted("name"), F.lit(" [label="), quoted("name"), F.lit("];")).alias("line"))
    return shown.unionByName(edges.select(F.lit(1).cast("long").alias("section"), F.concat(F.lit("    "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";")).alias("line")))
