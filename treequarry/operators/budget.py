"""What to disclose of a project under a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treequarry.operators.graph import BROADCAST_ROWS, DISCLOSE, checkpointed, reach

#: Plans of at most so many items are folded as one array each.
FOLDED = 1024


def tiers(edges: DataFrame, located: DataFrame, focus: DataFrame, depth: int = DISCLOSE) -> DataFrame:
    """(file, level, focus_ord): level 3 for the focus files (file, focus_ord), 2 for files of what they call, 1 for
    files within `depth` steps. A file keeps the level at which it was found first, walking the focus files in order,
    each with its callees before its trace. located: name, file."""
    named = located.join(F.broadcast(focus) if focus.count() <= BROADCAST_ROWS else focus, "file").select(F.col("focus_ord").alias("seed"), "name")
    # a trace for each focus file, not for each function in it: what they reach within the file has level 3 anyway
    far = reach(edges, named, depth)
    level = F.when(F.col("depth") == 1, 2).otherwise(1).cast("long").alias("level")
    found = far.select("name", F.col("seed").alias("focus_ord"), level).join(located, "name").filter("file is not null")
    first = found.groupBy("file").agg(F.min(F.struct("focus_ord", (-F.col("level")).alias("late"))).alias("first"))
    deps = first.join(focus.select("file"), "file", "left_anti").select("file", (-F.col("first.late")).alias("level"), F.col("first.focus_ord").alias("focus_ord"))
    return focus.select("file", F.lit(3).cast("long").alias("level"), "focus_ord").unionByName(deps)


def charged(files: DataFrame) -> DataFrame:
    """Files (file, level, tokens) with what a level costs: all, 60 % or 20 % of the tokens, rounded down."""
    share = F.when(F.col("level") == 3, 100).when(F.col("level") == 2, 60).otherwise(20)
    return files.withColumn("cost", F.floor(F.col("tokens") * share / 100).cast("long"))


def greedy(items: DataFrame, budget: int, order: list[str], group: list[str]) -> DataFrame:
    """Items (with cost) with taken: in order, each that still fits, going on past those that do not.

    Costs are no less than zero; a null cost counts as nothing, and of items in one place the cheaper comes first. Plans
    of few items are folded as arrays; longer ones are decided by halving, spread over all tasks. Both give the same.
    """
    sizes = items.groupBy(*group).agg(F.count("*").alias("_n"))
    long_plans = sizes.filter(F.col("_n") > FOLDED).select(F.struct(*group).alias("_plan"))
    if long_plans.isEmpty():
        return _folded(items, budget, order, group)
    long_plans = checkpointed(long_plans)
    long_plans = F.broadcast(long_plans) if long_plans.count() <= BROADCAST_ROWS else long_plans
    keyed = items.withColumn("_own", F.struct(*group))
    same = F.col("_own").eqNullSafe(F.col("_plan"))
    few, many = (keyed.join(long_plans, same, how).drop("_own") for how in ("left_anti", "left_semi"))
    return _folded(few, budget, order, group).unionByName(_halved(many, budget, order, group))


def _folded(items: DataFrame, budget: int, order: list[str], group: list[str]) -> DataFrame:
    """A plan as one sorted array, folded in the JVM."""
    cost = F.coalesce("cost", F.lit(0)).cast("long")
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], cost.alias("_cost"), F.struct(*items.columns).alias("_row"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken"))

    def step(state: Column, row: Column) -> Column:
        fits = state["used"] + row["_cost"] <= budget
        return F.struct((state["used"] + F.when(fits, row["_cost"]).otherwise(0)).alias("used"), F.concat(state["taken"], F.array(fits)).alias("taken"))

    plans = items.groupBy(*group).agg(rows.alias("_rows")).select("_rows", F.aggregate("_rows", start, step)["taken"].alias("_taken"))
    return plans.select(F.inline(F.arrays_zip(F.col("_rows")["_row"].alias("row"), F.col("_taken").alias("taken")))).select("row.*", "taken")


def _halved(items: DataFrame, budget: int, order: list[str], group: list[str]) -> DataFrame:
    """The same choice by prefix sums.

    Let `rest` be what is left of a plan's budget and `half` the largest power of two below it. Items above `rest` never
    fit again. Those up to `half` fit for as long as the rest stays above it, so they can be taken by their running sum
    alone, and between two and one times `half` a single item fits at most. The first place where either the sum brings
    the rest down to `half`, or such an item fits, ends a round: so a plan of any length is decided in as many rounds as
    its budget has binary digits, each one running sum over blocks of rows. What a round decides is kept as a span of places.
    """
    cost = F.coalesce("cost", F.lit(0)).cast("long")
    dealt = items.repartitionByRange(*[F.col(c) for c in (*group, *order)], cost).sortWithinPartitions(*group, *order, cost)
    dealt = checkpointed(dealt.select("*", F.struct(*group).alias("_plan"), F.spark_partition_id().alias("_block"), F.monotonically_increasing_id().alias("_at"), cost.alias("_cost")))
    places = checkpointed(dealt.select("_plan", "_block", "_at", "_cost").repartition("_plan", "_block").sortWithinPartitions("_plan", "_block", "_at"))
    state = places.select("_plan").distinct().select("_plan", F.lit(budget).cast("long").alias("rest"), F.lit(-1).cast("long").alias("after"), F.array().cast("array<struct<after:long,upto:long,half:long>>").alias("spans"))
    state, end = checkpointed(state), F.lit((1 << 63) - 1)
    half = F.when(F.col("rest") <= 1, 0).otherwise(F.expr("shiftleft(1L, length(bin(rest - 1)) - 1)"))
    span = lambda upto, half: F.array(F.struct(F.col("after"), upto.cast("long").alias("upto"), half.cast("long").alias("half")))
    while state.filter("rest > 0 and after < 9223372036854775807").count():
        active = state.filter((F.col("rest") > 0) & (F.col("after") < end)).select("_plan", "rest", "after", half.alias("half"))
        left = places.join(F.broadcast(active) if active.count() <= BROADCAST_ROWS else active, "_plan").filter("_at > after and _cost <= rest")
        small = F.when(F.col("_cost") <= F.col("half"), F.col("_cost")).otherwise(0)
        inside = Window.partitionBy("_plan", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        blocks = Window.partitionBy("_plan").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
        starts = left.groupBy("_plan", "_block").agg(F.sum(small).alias("sum")).select("_plan", "_block", F.coalesce(F.sum("sum").over(blocks), F.lit(0)).alias("start"))
        summed = left.withColumn("inside", F.coalesce(F.sum(small).over(inside), F.lit(0))).join(starts, ["_plan", "_block"])
        summed = summed.withColumn("then", F.col("rest") - F.col("start") - F.col("inside") - F.col("_cost"))
        ends = F.when(F.col("_cost") <= F.col("half"), F.col("then") <= F.col("half")).otherwise(F.col("then") >= 0)
        first = summed.filter(ends).groupBy("_plan").agg(F.min(F.struct("_at", "then")).alias("first"))
        over = (F.col("rest") > 0) & (F.col("after") < end)
        state = checkpointed(
            state.join(first, "_plan", "left").select(
                "_plan",
                F.when(over, F.coalesce("first.then", "rest")).otherwise(F.col("rest")).alias("rest"),
                F.when(over, F.coalesce("first._at", end)).otherwise(F.col("after")).alias("after"),
                F.when(over, F.concat("spans", span(F.coalesce("first._at", end), half))).otherwise(F.col("spans")).alias("spans"),
            )
        )
    # what comes after the budget is used up: only items that cost nothing
    spans = F.when((F.col("rest") == 0) & (F.col("after") < end), F.concat("spans", span(end, F.lit(0)))).otherwise(F.col("spans"))
    decided = state.select("_plan", spans.alias("_spans"))
    taken = F.exists("_spans", lambda s: (F.col("_at") > s["after"]) & (F.col("_at") <= s["upto"]) & ((F.col("_cost") <= s["half"]) | ((F.col("_at") == s["upto"]))))
    held = F.broadcast(decided) if decided.count() <= BROADCAST_ROWS else decided
    return dealt.join(held, "_plan").select(*items.columns, taken.alias("taken"))


def summary(plan: DataFrame, group: list[str]) -> DataFrame:
    """used_tokens, dropped_tokens, n_entries per plan."""
    return plan.groupBy(*group).agg(
        F.sum(F.when(F.col("taken"), F.col("cost")).otherwise(0)).cast("long").alias("used_tokens"), F.sum(F.when(F.col("taken"), 0).otherwise(F.col("cost"))).cast("long").alias("dropped_tokens"), F.count_if("taken").alias("n_entries")
    )


def ordered_tiers(plan: DataFrame) -> DataFrame:
    """All of a level before the next, then by focus and file: `ord` from 1.

    Places are counted within each level and focus, after what all groups before hold, so no task ranks the whole plan.
    """
    own = Window.partitionBy("level", "focus_ord").orderBy("file")
    before = Window.orderBy(F.desc("level"), "focus_ord").rowsBetween(Window.unboundedPreceding, -1)  # over a row a group
    starts = plan.groupBy("level", "focus_ord").agg(F.count("*").alias("n")).select("level", "focus_ord", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return plan.join(starts, ["level", "focus_ord"]).withColumn("ord", (F.col("start") + F.row_number().over(own)).cast("long")).select(*plan.columns, "ord")
