"""Unified diffs as tables of lines: parsing, applying, reversing, and a queue from which patches can be taken back.

A hunk's lines are told from file heads by the counts in its head, which running sums follow. Hunks that fit change
lines of the file as it was, so applying is one join of a patch's lines, gathered by file, with the files, and an order of
what stays and what is new; no file is folded hunk by hunk, and no file's lines are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treequarry.operators.graph import checkpointed

HEAD = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"


def hunk_offsets(hunks: DataFrame) -> DataFrame:
    """file, hunk_no, shift: by how many lines the hunks before it move a hunk."""
    before = Window.partitionBy("file").orderBy("hunk_no").rowsBetween(Window.unboundedPreceding, -1)
    return hunks.select("file", "hunk_no", F.coalesce(F.sum(F.col("new_count") - F.col("old_count")).over(before), F.lit(0)).cast("long").alias("shift"))


def hunk_heads(heads: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose `head` is a hunk's: keys, old_start, old_count, new_start, new_count; a count that is left out is 1."""
    number = lambda i: F.regexp_extract("head", HEAD, i).try_cast("long")
    count = lambda i: F.coalesce(number(i), F.lit(1).cast("long"))
    return heads.filter(F.col("head").rlike(HEAD)).select(*keys, number(1).alias("old_start"), count(2).alias("old_count"), number(3).alias("new_start"), count(4).alias("new_count"))


def clean_path(path: Column) -> Column:
    """Without what follows a tab, quotes, and a/ or b/ in front."""
    plain = F.btrim(F.btrim(F.substring_index(path, "\t", 1)), F.lit('"'))
    return F.regexp_replace(plain, "^[ab]/", "")


def patch_format(text: Column) -> Column:
    """git, unified, or null for what is neither."""
    return F.when(text.rlike(r"(?m)^diff --git "), "git").when(text.rlike(r"(?m)^--- ") & text.rlike(r"(?m)^\+\+\+ "), "unified")


def parse(patches: DataFrame) -> DataFrame:
    """Patches (patch_id, text) to their lines: patch_id, file and new_file (/dev/null where one is missing), hunk_no (in the
    file, from 1), line_no (in the hunk, from 1), old_start, op (space, -, + or \\), text.

    A null text has no lines. Heads of files count as such only outside of hunks.
    """
    order = Window.partitionBy("patch_id").orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("patch_id", "part").orderBy("n")
    count = lambda i: F.coalesce(F.regexp_extract("line", HEAD, i).try_cast("long"), F.lit(1).cast("long"))
    is_head = F.col("line").rlike(HEAD)
    rows = patches.select("patch_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("part", F.sum(F.when(is_head, 1).otherwise(0)).over(order))
    op = F.when(F.col("line") == "", " ").otherwise(F.substring("line", 1, 1))
    rows = rows.withColumn("head", is_head).withColumn("op", op)
    # of each part: its head's numbers, and how many old and new lines stand before a line
    number = lambda c: F.first(F.when(F.col("head"), c), True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("old_start", number(F.regexp_extract("line", HEAD, 1).try_cast("long"))).withColumn("olds", number(count(2))).withColumn("news", number(count(4)))
    so_far = lambda ops: F.coalesce(F.sum(F.when(~F.col("head") & F.col("op").isin(*ops), 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = (so_far(" -") < F.col("olds")) | (so_far(" +") < F.col("news"))
    rows = rows.withColumn("body", (F.col("part") > 0) & ~F.col("head") & ((left & F.col("op").isin(*" -+")) | (F.col("op") == "\\")))
    outside = ~F.col("body") & ~F.col("head")
    named = lambda mark: F.last(F.when(outside & F.col("line").startswith(mark), clean_path(F.substring("line", 5, 1 << 30))), True).over(before)
    rows = rows.withColumn("file", named("--- ")).withColumn("new_file", named("+++ ")).withColumn("file_no", F.coalesce(F.sum(F.when(outside & F.col("line").startswith("--- "), 1).otherwise(0)).over(before), F.lit(0)))
    in_file = Window.partitionBy("patch_id", "file_no").orderBy("n")
    rows = rows.withColumn("hunk_no", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(in_file)).filter("body")
    number_in = F.row_number().over(Window.partitionBy("patch_id", "part").orderBy("n"))
    text = F.when(F.col("op") == "\\", "").otherwise(F.substring("line", 2, 1 << 30))
    return rows.select("patch_id", "file", "new_file", F.col("hunk_no").cast("long").alias("hunk_no"), number_in.cast("long").alias("line_no"), "old_start", "op", text.alias("text"))


def reverse(lines: DataFrame) -> DataFrame:
    """Patch lines with additions and deletions changed about, as the patch that undoes them: starts are the new ones."""
    delta = F.when(F.col("op") == "+", 1).when(F.col("op") == "-", -1).otherwise(0)
    key = ["patch_id", "file", "new_file"]
    whole = lambda op: F.count(F.when(F.col("op").isin(*op), 1))
    before = lines.groupBy(*key, "hunk_no").agg(F.sum(delta).alias("n"), F.first("old_start").alias("old_start"), whole(" -").alias("olds"), whole(" +").alias("news"))
    order = Window.partitionBy(*key).orderBy("hunk_no").rowsBetween(Window.unboundedPreceding, -1)
    # a side without lines counts from the line before it
    start = F.col("old_start") + F.coalesce(F.sum("n").over(order), F.lit(0)) + F.when(F.col("olds") == 0, 1).otherwise(0) - F.when(F.col("news") == 0, 1).otherwise(0)
    turned = lines.drop("old_start").join(before.select(*key, "hunk_no", start.alias("old_start")), [*key, "hunk_no"])
    return turned.select("patch_id", F.col("new_file").alias("file"), F.col("file").alias("new_file"), "hunk_no", "line_no", "old_start", F.translate("op", "+-", "-+").alias("op"), "text")


def edits(patch_lines: DataFrame) -> DataFrame:
    """path, edit: what the lines of one patch do to each file, a row a file. Lines move once, by path."""
    lines = patch_lines.withColumn("path", F.when(F.col("file") == "/dev/null", F.col("new_file")).otherwise(F.col("file"))).repartition("path")
    hunk = Window.partitionBy("path", "hunk_no").orderBy("line_no")
    old = F.col("op").isin(*" -")
    olds = F.coalesce(F.sum(F.when(old, 1).otherwise(0)).over(hunk.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    whole = F.sum(F.when(old, 1).otherwise(0)).over(Window.partitionBy("path", "hunk_no"))
    # the line of the file that an old line is, or after which a new one comes
    first = F.greatest(F.col("old_start") - F.when(whole == 0, 0).otherwise(1), F.lit(0))
    placed = lines.withColumn("at", (first + olds).cast("long")).withColumn("last", F.lag("op").over(hunk))
    # twice the place of an old line, and one more for new lines after it
    spot = 2 * F.col("at") + F.when(F.col("op") == "+", 1).otherwise(0)
    marked = lambda ops: F.coalesce(F.bool_or((F.col("op") == "\\") & F.col("last").isin(*ops)), F.lit(False))
    gathered = lambda fits, row, name: F.collect_list(F.when(fits, row)).alias(name)
    hunks = placed.groupBy("path", "hunk_no").agg(
        F.min(spot).alias("low"),
        F.max(spot).alias("high"),
        gathered(old, F.struct("at", "text"), "olds"),
        gathered(F.col("op") == "-", F.col("at"), "gone"),
        gathered(F.col("op") == "+", F.struct("at", "hunk_no", "line_no", "text"), "news"),
        F.max("new_file").alias("new_file"),
        F.max("file").alias("file"),
        marked(" +").alias("open"),
        marked("-").alias("closed"),
    )
    reached = F.lag("high").over(Window.partitionBy("path").orderBy("hunk_no"))
    early = F.coalesce((F.col("low") < reached) | ((F.col("low") == reached) & (F.col("low") % 2 == 0)), F.lit(False))
    of_file = [F.flatten(F.collect_list(c)).alias(c) for c in ("olds", "gone", "news")] + [F.bool_or(c).alias(c) for c in ("early", "open", "closed")]
    whole_file = hunks.withColumn("early", early).groupBy("path").agg(*of_file, (F.max("new_file") == "/dev/null").alias("deleted"), (F.max("file") == "/dev/null").alias("created"))
    return whole_file.select("path", F.struct("olds", "gone", "news", "early", "open", "closed", "deleted", "created").alias("edit"))


def edited(files: DataFrame, edit: str = "edit") -> DataFrame:
    """Files (path, content, an edit that may be null, ...) with the content after it, and status: null without an edit.

    What stays and what is new is put in order within a row, which holds its file whole anyway. Each step is a generator of one
    row, so that no filter above it makes the steps below run again for each line.
    """
    step = lambda column, name: F.explode(F.array(column)).alias(name)
    e = lambda name: F.col(f"{edit}.{name}")
    body = F.when(F.endswith("content", F.lit("\n")), F.expr("left(content, char_length(content) - 1)")).otherwise(F.col("content"))
    none = F.array().cast("array<string>")
    rows = files.select("*", step(F.coalesce(F.when(body == "", none).otherwise(F.split(body, "\n")), none), "parts"))
    now = lambda at: F.when(at <= F.size("parts"), F.get("parts", (at - 1).cast("int")))
    wrong = F.exists(e("olds"), lambda x: now(x["at"]).isNull() | F.coalesce(now(x["at"]) != x["text"], F.lit(False)))
    bad = wrong | e("early") | (F.col("content").isNull() & ~e("created"))
    status = F.when(F.col(edit).isNull(), F.lit(None)).when(bad, "mismatch").when(e("deleted"), "deleted").when(e("created"), "created").otherwise("applied")
    places = F.array_except(F.when(F.size("parts") > 0, F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))).otherwise(F.array().cast("array<bigint>")), e("gone"))
    zero = F.lit(0).cast("long")
    stays = F.transform(places, lambda at: F.struct(at.alias("at"), zero.alias("hunk_no"), zero.alias("line_no"), now(at).alias("text")))
    listed = F.transform(F.array_sort(F.concat(stays, e("news"))), lambda x: x["text"])
    ends = F.when(e("open"), "").when(e("closed") | e("created") | F.endswith("content", F.lit("\n")), "\n").otherwise("")
    changed = F.when(F.size(places) + F.size(e("news")) > 0, F.concat(F.array_join(listed, "\n"), ends)).otherwise("")
    content = F.when(F.col("status").isNull() | (F.col("status") == "mismatch"), F.col("content")).when(F.col("status") != "deleted", changed)
    return rows.select("*", step(status, "status")).select(*[c for c in files.columns if c != "content"], "status", step(content, "content"))


def apply(files: DataFrame, patch_lines: DataFrame) -> DataFrame:
    """path, content, status of the files (path, content) that one patch's lines change: applied, created, deleted or mismatch.

    Context and deleted lines must be what the file has at their places, and hunks of a file in order, or nothing of
    the file changes. A mark of a missing line end decides how the file ends; without one it ends as before, and a new
    file with a line end.
    """
    return edited(edits(patch_lines).join(files.select("path", "content"), "path", "left")).select("path", "content", "status")


def taken_back(files: DataFrame, patch_lines: DataFrame) -> DataFrame:
    """All files (path, content) after one patch's lines are applied, and those that were applied are taken back.

    The edits of both ways meet by path before the files do, so contents move once.
    """
    there, back = edits(patch_lines), edits(reverse(patch_lines)).withColumnRenamed("edit", "back")
    after = edited(files.select("path", "content").join(there.join(back, "path", "full"), "path", "full"))
    left = after.filter("content is not null or edit is null and back is null")
    again = edited(left.withColumn("back", F.when(F.col("status") == "applied", F.col("back"))).drop("status", "edit"), "back")
    return again.filter("content is not null or back is null").select("path", "content")


def patched(files: DataFrame, changes: DataFrame) -> DataFrame:
    """All files (path, content) after `apply` found these changes."""
    kept = files.select("path", "content").join(changes.select("path"), "path", "left_anti")
    return kept.unionByName(changes.filter("content is not null").select("path", "content"))


def tallies(changes: DataFrame) -> DataFrame:
    """n_files, n_applied, n_conflicts"""
    return changes.agg(F.count("*").alias("n_files"), F.count_if(F.col("status") != "mismatch").alias("n_applied"), F.count_if(F.col("status") == "mismatch").alias("n_conflicts"))


def queued(queue: DataFrame, patch_lines: DataFrame, patch_id: int) -> DataFrame:
    """The queue (patch_id, place) with one more patch at its end, whose lines must be there."""
    last = queue.agg(F.coalesce(F.max("place"), F.lit(0)).alias("last")).first()["last"]
    new = patch_lines.filter(F.col("patch_id") == patch_id).select("patch_id").distinct()
    return queue.select("patch_id", "place").unionByName(new.select("patch_id", F.lit(last + 1).cast("long").alias("place")))


def unapply(files: DataFrame, queue: DataFrame, patch_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and queue without the patch that was applied last; as they are where the queue is empty."""
    last = queue.orderBy(F.desc("place")).first()
    if last is None:
        return files, queue
    files = checkpointed(files)
    back = apply(files, reverse(patch_lines.filter(F.col("patch_id") == last["patch_id"])))
    return patched(files, back), queue.filter(F.col("place") < last["place"])


def yank(files: DataFrame, queue: DataFrame, patch_lines: DataFrame, patch_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take a patch out of the queue: it and all later ones are taken back, and the later ones applied again in order.

    Returns files, queue and a report (patch_id, path, status) of what was applied again. A queue is the few patches of one
    working tree; each step is a join over its files.
    """
    place = queue.filter(F.col("patch_id") == patch_id).first()
    if place is None:
        raise ValueError(f"no patch {patch_id} in the queue")
    files, queue, patch_lines = checkpointed(files), checkpointed(queue), checkpointed(patch_lines)
    later = [r["patch_id"] for r in queue.filter(F.col("place") > place["place"]).orderBy("place").collect()]
    for back in [*reversed(later), patch_id]:
        files = checkpointed(patched(files, apply(files, reverse(patch_lines.filter(F.col("patch_id") == back)))))
    report = None
    for again in later:
        changes = checkpointed(apply(files, patch_lines.filter(F.col("patch_id") == again)))
        files = checkpointed(patched(files, changes))
        rows = changes.select(F.lit(again).cast("long").alias("patch_id"), "path", "status")
        report = rows if report is None else report.unionByName(rows)
    if report is None:
        report = files.select(F.lit(None).cast("long").alias("patch_id"), "path", F.lit("").alias("status")).limit(0)
    left = queue.filter(F.col("patch_id") != patch_id)
    order = Window.orderBy("place")  # over a row a patch
    return files, left.select("patch_id", F.row_number().over(order).cast("long").alias("place")), report
