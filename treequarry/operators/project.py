"""State of a project as tables that operators turn into new tables: hiding, checkpoints, undo, profiles, settings.

files: path, content. objects: hash, content. tracked: key, path, hash (one row per hidden file). Nothing is changed in
place; a caller writes the new snapshot beside the old one and switches over.
"""

from __future__ import annotations

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treequarry.functions import paths as P

BLOCK_BEGIN, BLOCK_END = "# treequarry begin", "# treequarry end"


def guard(path: Column, content: Column, exists: Column, hidden: Column) -> Column:
    """Why a path may not be hidden, as an error code, in the order of the checks; null if it may."""
    return (
        F.when(P.file_name(path).rlike(r"[\x00-\x1f\x7f]"), "E023")
        .when(P.is_config(path), "E018")
        .when(P.in_data_dir(path), "E019")
        .when(P.is_vcs(path), "E020")
        .when(~exists & hidden, "E012")
        .when(~exists, "E023")
        .when(P.is_binary(path, content), "E005")
        .when(~hidden & F.exists(F.split(content, "\n"), lambda x: x.rlike(r"^\.\.\.\[[0-9a-f]+\]\.{0,3}$")), "E014")
        .when(hidden, "E012")
    )


def checked(wanted: DataFrame, files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Wanted paths with content, hash and error."""
    on_disk = files.select("path", "content", F.lit(True).alias("there"))
    known = tracked.select("path", F.lit(True).alias("known")).distinct()
    rows = wanted.select("path").distinct().join(on_disk, "path", "left").join(known, "path", "left")
    error = guard(F.col("path"), F.coalesce("content", F.lit("")), F.coalesce("there", F.lit(False)), F.coalesce("known", F.lit(False)))
    return rows.select("path", "content", F.sha2("content", 256).alias("hash"), error.alias("error"))


def hide(wanted: DataFrame, files: DataFrame, tracked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files without those that are hidden now, the rows that are tracked then, and the objects to store."""
    good = checked(wanted, files, tracked).filter("error is null")
    new = good.select(F.col("path").alias("key"), "path", "hash")
    return files.join(good.select("path"), "path", "left_anti"), tracked.select("key", "path", "hash").unionByName(new), good.select("hash", "content").dropDuplicates(["hash"])


def show(wanted: DataFrame, files: DataFrame, tracked: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with hidden ones restored whose object is there, and what stays tracked."""
    back = tracked.join(wanted.select("path").distinct(), "path", "left_semi").join(objects.dropDuplicates(["hash"]), "hash").select("key", "path", "content")
    return files.select("path", "content").unionByName(back.select("path", "content")), tracked.join(back.select("key"), "key", "left_anti")


def apply_again(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Tracked files that are on disk again: applied where the content is still the stored one, skipped where it is not."""
    now = files.select("path", F.sha2("content", 256).alias("now"))
    return tracked.join(now, "path").select("path", F.when(F.col("hash") == F.col("now"), "applied").otherwise("skipped").alias("outcome"))


def save_checkpoint(files: DataFrame, name: str, created: str) -> DataFrame:
    """name, created, path, hash of every file."""
    return files.select(F.lit(name).alias("name"), F.lit(created).cast("timestamp").alias("created"), "path", F.sha2("content", 256).alias("hash"))


def restore_checkpoint(checkpoints: DataFrame, name: str, objects: DataFrame) -> DataFrame:
    """path, content, restored: files of a checkpoint; those whose object is missing or whose path leaves the project fail."""
    rows = checkpoints.filter(F.col("name") == name).join(objects.dropDuplicates(["hash"]), "hash", "left")
    safe = ~F.col("path").rlike(r"(^|/)\.\.(/|$)|^/")
    return rows.select("path", F.when(safe, F.col("content")).alias("content"), (safe & F.col("content").isNotNull()).alias("restored"))


def step(actions: DataFrame, cursors: DataFrame, redo: bool = False) -> DataFrame:
    """workspace, id, state: the action that undo or redo acts on, and the state to restore; none where there is nothing.

    actions: workspace, id, undoable, pre_state, post_state. Undo takes the action at the cursor, redo the one after it;
    the first action of a history cannot be undone.
    """
    at = actions.join(cursors, "workspace")
    if redo:
        return at.filter(F.col("id") == F.col("cursor") + 1).select("workspace", "id", F.col("post_state").alias("state"))
    return at.filter((F.col("id") == F.col("cursor")) & (F.col("cursor") > 1) & F.col("undoable")).select("workspace", "id", F.col("pre_state").alias("state"))


def load_settings(text: str) -> dict:
    """Settings from YAML: mode, whitelist, blacklist, objects; defaults where they are missing."""
    found = yaml.safe_load(text) or {}
    return {"version": found.get("version", 1), "mode": found.get("mode", "whitelist"), "whitelist": list(found.get("whitelist") or []), "blacklist": list(found.get("blacklist") or []), "objects": dict(found.get("objects") or {})}


def save_settings(settings: dict) -> str:
    return yaml.safe_dump(settings, sort_keys=False, allow_unicode=True)


def entries(spark: SparkSession, settings: dict) -> DataFrame:
    """list, ord, entry of both lists, in order."""
    rows = [(name, i + 1, e) for name, key in (("white", "whitelist"), ("black", "blacklist")) for i, e in enumerate(settings[key])]
    return spark.createDataFrame(rows, "list string, ord long, entry string")


def added(entries: DataFrame, name: str, entry: str) -> DataFrame:
    """Entries with one more at the end of a list, unless it is there."""
    own = entries.filter(F.col("list") == name)
    new = own.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("last"), F.count_if(F.col("entry") == entry).alias("known"))
    return entries.unionByName(new.filter("known = 0").select(F.lit(name).alias("list"), (F.col("last") + 1).cast("long").alias("ord"), F.lit(entry).alias("entry")))


def removed(entries: DataFrame, name: str, entry: str) -> DataFrame:
    return entries.filter(~((F.col("list") == name) & (F.col("entry") == entry)))


def ignore_block(text: str, lines: list[str]) -> str:
    """An ignore file with the managed block as its last part, written once however often it is asked for."""
    end = "\r\n" if "\r\n" in text else "\n"
    kept, inside = [], False
    for line in text.splitlines():
        inside = inside or line == BLOCK_BEGIN
        if not inside:
            kept.append(line)
        inside = inside and line != BLOCK_END
    while kept and not kept[-1]:
        kept.pop()
    return end.join([*kept, *([""] if kept else []), BLOCK_BEGIN, *lines, BLOCK_END, ""])


def between(ranges: DataFrame, total: DataFrame) -> DataFrame:
    """Stretches (file, first, last) of lines outside of ranges (file, line_start, line_end); total: file, n."""
    rows = ranges.select("file", "line_start", "line_end").withColumn("ends", F.lit(0)).unionByName(total.select("file", (F.col("n") + 1).alias("line_start"), (F.col("n") + 1).alias("line_end"), F.lit(1).alias("ends")))
    from pyspark.sql import Window

    before = Window.partitionBy("file").orderBy("line_start", "ends").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("reached", F.coalesce(F.max("line_end").over(before), F.lit(0)))
    return found.filter("line_start > reached + 1").select("file", (F.col("reached") + 1).cast("long").alias("first"), (F.col("line_start") - 1).cast("long").alias("last"))
