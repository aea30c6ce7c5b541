"""What actions did to workspaces, kept as changes, and the state of a workspace at any point of its history.

changes: workspace, id, path, before, after, before_mode, after_mode: hashes of a file's content before and after an action, null
where it was not there. A state is never written whole: it is one aggregation over the changes, so that a history of very many
actions costs what they changed. settings: workspace, id, key, before, after, in the same way; the key `config` stands for
settings as a whole, keys `objects.<path>` for hidden files, `mode` for the mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(before: DataFrame, after: DataFrame, action: int, names: dict[str, str]) -> DataFrame:
    """Changes that one action made, from two snapshots with workspace, a key, and values.

    `names`: the key first, then each value with what it is called in the changes, such as {"path": "path", "hash": "", "mode": "_mode"}
    for before, after, before_mode and after_mode. Rows that are the same before and after are left out.
    """
    key, *values = names
    old = before.select("workspace", key, *[F.col(v).alias("before" + names[v]) for v in values])
    new = after.select("workspace", key, *[F.col(v).alias("after" + names[v]) for v in values])
    same = F.lit(True)
    for v in values:
        same = same & F.col("before" + names[v]).eqNullSafe(F.col("after" + names[v]))
    return old.join(new, ["workspace", key], "full").filter(~same).withColumn("id", F.lit(action).cast("long"))


def as_of(changes: DataFrame, cursors: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """workspace, path, hash, mode of the files that workspaces have at their cursors (workspace, cursor).

    A file is as the last change up to the cursor left it; if all its changes are later, as the first of them found it; without any, as in
    `base` (workspace, path, hash, mode). Workspaces without a cursor give no rows.
    """
    last = lambda c: F.max_by(c, F.when(F.col("id") <= F.col("cursor"), F.col("id")))
    first = lambda c: F.min_by(c, F.when(F.col("id") > F.col("cursor"), F.col("id")))
    rows = changes.select("workspace", "path", "id", F.struct(F.col("after").alias("hash"), F.col("after_mode").alias("mode")).alias("new"), F.struct(F.col("before").alias("hash"), F.col("before_mode").alias("mode")).alias("old"))
    if base is not None:
        kept = F.struct("hash", "mode")
        rows = rows.unionByName(base.select("workspace", "path", F.lit(None).cast("long").alias("id"), kept.alias("new"), kept.alias("old")))
    found = rows.join(cursors.select("workspace", "cursor"), "workspace").groupBy("workspace", "path").agg(
        F.coalesce(last(F.col("new")), first(F.col("old")), F.first(F.when(F.col("id").isNull(), F.col("new")), True)).alias("state")
    )
    return found.filter("state.hash is not null").select("workspace", "path", "state.hash", "state.mode")


def targets(actions: DataFrame, cursors: DataFrame, redo: bool = False, force: bool = False) -> DataFrame:
    """workspace, id, error: the action that undo or redo acts on in each workspace with a cursor.

    actions: workspace, id, undoable. Undo takes the action at the cursor, and not the first of a history; redo takes the one after it.
    error: `nothing`, or `not_undoable` unless forced; else null.
    """
    at = cursors.select("workspace", "cursor", (F.col("cursor") + 1 if redo else F.col("cursor")).alias("id"))
    found = at.join(actions.select("workspace", "id", "undoable", F.lit(True).alias("there")), ["workspace", "id"], "left")
    none = F.col("there").isNull() | (F.lit(not redo) & (F.col("cursor") <= 1))
    error = F.when(none, "nothing").when(F.lit(not (redo or force)) & ~F.col("undoable"), "not_undoable")
    return found.select("workspace", "id", "cursor", error.alias("error"))


def stepped(changes: DataFrame, actions: DataFrame, cursors: DataFrame, objects: DataFrame, redo: bool = False, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """What undo or redo writes, and what came of it.

    First: workspace, path, content, mode of each file to write, and without a content of each file to remove. Second: workspace, id,
    error, cursor after the step. objects: hash, content. A workspace one of whose objects is missing (`missing_object`) stays as it is.
    """
    wanted = targets(actions, cursors, redo, force)
    side = ("after", "after_mode") if redo else ("before", "before_mode")
    files = changes.join(wanted.filter("error is null").select("workspace", "id"), ["workspace", "id"]).select("workspace", "path", F.col(side[0]).alias("hash"), F.col(side[1]).alias("mode"))
    held = files.join(objects.dropDuplicates(["hash"]).select("hash", "content"), "hash", "left")
    broken = held.filter("hash is not null and content is null").select("workspace", F.lit("missing_object").alias("broken")).distinct()
    outcome = wanted.join(broken, "workspace", "left").withColumn("error", F.coalesce("error", "broken"))
    moved = F.when(F.col("error").isNotNull(), F.col("cursor")).otherwise(F.col("id") if redo else F.col("id") - 1)
    writes = held.join(broken, "workspace", "left_anti").select("workspace", "path", "content", "mode")
    return writes, outcome.select("workspace", "id", "error", moved.alias("cursor"))


def written(files: DataFrame, writes: DataFrame) -> DataFrame:
    """workspace, path, content of all files after a step's writes; those without a content are gone."""
    rest = files.select("workspace", "path", "content").join(writes.select("workspace", "path"), ["workspace", "path"], "left_anti")
    return rest.unionByName(writes.filter("content is not null").select("workspace", "path", "content"))


def file_changes(changes: DataFrame, sizes: DataFrame) -> DataFrame:
    """workspace, id, path, before, after: sizes as text. sizes: hash, size; what is not there has 0 bytes."""
    size = sizes.select("hash", "size").dropDuplicates(["hash"])
    old, new = size.select(F.col("hash").alias("before"), F.col("size").alias("old")), size.select(F.col("hash").alias("after"), F.col("size").alias("new"))
    text = lambda c: F.concat(F.coalesce(F.col(c), F.lit(0)).cast("string"), F.lit(" bytes"))
    return changes.join(old, "before", "left").join(new, "after", "left").select("workspace", "id", "path", text("old").alias("before"), text("new").alias("after"))


def setting_changes(settings: DataFrame) -> DataFrame:
    """workspace, id, line: how showing an action tells changes of settings; settings that come or go as a whole are told alone."""
    whole = settings.filter("key = 'config'").select("workspace", "id", F.when(F.col("before").isNull(), "+ config created").when(F.col("after").isNull(), "- config removed").alias("line")).filter("line is not null")
    name = F.regexp_replace("key", r"^objects\.", "")
    known = F.startswith("key", F.lit("objects."))
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("?")), F.lit('"'))
    line = F.when(known & F.col("before").isNull(), F.concat(F.lit("+ objects["), quoted(name), F.lit("]: "), "after")).when(known & F.col("after").isNull(), F.concat(F.lit("- objects["), quoted(name), F.lit("]")))
    line = F.when(F.col("key") == "mode", F.concat(F.lit("mode: "), quoted(F.col("before")), F.lit(" -> "), quoted(F.col("after")))).otherwise(line)
    each = settings.filter(~F.col("before").eqNullSafe(F.col("after"))).select("workspace", "id", line.alias("line")).filter("line is not null")
    return each.join(whole.select("workspace", "id"), ["workspace", "id"], "left_anti").unionByName(whole)
