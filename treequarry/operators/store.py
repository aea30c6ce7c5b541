"""Content-addressed objects, checkpoints, action history and manifests as tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Actions that a history keeps.
HISTORY = 500


def new_objects(contents: DataFrame, stored: DataFrame) -> DataFrame:
    """hash, size, content of contents (a column content) that the store (a column hash) does not have, each once."""
    hashed = contents.select(F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"), "content").dropDuplicates(["hash"])
    return hashed.join(stored.select("hash").distinct(), "hash", "left_anti")


def append_objects(contents: DataFrame, path: str) -> None:
    """Write what is new below a path, partitioned by the first two digits of the hash.

    Of what is stored only the hashes of those of the 256 parts are read that the contents fall into, so a few objects cost a few
    parts however large the store is. A path that does not exist is an empty store.
    """
    spark = contents.sparkSession
    part = F.substring(F.sha2("content", 256), 1, 2)
    parts = [r["part"] for r in contents.filter("content is not null").select(part.alias("part")).distinct().collect()]  # 256 at most
    try:
        # with a schema, as parts such as 07 would else be read as numbers
        stored = spark.read.schema("hash string, first string").parquet(path).filter(F.col("first").isin(parts)).select("hash")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], "hash string")
    new_objects(contents.filter("content is not null"), stored).withColumn("first", F.substring("hash", 1, 2)).write.mode("append").partitionBy("first").parquet(path)


def listed(stored: DataFrame) -> DataFrame:
    """Hashes in the store, each once; names that are none are passed over."""
    from treequarry.functions.text import is_hash

    return stored.select("hash").filter(is_hash(F.col("hash"))).distinct()


def garbage(stored: DataFrame, referenced: DataFrame) -> DataFrame:
    """Stored objects, each once, that nothing refers to."""
    return stored.dropDuplicates(["hash"]).join(referenced.select("hash").distinct(), "hash", "left_anti")


def garbage_totals(stored: DataFrame, referenced: DataFrame) -> DataFrame:
    """deleted, freed_bytes"""
    return garbage(stored, referenced).agg(F.count("*").alias("deleted"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("freed_bytes"))


def totals(stored: DataFrame) -> DataFrame:
    """n_objects, total_bytes"""
    return stored.dropDuplicates(["hash"]).agg(F.count("*").alias("n_objects"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))


def split_history(actions: DataFrame, cursors: DataFrame) -> DataFrame:
    """Actions (workspace, id) with side: past up to the workspace's cursor, future after it."""
    return actions.join(cursors, "workspace").withColumn("side", F.when(F.col("id") <= F.col("cursor"), "past").otherwise("future")).drop("cursor")


def capped_history(actions: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The last `keep` actions of each workspace with ids from 1 again."""
    newest = Window.partitionBy("workspace").orderBy(F.desc("id"))
    oldest = Window.partitionBy("workspace").orderBy("id")
    kept = actions.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep).drop("_n")
    return kept.withColumn("new_id", F.row_number().over(oldest).cast("long"))


def pushed(actions: DataFrame, cursors: DataFrame, new: DataFrame) -> DataFrame:
    """History after new actions (workspace, ts, command): the future of those workspaces goes, and ids follow on."""
    touched = new.select("workspace").distinct().withColumn("touched", F.lit(True))
    kept = split_history(actions, cursors).join(touched, "workspace", "left").filter("side = 'past' or touched is null").drop("side", "touched")
    last = cursors.select("workspace", F.col("cursor"))
    order = Window.partitionBy("workspace").orderBy("ts", "command")
    numbered = new.join(last, "workspace", "left").withColumn("id", (F.coalesce("cursor", F.lit(0)) + F.row_number().over(order)).cast("long"))
    return kept.select("workspace", "id", "ts", "command").unionByName(numbered.select("workspace", "id", "ts", "command"))


def recent(actions: DataFrame, limit: int = 20) -> DataFrame:
    """The newest actions of each workspace, numbered from the newest."""
    order = Window.partitionBy("workspace").orderBy(F.desc("id"))
    return actions.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= limit)


def map_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that were added, removed or changed between two maps."""
    a, b = before.select(key, F.col(value).alias("was"), F.lit(1).alias("a")), after.select(key, F.col(value).alias("now"), F.lit(1).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change is not null")


def latest_checkpoints(checkpoints: DataFrame, group: str) -> DataFrame:
    """Of each group the name of the checkpoint created last, the greater name of equals."""
    return checkpoints.groupBy(group).agg(F.max_by("name", F.struct("created", "name")).alias("name"), F.max("created").alias("created"))


def manifest(files: DataFrame, hidden: DataFrame) -> DataFrame:
    """total, hidden, shown: files on disk (path) or hidden (path, kind); hidden ones count once, tracked or not on disk."""
    h = hidden.select("path").distinct().withColumn("h", F.lit(True))
    every = files.select("path").distinct().join(h, "path", "full")
    return every.agg(F.count("*").alias("total"), F.count("h").alias("hidden"), F.count_if(F.col("h").isNull()).alias("shown"))


def doctor(tracked: DataFrame, stored: DataFrame, metadata: DataFrame, legacy: DataFrame) -> DataFrame:
    """Issues (issue, key) of tracked objects (key, file, hash, is_full): bad hashes, missing objects, legacy markers,
    missing metadata of supported sources."""
    from treequarry.functions.paths import supported
    from treequarry.functions.text import is_hash

    bad = tracked.filter(~is_hash(F.col("hash")))
    good = tracked.filter(is_hash(F.col("hash")))
    missing = good.join(stored.select("hash").distinct(), "hash", "left_anti")
    old = good.filter("is_full").join(legacy.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    plain = good.filter(F.col("is_full") & supported(F.col("file"))).join(metadata.select("hash").distinct(), "hash", "left_anti")
    out = bad.select(F.lit("invalid_hash").alias("issue"), "key")
    for name, rows in (("missing_object", missing), ("legacy_marker", old), ("missing_metadata", plain)):
        out = out.unionByName(rows.select(F.lit(name).alias("issue"), "key"))
    return out


def stale(cache: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths of a cache (path, mtime, size, hash) that a listing with the same columns no longer bears out."""
    now = listing.select("path", F.col("mtime").alias("n_mtime"), F.col("size").alias("n_size"), F.col("hash").alias("n_hash"))
    differs = F.col("n_size").isNull() | (F.col("mtime") != F.col("n_mtime")) | (F.col("size") != F.col("n_size")) | (F.col("hash") != F.col("n_hash"))
    return cache.join(now, "path", "left").filter(differs).select("path")


def see_through(disk: DataFrame, full: DataFrame, original: DataFrame) -> DataFrame:
    """path, content of every file: the stored content of hidden ones, the original of partly hidden ones, else the disk's."""
    f, o = full.select("path", F.col("content").alias("f")), original.select("path", F.col("content").alias("o"))
    return disk.select("path", F.col("content").alias("d")).join(f, "path", "full").join(o, "path", "left").select("path", F.coalesce("f", "o", "d").alias("content"))
