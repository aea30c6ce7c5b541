"""Persisted state of a project: versioned tables that are written beside each other and switched by a committed row.

A table lies below a path: `rows/<token>` holds one version, `commits` a row (version, token) for each. A version counts
once its commit is there, so a writer that fails leaves the table as it was, and readers of an older version are not
disturbed. One writer at a time is assumed. Every change reads a version and writes the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treequarry.operators import store
from treequarry.operators.graph import checkpointed

COMMITS = "version long, token string"
#: What tables of a project hold.
CHECKPOINTS = "name string, created timestamp, path string, hash string"
PROFILES = "name string, list string, ord long, entry string"
HISTORY = "workspace long, id long, command string"
CACHE = "path string, mtime long, size long, hash string, format long, parsed string"
METADATA = "hash string, json string"
INDEX = "name string, n_entries long, file string, line_start long"
MANIFEST = "path string, kind string, on_disk boolean"
#: A change of the index: a file's symbols, or a row without a name for a file that has none (any more).
INDEX_CHANGES = "file string, name string, line_start long"
PATCHES = "patch_id long, text string"
QUEUE = "patch_id long, place long"
#: The format of cache entries that can be read.
FORMAT = 1
#: How tokens of versions begin that hold a whole state among changes.
BASE = "base-"


@dataclass(frozen=True)
class Table:
    """Where a table lies, and its columns."""

    path: str
    schema: str


def commits(spark: SparkSession, table: Table) -> DataFrame:
    """(version, token) of what was committed; none of a table that does not exist."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{table.path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def load(spark: SparkSession, table: Table, version: int | None = None) -> DataFrame:
    """The rows of a version, or of the last; a table without that version is empty."""
    found = commits(spark, table)
    if version is not None:
        found = found.filter(F.col("version") == version)
    last = found.orderBy(F.desc("version"), "token").first()
    return spark.createDataFrame([], table.schema) if last is None else spark.read.schema(table.schema).parquet(f"{table.path}/rows/{last['token']}")


def save(rows: DataFrame, table: Table, kind: str = "") -> int:
    """Write the next version and return its number. Columns are cast and ordered as the table's. A token begins with its kind."""
    spark = rows.sparkSession
    token = kind + uuid.uuid4().hex
    fields = spark.createDataFrame([], table.schema).schema.fields
    rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.parquet(f"{table.path}/rows/{token}")
    version = (commits(spark, table).agg(F.max("version")).first()[0] or 0) + 1
    spark.createDataFrame([(version, token)], COMMITS).coalesce(1).write.mode("append").parquet(f"{table.path}/commits")
    return version


def put(rows: DataFrame, table: Table, key: str) -> int:
    """Save the table with these rows in place of those with the same keys; the first rows are made once."""
    if not commits(rows.sparkSession, table).take(1):
        return save(rows, table)
    old = load(rows.sparkSession, table).join(rows.select(key).distinct(), key, "left_anti")
    fields = [f.name for f in old.schema.fields]
    return save(old.unionByName(rows.select(*fields)), table)


def drop(spark: SparkSession, table: Table, gone: Column) -> int:
    """Save the table without the rows that a condition names."""
    return save(load(spark, table).filter(~F.coalesce(gone, F.lit(False))), table)


def changes(spark: SparkSession, table: Table) -> DataFrame:
    """The rows of all versions since the last base, with `version`: of a table whose versions are changes, not states."""
    found = commits(spark, table).orderBy("version").collect()  # a row for each save since the table began
    since = max((r["version"] for r in found if r["token"].startswith(BASE)), default=0)
    out = spark.createDataFrame([], table.schema).withColumn("version", F.lit(0).cast("long"))
    for r in found:
        if r["version"] >= since:
            out = out.unionByName(spark.read.schema(table.schema).parquet(f"{table.path}/rows/{r['token']}").withColumn("version", F.lit(r["version"]).cast("long")))
    return out


def index_entries(spark: SparkSession, table: Table) -> DataFrame:
    """name, n_entries, file, line_start: of each file what its last change says."""
    all_of = changes(spark, table)
    last = all_of.groupBy("file").agg(F.max("version").alias("version"))
    entries = all_of.join(last, ["file", "version"]).filter("name is not null")
    return entries.join(entries.groupBy("name").agg(F.count("*").alias("n_entries")), "name").select("name", "n_entries", "file", "line_start")


def update_index(touched: DataFrame, symbols: DataFrame, table: Table) -> int:
    """Save changes alone: the symbols (file, name, line_start) of touched files (file); those without symbols are marked as such.

    What is written is in proportion to the change. `compact_index` merges changes into a new base from time to time.
    """
    own = symbols.select("file", "name", "line_start").join(touched.select("file").distinct(), "file", "left_semi")
    gone = touched.select("file").distinct().join(own.select("file").distinct(), "file", "left_anti")
    return save(own.unionByName(gone.select("file", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("line_start"))), table)


def compact_index(spark: SparkSession, table: Table) -> int:
    """Save the index as it is now as a new base, from which reading starts; older versions stay on disk."""
    return save(index_entries(spark, table).select("file", "name", "line_start"), table, BASE)


def places(rows: DataFrame, key: str, width: int = 100_000) -> DataFrame:
    """Rows with place: from 1 in the order of a whole number. Ranges of the key are counted, then ranked each for itself."""
    ranged = rows.withColumn("_range", F.floor(F.col(key) / width))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    starts = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranged.join(starts, "_range").withColumn("place", (F.col("_start") + rank).cast("long")).drop("_range", "_start")


def names(rows: DataFrame) -> DataFrame:
    """name, n: checkpoints or profiles with the number of their rows."""
    return rows.groupBy("name").agg(F.count("*").alias("n"))


def manifest(keys: DataFrame, files: DataFrame) -> DataFrame:
    """path, kind (full or partial), on_disk of what is hidden; keys: key, as `file`, `file#a-b` or `file#_original`.

    A file with a key of its own is hidden in full, whatever ranges it has besides.
    """
    ranged = F.col("key").rlike("#[0-9]+-[0-9]+$")
    path = F.when(ranged, F.regexp_replace("key", "#[^#]*$", "")).otherwise(F.col("key"))
    rows = keys.filter(~F.endswith("key", F.lit("#_original"))).select(path.alias("path"), F.when(ranged, "partial").otherwise("full").alias("kind"))
    there = files.select("path", F.lit(True).alias("there")).distinct()
    return rows.groupBy("path").agg(F.min("kind").alias("kind")).join(there, "path", "left").select("path", "kind", F.coalesce("there", F.lit(False)).alias("on_disk"))


def with_veils(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Files (path) with hidden: whether they have a key, in full or for a range; originals are none."""
    hidden = manifest(keys, files).select("path", F.lit(True).alias("h"))
    return files.select("path").join(hidden, "path", "left").select("path", F.coalesce("h", F.lit(False)).alias("hidden"))


def readable(cache: DataFrame) -> DataFrame:
    """Entries of the format that can be read; a cache of another format counts as empty."""
    return cache.filter(F.col("format") == FORMAT)


def valid(cache: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries that a listing (path, mtime, size, hash) bears out."""
    entries = readable(cache)
    return entries.join(store.stale(entries, listing), "path", "left_anti")


def cached_or_parsed(files: DataFrame, cache: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """path, hash, parsed, cached: from the cache (hash, parsed) where it has the content, else parsed now.

    `parse` turns files (path, content, hash) into (path, parsed); it gets only what the cache lacks.
    """
    hashed = files.select("path", "content", F.sha2("content", 256).alias("hash"))
    known = readable(cache).select("hash", "parsed").dropDuplicates(["hash"])
    found = hashed.select("path", "hash").join(known.hint("merge"), "hash").withColumn("cached", F.lit(True))
    # contents move once, and are written: a parser reads them again for each language. They may be few bytes and much work, so their
    # parts are not merged by size
    parts = 4 * files.sparkSession.sparkContext.defaultParallelism
    fresh = checkpointed(hashed.repartition(parts, "hash").join(known.select("hash").hint("merge"), "hash", "left_anti"))
    new = fresh.select("path", "hash").join(parse(fresh).hint("merge"), "path").withColumn("cached", F.lit(False))
    columns = ["path", "hash", "parsed", "cached"]
    return found.select(*columns).unionByName(new.select(*columns))


def stats(cache: DataFrame) -> DataFrame:
    """entries, total_bytes, shown (the lines of a report)."""
    counted = cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_bytes"))
    shown = F.concat(F.lit(f"Cache Statistics:\n  Version: {FORMAT}\n  Entries: "), F.col("entries").cast("string"), F.lit("\n  Total source size: "), F.col("total_bytes").cast("string"), F.lit(" bytes"))
    return counted.withColumn("shown", shown)


def summaries(actions: DataFrame, affected: DataFrame) -> DataFrame:
    """Actions (workspace, id, command) with category, n_files and summary; affected: workspace, id, path."""
    counts = affected.groupBy("workspace", "id").agg(F.count("*").alias("n_files"))
    n = F.coalesce("n_files", F.lit(0))
    rows = actions.join(counts, ["workspace", "id"], "left")
    return rows.select("workspace", "id", "command", category(F.col("command")).alias("category"), n.alias("n_files"), F.concat("command", F.lit(": "), n.cast("string"), F.lit(" file(s)")).alias("summary"))


def category(command: Column) -> Column:
    """Whether a command changes the project."""
    return F.when(command.isin("veil", "unveil", "apply", "restore", "checkpoint", "gc", "clean"), "operation").otherwise("meta")


def log_level(*wanted: Column) -> Column:
    """The first of several wishes that is a level, in small letters; warn without one."""
    known = [F.when(F.lower(w).isin("trace", "debug", "info", "warn", "error", "off"), F.lower(w)) for w in wanted]
    return F.coalesce(*known, F.lit("warn"))
