"""Operators over files: which of them patterns mean, ignore rules, scans, binaries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from treequarry.functions import paths as P
from treequarry.operators.graph import checkpointed

#: Ignore files, those that decide first in front.
IGNORE_FILES = (".ignore", ".gitignore")
#: Tasks of a listing or a read at most; rows that a task hands out to those; bytes of a batch that is handed on; the largest file
#: whose content is read.
MOST_TASKS, HANDED_OUT, BATCH_BYTES, LARGEST = 10_000, 5_000, 16 << 20, 1 << 30


def affected(files: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(pattern, path) for patterns (kind, pattern) of kind file, dir, regex or glob; each pair once. One scan serves all."""
    path = F.col("path")
    tests = {"file": lambda x: path == x, "dir": lambda x: F.startswith(path, F.lit(x)), "regex": lambda x: path.rlike(x), "glob": lambda x: path.rlike(P.glob_regex(x))}
    fits = F.array(*[F.when(tests[kind](x), F.lit(x)) for kind, x in patterns]).cast("array<string>")
    return files.select(F.explode(F.array_compact(fits)).alias("pattern"), "path").distinct()


def first_binaries(files: DataFrame) -> DataFrame:
    """folder, first: of each top folder that holds a binary file the first such by path; protected paths do not count."""
    path = F.col("path")
    open_ = ~(P.is_config(path) | P.in_data_dir(path) | P.is_vcs(path))
    found = files.filter(open_ & path.contains("/") & P.is_binary(path, F.col("content")))
    return found.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.min("path").alias("first"))


def empty_lines(files: DataFrame) -> DataFrame:
    """path, any_empty, none_empty: over the lines of each file."""
    parts = F.split("content", "\n")
    return files.select("path", F.exists(parts, lambda x: x == "").alias("any_empty"), F.forall(parts, lambda x: x != "").alias("none_empty"))


def ignore_rules(text: str) -> list[tuple[str, bool, bool]]:
    """Lines of an ignore file as (regex over paths relative to its folder, negated, folders only), in order.

    A slash at the start or inside ties a pattern to the folder; otherwise it fits a name at any depth.
    """
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line.strip() or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = re.sub(r"\\([#! ])", r"\1", line[negated:])
        folder, body = body.endswith("/"), body.rstrip("/")
        if body:
            tied = "/" in body
            rules.append((("^" if tied else "^(.*/)?") + P.glob_regex(body.lstrip("/"))[1:], negated, folder))
    return rules


def is_ignored(path: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """Whether the rules of one ignore file at the root leave a file out. The last rule that fits the path decides; where none
    does, the last that fits its folder, and so on up to the root."""
    parts = F.split(path, "/")

    def verdict(n: Column) -> Column:
        place, out = F.array_join(F.slice(parts, 1, n), "/"), F.lit(None).cast("boolean")
        for regex, negated, folder in rules:
            fits = place.rlike(regex) & (n < F.size(parts)) if folder else place.rlike(regex)
            out = F.when(fits, F.lit(not negated)).otherwise(out)
        return out

    verdicts = F.filter(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), verdict), lambda v: v.isNotNull())
    return F.coalesce(F.try_element_at(verdicts, F.lit(1)), F.lit(False))


def not_ignored(files: DataFrame, rules: list[tuple[str, bool, bool]]) -> DataFrame:
    return files.filter(~is_ignored(F.col("path"), rules))


def opened(place: str) -> tuple[FileSystem, str]:
    """The file system of a place and the path in it; a place without a scheme is local."""
    return FileSystem.from_uri(re.sub("^file:/+", "file:///", place) if ":" in place.split("/")[0] else "file://" + place)


def _fits(rules: list[tuple], path: str, folder: bool) -> bool | None:
    """The verdict of the last rule (base, regex, negated, folders) that fits a path: true leaves it out."""
    for base, regex, negated, folders in reversed(rules):
        if (folder or not folders) and path.startswith(base) and regex.search(path[len(base) :]):
            return not negated
    return None


def _dealt(rows: DataFrame, n: int, each: int) -> DataFrame:
    """n rows in tasks of about `each`. Few tasks hand them out: blocks of a shuffle are as many as its two sides multiplied."""
    return rows.coalesce(max(1, n // HANDED_OUT)).repartition(max(1, min(n // each, MOST_TASKS)))


def walk(spark: SparkSession, root: str, ignore: str = "") -> DataFrame:
    """path (relative), size, modified of all files below a folder that no ignore file leaves out, hidden ones too.

    A level of folders at a time is listed in tasks; nothing of a folder that is left out, or of version control, is listed or
    read. Each folder adds its own ignore files to those above it: the last rule that fits decides, that of the deepest
    file first, `.ignore` before `.gitignore`. `ignore` stands before the root's own rules. A folder is listed by one task.
    A row names the ignore files that hold for its folder; a task reads each of them once.
    """
    marks = "path string, ignores string"

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = opened(root)

        @lru_cache(4096)
        def rules_in(base: str, name: str) -> list[tuple]:
            with system.open_input_stream(f"{top.rstrip('/')}/{base}{name}") as file:
                text = file.read().decode("utf-8", "replace")
            return [(base, re.compile(x), n, f) for x, n, f in ignore_rules(text)]

        @lru_cache(1024)
        def held_by(ignores: str) -> list[list[tuple]]:
            given = [("", re.compile(x), n, f) for x, n, f in ignore_rules(ignore)]
            return [(given if kind == ".gitignore" else []) + [r for base, name in json.loads(ignores) if name == kind for r in rules_in(base, name)] for kind in IGNORE_FILES]

        rows = []
        for batch in batches:
            for folder, ignores in zip(batch["path"], batch["ignores"], strict=True):
                names = {i.base_name: i for i in system.get_file_info(FileSelector(f"{top.rstrip('/')}/{folder}".rstrip("/") or "/"))}
                if own := [[folder, n] for n in IGNORE_FILES if n in names and names[n].type == FileType.File]:
                    ignores = json.dumps(json.loads(ignores) + own)
                by_file = held_by(ignores)
                for name, info in names.items():
                    inner = info.type == FileType.Directory
                    verdicts = [_fits(rules, folder + name, inner) for rules in by_file]
                    if next((v for v in verdicts if v is not None), False) or inner and name + "/" in P.VCS:
                        continue
                    rows.append((folder + name + "/" * inner, inner, info.size or 0, info.mtime, ignores if inner else None))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["path", "folder", "size", "modified", "ignores"])
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["path", "folder", "size", "modified", "ignores"])

    folders, found, size = spark.createDataFrame([("", "[]")], marks), None, 1
    while size:
        level = checkpointed(_dealt(folders, size, 128).mapInPandas(listed, "path string, folder boolean, size long, modified timestamp, ignores string"))
        folders, here = level.filter("folder").select("path", "ignores"), level.filter("not folder").select("path", "size", "modified")
        found = here if found is None else found.unionByName(here)
        size = folders.count()
    return found


def contents(found: DataFrame, root: str) -> DataFrame:
    """Files (path, ...) with content as binary, read in tasks; null for files above 1 GB, which no row can hold safely."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = opened(root)
        for batch in batches:
            start, held, texts = 0, 0, []
            for i, (path, size) in enumerate(zip(batch["path"], batch["size"], strict=True)):
                if size > LARGEST:
                    texts.append(None)
                else:
                    with system.open_input_stream(f"{top.rstrip('/')}/{path}") as file:
                        texts.append(file.read())
                    held += size
                if held > BATCH_BYTES:
                    yield batch.iloc[start : i + 1].assign(content=texts)
                    start, held, texts = i + 1, 0, []
            if texts:
                yield batch.iloc[start:].assign(content=texts)

    return found.mapInPandas(read, StructType([*found.schema.fields, StructField("content", BinaryType())]))


def scan(spark: SparkSession, root: str, ignore: str = "") -> DataFrame:
    """path (relative), content, size, modified of the supported source files that a walk finds. Names come first: only
    files that stay are read."""
    path = F.col("path")
    found = walk(spark, root, ignore).filter(P.supported(path) & ~P.is_vcs(path))
    return contents(_dealt(found, found.count(), 256), root).select("path", F.decode("content", "UTF-8").alias("content"), "size", "modified")


def write_tree(files: DataFrame, root: str) -> None:
    """Write files (path, content) below a folder, in tasks. Writing one twice gives the same file."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = opened(root)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                place = f"{top.rstrip('/')}/{path}"
                system.create_dir(place.rpartition("/")[0], recursive=True)
                with system.open_output_stream(place) as file:
                    file.write((content or "").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("path", "content").mapInPandas(put, "n long").agg(F.sum("n")).collect()
