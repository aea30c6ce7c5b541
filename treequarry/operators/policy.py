"""What is hidden: ordered lists of patterns with line ranges, the markers that stand for hidden lines, restoring.

Policies: list (black or white), ord, kind (file, dir, regex), pattern, ranges (an array of (s, e), null for all lines).
Patterns meet each distinct path once. A few become one expression; of more, files and folders meet paths in an equi join (a
path has few folders), and so do regular expressions: each is filed under the rarest of the short pieces that it demands of a
path, and meets the paths that hold this piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treequarry.functions.patterns import KEY, keys
from treequarry.operators import intervals
from treequarry.operators.graph import checkpointed

#: Entries that are put into one expression; entries with their ranges that are broadcast. Larger ones are joined by shuffle.
FEW, BROADCAST_ROWS = 32, 100_000
POLICY = "list string, ord long, kind string, pattern string, ranges array<struct<s:long,e:long>>"
OWN = ["path", "list", "ord", "ranges"]


def _small(df: DataFrame, ranges: Column) -> DataFrame:
    """To be broadcast, if rows and the ranges in them are few enough; written first, as it is read twice."""
    df = checkpointed(df)
    weight = df.agg(F.sum(1 + F.coalesce(F.greatest(F.size(ranges), F.lit(0)), F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if weight <= BROADCAST_ROWS else df


def matches(paths: DataFrame, policy: DataFrame) -> DataFrame:
    """(path, list, ord, ranges) for each entry that fits a path; a directory's pattern ends in a slash."""
    p = paths.select("path").distinct()
    few = policy.select("list", "ord", "kind", "pattern", "ranges").limit(FEW + 1).collect()
    return _together(p, few) if len(few) <= FEW else _located(p, policy).unionByName(_filed(p, policy))


def _together(p: DataFrame, entries: list) -> DataFrame:
    """All entries as one expression over the path."""
    fits = {"file": lambda e: F.col("path") == e["pattern"], "dir": lambda e: F.lit(e["pattern"].endswith("/")) & F.startswith("path", F.lit(e["pattern"])), "regex": lambda e: F.rlike("path", F.lit(e["pattern"]))}
    ranges = lambda e: F.lit(None) if e["ranges"] is None else F.array(*[F.struct(F.lit(r["s"]).alias("s"), F.lit(r["e"]).alias("e")) for r in e["ranges"]])
    out = [F.when(fits[e["kind"]](e), F.struct(F.lit(e["list"]).alias("list"), F.lit(e["ord"]).cast("long").alias("ord"), ranges(e).cast("array<struct<s:bigint,e:bigint>>").alias("ranges"))) for e in entries if e["kind"] in fits and e["pattern"] is not None]
    none = F.array().cast("array<struct<list:string,ord:bigint,ranges:array<struct<s:bigint,e:bigint>>>>")
    return p.select("path", F.inline(F.filter(F.array(*out) if out else none, lambda x: x.isNotNull())))


def _located(p: DataFrame, policy: DataFrame) -> DataFrame:
    """Files and folders: a path meets its own name and those of its folders."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    places = F.when(F.size(parts) > 1, F.concat(F.array("path"), folders)).otherwise(F.array("path"))
    entries = _small(policy.filter("kind in ('file', 'dir')"), F.col("ranges"))
    return p.select("path", F.explode(places).alias("pattern")).join(entries, "pattern").filter("(kind = 'dir') = endswith(pattern, '/')").select(*OWN)


def _filed(p: DataFrame, policy: DataFrame) -> DataFrame:
    """Regular expressions, by the piece that fewest of them share. Those that demand nothing meet every path, and are dealt to
    as many groups as hold a bounded number each."""
    regex = policy.filter("kind = 'regex' and pattern is not null").select("list", "ord", "pattern", "ranges")

    def with_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(keys=[keys(x) for x in batch["pattern"]])

    pieces = checkpointed(regex.select("pattern").distinct().mapInPandas(with_keys, "pattern string, keys array<string>").select("pattern", F.explode("keys").alias("key")))
    shared = pieces.groupBy("key").agg(F.count("*").alias("n"))
    filed = pieces.join(shared, "key").groupBy("pattern").agg(F.min(F.struct("n", "key")).alias("best")).select("pattern", F.col("best.key").alias("key"))
    free = filed.filter("key = ''").count()
    groups = -(-free // BROADCAST_ROWS) or 1
    filed = filed.withColumn("group", F.when(F.col("key") == "", F.pmod(F.xxhash64("pattern"), F.lit(groups))).otherwise(0).cast("int"))
    entries = _small(regex.join(filed, "pattern"), F.col("ranges"))
    sizes = [r[0] for r in entries.select(F.length("key")).distinct().collect()]  # at most KEY + 1 numbers
    of_size = lambda n: F.array(F.lit("")) if not n else F.when(F.length("path") >= n, F.transform(F.sequence(F.lit(1), F.length("path") - n + 1), lambda i: F.substring("path", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(*[of_size(n) for n in sizes if n <= KEY])) if sizes else F.array().cast("array<string>")
    held = p.select("path", F.explode(found).alias("key")).withColumn("group", F.explode(F.when(F.col("key") == "", F.sequence(F.lit(0), F.lit(groups - 1))).otherwise(F.array(F.lit(0)))))
    return held.join(entries, ["key", "group"]).filter(F.rlike("path", F.col("pattern"))).select(*OWN)


def hidden_lines(lines: DataFrame, policy: DataFrame, whitelist: bool, files: DataFrame | None = None) -> DataFrame:
    """Lines (path, line_no) with hidden. `files` (path) spares a pass over the lines where it is known.

    Without a whitelist, the first blacklist entry that fits the path decides, even where its ranges miss the line.
    With one, any blacklist entry that covers the line hides it; else the first whitelist entry that fits decides;
    else it is hidden. A path keeps only what decides: the ranges of its first entry of a list, or all that hide.
    """
    of = lambda name: F.col("list") == name
    first = lambda name: F.min(F.when(of(name), F.struct("ord", "ranges")))["ranges"]
    every = F.flatten(F.collect_list(F.when(of("black"), F.col("ranges"))))
    whole = F.bool_or(of("black") & F.col("ranges").isNull())
    black = F.when(~F.coalesce(whole, F.lit(False)), every) if whitelist else first("black")
    lists = matches(files if files is not None else lines, policy).groupBy("path").agg(
        F.bool_or(of("black")).alias("in_black"), black.alias("black"), F.bool_or(of("white")).alias("in_white"), (first("white") if whitelist else F.lit(None).cast("array<struct<s:bigint,e:bigint>>")).alias("white")
    )
    rows = lines.select("path", "line_no").join(_small(lists, F.concat(*[F.coalesce(c, F.array()) for c in ("black", "white")])), "path", "left")
    covers = lambda c: F.col(c).isNull() | F.exists(c, lambda r: F.col("line_no").between(r["s"], r["e"]))
    in_black, in_white = (F.coalesce(c, F.lit(False)) for c in ("in_black", "in_white"))
    hidden = in_black & covers("black")
    if whitelist:
        hidden = hidden | ~(in_white & covers("white"))
    return rows.select("path", "line_no", hidden.alias("hidden"))


def overlaps(ranges: DataFrame) -> DataFrame:
    """Pairs of different ranges (path, s, e) of a path that overlap."""
    a = ranges.distinct()
    b = a.select(F.col("path").alias("o_path"), F.col("s").alias("o_s"), F.col("e").alias("o_e"))
    before = (F.col("s") < F.col("o_s")) | ((F.col("s") == F.col("o_s")) & (F.col("e") < F.col("o_e")))
    return a.join(b, (F.col("path") == F.col("o_path")) & (F.col("s") <= F.col("o_e")) & (F.col("o_s") <= F.col("e")) & before).drop("o_path")


def range_hashes(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """path, s, e, content, hash (its first 7 digits) of what each range hides."""
    held = lines.join(intervals.numbers(ranges, lines, "path", "s", "e", "line_no"), ["path", "line_no"])
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return held.groupBy("path", "s", "e").agg(content.alias("content")).withColumn("hash", F.substring(F.sha2("content", 256), 1, 7))


def marker(start: Column, end: Column, line: Column, digest: Column) -> Column:
    """What stands for a hidden line: the hash on the first (with dots after it if that is the only one), then nothing."""
    return F.when(line != start, "").when(start == end, F.concat(F.lit("...["), digest, F.lit("]..."))).otherwise(F.concat(F.lit("...["), digest, F.lit("]")))


def rendered(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines (path, line_no, text) with markers in place of what the ranges hide."""
    hashed = range_hashes(lines, ranges).select("path", "s", "e", "hash")
    joined = lines.join(intervals.numbers(hashed, lines, "path", "s", "e", "line_no"), ["path", "line_no"], "left")
    shown = F.when(F.col("hash").isNull(), F.col("text")).otherwise(marker(F.col("s"), F.col("e"), F.col("line_no"), F.col("hash")))
    return joined.select("path", "line_no", shown.alias("text"))


def restored(shown: DataFrame, stored: DataFrame, only: Column | None = None) -> DataFrame:
    """Lines with the stored ranges (path, s, e, content) put back; `only` chooses ranges by s and e."""
    back = stored.filter(only) if only is not None else stored
    put = back.select(F.col("path").alias("r_path"), "s", F.posexplode(F.split("content", "\n")).alias("i", "was")).select("r_path", (F.col("s") + F.col("i")).alias("r_line"), "was")
    joined = shown.join(put, (F.col("path") == F.col("r_path")) & (F.col("line_no") == F.col("r_line")), "left")
    return joined.select("path", "line_no", F.coalesce("was", "text").alias("text"))


def broken_markers(shown: DataFrame, stored: DataFrame) -> DataFrame:
    """Ranges (path, s, e) whose first line is not the marker of their content."""
    want = stored.select(F.col("path").alias("r_path"), "s", "e", F.substring(F.sha2("content", 256), 1, 7).alias("hash"))
    joined = want.join(shown, (F.col("path") == F.col("r_path")) & (F.col("line_no") == F.col("s")), "left")
    right = F.col("text").eqNullSafe(marker(F.col("s"), F.col("e"), F.col("s"), F.col("hash")))
    return joined.filter(~right).select(F.col("r_path").alias("path"), "s", "e")


def contents(lines: DataFrame) -> DataFrame:
    """path, content: lines joined again."""
    return lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("content"))


def numbered(lines: DataFrame) -> DataFrame:
    """path, line_no, shown: the number to the right of four places, then a bar."""
    number = F.when(F.length(F.col("line_no").cast("string")) > 4, F.col("line_no").cast("string")).otherwise(F.lpad(F.col("line_no").cast("string"), 4, " "))
    return lines.select("path", "line_no", F.concat(number, F.lit(" | "), "text").alias("shown"))


def sliced(lines: DataFrame, first: int, last: int) -> DataFrame:
    return lines.filter(F.col("line_no").between(first, last))


def windowed_positions(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Hidden lines with their place in the range, from 0."""
    return lines.join(intervals.numbers(ranges, lines, "path", "s", "e", "line_no"), ["path", "line_no"]).select("path", "line_no", (F.col("line_no") - F.col("s")).alias("position"))


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Of each key the row that is last by a column."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by)))).filter("_n = 1").drop("_n")
