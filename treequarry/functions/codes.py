"""Parsers of ranges and policy entries as columns, and error codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of error, in the order of the codes from E001.
ERRORS = (
    "RelativePath",
    "HiddenFileWithoutPath",
    "SymlinkOutsideProject",
    "BinaryFilePartialVeil",
    "BinaryFileVeil",
    "DirectoryContainsBinary",
    "InvalidCheckpointName",
    "DirectoryWithLineRanges",
    "InvalidLineRange",
    "OverlappingRanges",
    "EmptyFile",
    "AlreadyVeiled",
    "OverlappingVeil",
    "MarkerCollision",
    "MarkerIntegrityError",
    "NotVeiled",
    "ObjectNotFound",
    "ConfigFileProtected",
    "DataDirectoryProtected",
    "VcsDirectoryExcluded",
    "InvalidRegex",
    "InvalidHash",
    "Io",
    "Yaml",
    "CheckpointNotFound",
    "CorruptedMarker",
    "ParseError",
    "TreeSitterError",
    "CacheError",
    "PatchMismatch",
    "PartialRestore",
    "HistoryEmpty",
    "NothingToRedo",
    "ActionNotUndoable",
    "HashCollision",
)
RANGES = r"[0-9]+-[0-9]+(,[0-9]+-[0-9]+)*"


def error_code(kind: Column) -> Column:
    """E001 to E035; E000 for what is not known."""
    return F.concat(F.lit("E"), F.lpad(F.coalesce(F.array_position(F.array(*map(F.lit, ERRORS)), kind), F.lit(0)).cast("string"), 3, "0"))


def line_range(text: Column) -> Column:
    """`a-b` as a struct (s, e), counted from 1; both null where the order is wrong or it has another form."""
    s = F.regexp_extract(text, "^([0-9]+)-[0-9]+$", 1).try_cast("long")
    e = F.regexp_extract(text, "^[0-9]+-([0-9]+)$", 1).try_cast("long")
    good = (s >= 1) & (s <= e)
    return F.struct(F.when(good, s).alias("s"), F.when(good, e).alias("e"))


def overlapping(ranges: Column) -> Column:
    """Whether ranges (an array of (s, e)) overlap."""
    ordered = F.array_sort(ranges)
    pairs = F.zip_with(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 2, F.size(ordered)), lambda a, b: a["e"] >= b["s"])
    return F.exists(pairs, lambda x: x)


def policy_entries(entries: DataFrame, column: str = "entry") -> DataFrame:
    """Adds error, kind (literal, regex), pattern and ranges (as text); the first error counts.

    `./x` and `../x` are relative, `.x` is hidden. `/body/` or `/body/#ranges` is a regex. Otherwise what follows the
    last # is ranges if it has their form, and else part of the path. A directory takes no ranges.
    """
    e = F.col(column)
    is_regex = F.startswith(e, F.lit("/"))
    with_ranges = e.rlike(f"^/(.+)/#{RANGES}$")
    body = F.when(with_ranges, F.regexp_extract(e, f"^/(.+)/#{RANGES}$", 1)).otherwise(F.regexp_extract(e, "^/(.+)/$", 1))
    literal_ranges = F.when(e.rlike(f"#{RANGES}$"), F.regexp_extract(e, f"#({RANGES})$", 1))
    ranges = F.when(is_regex, F.when(with_ranges, F.regexp_extract(e, f"/#({RANGES})$", 1))).otherwise(literal_ranges)
    pattern = F.when(is_regex, body).when(literal_ranges.isNotNull(), F.regexp_replace(e, "#[^#]*$", "")).otherwise(e)
    listed = F.transform(F.split(ranges, ","), line_range)
    error = (
        F.when(F.startswith(e, F.lit("./")) | F.startswith(e, F.lit("../")), "E001")
        .when(F.startswith(e, F.lit(".")), "E002")
        .when(is_regex & (body == ""), "E021")
        .when(~is_regex & F.endswith(pattern, F.lit("/")) & ranges.isNotNull(), "E008")
        .when(F.exists(listed, lambda r: r["s"].isNull()), "E009")
        .when(overlapping(listed), "E010")
    )
    good = lambda c: F.when(F.col("error").isNull(), c)
    return entries.withColumn("error", error).withColumn("kind", good(F.when(is_regex, "regex").otherwise("literal"))).withColumn("pattern", good(pattern)).withColumn("ranges", good(ranges))
