"""Columns of texts, hashes, modes and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = r"^\.\.\.\[[0-9a-f]+\]\.{0,3}$"
HASH = "^[0-9a-fA-F]{7,64}$"


def lines(content: Column) -> Column:
    """An array of lines: a line end at the end opens no further line, and an empty text has none."""
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(content, r"\r?\n\z", ""), r"\r?\n"))


def estimated_tokens(content: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(content) / 4).cast("long")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def hash_parts(digest: Column) -> list[Column]:
    """Short form, and the three parts of its place in the store."""
    return [F.substring(digest, 1, 7).alias("short"), F.substring(digest, 1, 2).alias("first"), F.substring(digest, 3, 2).alias("second"), F.substring(digest, 5, 60).alias("rest")]


def is_marker(line: Column) -> Column:
    return line.rlike(MARKER)


def is_hash(text: Column) -> Column:
    return text.rlike(HASH)


def is_legacy_marker(content: Column) -> Column:
    return content == "...\n"


def mode_bits(mode: Column) -> Column:
    """The number of an octal mode; what is not octal counts as 644."""
    return F.when(mode.rlike("^[0-7]+$"), F.conv(mode, 8, 10).cast("long")).otherwise(F.lit(0o644)).cast("long")


def mode_text(bits: Column) -> Column:
    return F.conv(bits.bitwiseAND(F.lit(0o777)).cast("string"), 10, 8)


def version_parts(version: Column) -> Column:
    """Three numbers, without a leading v; each part ends at its first hyphen. Null with more or fewer parts, as `1.0.0-rc.1` has."""
    parts = F.transform(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda x: F.substring_index(x, "-", 1))
    return F.when((F.size(parts) == 3) & F.forall(parts, lambda x: x.rlike("^[0-9]+$")), F.transform(parts, lambda x: x.try_cast("long")))


def is_newer(version: Column, than: Column) -> Column:
    a, b = version_parts(version), version_parts(than)
    return F.coalesce((a[0] > b[0]) | ((a[0] == b[0]) & ((a[1] > b[1]) | ((a[1] == b[1]) & (a[2] > b[2])))), F.lit(False))


def truncated(text: Column, most: int) -> Column:
    """The longest prefix of at most so many bytes of UTF-8 that breaks no character."""
    data = F.encode(text, "UTF-8")
    # a character has four bytes at most, and those after its first are 10xxxxxx
    whole = lambda n: ~F.hex(F.substring(data, n + 1, 1)).rlike("^[89AB]")
    at = F.lit(max(most - 3, 0))
    for n in range(max(most - 2, 0), most + 1):
        at = F.when(whole(n), n).otherwise(at)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(data, F.lit(1), at), "UTF-8"))
