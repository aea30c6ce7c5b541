"""Results and errors as JSON, one object a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treequarry.functions.codes import error_code


def results(rows: DataFrame) -> DataFrame:
    """json: each row with its columns in order; the first names the command."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def errors(failed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, json: what failed (kind, message) with its code."""
    shown = F.struct(F.lit(True).alias("error"), error_code(F.col("kind")).alias("code"), F.col("message").alias("message"))
    return failed.select(*keys, F.to_json(shown).alias("json"))
