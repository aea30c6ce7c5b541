"""What the operators of this subpackage share: reading tables, checkpoints, batch sizes, samples."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from treequarry.session import shared_folder, shared_root, small_batches  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Heads:
    """A sample of bounded size: the first `rows` rows of some partitions; the other tasks read nothing."""

    partitions: frozenset[int]
    rows: int

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = self.rows if TaskContext.get().partitionId() in self.partitions else 0
        while left > 0:
            batch = next(batches, None)
            if batch is None:
                return
            yield batch.iloc[:left]
            left -= len(batch)


def heads(df: DataFrame, rows: int, partitions: int = 16) -> Heads:
    """About `rows` rows from up to `partitions` partitions spread over the table, for what may depend on a sample: speed.

    To be called on the batches of mapInPandas directly after the scan. A task stops its scan after the batch that it needs.
    """
    n = df.rdd.getNumPartitions()
    some = max(1, min(n, partitions))
    return Heads(frozenset(i * n // some for i in range(some)), -(-rows // some))


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the lineage is cut, and the rows survive the loss of any executor."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def with_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Fail early, and clearly, where the column is missing."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r} among {df.columns}")
    return df
