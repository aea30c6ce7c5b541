"""A session with the settings that the operators assume; on a cluster its own settings take over the sizes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch handed to Python; a batch ends where it reaches either. Documents can be very long.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def session(app: str = "treequarry", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution are part of the semantics and of the plans; everything else can be set freely."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local sessions without one, a temporary folder."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if context._jsc.sc().getCheckpointDir().isDefined():
            return context._jsc.sc().getCheckpointDir().get()
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="treequarry-")
        context.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared root."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of each Arrow batch, and so the memory of a Python worker.

    These are settings of the session, and stay; only larger values are lowered.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.fullmatch("([0-9]+)b?", spark.conf.get(key))
        if now is None or int(now[1]) > most:
            spark.conf.set(key, str(most))
