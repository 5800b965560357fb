"""Session helpers: cutting lineage and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> None:
    """Make sure that the session has a checkpoint folder; one of our own only where none is set on one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftgraph-"))


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder: lineage is cut and lost executors cost nothing."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def maybe_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint when a counted check shows that it has at most ``rows`` rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
