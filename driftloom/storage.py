"""The shared folder for checkpoints, and cutting lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    A session on one machine that names none gets a new temporary folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="driftloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows of a checkpoint's file at least, where their number is known.
ROWS_A_FILE = 20_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows from a reliable checkpoint: later plans start here and survive lost executors.

    Used where a small or expensive intermediate is read several times, because every reader would
    otherwise repeat the whole plan above it. ``rows`` is about the number of rows, if known: few rows go to
    few files. A file costs more than its rows then, on local disks a process or two of the executor for its permissions.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).checkpoint()
