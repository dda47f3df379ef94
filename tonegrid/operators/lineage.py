"""Where long plans are cut: reliable checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Where none is set, a local session gets a temporary one; on a cluster no folder can be assumed, and that is an error.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if path := spark.conf.get("spark.checkpoint.dir", None):
        if not known.isDefined():
            context.setCheckpointDir(path)
        return path.rstrip("/")
    if not known.isDefined():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """The frame from a reliable checkpoint."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


#: Rows of a task where rows are dealt by their number.
TASK_ROWS = 125_000


def dealt(frame: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The frame by hash of the keys, in tasks of TASK_ROWS rows or so where it has ``rows``.

    Partitions that are joined by their bytes hold millions of short rows, whose tables of groups take many times that.
    """
    return frame.repartition(max(1, math.ceil(rows / TASK_ROWS)), *keys)


#: Tasks of a short table, so that no single one holds all of it.
FEWEST = 4


def fewer(frame: DataFrame, rows: int) -> DataFrame:
    """The frame in tasks of TASK_ROWS rows or so where it has ``rows``, or in those that it has if they are fewer.

    Every task of a shuffle writes files of its own; a table of some thousand links over hundreds of tasks is mostly files.
    """
    return frame.coalesce(max(FEWEST, math.ceil(rows / TASK_ROWS)))


def cut_short(frame: DataFrame) -> DataFrame:
    """The frame from a reliable checkpoint, read in as few tasks as ``fewer`` deals out; for rows of some bytes."""
    short = cut(frame)
    return fewer(short, short.count())


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet, in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
