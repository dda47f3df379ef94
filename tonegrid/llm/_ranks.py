"""Ranks within groups, however large a group is: sorted ranges number their own rows, and range starts are added."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tonegrid.operators.lineage import cut


def _differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays differ; nulls are equal to each other."""
    plain = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(plain, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _numbered(batches, group: str):
    """Adds to sorted rows: the partition, the number of the row's run of one group, and the place in that run."""
    part, last, run, length = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        if not (n := batch.num_rows):
            continue
        groups = batch.column(group)
        new = np.ones(n, dtype=bool)
        new[1:] = _differ(groups[1:], groups[:-1])
        if last is not None:
            new[:1] = _differ(groups[:1], last)
        place = np.arange(n)
        start = np.maximum.accumulate(np.where(new, place, -1))
        at, runs = np.where(start >= 0, place - start, place + length), run + np.cumsum(new)
        last, run, length = groups[-1:], int(runs[-1]), int(at[-1]) + 1
        added = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(runs.astype(np.int64)), pa.array(at.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "_part", "_run", "_at"])


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``rank`` (long): the place of a row in its ``group`` by ``order``, ascending, nulls first; nulls are one group.

    Rows are dealt by ranges of (group, order, a number of the row), so neither a large group nor many equal rows meet
    in one task. Rows equal in group and order get their ranks in no stated order. The result is cut from its lineage.
    What is broadcast has a row for each partition. Column names with a leading underscore are taken.
    """
    keys = [group, *order]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys, "_row").sortWithinPartitions(*keys).drop("_row")
    added = [StructField("_part", IntegerType()), StructField("_run", LongType()), StructField("_at", LongType())]
    numbered = cut(dealt.mapInArrow(lambda batches: _numbered(batches, group), StructType([*dealt.schema.fields, *added])))

    place = F.struct("_run", "_at")
    parts = numbered.groupBy("_part").agg(F.min_by(group, place).alias("first"), F.max_by(group, place).alias("last"), F.max("_run").alias("runs"), (F.max_by("_at", place) + 1).alias("length"))
    by_part = Window.orderBy("_part")
    goes_on = F.coalesce(F.col("first").eqNullSafe(F.lag("last").over(by_part)) & F.lag("_part").over(by_part).isNotNull(), F.lit(False))
    parts = parts.withColumn("goes_on", goes_on).withColumn("chain", F.sum((~F.col("goes_on") | (F.col("runs") > 1)).cast("int")).over(by_part))
    parts = parts.withColumn("so_far", F.sum("length").over(Window.partitionBy("chain").orderBy("_part")))
    starts = parts.select("_part", F.when(F.col("goes_on"), F.lag("so_far").over(by_part)).otherwise(F.lit(0)).alias("_start"))
    rank = F.col("_at") + F.when(F.col("_run") == 1, F.col("_start")).otherwise(F.lit(0))
    return numbered.join(F.broadcast(starts), "_part").select(*rows.columns, rank.alias("rank"))
