"""Lineage cuts in the folder that the session names for all executors; Arrow functions by steps."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that are Python objects at a time, within an Arrow batch.
STEP = 64


def by_steps(make: Callable, kind: pa.DataType, name: str):
    """An Arrow function of type ``name``: what ``make`` gives for each row's value (a struct's: its fields), a few rows at a time.

    A worker then holds an Arrow batch, whose bytes Spark bounds, and the objects of STEP rows, not
    those of a whole batch: its memory doesn't grow with the rows of a task.
    """

    @F.arrow_udf(name)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for at in range(0, len(b), STEP):
                part = b.slice(at, STEP)
                rows = zip(*(c.to_numpy(zero_copy_only=False) for c in (part.flatten() if pa.types.is_struct(part.type) else [part])))
                yield pa.array([make(*r) for r in rows], kind)

    return run


def cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():  # only where the session sets none, on one machine
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexloom-"))
    return df.checkpoint(eager=True)


def ranked(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``name``: the row's number from 1 among those with its ``by``, in ``order``; a hot value is no single window.

    Rows are sorted by range over the cluster, numbered within each range, and what earlier ranges
    have of a value is added. The ranges are cut to the shared folder, so that they don't change.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))
    counts = rows.groupBy("_range", *by).agg(F.count("*").alias("_had"))
    before = F.sum("_had").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(F.col("_range").alias("_r2"), *(F.col(b).alias(f"_b{i}") for i, b in enumerate(by)), F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r2")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    own = F.row_number().over(W.partitionBy("_range", *by).orderBy(*order))
    return rows.withColumn("_own", own).join(counts, same).withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)
