"""Helpers the operators share: Arrow mapping, the shared folder, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: White space of every contract here: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that are Python objects at a time, within an Arrow batch.
STEP = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (local tests) a folder of this machine
    is set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """Where this application writes its tables and files."""
    return f"{shared_dir(spark)}/lexloom-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Deletes all that this application wrote there; call it once its results have been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(path: str):
    """A ``pyarrow`` file system and the path within it, of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder and cuts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet to the shared folder and reads it again; columns can then be pruned."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def utf8(column: str = "text") -> Column:
    """The text as bytes, null as empty: Python then decodes only where it needs to."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b"")).alias(column)


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """``make()`` runs once a task and returns a function from column lists to column lists."""
    struct = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                out = work(*(c.to_pylist() for c in batch.slice(at, STEP).columns))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, struct)


#: The largest groups, whose owners are broadcast: so many at most.
HOT = 1000


def attach(rows: DataFrame, on: str, owners: DataFrame, key: str, values: tuple[str, ...], count: str) -> DataFrame:
    """Left-joins ``owners`` (one row a key, ``count`` rows of ``rows`` each) to ``rows``; both keys are binary.

    The HOT largest groups are broadcast and their rows spread over the shuffle, so that no key of
    it has more than a HOT-th of the rows.
    """
    hot = owners.where(F.col(count) > 1).orderBy(F.desc(count), key).limit(HOT).select(F.col(key).alias("_hk"), *(F.col(v).alias(f"_h_{v}") for v in values))
    cold = owners.select(F.col(key).alias("_ck"), *(F.col(v).alias(f"_c_{v}") for v in values))
    met = rows.join(F.broadcast(hot), F.col(on) == F.col("_hk"), "left")
    spread = F.when(F.col("_hk").isNull(), F.col(on)).otherwise(F.concat(F.lit("hot"), F.monotonically_increasing_id().cast("string")).cast("binary"))
    met = met.withColumn("_jk", spread).join(cold, F.col("_jk") == F.col("_ck"), "left")
    return met.select(*rows.columns, *(F.coalesce(f"_h_{v}", f"_c_{v}").alias(v) for v in values))
