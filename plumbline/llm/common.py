"""Session, scratch-table and join helpers shared by the operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch handed to a Python worker.  Two workers of an executor hold a few batches each.
ARROW_BATCH_BYTES = 1 << 20
ARROW_BATCH_ROWS = 1000

#: Narrow rows that may be broadcast: about 16 MB of them.
BROADCAST_ROWS = 1_000_000

_own_folder: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark runs in one process."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once to the shared folder: cut lineage that outlives lost executors.

    ``drop_scratch`` removes all such tables of the application.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table that ``written`` made in this application; call it once the results are stored."""
    _delete(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")


def drop(stored: DataFrame) -> None:
    """Delete a table that ``written`` made; call it once all that is derived from it is stored."""
    for file in stored.inputFiles()[:1]:
        _delete(stored.sparkSession, file.rsplit("/", 1)[0])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    with contextlib.suppress(Exception):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with small batches, so that a worker's memory follows the batch and not the partition."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def small_enough(stored: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table of narrow rows (ids, hashes) may be broadcast: the check of its size."""
    return stored.count() <= rows


def whole_numbers(df: DataFrame, column: str) -> None:
    """Raises where a column that is to order or name rows is no whole number."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        raise TypeError(f"{column} must be a whole number, not {df.schema[column].dataType.simpleString()}")
