"""Spark sessions."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "plumbline", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; a cluster's own settings for size and folders stand."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, for plans that use it several times: a checkpoint in the shared folder where the session has
    one, which outlives lost executors, else cached."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


_own_folder: str | None = None


def scratch_folder(spark: SparkSession) -> str:
    """A folder for files of this session in ``spark.checkpoint.dir``; a temporary one only where Spark runs in one process."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, as a table in the scratch folder whose size Spark knows when it plans a join; cached where there is no folder."""
    spark = df.sparkSession
    try:
        path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    except ValueError:
        return df.persist()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``stored`` made; call it once all that is derived from it is stored."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1] if not table.is_cached else ():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        with contextlib.suppress(Exception):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
