"""Incremental ingest of records, and windowed scores: extensions on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import records
from plumbline.sources.files import RECORD_SCHEMA


def record_stream(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON-lines files as they arrive; the checkpoint keeps which were read, so none is read twice."""
    return spark.readStream.schema(RECORD_SCHEMA).json(path).withColumn("arrived", F.current_timestamp())


def keep_newest(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Adds each batch to a store, reduced to one record for each identity.

    A batch is written under its number alone, whatever the store holds, so its cost is its own; one that is run again
    after a failure writes the same place again.  ``newest`` reads the store, ``compacted`` folds its batches.
    """
    def fold(batch: DataFrame, number: int) -> None:
        # Numbers of a batch lie beyond those of the batches before it.
        order = F.lit(number).cast("decimal(18,0)") * F.lit(str(2**64)).cast("decimal(20,0)") + F.xxhash64("evaluation_id", "retrieved_timestamp", "model_info", "eval_library").cast("decimal(20,0)")
        rows = batch.withColumns({"batch": F.lit(number), "ord": order.cast("decimal(38,0)")})
        records.deduplicated_storage(rows).write.mode("overwrite").parquet(f"{store}/batches/number={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, store: str) -> DataFrame:
    """The newest record of each identity over all batches of a store; among equals the earliest batch's."""
    return records.deduplicated_storage(spark.read.parquet(f"{store}/batches")).drop("number")


def compacted(spark: SparkSession, store: str, into: str) -> None:
    """A new store of one batch with the newest records; the old one can then be removed."""
    newest(spark, store).write.mode("overwrite").parquet(f"{into}/batches/number=0")


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_scores(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean of each event type in tumbling windows; events later than the watermark are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """A row for each user's run of events without a longer gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
