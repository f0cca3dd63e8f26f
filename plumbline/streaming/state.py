"""Ingest with state: the newest record of each identity is kept in the state store, and only changes go on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plumbline.functions import text as T
from plumbline.operators import records
from plumbline.sources.files import RECORD_SCHEMA

#: The state store that holds values with a time to live; with one, empty batches would follow without end.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
HELD = "version string, at double, record string"


class NewestRecord(StatefulProcessor):
    """Holds the newest record of a key: highest version, then latest time, then first come; of one batch, least text."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("newest", HELD, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:
            for version, at, record in zip(frame["version"], frame["at"], frame["record"], strict=True):
                if best is None or (version, at) > best[:2] or ((version, at) == best[:2] and record < best[2]):
                    best = (version, at, record)
        held = self.held.get() if self.held.exists() else None
        if best is not None and (held is None or best[:2] > tuple(held)[:2]):
            self.held.update(best)
            yield pd.DataFrame({"identity": [key[0]], "version": [best[0]], "at": [best[1]], "record": [best[2]], "replaces": [held is not None]})

    def close(self) -> None:
        pass


def changes(stream: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """The records of a stream that are new or newer than what their identity had, as ``identity``, ``version``, ``at``,
    ``record`` (JSON) and ``replaces``; a record that is older, or equal in version and time, gives nothing.

    One value for each identity is held, ``keep_ms`` milliseconds long after its last change where given; an identity that
    has expired is new again.  Each batch costs what its own rows cost.  A batch's rows of one key come to one task, which
    keeps only the best of them.
    """
    version = F.coalesce(T.version(F.col("eval_library.version")), F.array().cast("array<int>"))
    # Numbers of one width, so that texts are in the order of the arrays.
    padded = F.array_join(F.transform(version, lambda x: F.lpad(x.cast("string"), 10, "0")), ".")
    fields = [c for c in stream.columns if c != "arrived"]
    slim = stream.select(F.to_json(records.storage_key(), {"ignoreNullFields": "false"}).alias("identity"), padded.alias("version"), T.epoch(F.col("retrieved_timestamp")).alias("at"), F.to_json(F.struct(*fields)).alias("record"))
    return slim.groupBy("identity").transformWithStateInPandas(NewestRecord(keep_ms), f"identity string, {HELD}, replaces boolean", "append", "processingTime" if keep_ms else "none")


def keep_changes(stream: DataFrame, store: str, checkpoint: str, keep_ms: int | None = None) -> StreamingQuery:
    """Adds the changes of a stream to a store of files, each once whatever fails and is run again."""
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in SETTINGS}
    try:
        for name, value in SETTINGS.items():
            conf.set(name, value)
        return changes(stream, keep_ms).writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        # A query takes the settings of its start.
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def current(spark: SparkSession, store: str) -> DataFrame:
    """The records of a store of changes that nothing newer has replaced; among equals, the one of least text."""
    rows = spark.read.parquet(store)
    newest = rows.groupBy("identity").agg(F.max(F.struct("version", "at")).alias("_best"))
    last = rows.join(newest, "identity").where(F.struct("version", "at") == F.col("_best")).groupBy("identity").agg(F.min("record").alias("record"))
    return last.select(F.from_json("record", RECORD_SCHEMA).alias("r")).select("r.*")
