"""Latest wins, as a stream: results that come back out of order are dropped once a newer one of their key was seen.

:func:`newest` remembers for each key the greatest sequence number, in state that
expires when the key is idle.  :func:`publish` writes each micro-batch to a folder
of its own number, so a batch that runs again after a failure overwrites itself;
:func:`published` reads what stands, whatever state had expired meanwhile.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from lexiforge.streaming.keystrokes import latest

#: Settings of a session that runs :func:`newest`: the store that can expire state, and no micro-batches
#: without data, which would follow each other without end and write an empty folder each.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
IDLE_MS = 24 * 3600 * 1000


class DropStale(StatefulProcessor):
    """Gives the newest row of a key in a micro-batch, if it is newer than all before."""

    def __init__(self, seq: str, columns: list[str], idle_ms: int) -> None:
        self.seq, self.columns, self.idle_ms = seq, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("seq", LongType())]), self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = None
        for batch in rows:
            batch = batch[batch[self.seq].notna()]
            if len(batch):
                row = batch.loc[[batch[self.seq].idxmax()], self.columns]
                if best is None or row[self.seq].iat[0] > best[self.seq].iat[0]:
                    best = row
        if best is None:
            return
        seq = int(best[self.seq].iat[0])
        if not self.seen.exists() or seq > self.seen.get()[0]:
            self.seen.update((seq,))
            yield best

    def close(self) -> None:
        pass


def newest(events: DataFrame, key: str, seq: str, *values: str, idle_ms: int = IDLE_MS) -> DataFrame:
    """``(key, seq, *values)`` of a stream: a row for each key and micro-batch that brought a newer one.

    A sequence number names one row of its key: of rows that share it one stands.
    Rows without a number are dropped; a null key is a key.  State is a number a
    key and goes when the key was idle for ``idle_ms``.  The session must have
    ``SETTINGS`` when the query starts.
    """
    columns = [key, seq, *values]
    rows = events.select(*columns).withColumn(seq, events[seq].cast("bigint"))
    return rows.groupBy(key).transformWithStateInPandas(DropStale(seq, columns, idle_ms), rows.schema, "update", "processingTime")


def publish(rows: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start writing a stream of newest rows; with ``once``, what is there now is written and the query ends."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    writer = rows.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def published(spark: SparkSession, folder: str, key: str, seq: str, *values: str) -> DataFrame:
    """The row that stands for each key."""
    return latest(spark.read.parquet(folder), key, seq, *values)
