"""Tailing a changelog: the live state of a stream of versions.

State holds the newest (seq, op, value) of each key. Lateness is a matter of
``seq``, not of arrival: a version older than the one held changes nothing.
Tombstones stay in the state, or an older put would come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import CHANGELOG

OUTPUT = "key binary, seq long, op byte, value binary"


class Newest(StatefulProcessor):
    """Emits a key's version whenever a newer one arrives."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("newest", "seq long, op byte, value binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = self.held.get() if self.held.exists() else None
        before = best
        for part in rows:
            row = part.loc[part["seq"].idxmax()]
            if best is None or int(row["seq"]) > best[0]:
                best = int(row["seq"]), int(row["op"]), row["value"]
        if best is not None and best is not before:
            self.held.update(best)
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "op": [best[1]], "value": [best[2]]})

    def close(self) -> None:
        pass


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """New files of a changelog folder as a stream."""
    return spark.readStream.schema(CHANGELOG).parquet(path)


def newest_stream(changes: DataFrame) -> DataFrame:
    """(key, seq, op, value) in update mode: each key's newest version. Needs the
    RocksDB state store (``use_state_store``)."""
    return changes.groupBy("key").transformWithStateInPandas(Newest(), OUTPUT, "Update", "None")


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live_view(changes: DataFrame) -> DataFrame:
    """The same as a streaming aggregation, for complete mode: built in, with
    partial sums, and without Python."""
    from pyspark.sql import functions as F

    return changes.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("v")).select("key", "seq", "v.op", "v.value")


def publish(view: DataFrame, path: str, progress: str, name: str) -> None:
    """Run a stream of whole results to the end of what is there; the last
    result is a Parquet folder. For complete mode."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    view.writeStream.outputMode("complete").foreachBatch(put).queryName(name).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
