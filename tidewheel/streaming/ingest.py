"""Streams: idempotent ingest, failure streaks as state, daily counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewheel.functions.timewin import ZONE
from tidewheel.operators.store import Store


def idempotent_sink(stream: DataFrame, store: Store, table: str, keys: list[str], stamp: str, seq: str, checkpoint: str) -> DataStreamWriter:
    """Inserts each micro-batch if absent from all truth; a batch that is run again adds nothing."""
    schema = stream.drop(seq).schema

    def write(batch: DataFrame, _: int) -> None:
        store.insert(table, batch, schema, keys, stamp, seq)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class Streak(StatefulProcessor):
    """Errors in a row of each source: another attempt resets, a skipped one is no attempt."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n = self.state.get()[0] if self.state.exists() else 0
        every = pd.concat(list(rows)).sort_values("seq")
        for status in every["status"]:
            n = n if status == "skipped" else n + 1 if status == "error" else 0
        self.state.update((n,))
        yield pd.DataFrame({"source_id": [key[0]], "streak": [n]})

    def close(self) -> None:
        pass


def streaks(log: DataFrame) -> DataFrame:
    """A stream of (source_id, streak) whenever a source has new rows; needs the RocksDB state store."""
    return log.groupBy("source_id").transformWithStateInPandas(Streak(), outputStructType="source_id long, streak long", outputMode="Update", timeMode="None")


def daily_counts(events: DataFrame, lateness: str = "7 days", zone: str = ZONE) -> DataFrame:
    """day, n: events by local calendar day (days of 23 and 25 hours included); later than ``lateness`` are dropped.

    Windows are of local wall-clock time, so each is one calendar day, which the watermark closes at its end.
    """
    local = events.withColumn("at", F.from_utc_timestamp("at", zone)).withWatermark("at", lateness)
    counted = local.groupBy(F.window("at", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.date_from_unix_date(F.floor(F.unix_micros("window.start") / 86_400_000_000).cast("int")).alias("day"), "n")


def trailing_counts(events: DataFrame, days: int = 7, lateness: str = "7 days") -> DataFrame:
    """Counts of sliding windows of ``days``; the exact trailing window at local midnight is a batch query over truth."""
    return events.withWatermark("at", lateness).groupBy(F.window("at", f"{days} days", "1 day")).agg(F.count(F.lit(1)).alias("n"))
