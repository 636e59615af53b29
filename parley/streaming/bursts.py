"""Bursts found inside the stream: a key's running baseline is state, and a burst comes out when its window closes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.operators.trends import window_counts
from parley.plans.shipping import ship_package

BURSTS = "window_start timestamp, key string, n bigint, baseline double, ratio double"


class RunningBaseline(StatefulProcessor):
    """Takes the windows of a key that closed just now; the state is how often the key was counted before them."""

    def __init__(self, origin: int, window_seconds: int, threshold: float):
        self.origin, self.window_seconds, self.threshold = origin, window_seconds, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = pd.concat(list(rows)).sort_values("start")
        before = self.before.get()[0] if self.before.exists() else 0
        found = []
        for start, name, n in zip(closed["start"].tolist(), closed["key"].tolist(), closed["n"].tolist()):
            earlier = (start - self.origin) / self.window_seconds
            if before and earlier > 0:
                baseline = before / earlier
                if n / baseline >= self.threshold:
                    found.append((start, name, n, baseline, n / baseline))
            before += n
        self.before.update((before,))
        yield pd.DataFrame(found, columns=["start", "key", "n", "baseline", "ratio"])

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start within it keep their state in RocksDB, as keyed state of any kind asks for."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream_bursts(
    stream: DataFrame, path: str, checkpoint: str, key: Column, origin: dt.datetime, time_column: str = "timestamp", *,
    hours: int = 24, delay: str = "1 hour", threshold: float = 2.0,
) -> None:
    """Read what the stream has to offer now and append the bursts of every window that the watermark has passed.

    The same bursts as ``trends.bursts`` finds in the closed windows, given the start of the first window as ``origin`` (in
    UTC; with a zone any other): the baseline is the mean count of all windows since then, windows without the key
    count as zero, and a key never seen before has no baseline. Windows close in order, so a key's windows reach its state in
    order, and each is counted once.

    Rows later than ``delay`` behind a closed window are lost, as with any watermark. State is one number per key, and one
    per open window and key. Call it again with the same folders, options and number of shuffle partitions to go on where it
    stopped: after a failure the batch that was under way is done again, and the files of its first try are ignored by readers of
    the folder.
    """
    origin = origin if origin.tzinfo else origin.replace(tzinfo=dt.timezone.utc)
    counts = window_counts(stream.withWatermark(time_column, delay), key.cast("string"), time_column, hours=hours)
    closed = counts.select(F.unix_seconds("window_start").alias("start"), "key", "n")
    spark = stream.sparkSession
    ship_package(spark)
    found = closed.groupBy("key").transformWithStateInPandas(
        RunningBaseline(int(origin.timestamp()), hours * 3600, threshold),
        "start bigint, key string, n bigint, baseline double, ratio double",
        "Append",
        "None",
    )
    found = found.select(F.timestamp_seconds("start").alias("window_start"), "key", "n", "baseline", "ratio")
    writer = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    with _rocksdb_state(spark):
        writer.trigger(availableNow=True).start(path).awaitTermination()
