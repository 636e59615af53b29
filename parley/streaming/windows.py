"""Tumbling-window counts of a stream, and a whole picture of it at any time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.trends import window_counts


def closed_window_counts(
    stream: DataFrame, path: str, checkpoint: str, key: Column, time_column: str = "timestamp", *,
    hours: int = 24, delay: str = "1 hour",
) -> None:
    """Count what the stream has to offer now and append every window the watermark has passed.

    Rows later than ``delay`` behind a closed window are lost, as with any watermark; a run that
    takes all its input in one batch loses none. State is one number per open window and key.
    Call it again with the same folders to go on where it stopped.
    """
    counts = window_counts(stream.withWatermark(time_column, delay), key, time_column, hours=hours)
    writer = counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(path).awaitTermination()


def with_open_windows(
    closed: DataFrame, batch: DataFrame, key: Column, time_column: str = "timestamp", *, hours: int = 24
) -> DataFrame:
    """The closed windows of a stream and, counted from its source, the ones after them.

    The watermark closes windows in order, so everything after the last closed window is open.
    """
    last_closed = closed.agg(F.max("window_start")).scalar()
    open_rows = batch.filter(
        F.coalesce(F.col(time_column) >= last_closed + F.make_dt_interval(hours=F.lit(hours)), F.lit(True))
    )
    return closed.unionByName(window_counts(open_rows, key, time_column, hours=hours))
