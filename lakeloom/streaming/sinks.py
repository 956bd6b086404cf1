"""Streams into frames, each batch added once; windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sdk import Lake


def stream_to_frame(stream: DataFrame, lake: Lake, hive: str, box: str, frame: str, checkpoint: str, writer: str | None = None, once: bool = False) -> StreamingQuery:
    """Adds each micro-batch to a frame. The ledger keeps the writer's last batch, so that a batch that Spark runs again
    after a failure is not added twice."""
    who = writer or f"stream:{checkpoint}"

    def add(batch: DataFrame, number: int) -> None:
        lake.write_df(hive, box, frame, batch, writer=who, number=number)

    started = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if once else started).start()


def windowed(stream: DataFrame, time: str, late: str, length: str, slide: str | None = None, by: list[str] | None = None, value: str | None = None) -> DataFrame:
    """Counts (and sums of ``value``) by tumbling or sliding windows; rows later than ``late`` are dropped."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    aggregates = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return stream.withWatermark(time, late).groupBy(window, *(by or [])).agg(*aggregates)


def session_counts(stream: DataFrame, time: str, late: str, gap: str, by: list[str]) -> DataFrame:
    """Rows by sessions: a gap in event time ends one."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
