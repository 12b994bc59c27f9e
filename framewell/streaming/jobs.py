"""Streaming forms of the service: admission, counters, motion, events and interval detection.

Offsets are committed after a micro-batch succeeds, so sinks see a batch at least once; the keyed sinks replace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from framewell.functions.pixels import count_where
from framewell.operators import motion as D
from framewell.operators.admission import admit
from framewell.operators.intervals import dark_pixel_limit
from framewell.operators.metrics import interval_counters
from framewell.sources.objects import object_sink
from framewell.sources.records import read_records
from framewell.sources.results import latest_results


def admitted_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, max_delay_ms: int | None = None
) -> DataFrame:
    """Admitted records of a folder as they arrive."""
    records = read_records(spark, path, streaming=True, max_files_per_trigger=max_files_per_trigger)
    return admit(records, max_delay_ms=max_delay_ms)


def counters_stream(events: DataFrame, interval: str = "1 minute", watermark: str = "5 minutes") -> DataFrame:
    """Interval counters of a stream, each interval once it is past the watermark."""
    return interval_counters(events, interval, watermark=watermark)


def motion_stream(frames: DataFrame, config: DataFrame) -> DataFrame:
    """Motion boxes of a stream of frames against a table of configurations, models kept in the state store."""
    return D.stream_motion_boxes(D.zone_regions(frames, D.watched_zones(config)))


def report_motion_batch(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands on the frames of a micro-batch that count as motion."""
    return lambda boxes, batch_id: write(D.report_motion(boxes), batch_id)


def to_files(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream as Parquet files, each batch exactly once."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_object_store(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Put a stream of tagged objects into the object table; each batch is a put, so one that runs twice replaces itself."""
    writer = df.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, batch_id: object_sink(batch, path, put=batch_id))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_results(df: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Put a stream of result items into a keyed table.

    A batch writes its own folder, so its cost does not grow with the table and a batch that runs twice replaces
    itself. Which item of a key counts is settled when the table is read.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def compact_results(spark: SparkSession, table: str, out: str) -> None:
    """Write the current items of a keyed table as the first batch of a new table, so that reads stop growing."""
    read_results(spark, table).write.mode("overwrite").parquet(f"{out}/batch=-1")


def read_results(spark: SparkSession, table: str) -> DataFrame:
    """The items of a keyed table: per key the highest version, of equal versions the one that came last."""
    return latest_results(spark.read.parquet(table), tie="batch")


class _Runs(StatefulProcessor):
    """Open run of one stream: first and last time and number of rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getValueState("open", "start DOUBLE, last DOUBLE, n LONG")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._open.get() if self._open.exists() else None
        start, last, n = held if held else (None, None, 0)
        out = []
        # one stream of one micro-batch, whose size the source's rate limit sets
        for r in pd.concat(list(rows)).sort_values(["pts", "seq"]).itertuples(index=False):
            if r.flagged:
                start = r.pts if start is None else start
                last, n = r.pts, n + 1
            elif start is not None:
                out.append((*key, start, r.pts, last, n))
                start, last, n = None, None, 0
        if start is None:
            self._open.clear()
        else:
            self._open.update((start, last, n))
        yield pd.DataFrame(out, columns=["stream_id", "start", "end", "last", "n"])

    def close(self) -> None:
        pass


def runs_stream(df: DataFrame, flag: Column) -> DataFrame:
    """Runs of flagged rows of a stream, each when the row that ends it arrives; rows must arrive in time order."""
    rows = df.select(F.col("stream_id").cast("long").alias("stream_id"), "pts", "seq", flag.alias("flagged"))
    schema = "stream_id LONG, start DOUBLE, end DOUBLE, last DOUBLE, n LONG"
    return rows.groupBy("stream_id").transformWithStateInPandas(
        _Runs(), outputStructType=schema, outputMode="Append", timeMode="None"
    )


def dark_intervals_stream(frames: DataFrame, d: float = 2.0, pic: float = 0.98, pix: float = 0.10) -> DataFrame:
    limit = dark_pixel_limit(pix)
    share = count_where(F.col("luma"), lambda x: x <= limit) / F.size("luma")
    found = runs_stream(frames, share >= pic)
    return found.filter(F.col("end") - F.col("start") >= d).select("stream_id", "start", "end")


def silence_intervals_stream(samples: DataFrame, noise: float = 0.001, d: float = 2.0) -> DataFrame:
    found = runs_stream(samples, (F.col("value") < noise) & (F.col("value") > -noise))
    return found.filter(F.col("last") - F.col("start") >= d).select("stream_id", "start", "end", "n")
