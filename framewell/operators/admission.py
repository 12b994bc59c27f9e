"""Admission of keyed records: validation, delays, lag limits and grouping.

All but ``group_frames`` are narrow and work alike on batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.functions.tokens import camera_token, epoch_millis, event_time
from framewell.ordered import nest

# Largest accepted lag of a batch, and largest delay of one frame (deployed and development).
MAX_BATCH_LAG_MS = 300_000
MAX_DATA_DELAY_MS = {"deployed": 300_000, "development": 60_000}


def drop_empty_payload(df: DataFrame) -> DataFrame:
    return df.filter(F.length("payload") > 0)


def with_token(df: DataFrame) -> DataFrame:
    return df.withColumn("token", camera_token(F.col("partition_key")))


def split_valid_malformed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with a readable time, with ``event_ts`` added, and the records without one for a dead-letter table."""
    timed = df.withColumn("event_ts", event_time(F.col("utc_date_time")))
    return timed.filter(F.col("event_ts").isNotNull()), timed.filter(F.col("event_ts").isNull()).drop("event_ts")


def lag_gate(df: DataFrame, max_ms: int = MAX_BATCH_LAG_MS) -> tuple[DataFrame, DataFrame]:
    """Records of batches within the lag limit, and the number of records of each skipped batch."""
    late = F.coalesce(F.col("behind_latest_ms") > max_ms, F.lit(False))
    skipped = df.filter(late).groupBy("batch_id").agg(F.count(F.lit(1)).alias("skipped"))
    return df.filter(~late), skipped


def receive_delay(df: DataFrame) -> DataFrame:
    """Add ``delay_ms``: receive time minus event time, negative for clocks that run ahead."""
    delay = epoch_millis(F.col("receive_ts")) - epoch_millis(F.col("event_ts"))
    return df.withColumn("delay_ms", delay.cast("long"))


def data_delay_gate(df: DataFrame, max_ms: int = MAX_DATA_DELAY_MS["deployed"]) -> DataFrame:
    """Frames not older than the limit at the time they were received."""
    return df.filter(F.col("delay_ms") <= max_ms)


def delay_counts(df: DataFrame, max_ms: int = MAX_DATA_DELAY_MS["deployed"]) -> DataFrame:
    """Per batch, how many frames the delay limit keeps and drops."""
    late = F.coalesce(F.col("delay_ms") > max_ms, F.lit(False))
    return df.groupBy("batch_id").agg(
        F.count(F.when(~late, 1)).alias("kept"), F.count(F.when(late, 1)).alias("dropped")
    )


def group_frames(df: DataFrame, part: Column | None = None) -> DataFrame:
    """Frames of each (batch, full partition key) in arrival order, as one array.

    A batch is what one fetch brings, so its groups are small. A caller with larger groups gives ``part``, a column that
    cuts them, such as a range of ``seq``; the arrays then are those of the parts.
    """
    return nest(df, ["batch_id", "partition_key"], ["seq"], F.struct("seq", "payload"), "frames", part)


def admit(df: DataFrame, max_lag_ms: int = MAX_BATCH_LAG_MS, max_delay_ms: int | None = None) -> DataFrame:
    """The admission steps in order: lag limit, empty payloads, readable times, token and delay."""
    kept, _ = lag_gate(df, max_lag_ms)
    good, _ = split_valid_malformed(drop_empty_payload(kept))
    rows = receive_delay(with_token(good))
    return rows if max_delay_ms is None else data_delay_gate(rows, max_delay_ms)


def delay_by_token(df: DataFrame) -> DataFrame:
    """Record count and delays per camera; partial aggregation happens before the shuffle, so hot cameras are fine."""
    return df.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("delay_ms"), 6).alias("mean_delay_ms"),
        F.max("delay_ms").alias("max_delay_ms"),
    )
