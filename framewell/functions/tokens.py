"""Expressions on record keys, times and retention fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text form of event times.
EVENT_TIME_SHAPE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}$"


def camera_token(partition_key: Column) -> Column:
    """Text before the first comma of a partition key, or the whole key when that part is blank."""
    head = F.split_part(partition_key, F.lit(","), F.lit(1))
    return F.when(F.trim(head) != "", head).otherwise(partition_key)


def event_time(text: Column) -> Column:
    """UTC text as a timestamp without time zone, null when the text has another form."""
    return F.when(text.rlike(EVENT_TIME_SHAPE), text.try_cast("timestamp_ntz"))


def epoch_millis(ts: Column) -> Column:
    """Whole milliseconds since 1970, counted downwards, for times with or without zone."""
    micros = F.timestamp_diff(
        "MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")
    )
    return (micros - F.pmod(micros, F.lit(1000))) / 1000


def expiry_days(hours: Column) -> Column:
    """Hours to days, a started day counting whole."""
    return F.ceil(hours / 24)
