"""Keyed result table with replace-on-write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


KEYS = ("token", "created")


def latest_results(items: DataFrame, tie: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per key the item of the highest version, of equal versions the one with the highest ``tie`` column.

    One aggregation with a partial step, so many copies of one key shrink before they are shuffled.
    """
    kept = [c for c in items.columns if c != tie]
    row = F.struct(*[c for c in kept if c not in keys])
    best = items.groupBy(*keys).agg(F.max_by(row, F.struct("version", tie, row)).alias("_row"))
    return best.select(*keys, "_row.*").select(*kept)


def upsert_results(target: DataFrame, updates: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The target after putting the updates; an update wins over an old item of equal version."""
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return latest_results(both, "_new", keys)
