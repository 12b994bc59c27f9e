"""Channel routing, delay and padding of sample streams, from rows (stream_id, channel, n, value) with ``n`` from 0.

Channel numbers and delays are parameters and become expressions or short lists of rows; samples move by their position,
so nothing here needs a stream in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.ordered import explode_range

KEY = "stream_id"
ROW = [KEY, "channel", "n", "value"]


def channel_map(df: DataFrame, mapping: dict[int, int]) -> DataFrame:
    """Each output channel takes the samples of the input channel it names; channels that none names disappear."""
    pairs = [F.struct(F.lit(o).alias("o"), F.lit(i).alias("i")) for o, i in sorted(mapping.items())]
    taken = F.filter(F.array(*pairs), lambda p: p["i"] == F.col("channel"))
    return df.withColumn("_o", F.explode(F.transform(taken, lambda p: p["o"]))).select(
        KEY, F.col("_o").alias("channel"), "n", "value"
    )


def channel_split(df: DataFrame, channels: list[int]) -> dict[int, DataFrame]:
    """A stream of its own for each channel."""
    return {c: df.filter(F.col("channel") == c).select(KEY, "n", "value") for c in channels}


def _lengths(df: DataFrame) -> DataFrame:
    return df.groupBy(KEY).agg((F.max("n") + 1).alias("_len"))


def channel_join(inputs: list[DataFrame], mapping: dict[int, tuple[int, int]]) -> DataFrame:
    """Output channels from (input, channel) pairs, position by position, as long as the shortest input of a stream.

    A stream that some input lacks has no output.
    """
    parts = [
        channel_map(df, {o: c for o, (i, c) in mapping.items() if i == k})
        for k, df in enumerate(inputs)
        if any(i == k for i, _ in mapping.values())
    ]
    lengths = reduce(DataFrame.unionByName, [_lengths(df) for df in inputs])
    ends = lengths.groupBy(KEY).agg(F.count("*").alias("_k"), F.min("_len").alias("_len")).filter(F.col("_k") == len(inputs))
    joined = reduce(DataFrame.unionByName, parts).join(ends.drop("_k"), KEY)
    return joined.filter(F.col("n") < F.col("_len")).select(*ROW)


def channel_merge(inputs: list[DataFrame], channels: list[int]) -> DataFrame:
    """The channels of all inputs one after the other; ``channels`` says how many each input has, numbered from 0."""
    pairs = [(k, c) for k, count in enumerate(channels) for c in range(count)]
    return channel_join(inputs, dict(enumerate(pairs)))


def _silence(spans: DataFrame) -> DataFrame:
    """Rows of value 0 for positions _a to _b (both included) of spans (stream_id, channel, _a, _b)."""
    return explode_range(spans, F.col("_a"), F.col("_b"), "n").withColumn("value", F.lit(0.0)).select(*ROW)


def channel_delay(df: DataFrame, delays: dict[int, int]) -> DataFrame:
    """Each channel starts later by its delay in samples, with silence before; all end with the channel delayed most,
    with silence behind."""
    late = F.lit(0)
    for channel, d in delays.items():
        late = F.when(F.col("channel") == channel, d).otherwise(late)
    most = max([0, *delays.values()])
    moved = df.select(KEY, "channel", (F.col("n") + late).alias("n"), F.col("value").cast("double").alias("value"))
    ends = df.groupBy(KEY, "channel").agg((F.max("n") + 1).alias("_len")).withColumn("_late", late)
    before = ends.select(KEY, "channel", F.lit(0).alias("_a"), (F.col("_late") - 1).alias("_b"))
    behind = ends.select(
        KEY, "channel", (F.col("_len") + F.col("_late")).alias("_a"), (F.col("_len") + most - 1).alias("_b")
    )
    return moved.unionByName(_silence(before.unionByName(behind)))


def pad(df: DataFrame, whole: int | None = None, more: int | None = None) -> DataFrame:
    """Silence behind each channel: up to ``whole`` samples, or ``more`` samples; longer channels stay as they are."""
    if (whole is None) == (more is None):
        raise ValueError("give whole or more")
    ends = df.groupBy(KEY, "channel").agg((F.max("n") + 1).alias("_a"))
    last = F.lit(whole - 1) if whole is not None else F.col("_a") + more - 1
    rows = df.select(KEY, "channel", "n", F.col("value").cast("double").alias("value"))
    return rows.unionByName(_silence(ends.withColumn("_b", last)))
