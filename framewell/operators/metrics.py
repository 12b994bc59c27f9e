"""Operational metrics as time series."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewell.ordered import BLOCK_ROWS, ordered, same_keys

# Observations a histogram keeps, rows a series keeps, and minutes of a series shown.
HISTOGRAM_SIZE, SERIES_ROWS, SERIES_MINUTES = 2000, 1024, 60
# Names of the interval counters.
COUNTERS = [
    "recordCount",
    "receiveDelayedCount",
    "dataDelayedCount",
    "s3FailureCount",
    "sqsFailureCount",
    "s3SuccessfulCount",
    "sqsSuccessfulCount",
    "objectMotionCount",
    "objectErrorCount",
    "objectDataDelayedCount",
]
# Quantiles of a summary.
QUANTILES = {"median": 0.5, "p75": 0.75, "p95": 0.95, "p98": 0.98, "p99": 0.99, "p999": 0.999}
SUMMARY = ["count", "min", "max", "mean", "stddev", *QUANTILES]
RATES = ["count", "mean_rate", "m1", "m5", "m15"]
# Columns reported for each kind of metric.
REPORT_COLUMNS = {
    "gauge": ["value"],
    "counter": ["count"],
    "histogram": SUMMARY,
    "meter": RATES,
    "timer": SUMMARY + RATES[1:],
}
SALTS = 1024


def interval_counters(
    events: DataFrame, interval: str = "1 minute", counters: list[str] | None = None, watermark: str | None = None
) -> DataFrame:
    """Sum of each counter per interval, from rows (ts, counter, amount); what a read-and-reset would report.

    With a watermark it runs on a stream in append mode.
    """
    rows = events.withWatermark("ts", watermark) if watermark else events
    names = counters or COUNTERS
    sums = [
        F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("amount"))), F.lit(0)).cast("long").alias(c) for c in names
    ]
    out = rows.groupBy(F.window("ts", interval).alias("_w")).agg(*sums)
    return out.select(F.col("_w.start").alias("interval_start"), *names)


def sliding_histogram(
    df: DataFrame, n: int = HISTOGRAM_SIZE, metric: str = "metric", block_rows: int | None = None
) -> DataFrame:
    """Per observation: count, min, max, mean and stddev of the last ``n`` observations of its metric.

    The last n rows are the head of the row's own chunk of n and the tail of the chunk before. Both are running
    aggregates inside one chunk, so a row costs the same for any n and no task needs more than a chunk in order. The
    spreads of head and tail are centred on their own means and joined by the distance of these.
    """
    rows = ordered(df.select(metric, "seq", "value"), [metric], ["seq"], block_rows).index("_i").done()
    rows = rows.withColumns({"_chunk": F.floor(F.col("_i") / n), "_pos": F.col("_i") % n})
    v = F.col("value").cast("double")
    parts = {"n": F.count(v), "s": F.sum(v), "q": F.var_pop(v), "lo": F.min(v), "hi": F.max(v)}
    chunk = Window.partitionBy(metric, "_chunk")
    head = chunk.orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    tail = chunk.orderBy(F.col("_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"h_{k}": c.over(head) for k, c in parts.items()})
    before = rows.withColumns({f"t_{k}": c.over(tail) for k, c in parts.items()}).filter(F.col("_pos") > 0)
    before = before.select(
        F.col(metric).alias("_m"), (F.col("_i") + (n - 1)).alias("_j"), *[f"t_{k}" for k in parts]
    )
    on = same_keys(own, before, [(metric, "_m")]) & (own["_i"] == before["_j"])
    both = own.join(before, on, "left")

    def total(k: str) -> Column:
        return F.col(f"h_{k}") + F.coalesce(F.col(f"t_{k}"), F.lit(0))

    count, mean = total("n"), total("s") / total("n")
    part = {k: (F.coalesce(F.col(f"{k}_n"), F.lit(0)), F.coalesce(F.col(f"{k}_q"), F.lit(0.0))) for k in "ht"}
    gap = F.try_divide("h_s", "h_n") - F.try_divide("t_s", "t_n")
    between = F.coalesce(gap * gap * part["h"][0] * part["t"][0] / F.nullif(count, F.lit(0)), F.lit(0.0))
    spread = part["h"][0] * part["h"][1] + part["t"][0] * part["t"][1] + between
    return both.select(
        metric,
        "seq",
        count.cast("long").alias("count"),
        F.least("h_lo", "t_lo").alias("min"),
        F.greatest("h_hi", "t_hi").alias("max"),
        mean.alias("mean"),
        F.when(count > 1, F.sqrt(spread / (count - 1))).otherwise(0.0).alias("stddev"),
    )


def sliding_summary(
    df: DataFrame, n: int = HISTOGRAM_SIZE, metric: str = "metric", block_rows: int | None = None
) -> DataFrame:
    """Per observation with a value all columns of a summary over the last ``n`` observations of its metric, itself included.

    A metric is cut into chunks of neighbouring rows; each takes the last n - 1 rows before it along, and a task holds one
    chunk, whatever the length of the metric. Inside, the window is a sorted list that each row enters and leaves by
    binary search.
    """
    rows = df.filter(F.col("value").isNotNull()).select(metric, "seq", F.col("value").cast("double").alias("value"))
    size = max(n, block_rows or BLOCK_ROWS)
    placed = ordered(rows, [metric], ["seq"], block_rows).index("_i").done()
    own, place = F.floor(F.col("_i") / size), F.col("_i") % size
    chunks = F.when(place >= size - (n - 1), F.array(own, own + 1)).otherwise(F.array(own))
    dealt = placed.withColumn("_chunk", F.explode(chunks)).withColumn("_context", F.col("_chunk") != own)

    def summed(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("_i")
        before = int(np.count_nonzero(chunk.column("_context").to_numpy()))
        found = window_statistics(chunk.column("value").to_numpy(), n, before)
        kept = chunk.slice(before)
        if before == chunk.num_rows:
            found = {name: np.zeros(0) for name in SUMMARY}
        out = {metric: kept.column(metric), "seq": kept.column("seq"), **found}
        return pa.table({**out, "count": pa.array(found["count"], pa.int64())})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"`{metric}` {kinds[metric]}, seq {kinds['seq']}, count long, " + ", ".join(f"{c} double" for c in SUMMARY[1:])
    return dealt.groupBy(metric, "_chunk").applyInArrow(summed, schema)


def window_statistics(values: np.ndarray, n: int, skip: int = 0) -> dict[str, np.ndarray]:
    """Summary of the last ``n`` values at each place from ``skip`` on; sums are taken about the mean of all values."""
    held, quantiles = [], list(QUANTILES.values())
    places = np.arange(skip, values.size)
    ends, found = [], np.zeros((places.size, len(quantiles)))
    for i, v in enumerate(values.tolist()):
        if i >= n:
            held.pop(bisect_left(held, float(values[i - n])))
        insort(held, v)
        if i >= skip:
            ends.append((held[0], held[-1]))
            for k, q in enumerate(quantiles):
                at = q * (len(held) + 1)
                low = int(at)
                if 1 <= low < len(held):
                    found[i - skip, k] = held[low - 1] + (at - low) * (held[low] - held[low - 1])
                else:
                    found[i - skip, k] = held[0] if low < 1 else held[-1]
    centre = values.mean() if values.size else 0.0
    sums = np.concatenate([[0.0], np.cumsum(values - centre)])
    squares = np.concatenate([[0.0], np.cumsum(np.square(values - centre))])
    start, count = np.maximum(places + 1 - n, 0), np.minimum(places + 1, n)
    total, square = sums[places + 1] - sums[start], squares[places + 1] - squares[start]
    spread = np.maximum(square - total * total / count, 0) / np.maximum(count - 1, 1)
    low, high = np.array(ends, dtype=float).reshape(-1, 2).T
    spread[low == high] = 0  # what is left there is rounding
    out = {"count": count, "min": low, "max": high, "mean": centre + total / count, "stddev": np.sqrt(spread)}
    return out | dict(zip(QUANTILES, found.T))


def last_rows(df: DataFrame, n: int, metric: str = "metric", order: str = "seq") -> DataFrame:
    """The last n rows per metric, cut down inside salted parts before the rows of a metric meet."""
    salted = df.withColumn("_salt", F.pmod(F.hash(order), F.lit(SALTS)))
    newest = F.col(order).desc()
    some = salted.withColumn("_r", F.row_number().over(Window.partitionBy(metric, "_salt").orderBy(newest)))
    some = some.filter(F.col("_r") <= n).drop("_r", "_salt")
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy(metric).orderBy(newest)))
    return ranked.filter(F.col("_r") <= n).drop("_r")


def quantile(values: Column, q: float) -> Column:
    """Quantile of a sorted array at position q(n + 1), between its neighbours, held inside the array."""
    n = F.size(values)
    at = F.lit(q) * (n + 1)
    low = F.floor(at).cast("int")
    lower, upper = F.get(values, low - 1), F.get(values, low)
    inner = lower + (at - F.floor(at)) * (upper - lower)
    return F.when(low < 1, F.get(values, F.lit(0))).when(low >= n, F.get(values, n - 1)).otherwise(inner)


def histogram_summary(
    df: DataFrame, n: int = HISTOGRAM_SIZE, metric: str = "metric", scale: float = 1.0
) -> DataFrame:
    """Per metric the number of all observations and statistics of the last n, divided by ``scale``."""
    counts = df.groupBy(F.col(metric).alias("_m")).agg(F.count("value").alias("count"))
    kept = last_rows(df.filter(F.col("value").isNotNull()), n, metric).groupBy(metric).agg(
        F.sort_array(F.collect_list(F.col("value").cast("double") / scale)).alias("_v"),
        F.avg(F.col("value") / scale).alias("mean"),
        F.coalesce(F.stddev_samp(F.col("value") / scale), F.lit(0.0)).alias("stddev"),
    )
    out = kept.join(counts, same_keys(kept, counts, [(metric, "_m")]))
    v = F.col("_v")
    return out.select(
        metric,
        "count",
        F.get(v, 0).alias("min"),
        F.get(v, F.size(v) - 1).alias("max"),
        "mean",
        "stddev",
        *[quantile(v, q).alias(name) for name, q in QUANTILES.items()],
    )


def meter_rates(df: DataFrame, metric: str = "metric", ts_seconds: str = "pts") -> DataFrame:
    """Per metric and minute with events: count so far, mean rate since the first minute, and rates of the last
    1, 5 and 15 minutes, in events per second.

    Events are counted per minute first, so the windows run over at most one row per minute and metric.
    """
    minute = F.floor(F.col(ts_seconds) / 60).alias("minute")
    per_minute = df.groupBy(metric, minute).agg(F.count(F.lit(1)).alias("_n"))
    by_minute = Window.partitionBy(metric).orderBy("minute")
    start = F.min("minute").over(Window.partitionBy(metric))
    so_far = F.sum("_n").over(by_minute.rowsBetween(Window.unboundedPreceding, 0))

    def recent(minutes: int) -> Column:
        return F.sum("_n").over(by_minute.rangeBetween(-(minutes - 1), 0)) / (60.0 * minutes)

    return per_minute.select(
        metric,
        "minute",
        so_far.alias("count"),
        (so_far / ((F.col("minute") - start + 1) * 60)).alias("mean_rate"),
        recent(1).alias("m1"),
        recent(5).alias("m5"),
        recent(15).alias("m15"),
    )


def latest_rates(df: DataFrame, metric: str = "metric", ts_seconds: str = "pts") -> DataFrame:
    rates = meter_rates(df, metric, ts_seconds)
    last = rates.groupBy(metric).agg(F.max_by(F.struct(*RATES), "minute").alias("_r"))
    return last.select(metric, "_r.*")


def timer_summary(
    df: DataFrame, metric: str = "metric", ts_seconds: str = "pts", units_per_ms: float = 1_000_000.0
) -> DataFrame:
    """Summary of durations in milliseconds together with the latest rates per second."""
    sums = histogram_summary(df, metric=metric, scale=units_per_ms)
    rates = latest_rates(df, metric, ts_seconds).drop("count").withColumnRenamed(metric, "_m")
    return sums.join(rates, same_keys(sums, rates, [(metric, "_m")])).drop("_m")


def metric_reports(df: DataFrame, ts_seconds: str = "pts") -> DataFrame:
    """Long report rows (metric, kind, col, value) of samples (metric, kind, seq, value, pts).

    Each kind has its own columns: a gauge its last value, a counter its sum, the others their summaries.
    """
    gauge = df.filter(F.col("kind") == "gauge").groupBy("metric").agg(F.max_by("value", "seq").alias("value"))
    counter = df.filter(F.col("kind") == "counter").groupBy("metric").agg(F.sum("value").alias("count"))
    by_kind = {
        "gauge": gauge,
        "counter": counter,
        "histogram": histogram_summary(df.filter(F.col("kind") == "histogram")),
        "meter": latest_rates(df.filter(F.col("kind") == "meter"), ts_seconds=ts_seconds),
        "timer": timer_summary(df.filter(F.col("kind") == "timer"), ts_seconds=ts_seconds),
    }
    out = None
    for kind, wide in by_kind.items():
        cols = REPORT_COLUMNS[kind]
        doubles = wide.select("metric", F.lit(kind).alias("kind"), *[F.col(c).cast("double").alias(c) for c in cols])
        long = doubles.unpivot(["metric", "kind"], cols, "col", "value")
        out = long if out is None else out.unionByName(long)
    return out


def recent_series(series: DataFrame, metric: str, col: str, as_of_seconds: float | None = None) -> DataFrame:
    """One column of one metric from rows (name, col, ts, value): its last 1024 rows, of these the last 60 minutes before
    ``as_of_seconds``, or before the newest of them.

    An unknown column gives no rows. The newest rows are picked per partition before they meet.
    """
    rows = series.filter((F.col("name") == metric) & (F.col("col") == col))
    newest = rows.orderBy(F.col("ts").desc(), F.col("value")).limit(SERIES_ROWS)
    if as_of_seconds is not None:
        return newest.filter(F.col("ts") >= as_of_seconds - 60 * SERIES_MINUTES)
    # at most SERIES_ROWS rows meet in this window
    last = F.max("ts").over(Window.partitionBy("name"))
    return newest.withColumn("_last", last).filter(F.col("ts") >= F.col("_last") - 60 * SERIES_MINUTES).drop("_last")
