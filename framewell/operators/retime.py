"""Selection, re-timing and resampling of timestamped rows, one stream per ``stream_id``."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.ordered import Ordered, explode_range, ordered
from framewell.sequential import in_order, scan

KEY = "stream_id"


def _stream(df: DataFrame, block_rows: int | None) -> Ordered:
    return ordered(df, [KEY], ["pts", "seq"], block_rows)


def with_timeline(df: DataFrame, block_rows: int | None = None) -> Ordered:
    """Add what expressions may use: n, t, prev_pts, prev_t, start_pts and start_t."""
    s = _stream(df, block_rows).index("n").shift({"prev_pts": F.col("pts")})
    s = s.running({"start_pts": ("first", F.col("pts"))})
    return s.columns({"t": F.col("pts"), "prev_t": F.col("prev_pts"), "start_t": F.col("start_pts")})


def select_rows(df: DataFrame, expr: str, block_rows: int | None = None) -> DataFrame:
    """Rows for which a Spark SQL expression over the row and its timeline is not zero; NaN counts as not zero."""
    return with_timeline(df, block_rows).done().filter(F.expr(expr).cast("double") != 0)


def _successors(pts: np.ndarray, gap: float) -> np.ndarray:
    """Position of the first row at least ``gap`` after each row, the number of rows where there is none."""
    n = pts.size
    at = np.arange(n)
    after = np.maximum(np.searchsorted(pts, pts + gap), at + 1)
    while (early := (after < n) & (pts[np.minimum(after, n - 1)] - pts < gap)).any():  # last digits of pts + gap
        after[early] += 1
    while (late := (after > at + 1) & (pts[after - 1] - pts >= gap)).any():
        after[late] -= 1
    return after


def _last_selected(pts: np.ndarray, gap: float) -> np.ndarray:
    """Position of the last selected row for each row as the first one, by doubling of the way along the successors."""
    way = _successors(pts, gap)
    way = np.where(way < pts.size, way, np.arange(pts.size))
    while (way[way] != way).any():
        way = way[way]
    return way


def select_with_gap(df: DataFrame, gap: float, block_rows: int | None = None) -> DataFrame:
    """The first row of a stream, then each row at least ``gap`` after the last selected one.

    A block says for each place where the selection can enter it which row is selected last; neighbouring entries that end
    alike are one, so this is short. From the entries of the blocks all of them select at once.
    """

    def ends(rows: pa.Table) -> bytes:
        pts = rows.column("pts").to_numpy()
        last = _last_selected(pts, gap)
        turn = np.append(np.flatnonzero(last[1:] != last[:-1]), pts.size - 1)
        return np.stack([pts[turn], pts[last[turn]]]).astype("<f8").tobytes()

    def advance(state: bytes, block: bytes) -> bytes:
        reach, last = np.frombuffer(block, "<f8").reshape(2, -1)
        fits = reach - struct.unpack("d", state)[0] >= gap if state else np.ones(reach.size, dtype=bool)
        return struct.pack("d", last[fits.argmax()]) if fits.any() else state

    def step(rows: pa.Table, state: bytes) -> pa.Table:
        pts = rows.column("pts").to_numpy()
        fits = pts - struct.unpack("d", state)[0] >= gap if state else np.ones(pts.size, dtype=bool)
        chosen = np.zeros(pts.size + 1, dtype=bool)
        chosen[fits.argmax() if fits.any() else -1] = True
        way = np.append(_successors(pts, gap), pts.size)
        while (way[chosen] < pts.size).any():
            chosen[way[chosen]] = True
            way = way[way]
        return rows.filter(pa.array(chosen[:-1]))

    timed = ordered(df.filter(F.col("pts").isNotNull()), [KEY], ["pts", "seq"], block_rows)
    return scan(timed, ends, advance, step, df.schema)


def select_with_previous(df: DataFrame, gap: float, block_rows: int | None = None) -> DataFrame:
    """The rows of :func:`select_with_gap` with ``selected_n``, their number among the selected ones, and ``prev_selected_n``
    and ``prev_selected_pts`` of the row selected before."""
    numbered = ordered(df.filter(F.col("pts").isNotNull()), [KEY], ["pts", "seq"], block_rows).index("n").done()
    s = ordered(select_with_gap(numbered, gap, block_rows), [KEY], ["pts", "seq"], block_rows).index("selected_n")
    return s.shift({"prev_selected_n": F.col("n"), "prev_selected_pts": F.col("pts")}).done()


def route_rows(df: DataFrame, expr: str, n: int) -> DataFrame:
    """Rows with the output number an expression gives: 0 drops, NaN and negative go to 0, else ceil - 1, at most n - 1."""
    value = F.expr(expr).cast("double")
    up = F.least(F.ceil(value) - 1, F.lit(n - 1)).cast("int")
    out = F.when(F.isnan(value) | (value < 0), F.lit(0)).otherwise(up)
    return df.filter(value != 0).withColumn("out_no", out)


def frame_sad(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two pixel arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, d: s + d)


def _whole_blocks(luma: Column, width: int, height: int) -> Column:
    if width % 8 == 0 and height % 8 == 0:
        return luma
    w, h = width // 8 * 8, height // 8 * 8
    return F.filter(luma, lambda _, i: (i % width < w) & (i < width * h))


def scene_score(df: DataFrame, width: int = 8, height: int = 8, block_rows: int | None = None) -> DataFrame:
    """Add ``mafd``, the mean absolute change per pixel in whole 8x8 blocks, and ``score`` between 0 and 1.

    The score takes the change, or its own change against the row before when that is smaller. First row: 0.
    """
    s = _stream(df, block_rows).shift({"_prev": _whole_blocks(F.col("luma"), width, height)})
    pixels = (width // 8 * 8) * (height // 8 * 8)
    change = frame_sad(_whole_blocks(F.col("luma"), width, height), F.col("_prev")) / pixels
    s = s.columns({"mafd": F.when(F.col("_prev").isNotNull(), change)}).drop("_prev")
    s = s.shift({"_before": F.coalesce("mafd", F.lit(0.0))})
    least = F.least(F.col("mafd"), F.abs(F.col("mafd") - F.col("_before"))) / 100
    score = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), least)), F.lit(0.0))
    return s.columns({"score": score, "mafd": F.coalesce("mafd", F.lit(0.0))}).done("_before")


def trim(
    df: DataFrame,
    start_frame: int | None = None,
    start_pts: float | None = None,
    end_frame: int | None = None,
    end_pts: float | None = None,
    duration: float | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Rows between a start and an end.

    A row passes the start when its number or its time is far enough. It passes the end while any given end condition
    holds; the first row that fails them all ends its stream for good.
    """
    s = _stream(df, block_rows).index("_n")
    begun = [F.col("_n") >= start_frame] if start_frame is not None else []
    begun += [F.col("pts") >= start_pts] if start_pts is not None else []
    if begun:
        s = s.only(_any(begun))
    if duration is not None:
        s = s.running({"_first": ("first", F.col("pts"))})
    inside = [F.col("_n") < end_frame] if end_frame is not None else []
    inside += [F.col("pts") < end_pts] if end_pts is not None else []
    inside += [F.col("pts") - F.col("_first") < duration] if duration is not None else []
    if inside:
        s = s.running({"_over": ("max", F.when(_any(inside), 0).otherwise(1))})
        s = s.only(F.col("_over") == 0)
    return s.done("_n", "_first", "_over")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def frame_step(df: DataFrame, n: int, block_rows: int | None = None) -> DataFrame:
    """Every n-th row of a stream, the first one included."""
    return _stream(df, block_rows).index("_n").done().filter(F.col("_n") % n == 0).drop("_n")


ROUNDINGS = {"near": F.round, "down": F.floor, "zero": F.floor, "up": F.ceil, "inf": F.ceil}


def resample_fps(
    df: DataFrame, fps: float, rounding: str = "near", block_rows: int | None = None
) -> DataFrame:
    """Constant rate: one row per slot with the number, time and source row (``seq``) shown there.

    The last row of a slot wins, a gap repeats the row before, and the output ends with the last slot.
    """
    timed = df.filter(F.col("pts").isNotNull()).select(KEY, "pts", "seq")
    s = _stream(timed, block_rows).totals({"_first": F.min("pts")})
    slot = ROUNDINGS[rounding]((F.col("pts") - F.col("_first")) * fps).cast("long")
    rows = s.done().withColumn("slot", slot)
    winners = rows.groupBy(KEY, "slot").agg(
        F.max_by("seq", F.struct("pts", "seq")).alias("seq"), F.first("_first").alias("_first")
    )
    shown = ordered(winners, [KEY], ["slot"], block_rows).shift({"_next": F.col("slot")}, -1).done()
    shown = shown.withColumnRenamed("slot", "_slot")
    filled = explode_range(shown, F.col("_slot"), F.coalesce(F.col("_next") - 1, F.col("_slot")), "slot")
    return filled.select(KEY, "slot", (F.col("_first") + F.col("slot") / fps).alias("pts"), "seq")


def retime(df: DataFrame, expr: str, accumulate: bool = False, block_rows: int | None = None) -> DataFrame:
    """Set ``new_pts`` from a Spark SQL expression over the row and its timeline.

    With ``accumulate`` the expression is the step from the new time of the row before, starting at 0.
    """
    s = with_timeline(df, block_rows)
    s = s.running({"new_pts": ("sum", F.expr(expr))}) if accumulate else s.columns({"new_pts": F.expr(expr)})
    return s.done("n", "t", "prev_t", "start_t", "prev_pts", "start_pts")


def dejudder(df: DataFrame, cycle: int = 4, ticks: str = "ticks", block_rows: int | None = None) -> DataFrame:
    """Add ``new_ticks``: times of rows in arrival order smoothed over a cycle, in units of 1 / (2 * cycle) tick.

    A time is the one before plus a step made of the times up to cycle + 1 rows back, so it is a running sum of steps.
    When a clock jumps backwards the times before the jump are moved to the new clock; the steps of streams with such a
    jump, and of no others, come from walking their rows in order.
    """
    s = ordered(df, [KEY], ["seq"], block_rows)
    p = F.col(ticks)
    back = {"_p1": 1, "_pc": cycle, "_pc1": cycle + 1, "_pc2": cycle + 2}
    s = s.index("_n").shifts({name: (p, k) for name, k in back.items()})
    rows = s.totals({"_jumps": F.max(F.coalesce(p < F.col("_pc2"), F.lit(False)))}).done()
    step = (cycle - 1) * (F.col("_pc1") - F.col("_p1")) + (cycle + 1) * (p - F.col("_pc"))
    kept = [*df.columns, "_n"]
    steady = rows.filter(~F.col("_jumps")).withColumn("_step", step).select(*kept, "_step")
    walked = _smoothing_steps(rows.filter("_jumps").select(*kept), cycle, ticks, block_rows)
    s = ordered(steady.unionByName(walked), [KEY], ["seq"], block_rows, probe=df)
    early = F.col("_n") < cycle + 2
    s = s.columns({"_base": F.when(F.col("_n") == cycle + 1, p * (2 * cycle)).when(~early, F.col("_step"))})
    s = s.running({"_sum": ("sum", F.col("_base"))})
    new = F.when(early, p * (2 * cycle)).otherwise(F.col("_sum")).cast("long")
    return s.columns({"new_ticks": new}).done("_n", "_step", "_base", "_sum")


def _smoothing_steps(df: DataFrame, cycle: int, ticks: str, block_rows: int | None) -> DataFrame:
    """Add the smoothing step of each row; the state is the last cycle + 2 times on the clock in force."""
    held = cycle + 2

    def step(pdf: pd.DataFrame, state: bytes) -> tuple[pd.DataFrame, bytes]:
        past = list(struct.unpack(f"{len(state) // 8}q", state))
        steps = []
        for p in pdf[ticks].astype("int64"):
            if len(past) < held:
                steps.append(None)
            else:
                if p < past[0]:
                    moved = p - past[2] + past[1] - past[-1]
                    past = [q + moved for q in past]
                steps.append((cycle - 1) * (past[1] - past[-1]) + (cycle + 1) * (p - past[2]))
            past = [*past, int(p)][-held:]
        return pdf.assign(_step=pd.array(steps, dtype="Int64")), struct.pack(f"{len(past)}q", *past)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _step BIGINT"
    return in_order(df, [KEY], ["seq"], step, schema, block_rows)


def fill_gaps(df: DataFrame, period: float, min_delta: float = 0.1, block_rows: int | None = None) -> DataFrame:
    """Samples on a steady clock: silence where time is missing, overlapping samples dropped.

    A row is expected one ``period`` after the latest time before it. When it comes more than ``min_delta`` later, zero
    samples fill the gap (``filled`` true); when it comes more than ``min_delta`` too early it is dropped.
    """
    s = ordered(df.select(KEY, "seq", "pts", "value"), [KEY], ["seq"], block_rows)
    s = s.running({"_seen": ("max", F.col("pts"))}, inclusive=False)
    late = F.col("pts") - (F.col("_seen") + period)
    rows = s.done().withColumn("_late", F.coalesce(late, F.lit(0.0))).filter(F.col("_late") >= -min_delta)
    missing = F.when(F.col("_late") > min_delta, F.round(F.col("_late") / period)).otherwise(0)
    gaps = explode_range(rows.withColumn("_m", missing), F.lit(1), F.col("_m"), "_k")
    silence = gaps.select(
        KEY, "seq", (F.col("_seen") + F.col("_k") * period).alias("pts"), F.lit(0.0).alias("value"), F.lit(True).alias("filled")
    )
    return rows.select(KEY, "seq", "pts", "value", F.lit(False).alias("filled")).unionByName(silence)


def rebatch(
    df: DataFrame, n: int = 1024, rate: float = 1.0, pad: bool = True, block_rows: int | None = None
) -> DataFrame:
    """Blocks of n samples; the last of a stream is padded with zeros or left short.

    The time of a block is the first time of the stream plus the samples before it over the rate.
    """
    s = _stream(df, block_rows).index("_n").running({"_first": ("first", F.col("pts"))})
    rows = s.done().withColumns({"block_no": F.floor(F.col("_n") / n), "_at": F.col("_n") % n})
    blocks = rows.groupBy(KEY, "block_no").agg(
        F.sort_array(F.collect_list(F.struct("_at", "value"))).alias("_v"), F.min("_first").alias("_first")
    )
    values = F.transform("_v", lambda v: v["value"])
    size = F.size("_v")
    if pad:
        values = F.concat(values, F.array_repeat(F.lit(0.0), F.lit(n) - size))
    return blocks.select(
        KEY,
        "block_no",
        (F.col("_first") + F.col("block_no") * n / rate).alias("pts"),
        size.alias("n_real"),
        values.alias("samples"),
    )
