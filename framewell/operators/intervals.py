"""Interval and event detection on frame and sample streams."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewell.functions.pixels import column_sums, count_where, even_up, half, level_vector, row_sums
from framewell.operators.kernels import block_sums, interlace_sums
from framewell.operators.retime import frame_sad
from framewell.ordered import Ordered, join_per_key, ordered
from framewell.sequential import in_order

KEY = "stream_id"


def _stream(df: DataFrame, block_rows: int | None) -> Ordered:
    return ordered(df, [KEY], ["pts", "seq"], block_rows)


def runs(df: DataFrame, flag: Column, block_rows: int | None = None) -> DataFrame:
    """Unbroken runs of flagged rows per stream: start, last flagged time, time of the row that ends it, and length.

    A flagged row belongs to the run numbered by the unflagged rows before it, so one running count and one
    aggregation find the runs.
    """
    marked = df.select(KEY, "pts", "seq", F.coalesce(flag, F.lit(False)).alias("_on"))
    s = _stream(marked, block_rows).running({"_off": ("sum", F.when(F.col("_on"), 0).otherwise(1))})
    on, off = F.col("_on"), ~F.col("_on")
    # the row that ends run r is the unflagged row number r + 1
    rows = s.done().withColumn("_run", F.col("_off") - F.when(off, 1).otherwise(0))
    found = rows.groupBy(KEY, "_run").agg(
        F.min(F.when(on, F.col("pts"))).alias("start"),
        F.max(F.when(on, F.col("pts"))).alias("last"),
        F.min(F.when(off, F.col("pts"))).alias("stop"),
        F.count(F.when(on, 1)).alias("n"),
    )
    return found.filter(F.col("n") > 0).drop("_run")


def dark_pixel_limit(pix: float = 0.10, full_range: bool = False) -> int:
    return int(pix * 255) if full_range else int(16 + pix * (235 - 16))


def dark_intervals(
    frames: DataFrame,
    d: float = 2.0,
    pic: float = 0.98,
    pix: float = 0.10,
    full_range: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Times between the first dark frame of a run and the frame that ends it, or the last frame of the stream."""
    limit = dark_pixel_limit(pix, full_range)
    share = count_where(F.col("luma"), lambda x: x <= limit) / F.size("luma")
    found = runs(frames, share >= pic, block_rows)
    ended = found.select(KEY, "start", F.coalesce("stop", "last").alias("end"))
    ended = ended.withColumn("duration", F.col("end") - F.col("start"))
    return ended.filter(F.col("duration") >= d)


def dark_frames(
    frames: DataFrame, amount: int = 98, thresh: int = 32, block_rows: int | None = None
) -> DataFrame:
    """Frames of which at least ``amount`` percent lies below the threshold, with the number of the last key frame."""
    pct = F.floor(count_where(F.col("luma"), lambda x: x < thresh) * 100 / F.size("luma")).cast("int")
    light = frames.select(KEY, "pts", "seq", "is_key", pct.alias("pblack"))
    s = _stream(light, block_rows).index("n")
    s = s.running({"last_keyframe": ("last", F.when(F.col("is_key"), F.col("n")))})
    out = s.columns({"last_keyframe": F.coalesce("last_keyframe", F.lit(0).cast("long"))}).done("is_key")
    return out.filter(F.col("pblack") >= amount)


def silence_intervals(
    samples: DataFrame,
    noise: float = 0.001,
    d: float = 2.0,
    rate: float | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Runs of samples strictly between -noise and noise that go on for ``d`` seconds; an open run has no end.

    With a sample rate a run must hold rate * d samples, otherwise its own times must span d.
    """
    quiet = (F.col("value") < noise) & (F.col("value") > -noise)
    found = runs(samples, quiet, block_rows)
    long_enough = F.col("n") >= int(rate * d) if rate else F.col("last") - F.col("start") >= d
    out = found.filter(long_enough).select(KEY, "start", F.col("stop").alias("end"), "n")
    return out.withColumn("duration", F.col("end") - F.col("start"))


def trim_silence(
    samples: DataFrame, threshold: float, duration: int = 1, window: int = 20, block_rows: int | None = None
) -> DataFrame:
    """Rows from the first run on whose RMS over the last ``window`` rows stays above the threshold for ``duration`` rows.

    The window is filled with zeros before the first row. A stream without such a run gives no rows.
    """
    squares = F.sum(F.col("value") * F.col("value"))
    s = _stream(samples, block_rows).sliding(window, {"_sq": squares})
    s = s.columns({"_loud": F.sqrt(F.col("_sq") / window) > threshold}).drop("_sq")
    s = s.index("_n").running({"_off": ("sum", F.when(F.col("_loud"), 0).otherwise(1))})
    rows = s.done()
    loud = rows.filter("_loud").groupBy(KEY, "_off").agg(F.min("_n").alias("_a"), F.count(F.lit(1)).alias("_c"))
    starts = loud.filter(F.col("_c") >= max(duration, 1)).groupBy(KEY).agg(F.min("_a").alias("_start"))
    kept = join_per_key(rows, starts, [KEY], "_n").filter(F.col("_n") >= F.col("_start"))
    return kept.drop("_n", "_off", "_loud", "_start")


def near_duplicate_frames(
    frames: DataFrame,
    width: int = 8,
    height: int = 8,
    hi: int = 768,
    lo: int = 320,
    frac: float = 0.33,
    max_drops: int = 0,
    first_col: int = 8,
    block_rows: int | None = None,
) -> DataFrame:
    """Add ``keep`` and ``drop_count``: whether a frame differs enough from the last kept one.

    A frame is kept when one 8x8 square differs by more than ``hi`` or more than a share of the squares by more than
    ``lo``. A positive ``max_drops`` bounds the drops in a row, a negative one asks for kept frames between drops. The
    comparison needs the last kept frame, so a stream is walked in order.
    """
    need = int((width // 16) * (height // 16) * frac)

    def step(pdf: pd.DataFrame, state: bytes) -> tuple[pd.DataFrame, bytes]:
        drops, ref = 0, None
        if state:
            drops = struct.unpack("q", state[:8])[0]
            ref = np.frombuffer(state, dtype=np.int32, offset=8).reshape(height, width)
        keep, counts = [], []
        for luma in pdf["luma"]:
            cur = np.asarray(luma, dtype=np.int32).reshape(height, width)
            free = not (max_drops > 0 and drops >= max_drops) and not (max_drops < 0 and drops - 1 > max_drops)
            same = False
            if ref is not None and free:
                sums = block_sums(cur, ref, first_col=first_col)
                same = not (sums > hi).any() and int((sums > lo).sum()) <= need
            drops = max(1, drops + 1) if same else min(-1, drops - 1)
            ref = ref if same else cur
            keep.append(not same)
            counts.append(drops)
        out = pdf.drop(columns=["luma"]).assign(keep=keep, drop_count=counts)
        held = struct.pack("q", drops) + ref.astype(np.int32).tobytes() if ref is not None else state
        return out[[KEY, "seq", "pts", "keep", "drop_count"]], held

    kind = frames.schema["seq"].dataType.simpleString()
    key = frames.schema[KEY].dataType.simpleString()
    schema = f"{KEY} {key}, seq {kind}, pts DOUBLE, keep BOOLEAN, drop_count INT"
    return in_order(frames.select(KEY, "seq", "pts", "luma"), [KEY], ["pts", "seq"], step, schema, block_rows)


def _largest_square(width: int, height: int, block: tuple[int, int]):
    """Largest sum of differences over two by two neighbouring half blocks, as a vectorised function."""
    hx, hy = block[0] // 2, block[1] // 2

    @F.pandas_udf("long")
    def largest(now: pd.Series, before: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(now, before):
            if a is None or b is None:
                out.append(0)
                continue
            d = np.abs(np.asarray(a, dtype=np.int64) - np.asarray(b, dtype=np.int64)).reshape(height, width)
            d = np.pad(d, ((0, -height % hy), (0, -width % hx)))
            q = d.reshape(d.shape[0] // hy, hy, d.shape[1] // hx, hx).sum(axis=(1, 3))
            four = q[:-1, :-1] + q[:-1, 1:] + q[1:, :-1] + q[1:, 1:]
            out.append(int(four.max()) if four.size else -1)
        return pd.Series(out, dtype="int64")

    return largest


def drop_one_per_cycle(
    frames: DataFrame,
    cycle: int = 5,
    width: int = 8,
    height: int = 8,
    block: tuple[int, int] | None = None,
    dup_percent: float = 1.1,
    scene_percent: float = 15.0,
    block_rows: int | None = None,
) -> DataFrame:
    """Drop one frame of each full block of ``cycle`` frames; a last block that is not full is kept whole.

    The frame that differs least from the one before goes, the first of equals. When a frame of the block changes the
    scene and none is a duplicate, the last scene change goes. Without ``block`` the whole frame is one square.
    """
    size = block or (width, height)
    scene, dup = int(255 * width * height * scene_percent / 100), int(255 * size[0] * size[1] * dup_percent / 100)
    s = _stream(frames, block_rows).index("_n").shift({"_prev": F.col("luma")})
    change = F.coalesce(frame_sad(F.col("luma"), F.col("_prev")), F.lit(0).cast("long"))
    largest = _largest_square(width, height, block)(F.col("luma"), F.col("_prev")) if block else F.col("_tot")
    s = s.columns({"_tot": change}).columns({"_max": largest})
    rows = s.done("_prev").withColumn("_cycle", F.floor(F.col("_n") / cycle))
    one = Window.partitionBy(KEY, "_cycle")
    low = F.min(F.struct("_max", "_n")).over(one)
    scene_at = F.max(F.when(F.col("_tot") > scene, F.col("_n"))).over(one)
    rows = rows.withColumns({"_low": low, "_scene": scene_at, "_size": F.count(F.lit(1)).over(one)})
    no_dup = F.col("_low._max") >= dup
    gone = F.when(F.col("_scene").isNotNull() & no_dup, F.col("_scene")).otherwise(F.col("_low._n"))
    kept = rows.filter((F.col("_size") < cycle) | (F.col("_n") != gone))
    return kept.drop("_n", "_tot", "_max", "_cycle", "_low", "_scene", "_size")


def representative_frame(frames: DataFrame, n: int = 100, block_rows: int | None = None) -> DataFrame:
    """Per batch of n frames the one whose histogram is nearest to the mean of the batch, the first of equals.

    A frame is a vector of 256 counts; those of a batch, at most ``n``, meet in one group. With b frames in the batch, count
    c and batch total S of a value, b * b times the squared error is the whole number (b * c - S)**2 summed over the values.
    A null picture counts as one without pixels.
    """
    counted = frames.select(KEY, "pts", "seq", level_vector(F.col("luma")).alias("_h"))
    rows = _stream(counted, block_rows).index("n").done().withColumn("batch", F.floor(F.col("n") / n))

    def nearest(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("n")
        counts = np.frombuffer(b"".join(batch.column("_h").to_pylist()), dtype="<u4").reshape(batch.num_rows, -1)
        size, most = batch.num_rows, int(counts.sum(axis=1).max())
        exact = np.int64 if (size * most) ** 2 < 1 << 62 else object
        counts = counts.astype(exact)
        apart = size * counts - counts.sum(axis=0)
        errors = (apart * apart).sum(axis=1)
        i = int(errors.argmin())
        one = batch.slice(i, 1).select([KEY, "batch", "n", "seq", "pts"])
        return one.add_column(3, "sum_sq_err", pa.array([int(errors[i]) / (size * size)], pa.float64()))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"{KEY} {kinds[KEY]}, batch long, n long, sum_sq_err double, seq {kinds['seq']}, pts {kinds['pts']}"
    return rows.groupBy(KEY, "batch").applyInArrow(nearest, schema)


TYPES = ["tff", "bff", "progressive", "undetermined"]
REPEATS = ["top", "bottom", "neither"]


def _interlace_measure(width: int, height: int):
    @F.pandas_udf("a0 LONG, a1 LONG, delta LONG, g0 LONG, g1 LONG")
    def measure(prev: pd.Series, cur: pd.Series, nxt: pd.Series) -> pd.DataFrame:
        out = []
        for p, c, n in zip(prev, cur, nxt):
            planes = [np.asarray(x).reshape(height, width) for x in (p, c, n)]
            alpha, delta, gamma = interlace_sums(*planes)
            out.append((*alpha, delta, *gamma))
        return pd.DataFrame(out, columns=["a0", "a1", "delta", "g0", "g1"])

    return measure


def interlace_class(
    frames: DataFrame,
    width: int = 8,
    height: int = 8,
    interlace: float = 1.04,
    progressive: float = 1.5,
    repeat: float = 3.0,
    block_rows: int | None = None,
) -> DataFrame:
    """Per frame: field order by itself (single), repeated field, field order by vote (multiple) and running totals.

    The sums come from a frame and both neighbours; at the ends of a stream the frame stands for the missing one. The
    vote looks at the last four single results and is the only part that walks a stream in order.
    """
    s = _stream(frames.select(KEY, "pts", "seq", "luma"), block_rows)
    s = s.shift({"_p": F.col("luma")}, 1).shift({"_x": F.col("luma")}, -1)
    m = _interlace_measure(width, height)(F.coalesce("_p", "luma"), F.col("luma"), F.coalesce("_x", "luma"))
    s = s.columns({"_m": m}).drop("_p", "_x", "luma")
    a0, a1, delta, g0, g1 = (F.col(f"_m.{c}") for c in ("a0", "a1", "delta", "g0", "g1"))
    single = (
        F.when(a0 > interlace * a1, "tff")
        .when(a1 > interlace * a0, "bff")
        .when(a1 > progressive * delta, "progressive")
        .otherwise("undetermined")
    )
    repeated = F.when(g0 > repeat * g1, "top").when(g1 > repeat * g0, "bottom").otherwise("neither")
    s = s.columns({"single": single, "repeated": repeated}).drop("_m")
    s = _voted(s)
    totals = {f"total_{t}": ("sum", F.when(F.col("multiple") == t, 1).otherwise(0)) for t in TYPES}
    totals |= {f"total_repeat_{r}": ("sum", F.when(F.col("repeated") == r, 1).otherwise(0)) for r in REPEATS}
    return s.running(totals).done()


def _voted(s: Ordered) -> Ordered:
    """Add ``multiple``, the type voted by the last four single results.

    The determined ones among them vote if they agree. Three or four votes decide whatever was decided before, fewer only
    while nothing is decided. So the last strong vote stands, before it the first vote of all.
    """
    unknown = F.lit("undetermined")
    s = s.shifts({f"_s{k}": (F.col("single"), k) for k in (1, 2, 3)})
    votes = F.filter(F.array("single", "_s1", "_s2", "_s3"), lambda t: t != unknown)
    agreed = F.when(F.size(F.array_distinct("_votes")) == 1, F.get("_votes", F.lit(0)))
    s = s.columns({"_votes": votes}).columns({"_any": agreed, "_strong": F.when(F.size("_votes") >= 3, agreed)})
    s = s.running({"_first": ("first", F.col("_any")), "_last": ("last", F.col("_strong"))})
    s = s.columns({"multiple": F.coalesce("_last", "_first", unknown)})
    return s.drop("_s1", "_s2", "_s3", "_votes", "_any", "_strong", "_first", "_last")


def crop_bounds(
    frames: DataFrame,
    width: int = 8,
    height: int = 8,
    limit: int = 24,
    round_to: int = 16,
    reset: int = 0,
    block_rows: int | None = None,
) -> DataFrame:
    """Running outer bounds of the lines whose mean exceeds the limit, and the crop area rounded from them.

    The first two frames of a stream are left out. With ``reset`` the bounds start anew every so many frames.
    """
    round_to = 16 if round_to <= 1 else round_to * 2 if round_to % 2 else round_to

    def edges(sums: Column, length: int) -> tuple[Column, Column]:
        bright = F.transform(sums, lambda v: F.floor(v / length) > limit)
        first, last = F.array_position(bright, True) - 1, F.size(bright) - F.array_position(F.reverse(bright), True)
        some = F.array_contains(bright, True)
        return F.when(some, first), F.when(some, last)

    y_first, y_last = edges(row_sums(F.col("luma"), width, height), width)
    x_first, x_last = edges(column_sums(F.col("luma"), width, height), height)
    light = frames.select(
        KEY, "pts", "seq", y_first.alias("_y1"), y_last.alias("_y2"), x_first.alias("_x1"), x_last.alias("_x2")
    )
    rows = _stream(light, block_rows).index("n").done().filter(F.col("n") >= 2)
    rows = rows.withColumn("segment", F.floor((F.col("n") - 2) / reset) if reset else F.lit(0))
    s = ordered(rows, [KEY, "segment"], ["pts", "seq"], block_rows)
    s = s.running({"y1": ("min", F.coalesce("_y1", F.lit(height - 1))), "x1": ("min", F.coalesce("_x1", F.lit(width - 1)))})
    low = s.columns({"y1": F.least("y1", F.lit(height - 1)), "x1": F.least("x1", F.lit(width - 1))})
    # an outer line counts only beyond the inner one found so far
    s = low.running(
        {
            "y2": ("max", F.when(F.col("_y2") > F.col("y1"), F.col("_y2")).otherwise(0)),
            "x2": ("max", F.when(F.col("_x2") > F.col("x1"), F.col("_x2")).otherwise(0)),
        }
    )
    out = s.done("_y1", "_y2", "_x1", "_x2")
    for a, b, start, length in (("x1", "x2", "x", "w"), ("y1", "y2", "y", "h")):
        out = out.withColumn(start, even_up(F.col(a)))
        out = out.withColumn(length, F.col(b) - F.col(start) + 1)
        out = out.withColumn("_shrink", F.col(length) % round_to)
        out = out.withColumns(
            {length: F.col(length) - F.col("_shrink"), start: F.col(start) + even_up(half(F.col("_shrink")))}
        )
    cols = ("x1", "x2", "y1", "y2", "w", "h", "x", "y")
    return out.select(KEY, "seq", "pts", "n", *[F.col(c).cast("int").alias(c) for c in cols])


def bright_bbox(frames: DataFrame, width: int = 8, min_val: int = 16) -> DataFrame:
    """Bounding box of the pixels above ``min_val``; frames without any give no row."""
    places = F.filter(
        F.transform("luma", lambda v, i: F.when(v > min_val, i)), lambda i: i.isNotNull()
    )
    xs = F.transform("_at", lambda i: i % width)
    ys = F.transform("_at", lambda i: F.floor(i / width).cast("int"))
    rows = frames.withColumn("_at", places).filter(F.size("_at") > 0)
    return rows.select(
        KEY,
        "seq",
        "pts",
        F.array_min(xs).cast("int").alias("x1"),
        F.array_min(ys).alias("y1"),
        F.array_max(xs).cast("int").alias("x2"),
        F.array_max(ys).alias("y2"),
    )
