"""Statistics, fingerprints and comparison of frame and sample streams."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewell.functions.boxes import idiv
from framewell.functions.checksums import ADLER_BASE, adler_before, adler_sums, crc32_before
from framewell.functions.pixels import (
    adler32,
    adler32_bytes,
    digits,
    kth_smallest,
    level_counts,
    pcm_bytes,
    share_position,
    total,
    total_squares,
)
from framewell.operators.kernels import outlier_pixels, out_of_range_pixels, repeated_line_pixels, ssim as ssim_kernel
from framewell.operators.retime import frame_sad
from framewell.ordered import Ordered, ordered, same_keys
from framewell.sequential import scan

KEY = "stream_id"
# Full power of 16-bit samples, the level reported for silence, and the smallest normal double, which
# is where the largest level of a signal starts from.
FULL_POWER, MAX_DB, TINY = 32768 * 32768, 91, 2.2250738585072014e-308
# Fixed value: PSNR reported for equal inputs.
EQUAL_PSNR = 999.99


def level_db(power: Column) -> Column:
    """Decibels below full power, 91 for no power."""
    return F.when(power == 0, F.lit(float(MAX_DB))).otherwise(
        F.log(power.cast("double") / FULL_POWER) * (-10 / math.log(10))
    )


def _by_value(samples: DataFrame) -> DataFrame:
    """Number of samples per stream and 16-bit value: at most 65536 rows per stream whatever its length."""
    return samples.groupBy(KEY, F.col("pcm").cast("long").alias("v")).agg(F.count(F.lit(1)).alias("c"))


def volume_stats(samples: DataFrame) -> DataFrame:
    """Per stream: number of samples, mean power rounded to a whole number, and mean and largest level in dB."""
    counts = _by_value(samples)
    energy = (F.col("v") * F.col("v")).cast("decimal(38,0)") * F.col("c")
    sums = counts.groupBy(KEY).agg(
        F.sum("c").alias("n_samples"), F.sum(energy).alias("_e"), F.max(F.abs("v")).alias("_peak")
    )
    power = idiv(F.col("_e") + idiv(F.col("n_samples"), 2), F.col("n_samples"))
    return sums.withColumn("power", power.cast("long")).select(
        KEY,
        "n_samples",
        "power",
        (-level_db(F.col("power"))).alias("mean_db"),
        (-level_db(F.col("_peak") * F.col("_peak"))).alias("max_db"),
    )


def volume_histogram(samples: DataFrame) -> DataFrame:
    """Samples per whole dB from the loudest level on, until a thousandth of the stream is covered.

    Levels in between without samples are listed with 0. A stream has at most 92 levels.
    """
    db = level_db(F.col("v") * F.col("v")).cast("int")
    bins = _by_value(samples).groupBy(KEY, db.alias("db")).agg(F.sum("c").alias("c"))
    held = bins.groupBy(KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("db", "c"))).alias("_m"),
        F.min("db").alias("_from"),
        F.sum("c").alias("_n"),
    )
    levels = held.withColumn("db", F.explode(F.sequence(F.col("_from"), F.lit(MAX_DB))))
    levels = levels.withColumn("count", F.coalesce(F.element_at("_m", F.col("db")), F.lit(0).cast("long")))
    before = Window.partitionBy(KEY).orderBy("db").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("_sum", F.coalesce(F.sum("count").over(before), F.lit(0)))
    return levels.filter(F.col("_sum") < F.floor(F.col("_n") / 1000)).select(KEY, "db", "count")


def _decibels(level: Column) -> Column:
    return F.when(level > 0, F.log10(level) * 20)


CHANNEL = [KEY, "channel"]


def _channels(samples: DataFrame, block_rows: int | None) -> Ordered:
    return ordered(samples.select(*CHANNEL, "pts", "seq", "value"), CHANNEL, ["pts", "seq"], block_rows)


def _same_channel(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    names = {k: f"_c{i}" for i, k in enumerate(CHANNEL)}
    right = right.withColumnsRenamed(names)
    return left.join(right, same_keys(left, right, list(names.items())), how).drop(*names.values())


def _channel_sums(s: Ordered) -> DataFrame:
    """Closed-form sums per (stream, channel), with the squared lengths of runs at the lowest and highest level.

    A run counts once a sample after it leaves the level, so a run that ends the channel does not.
    """
    v = F.col("value")
    level = {"min": F.min(v), "max": F.max(v)}
    # a signal that never rises above zero has no highest level of its own
    floor = {"max": F.greatest("max", F.lit(TINY))}
    out = s.df.groupBy(*CHANNEL).agg(
        F.count(v).alias("n"), F.sum(v).alias("sx"), F.sum(v * v).alias("sx2"), *[c.alias(k) for k, c in level.items()]
    ).withColumns(floor)
    s = s.totals(level).columns(floor)
    away = {k: F.when(v == F.col(k), 0).otherwise(1) for k in level}
    rows = s.running({f"_off_{k}": ("sum", c) for k, c in away.items()}).columns(
        {f"_away_{k}": c for k, c in away.items()}
    )
    for k in level:
        off = F.col(f"_away_{k}")
        found = rows.df.withColumn("_run", F.col(f"_off_{k}") - off).groupBy(*CHANNEL, "_run").agg(
            F.sum(1 - off).alias("_len"), F.max(off).alias("_left")
        )
        per_channel = found.groupBy(*CHANNEL).agg(
            F.sum("_len").alias(f"{k}_count"), F.sum(F.col("_len") * F.col("_len") * F.col("_left")).alias(f"{k}_runs")
        )
        out = _same_channel(out, per_channel, "inner")
    return out.withColumnsRenamed({"min": "lo", "max": "hi"})


def _decayed(powers: np.ndarray, mult: float) -> np.ndarray:
    """Running sums in which all earlier terms are multiplied by ``mult`` at each step, by doubling of the reach."""
    out, reach = powers.copy(), 1
    while reach < out.size and mult > 0:
        out[reach:] += mult * out[:-reach]
        reach, mult = 2 * reach, mult * mult
    return out


def _power_range(samples: DataFrame, length: float, rate: float, block_rows: int | None) -> DataFrame:
    """Lowest and highest decayed power per channel, once the decay has had five time constants to settle. A block takes a
    power to ``mult ** n`` times it plus a constant; samples without a value count as none."""
    mult, settle = math.exp(-1 / length / rate), int(5 * length * rate + 0.5)

    def powers(rows: pa.Table) -> np.ndarray:
        return _decayed(np.square(rows.column("value").to_numpy()) * (1.0 - mult), mult)

    def taken(rows: pa.Table) -> bytes:
        return struct.pack("qd", rows.num_rows, powers(rows)[-1])

    def advance(state: bytes, block: bytes) -> bytes:
        (n, power), (more, constant) = struct.unpack("qd", state or bytes(16)), struct.unpack("qd", block)
        return struct.pack("qd", n + more, power * mult**more + constant)

    def step(rows: pa.Table, state: bytes) -> pa.Table:
        n, power = struct.unpack("qd", state or bytes(16))
        found = powers(rows) + power * mult ** np.arange(1.0, rows.num_rows + 1)
        settled = found[max(settle - n, 0) :]
        first = rows.select(CHANNEL).slice(0, min(1, settled.size))
        low, high = (pa.array([f(settled)] if settled.size else [], pa.float64()) for f in (np.min, np.max))
        return first.append_column("_low", low).append_column("_high", high)

    some = samples.select(*CHANNEL, "pts", "seq", "value").filter(F.col("value").isNotNull())
    s = ordered(some, CHANNEL, ["pts", "seq"], block_rows)
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in CHANNEL)
    parts = scan(s, taken, advance, step, f"{kinds}, _low DOUBLE, _high DOUBLE")
    return parts.groupBy(*CHANNEL).agg(F.min("_low").alias("min_power"), F.max("_high").alias("max_power"))


def signal_stats(
    samples: DataFrame, length: float = 0.05, rate: float = 1.0, block_rows: int | None = None
) -> DataFrame:
    """Per channel: offset, extremes, levels in dB, crest and flat factor and the number of peaks."""
    s = _channels(samples, block_rows)
    both = _same_channel(_channel_sums(s), _power_range(samples, length, rate, block_rows), "left")
    mean_square = F.col("sx2") / F.col("n")
    both = both.withColumns(
        {"max_power": F.coalesce("max_power", mean_square), "min_power": F.coalesce("min_power", mean_square)}
    )
    return both.select(*CHANNEL, *_signal_columns())


def _signal_columns() -> list[Column]:
    peak = F.greatest(-F.col("lo"), F.col("hi"))
    rms = F.sqrt(F.col("sx2") / F.col("n"))
    peaks = F.col("min_count") + F.col("max_count")
    return [
        F.col("n"),
        (F.col("sx") / F.col("n")).alias("dc_offset"),
        F.col("lo").alias("min_level"),
        F.col("hi").alias("max_level"),
        _decibels(peak).alias("peak_db"),
        _decibels(rms).alias("rms_db"),
        _decibels(F.sqrt("max_power")).alias("rms_peak_db"),
        _decibels(F.sqrt("min_power")).alias("rms_trough_db"),
        F.when(F.col("sx2") != 0, peak / rms).otherwise(1.0).alias("crest_factor"),
        _decibels((F.col("min_runs") + F.col("max_runs")) / peaks).alias("flat_factor"),
        peaks.alias("peak_count"),
    ]


def signal_stats_overall(samples: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The closed-form part of ``signal_stats`` over all channels of a stream together.

    The offset is the one of the channel with the largest sum; counts of peaks and samples are per channel.
    """
    sums = _channel_sums(_channels(samples, block_rows))
    every = sums.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("_channels"),
        F.sum("n").alias("_n"),
        F.max_by("sx", F.struct(F.abs("sx"), -F.col("channel"))).alias("_sx"),
        F.sum("sx2").alias("_sx2"),
        F.min("lo").alias("min_level"),
        F.max("hi").alias("max_level"),
        F.sum(F.col("min_runs") + F.col("max_runs")).alias("_runs"),
        F.sum(F.col("min_count") + F.col("max_count")).alias("_peaks"),
    )
    per_channel = idiv(F.col("_n"), F.col("_channels"))
    return every.select(
        KEY,
        per_channel.alias("n"),
        (F.col("_sx") / per_channel).alias("dc_offset"),
        "min_level",
        "max_level",
        _decibels(F.greatest(-F.col("min_level"), F.col("max_level"))).alias("peak_db"),
        _decibels(F.sqrt(F.col("_sx2") / F.col("_n"))).alias("rms_db"),
        _decibels(F.col("_runs") / F.col("_peaks")).alias("flat_factor"),
        (F.col("_peaks") / F.col("_channels")).alias("peak_count"),
    )


def plane_stats(plane: Column, prefix: str) -> list[Column]:
    """Lowest, 10 % level, mean, 90 % level and highest value of a plane."""
    n = F.size(plane)
    return [
        F.array_min(plane).alias(f"{prefix}min"),
        kth_smallest(plane, share_position(n, 10)).alias(f"{prefix}low"),
        (total(plane) / n).alias(f"{prefix}avg"),
        kth_smallest(plane, share_position(n, 90)).alias(f"{prefix}high"),
        F.array_max(plane).alias(f"{prefix}max"),
    ]


def frame_signal_stats(
    frames: DataFrame, planes: dict[str, str] | None = None, block_rows: int | None = None
) -> DataFrame:
    """Level statistics of each plane and its mean change since the frame before; 0 for the first frame.

    ``planes`` maps a name to its array column. With planes u and v, saturation and hue are described as well.
    """
    planes = planes or {"y": "luma"}
    s = ordered(frames, [KEY], ["pts", "seq"], block_rows).shift({f"_p{p}": F.col(c) for p, c in planes.items()})
    out = []
    for p, c in planes.items():
        change = F.coalesce(frame_sad(F.col(c), F.col(f"_p{p}")), F.lit(0).cast("long"))
        out += [*plane_stats(F.col(c), p), (change / F.size(c)).alias(f"{p}dif")]
    rows = s.done()
    if "u" in planes and "v" in planes:
        u, v = F.col(planes["u"]), F.col(planes["v"])
        # one byte holds a saturation
        sat = F.zip_with(u, v, lambda a, b: F.floor(F.hypot(a - 128, b - 128)).cast("int").bitwiseAND(255))
        hue = F.zip_with(u, v, lambda a, b: F.floor(F.degrees(F.atan2(a - 128, b - 128)) + 180).cast("int"))
        rows = rows.withColumns({"_sat": sat, "_hue": hue})
        within = F.filter("_hue", lambda h: h < 360)
        out += plane_stats(F.col("_sat"), "sat")
        out += [
            kth_smallest(F.col("_hue"), idiv(F.size("_hue"), 2).cast("int") + 1).alias("huemed"),
            (total(within) / F.size("_hue")).alias("hueavg"),
        ]
    return rows.select(KEY, "seq", "pts", *out)


def signal_flags(frames: DataFrame) -> DataFrame:
    """Shares of outlier pixels, repeated lines and pixels out of range, from rows with planes y, u, v as bytes."""

    @F.pandas_udf("tout DOUBLE, vrep DOUBLE, brng DOUBLE")
    def flags(y: pd.Series, u: pd.Series, v: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c, w, h in zip(y, u, v, width, height):
            luma = np.frombuffer(a, dtype=np.uint8).reshape(h, w)
            chroma = [np.frombuffer(p, dtype=np.uint8).reshape(h // 2, w // 2) for p in (b, c)]
            counts = outlier_pixels(luma), repeated_line_pixels(luma), out_of_range_pixels(luma, *chroma)
            out.append([k / (w * h) for k in counts])
        return pd.DataFrame(out, columns=["tout", "vrep", "brng"])

    marked = frames.withColumn("_f", flags("y", "u", "v", "width", "height"))
    return marked.select(KEY, "seq", "pts", "_f.tout", "_f.vrep", "_f.brng")


def frame_info(
    frames: DataFrame, planes: dict[str, str] | None = None, block_rows: int | None = None
) -> DataFrame:
    """Per frame: number, time, size, key flag, checksum of all planes, and per plane checksum, mean and deviation."""
    planes = planes or {"y": "luma"}
    out = []
    for p, c in planes.items():
        n, s = F.size(c), total(F.col(c))
        spread = (total_squares(F.col(c)) - s * s.cast("double") / n) / n
        out += [
            adler32(F.col(c)).alias(f"{p}_checksum"),
            idiv(s + idiv(n, 2), n).alias(f"{p}_mean"),
            F.sqrt(F.greatest(spread, F.lit(0.0))).alias(f"{p}_stdev"),
        ]
    everything = F.concat(*[F.col(c) for c in planes.values()])
    s = ordered(frames, [KEY], ["pts", "seq"], block_rows).index("n")
    return s.done().select(
        KEY, "n", "seq", "pts", "is_key", F.size(everything).alias("size"), adler32(everything).alias("checksum"), *out
    )


def sample_block_info(blocks: DataFrame, rate: float, channels: int = 1, block_rows: int | None = None) -> DataFrame:
    """Per block of 16-bit samples: number, time, rate, channels, samples and checksum of its bytes."""
    return blocks.select(
        KEY,
        F.col("block_no").alias("n"),
        "pts",
        F.lit(rate).alias("rate"),
        F.lit(channels).alias("channels"),
        F.size("samples").alias("n_samples"),
        adler32(pcm_bytes(F.col("samples"))).alias("checksum"),
    )


def frame_checksums(frames: DataFrame, algo: str = "md5", data: str = "data") -> DataFrame:
    """One line per packet: stream, dts, pts, duration, size and the hash of its bytes."""
    digest = {"md5": F.md5(data), "adler32": adler32_bytes(F.col(data))}[algo]
    return frames.select(KEY, "seq", "dts", "pts", "duration", F.length(data).alias("size"), digest.alias("hash"))


def packets(frames: DataFrame, duration: float) -> DataFrame:
    """Frames as packets: the luma values as bytes, decoded in display order."""
    return frames.select(
        KEY, "seq", "pts", F.col("pts").alias("dts"), F.lit(duration).alias("duration"), digits(F.col("luma")).alias("data")
    )


def stream_checksum(
    df: DataFrame, data: str = "data", fan: int = 1024, levels: int = 4, block_rows: int | None = None
) -> DataFrame:
    """One hash per stream over all its packets in order.

    MD5 of each packet, then of each ``fan`` neighbouring hashes in a row, and so on for a fixed number of levels, so
    that no task ever joins more than ``fan`` hashes. Four levels of 1024 hold 10^12 packets per stream.
    """
    rows = ordered(df.select(KEY, "pts", "seq", F.md5(data).alias("h")), [KEY], ["pts", "seq"], block_rows)
    tree = rows.index("i").done().select(KEY, "i", "h")
    for _ in range(levels):
        place = F.floor(F.col("i") / fan)
        tree = tree.withColumn("_up", place).groupBy(KEY, "_up").agg(
            F.sort_array(F.collect_list(F.struct("i", "h"))).alias("_l")
        )
        joined = F.array_join(F.transform("_l", lambda s: s["h"]), "")
        tree = tree.select(KEY, F.col("_up").alias("i"), F.md5(joined).alias("h"))
    return tree.select(KEY, F.col("h").alias("checksum"))


def concatenated_checksum(
    df: DataFrame, algo: str = "crc32", data: str = "data", block_rows: int | None = None
) -> DataFrame:
    """CRC-32 or Adler-32 per stream over the bytes of all its packets in order, as if they were one.

    Each packet is summed by itself; what its bytes do to the sum of the whole depends on the number of bytes behind it
    alone, so packets add up in any order.
    """
    length = F.length(data).cast("long")
    first, second = adler_sums(F.col(data))
    own = {"crc32": {"_crc": F.crc32(data)}, "adler32": {"_s1": first, "_s2": second}}[algo]
    rows = df.filter(F.col(data).isNotNull()).select(KEY, "pts", "seq", length.alias("_n"), *[c.alias(n) for n, c in own.items()])
    s = ordered(rows, [KEY], ["pts", "seq"], block_rows, probe=df.select(KEY, "pts", "seq"))
    s = s.running({"_end": ("sum", F.col("_n"))}).totals({"_all": F.sum("_n")})
    placed, after = s.done(), F.col("_all") - F.col("_end")
    if algo == "crc32":
        sums = placed.withColumn("_part", crc32_before("_crc", after)).groupBy(KEY).agg(F.bit_xor("_part").alias("_sum"))
        return sums.select(KEY, F.lower(F.lpad(F.hex("_sum"), 8, "0")).alias("checksum"))
    sums = placed.groupBy(KEY).agg(
        F.sum("_s1").alias("_a"), F.sum(adler_before(F.col("_s1"), F.col("_s2"), after)).alias("_b"), F.sum("_n").alias("_size")
    )
    a, b = (1 + F.col("_a")) % ADLER_BASE, (F.col("_size") + F.col("_b")) % ADLER_BASE
    return sums.select(KEY, F.lower(F.lpad(F.hex(b * 65536 + a), 8, "0")).alias("checksum"))


def level_histogram(frames: DataFrame, plane: str = "luma") -> DataFrame:
    """Number of pixels of each value per frame, counted inside the row that holds the frame."""
    levels = frames.select(KEY, "seq", F.explode(level_counts(F.col(plane))).alias("_l"))
    return levels.select(KEY, "seq", F.col("_l.value").alias("value"), F.col("_l.n").alias("n"))


def _pairs(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    left = a.select(KEY, "seq", F.col(col).alias("_a"))
    right = b.select(KEY, "seq", F.col(col).alias("_b"))
    return left.join(right, [KEY, "seq"])


def _psnr(sums: DataFrame, peak: int) -> DataFrame:
    ratio = F.log10(F.lit(float(peak) ** 2) * F.col("n") / F.col("sse")) * 10
    return sums.select(
        KEY,
        "n",
        "sse",
        F.sqrt(F.col("sse") / F.col("n")).alias("stddev"),
        F.when(F.col("sse") == 0, F.lit(EQUAL_PSNR)).otherwise(ratio).alias("psnr"),
        "max_diff",
    )


def psnr(a: DataFrame, b: DataFrame, col: str = "luma", peak: int = 255) -> DataFrame:
    """Per stream over frames of equal number: pixels, squared error, deviation, PSNR and largest difference."""
    d = F.zip_with("_a", "_b", lambda x, y: F.abs(x - y))
    per_frame = _pairs(a, b, col).select(KEY, d.alias("_d"))
    sums = per_frame.groupBy(KEY).agg(
        F.sum(F.size("_d")).alias("n"),
        F.sum(total_squares(F.col("_d"))).alias("sse"),
        F.max(F.array_max("_d")).alias("max_diff"),
    )
    return _psnr(sums, peak)


def sample_psnr(a: DataFrame, b: DataFrame, col: str = "pcm", peak: int = 65535) -> DataFrame:
    """The same over 16-bit samples of equal number."""
    d = F.abs(F.col("_a") - F.col("_b")).cast("long")
    sums = _pairs(a, b, col).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("sse"), F.max(d).cast("int").alias("max_diff")
    )
    return _psnr(sums, peak)


def ssim(a: DataFrame, b: DataFrame, width: int = 8, height: int = 8, col: str = "luma") -> DataFrame:
    """Structural similarity of frames of equal number."""

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(
            [
                ssim_kernel(np.asarray(p).reshape(height, width), np.asarray(q).reshape(height, width))
                for p, q in zip(x, y)
            ],
            dtype="float64",
        )

    return _pairs(a, b, col).select(KEY, "seq", similarity("_a", "_b").alias("ssim"))
