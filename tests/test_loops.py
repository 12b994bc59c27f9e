"""Closed forms and block runs against plain loops on small random streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell.operators import combine as C
from framewell.operators import intervals as I
from framewell.operators import metrics as M
from framewell.operators import retime as R
from framewell.operators import stats as S
from framewell.ordered import ordered


def stream(spark, rng, streams=2, n=30, ties=True):
    rows = []
    for s in range(streams):
        pts = np.cumsum(rng.choice([0.0, 0.1, 0.25, 0.5, 2.0] if ties else [0.1, 0.25, 0.5, 2.0], n))
        rows += [(s, i, float(p), float(v)) for i, (p, v) in enumerate(zip(pts, rng.integers(-4, 5, n) / 4))]
    return rows, spark.createDataFrame(rows, "stream_id INT, seq BIGINT, pts DOUBLE, value DOUBLE")


def by_stream(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


BLOCKS = [None, 10]


@pytest.mark.parametrize("blocks", BLOCKS)
@pytest.mark.parametrize("seed", [1, 2])
def test_ordered_helpers(spark, blocks, seed):
    rows, df = stream(spark, np.random.default_rng(seed))
    s = ordered(df, ["stream_id"], ["pts", "seq"], blocks)
    assert s.long().isEmpty() == (blocks is None)
    some = F.when(F.col("value") > 0, F.col("value"))
    s = s.index("n").shift({"b3": F.col("value")}, 3).shift({"a2": F.col("value")}, -2)
    s = s.running({"total": ("sum", F.col("value")), "last": ("last", some), "first": ("first", some)})
    s = s.running({"before": ("max", F.col("value"))}, inclusive=False)
    s = s.totals({"whole": F.count(F.lit(1))}).sliding(5, {"five": F.sum("value")})
    got = {(r.stream_id, r.seq): r for r in s.done().collect()}
    for key, own in by_stream(rows).items():
        v = [r[3] for r in own]
        for i, x in enumerate(v):
            r, so_far = got[key, i], [y for y in v[: i + 1] if y > 0]
            assert r.n == i and r.whole == len(v)
            assert r.b3 == (v[i - 3] if i >= 3 else None)
            assert r.a2 == (v[i + 2] if i + 2 < len(v) else None)
            assert math.isclose(r.total, sum(v[: i + 1]), abs_tol=1e-9)
            assert r.last == (so_far[-1] if so_far else None) and r.first == (so_far[0] if so_far else None)
            assert r.before == (max(v[:i]) if i else None)
            assert math.isclose(r.five, sum(v[max(0, i - 4) : i + 1]), abs_tol=1e-9)


def test_streams_of_null_key_and_uneven_length(spark):
    df = spark.range(50).select(
        F.when(F.col("id") < 45, F.lit(None)).otherwise(F.lit("small")).alias("stream_id"), F.col("id").alias("pts"), F.col("id").alias("seq")
    )
    got = ordered(df, ["stream_id"], ["pts", "seq"], 10).index("n").done().collect()
    assert sorted(r.n for r in got if r.stream_id is None) == list(range(45))
    assert sorted(r.n for r in got if r.stream_id) == list(range(5))


def loop_gap(own, gap):
    out, last = [], None
    for _, i, p, _ in own:
        if last is None or p - last >= gap:
            out.append(i)
            last = p
    return out


@pytest.mark.parametrize("blocks", BLOCKS)
def test_select_with_gap(spark, blocks):
    rows, df = stream(spark, np.random.default_rng(5))
    got = R.select_with_gap(df, 1.3, blocks).collect()
    for key, own in by_stream(rows).items():
        assert sorted(r.seq for r in got if r.stream_id == key) == loop_gap(own, 1.3)


def loop_trim(own, start_frame, start_pts, end_frame, duration):
    out, first = [], None
    for n, (_, i, p, _) in enumerate(own):
        if not (n >= start_frame or p >= start_pts):
            continue
        first = p if first is None else first
        if not (n < end_frame or p - first < duration):
            break
        out.append(i)
    return out


@pytest.mark.parametrize("blocks", BLOCKS)
def test_trim(spark, blocks):
    rows, df = stream(spark, np.random.default_rng(8))
    got = R.trim(df, start_frame=9, start_pts=3.0, end_frame=12, duration=6.0, block_rows=blocks).collect()
    for key, own in by_stream(rows).items():
        assert sorted(r.seq for r in got if r.stream_id == key) == loop_trim(own, 9, 3.0, 12, 6.0)


def loop_resample(own, fps):
    first, out, held = own[0][2], [], own[0][1]
    for _, i, p, _ in own[1:]:
        slot = math.floor((p - first) * fps + 0.5)
        while len(out) < slot:
            out.append(held)
        held = i
    return out + [held]


@pytest.mark.parametrize("fps", [1.0, 10.0])
@pytest.mark.parametrize("blocks", BLOCKS)
def test_resample_fps(spark, fps, blocks):
    rows, df = stream(spark, np.random.default_rng(3))
    got = R.resample_fps(df, fps, block_rows=blocks).collect()
    for key, own in by_stream(rows).items():
        mine = sorted((r.slot, r.seq) for r in got if r.stream_id == key)
        assert [k for k, _ in mine] == list(range(len(mine)))
        assert [i for _, i in mine] == loop_resample(own, fps)


def loop_dejudder(ticks, c):
    """Times kept as a list on one clock: after a jump back all earlier times move by the jump."""
    seen, out = [], []
    for p in ticks:
        if len(seen) < c + 2:
            out.append(2 * c * p)
        else:
            if p < seen[-c - 2]:
                # the step over the jump is taken to be the one a cycle earlier
                shift = (p - seen[-1]) - (seen[-c] - seen[-c - 1])
                seen = [q + shift for q in seen]
            out.append(out[-1] - (c - 1) * (seen[-1] - seen[-c - 1]) + (c + 1) * (p - seen[-c]))
        seen.append(p)
    return out


@pytest.mark.parametrize("jump", [False, True])
@pytest.mark.parametrize("blocks", BLOCKS)
def test_dejudder(spark, jump, blocks):
    rng = np.random.default_rng(11)
    rows = []
    for s in range(3):
        ticks = np.cumsum(rng.integers(1, 9, 40)).tolist()
        if jump and s != 1:
            ticks[20:] = [t - 150 for t in ticks[20:]]
        rows += [(s, i, int(t)) for i, t in enumerate(ticks)]
    df = spark.createDataFrame(rows, "stream_id INT, seq BIGINT, ticks BIGINT")
    got = R.dejudder(df, 4, block_rows=blocks).collect()
    for s in range(3):
        want = loop_dejudder([t for k, _, t in rows if k == s], 4)
        assert [r.new_ticks for r in sorted(got, key=lambda r: r.seq) if r.stream_id == s] == want


def loop_duplicates(pictures, hi, lo, frac, most):
    ref, drops, out = None, 0, []
    for p in pictures:
        grid = np.array(p).reshape(16, 16)
        free = not (most > 0 and drops >= most) and not (most < 0 and drops - 1 > most)
        same = False
        if ref is not None and free:
            count, same = 0, True
            for y in range(0, 16 - 7, 4):
                for x in range(8, 16 - 7, 4):
                    d = int(np.abs(grid[y : y + 8, x : x + 8] - ref[y : y + 8, x : x + 8]).sum())
                    count += d > lo
                    same = same and d <= hi and count <= int(1 * 1 * frac)
        drops = max(1, drops + 1) if same else min(-1, drops - 1)
        ref = ref if same else grid
        out.append((not same, drops))
    return out


@pytest.mark.parametrize("most", [0, 2, -3])
@pytest.mark.parametrize("blocks", BLOCKS)
def test_near_duplicate_frames(spark, most, blocks):
    rng = np.random.default_rng(21)
    rows = []
    for s in range(2):
        level = np.full(256, 100)
        for i in range(30):
            level = np.clip(level + (rng.integers(-60, 60) if rng.random() < 0.2 else rng.integers(-3, 4)), 0, 255)
            rows.append((s, i, i * 0.04, [int(v) for v in level]))
    df = spark.createDataFrame(rows, "stream_id INT, seq BIGINT, pts DOUBLE, luma ARRAY<INT>")
    got = I.near_duplicate_frames(df, 16, 16, max_drops=most, block_rows=blocks).collect()
    for s in range(2):
        want = loop_duplicates([r[3] for r in rows if r[0] == s], 768, 320, 0.33, most)
        mine = [(r.keep, r.drop_count) for r in sorted(got, key=lambda r: r.seq) if r.stream_id == s]
        assert mine == want
        assert {k for k, _ in mine} == {True, False}


def loop_vote(singles):
    """One clear vote decides at first; afterwards three of the last four, with no other among them."""
    decided, out = "undetermined", []
    for i in range(len(singles)):
        votes = [t for t in singles[max(0, i - 3) : i + 1] if t != "undetermined"]
        if len(set(votes)) == 1 and len(votes) >= (1 if decided == "undetermined" else 3):
            decided = votes[0]
        out.append(decided)
    return out


@pytest.mark.parametrize("blocks", BLOCKS)
def test_interlace_vote(spark, blocks):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(2):
        pictures = rng.integers(0, 255, (30, 8, 8))
        for i in range(1, 30):
            if rng.random() < 0.7:
                pictures[i, 1::2] = pictures[i - 1, 1::2]
        rows += [(s, i, i * 0.04, [int(v) for v in p.ravel()]) for i, p in enumerate(pictures)]
    df = spark.createDataFrame(rows, "stream_id INT, seq BIGINT, pts DOUBLE, luma ARRAY<INT>")
    got = I.interlace_class(df, block_rows=blocks).collect()
    for s in range(2):
        mine = sorted((r for r in got if r.stream_id == s), key=lambda r: r.seq)
        assert [r.multiple for r in mine] == loop_vote([r.single for r in mine])
        assert mine[-1].total_tff == sum(r.multiple == "tff" for r in mine)


def loop_signal(values, mult, settle):
    power, low, high = 0.0, math.inf, 0.0
    for n, x in enumerate(values):
        power = power * mult + (1 - mult) * x * x
        if n >= settle:
            low, high = min(low, power), max(high, power)
    if len(values) <= settle:
        low = high = sum(x * x for x in values) / len(values)
    return low, high


@pytest.mark.parametrize("blocks", BLOCKS)
def test_signal_power_range(spark, blocks):
    rows, df = stream(spark, np.random.default_rng(9))
    got = S.signal_stats(df.withColumn("channel", F.lit(0)), 0.5, 4.0, blocks).collect()
    for key, own in by_stream(rows).items():
        low, high = loop_signal([r[3] for r in own], math.exp(-1 / 0.5 / 4.0), 10)
        mine = next(r for r in got if r.stream_id == key)
        assert math.isclose(mine.rms_peak_db, 20 * math.log10(math.sqrt(high)), abs_tol=1e-9)
        assert math.isclose(mine.rms_trough_db, 20 * math.log10(math.sqrt(low)), abs_tol=1e-9)


@pytest.mark.parametrize("blocks", BLOCKS)
def test_fill_gaps_by_hand(spark, blocks):
    pts = [0.0, 1.0, 2.0, 5.0, 5.2, 6.0, 7.4]
    df = spark.createDataFrame([(1, i, p, 1.0) for i, p in enumerate(pts)], "stream_id INT, seq BIGINT, pts DOUBLE, value DOUBLE")
    got = R.fill_gaps(df, 1.0, 0.5, 3 if blocks else None).collect()
    assert sorted((round(r.pts, 6), r.filled) for r in got) == [
        (0.0, False), (1.0, False), (2.0, False), (3.0, True), (4.0, True), (5.0, False), (6.0, False), (7.4, False),
    ]


def test_long_gaps_unfold(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 250000.0)], "stream_id INT, seq BIGINT, pts DOUBLE")
    got = R.resample_fps(df, 1.0)
    assert got.count() == 250001 and got.filter("seq = 0").count() == 250000


def test_mix_norm_falls_after_an_input_ends(spark):
    def tone(n):
        return spark.range(n).selectExpr("1 AS stream_id", "id AS seq", "CAST(id AS DOUBLE) AS pts", "1.0D AS value")

    got = C.mix_streams([tone(4), tone(9), tone(6)], transition=4.0)
    want, norm, lengths = [], 3.0, (4, 9, 6)
    for n in range(9):
        active = sum(k > n for k in lengths)
        if norm > active:
            norm = max(norm - 0.25, active)
        want.append(active / norm)
    assert [round(r.value, 9) for r in got.orderBy("n").collect()] == [round(v, 9) for v in want]
    assert C.mix_streams([tone(4), tone(9)], "first").count() == 4


def test_last_rows_and_quantiles(spark):
    values = [5, 1, 9, 7, 3, 8, 2]
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)], "metric STRING, seq BIGINT, value BIGINT")
    row = M.histogram_summary(df, n=5).first()
    assert row["count"] == 7 and row.min == 2 and row.max == 9 and row.median == 7
    assert row.p75 == 8.5 and row.p999 == 9
    got = M.sliding_histogram(df, n=3).orderBy("seq").collect()
    for i, r in enumerate(got):
        last = values[max(0, i - 2) : i + 1]
        assert (r["count"], r.min, r.max) == (len(last), min(last), max(last))
        assert math.isclose(r.mean, np.mean(last))
        assert math.isclose(r.stddev, np.std(last, ddof=1) if i else 0, abs_tol=1e-9)


def test_volume_of_silence_and_full_scale(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, -32768), (2, 32767)], "stream_id INT, pcm INT")
    got = {r.stream_id: r for r in S.volume_stats(df).collect()}
    assert got[1].mean_db == got[1].max_db == -91.0
    assert got[2].max_db == 0.0 and abs(got[2].mean_db) < 1e-3


def test_checksum_of_bytes_and_of_arrays_agree(spark):
    from framewell.functions.pixels import adler32, adler32_bytes, digits

    df = spark.createDataFrame([([(i * 37) % 256 for i in range(300)],), ([255] * 70000,), ([7],)], "luma ARRAY<INT>")
    got = df.select(adler32(F.col("luma")).alias("a"), adler32_bytes(digits(F.col("luma"))).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_stream_checksum_sees_order(spark):
    def packets(order):
        rows = [(1, float(i), i, bytes([b])) for i, b in enumerate(order)]
        return spark.createDataFrame(rows, "stream_id INT, pts DOUBLE, seq BIGINT, data BINARY")

    one, two = (S.stream_checksum(packets(o), fan=4).first().checksum for o in (range(20), [1, 0, *range(2, 20)]))
    assert one != two
    assert S.stream_checksum(packets(range(20)), fan=4, block_rows=3).first().checksum == one
