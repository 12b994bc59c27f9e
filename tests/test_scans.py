"""Ordered streams in blocks, scans over them, sliding statistics and checksums of concatenations."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell.operators import metrics as M
from framewell.operators import retime as R
from framewell.operators import stats as S
from framewell.ordered import BLOCK, ordered


def block_sizes(df, keys, rows):
    return [r["count"] for r in ordered(df, keys, ["pts", "seq"], rows).df.groupBy(*keys, BLOCK).count().collect()]


def test_rows_of_one_time_are_parted_by_the_second_key(spark):
    df = spark.range(10_000).selectExpr("1 AS stream_id", "7.0D AS pts", "id AS seq")
    sizes = block_sizes(df, ["stream_id"], 500)
    assert sum(sizes) == 10_000 and max(sizes) < 1500 and len(sizes) > 10
    got = ordered(df, ["stream_id"], ["pts", "seq"], 500).index("n").done()
    assert got.filter("n <> seq").count() == 0


def test_streams_one_after_another_and_uneven_times_have_cuts_of_their_own(spark):
    df = spark.range(12_000).selectExpr(
        "CAST(id DIV 3000 AS INT) AS stream_id", "CAST(exp((id % 3000) / 100.0) + id DIV 3000 * 1e15 AS DOUBLE) AS pts", "id AS seq"
    )
    sizes = block_sizes(df, ["stream_id"], 300)
    assert sum(sizes) == 12_000 and max(sizes) < 1000 and len(sizes) > 20
    short = ordered(df, ["stream_id"], ["pts", "seq"], 100_000)
    assert short.long().count() == 0 and short.index("n").done().filter("n <> seq % 3000").count() == 0


def test_plans_start_no_job(spark):
    df = spark.range(100).selectExpr("1 AS stream_id", "CAST(id AS DOUBLE) AS pts", "id AS seq", "CAST(id AS DOUBLE) AS value")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "plans")
    s = ordered(df, ["stream_id"], ["pts", "seq"], 10).index("n").shift({"p": F.col("value")}).totals({"t": F.sum("value")})
    plans = [s.done(), R.select_with_gap(df, 3.0), M.sliding_summary(df.withColumnRenamed("stream_id", "metric"), 5)]
    plans.append(R.dejudder(df.withColumn("ticks", F.col("seq")), 4))
    assert not tracker.getJobIdsForGroup("plans") and len(plans) == 4
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("algo", ["crc32", "adler32"])
@pytest.mark.parametrize("blocks", [None, 10])
def test_checksums_of_streams_are_those_of_all_bytes(spark, algo, blocks):
    rng = random.Random(3)
    rows, whole = [], {}
    for stream in range(3):
        for i in range(60):
            data = rng.randbytes(rng.choice([0, 1, 7, 300, 70_000 if i == 5 else 64]))
            rows.append((stream, i // 3 * 1.0, i, bytearray(data)))
            whole[stream] = whole.get(stream, b"") + data
    rows.append((9, 0.0, 0, bytearray()))
    whole[9] = b""
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "stream_id INT, pts DOUBLE, seq BIGINT, data BINARY").repartition(5)
    got = {r.stream_id: r.checksum for r in S.concatenated_checksum(df, algo, block_rows=blocks).collect()}
    assert got == {k: f"{getattr(zlib, algo)(v):08x}" for k, v in whole.items()}


@pytest.mark.parametrize(("n", "blocks"), [(5, None), (5, 8), (1, 8), (40, 16)])
def test_sliding_summary_matches_each_window(spark, n, blocks):
    rng = np.random.default_rng(n)
    rows = [(f"m{k}", i, float(rng.integers(0, 30))) for k, size in enumerate((70, 3, 1)) for i in range(size)]
    df = spark.createDataFrame([*rows, ("m0", 500, None)], "metric STRING, seq BIGINT, value DOUBLE").repartition(4)
    got = {(r.metric, r.seq): r for r in M.sliding_summary(df, n, block_rows=blocks).collect()}
    assert len(got) == len(rows)
    for metric in ("m0", "m1", "m2"):
        values = [v for m, _, v in rows if m == metric]
        for i in range(len(values)):
            w, r = sorted(values[max(0, i + 1 - n) : i + 1]), got[metric, i]
            assert (r["count"], r.min, r.max) == (len(w), w[0], w[-1])
            assert np.isclose(r.mean, np.mean(w)) and np.isclose(r.stddev, np.std(w, ddof=1) if len(w) > 1 else 0, atol=1e-9)
            for name, q in M.QUANTILES.items():
                at = q * (len(w) + 1)
                low = int(at)
                want = w[0] if low < 1 else w[-1] if low >= len(w) else w[low - 1] + (at - low) * (w[low] - w[low - 1])
                assert np.isclose(r[name], want)
    assert M.sliding_summary(df.limit(0), n).count() == 0


@pytest.mark.parametrize("blocks", [None, 10])
@pytest.mark.parametrize("gap", [0.0, 0.3, 2.0, 1e9])
def test_selections_know_the_one_before(spark, gap, blocks):
    rng = np.random.default_rng(6)
    rows = [(s, i, float(t)) for s in range(3) for i, t in enumerate(np.round(np.cumsum(rng.choice([0, 0.1, 0.7], 80)), 1))]
    df = spark.createDataFrame(rows, "stream_id INT, seq BIGINT, pts DOUBLE").repartition(3)
    got = R.select_with_previous(df, gap, blocks).collect()
    for s in range(3):
        want, last = [], None
        for _, i, t in (r for r in rows if r[0] == s):
            if last is None or t - last[1] >= gap:
                want.append((i, i, len(want), *((None, None) if last is None else last)))
                last = (i, t)
        mine = sorted((r.seq, r.n, r.selected_n, r.prev_selected_n, r.prev_selected_pts) for r in got if r.stream_id == s)
        assert mine == want
