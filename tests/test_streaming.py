"""A stream over several files gives what the batch over all of them gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell.operators import admission as A
from framewell.operators import intervals as I
from framewell.operators import motion as D
from framewell.plans import fixtures as V
from framewell.plans.service import counter_events
from framewell.sources import records as SR
from framewell.streaming import jobs as J


def in_files(df, path, key, parts):
    """Write rows as files that follow each other in time."""
    edges = df.selectExpr(f"min({key}) AS a", f"max({key}) AS b").first()
    width = (edges.b - edges.a) / parts + 1e-9
    for i in range(parts):
        low, high = edges.a + i * width, edges.a + (i + 1) * width
        df.filter((F.col(key) >= low) & (F.col(key) < high)).coalesce(1).write.mode("append").parquet(path)


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture
def record_files(spark, sf_dir, tmp_path):
    path = str(tmp_path / "records")
    in_files(V.records(spark, sf_dir).drop("event_type"), path, "seq", 4)
    return path


def finish(query):
    query.awaitTermination(240)
    assert query.exception() is None


def test_admission(spark, sf_dir, tmp_path, record_files):
    stream = J.admitted_stream(spark, record_files, max_files_per_trigger=1, max_delay_ms=300_000)
    finish(J.to_files(stream, str(tmp_path / "out"), str(tmp_path / "ck")))
    want = A.admit(V.records(spark, sf_dir), max_delay_ms=300_000)
    got = rows_of(spark.read.parquet(str(tmp_path / "out")), "seq", "token", "delay_ms")
    assert got == rows_of(want, "seq", "token", "delay_ms")


def test_counters(spark, sf_dir, tmp_path, record_files):
    cols = ["interval_start", "recordCount", "dataDelayedCount"]
    rows = SR.read_records(spark, record_files, streaming=True, max_files_per_trigger=1)
    admitted = A.admit(rows).withColumn("event_type", F.lit("x"))
    events = counter_events(admitted).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = J.counters_stream(events, "6 hours", "1 hour")
    finish(J.to_files(stream, str(tmp_path / "out"), str(tmp_path / "ck")))
    batch = counter_events(A.admit(SR.read_records(spark, record_files)).withColumn("event_type", F.lit("x")))
    batch = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    want = rows_of(J.interval_counters(batch, "6 hours"), *cols)
    got = rows_of(spark.read.parquet(str(tmp_path / "out")), *cols)
    # intervals the watermark has not passed are not out yet
    assert len(got) > 50 and got == want[: len(got)] and len(want) - len(got) <= 2


def test_results_are_replaced_by_key(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "token STRING, created STRING, version LONG, item STRING"
    spark.createDataFrame([("a", "1", 1, "x"), ("a", "1", 2, "y"), ("b", "1", 1, "z")], schema).write.parquet(src)
    items = spark.readStream.schema(schema).parquet(src)
    finish(J.to_results(items, str(tmp_path / "t"), str(tmp_path / "ck")))
    spark.createDataFrame([("b", "1", 1, "new"), ("a", "1", 1, "late")], schema).write.mode("append").parquet(src)
    finish(J.to_results(items, str(tmp_path / "t"), str(tmp_path / "ck")))
    got = rows_of(J.read_results(spark, str(tmp_path / "t")), "token", "created", "version", "item")
    assert got == [("a", "1", 2, "y"), ("b", "1", 1, "new")]


def test_object_store_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    df = spark.range(10).selectExpr(
        "id AS object_key", "timestamp_ntz'2024-01-05 10:00:00' AS created", "'7' AS expired", "CAST('abc' AS BINARY) AS body"
    )
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    finish(J.to_object_store(stream, str(tmp_path / "objects"), str(tmp_path / "ck")))
    got = spark.read.parquet(str(tmp_path / "objects"))
    assert got.count() == 10 and got.filter("length = 3 AND event_date = '2024-01-05'").count() == 10


def test_dark_and_silent_runs(spark, sf_dir, tmp_path):
    frames, path = V.frames(spark, sf_dir), str(tmp_path / "frames")
    in_files(frames, path, "pts", 3)
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(path)
    finish(J.to_files(J.dark_intervals_stream(stream), str(tmp_path / "d"), str(tmp_path / "ckd")))
    found = I.runs(frames, F.lit(True)).groupBy("stream_id").agg(F.max("last").alias("eof"))
    want = I.dark_intervals(frames).join(found, "stream_id").filter("end < eof")
    got = rows_of(spark.read.parquet(str(tmp_path / "d")), "stream_id", "start", "end")
    assert len(got) > 5
    assert set(rows_of(want, "stream_id", "start", "end")) <= set(got)
    assert set(got) <= set(rows_of(I.dark_intervals(frames), "stream_id", "start", "end"))

    samples, path = V.samples(spark, sf_dir), str(tmp_path / "samples")
    in_files(samples, path, "pts", 3)
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(path)
    finish(J.to_files(J.silence_intervals_stream(stream, 0.1, 21600.0), str(tmp_path / "s"), str(tmp_path / "cks")))
    want = I.silence_intervals(samples, 0.1, 21600.0).filter("end IS NOT NULL")
    got = rows_of(spark.read.parquet(str(tmp_path / "s")), "stream_id", "start", "end", "n")
    assert got == rows_of(want, "stream_id", "start", "end", "n") and len(got) > 10


def moving_square(n=12, size=(360, 640)):
    """Textured still pictures of two cameras; over the first one a square moves from frame 5 on."""
    rng = np.random.default_rng(7)
    base = {t: rng.integers(95, 106, size).astype(np.uint8) for t in ("moving", "still")}
    rows = []
    for t, img in base.items():
        for f in range(n):
            frame = img.copy()
            if t == "moving" and f >= 5:
                frame[100:160, 40 + 8 * (f - 5) : 100 + 8 * (f - 5)] = 200
            rows.append((t, f, size[1], size[0], bytearray(frame.tobytes())))
    return rows


CONFIG_SCHEMA = "token STRING, sensitivity INT, zones ARRAY<STRUCT<zone_no INT, id INT, x INT, y INT, w INT, h INT>>"
FRAME_SCHEMA = "token STRING, frame_no BIGINT, width INT, height INT, luma BINARY"


@pytest.fixture(scope="module")
def clip(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clip"))
    df = spark.createDataFrame(moving_square(), FRAME_SCHEMA)
    in_files(df, path, "frame_no", 3)
    return path


@pytest.fixture(scope="module")
def clip_config(spark):
    zones = [(1, 11, 0, 0, 50, 100), (2, 12, 40, 10, 70, 80)]
    return spark.createDataFrame([("moving", 1000, zones), ("still", 1000, [])], CONFIG_SCHEMA)


def test_square_is_found_on_its_path(spark, clip, clip_config):
    got = D.detect_motion(spark.read.parquet(clip), clip_config).collect()
    assert {r.token for r in got} == {"moving"}
    assert min(r.frame_no for r in got) == 5
    assert {r.zone_id for r in got} == {11}
    assert all(r.x1 >= 5 and r.x2 <= 27 and r.y1 >= 27 and r.y2 <= 45 for r in got)


def test_motion_in_blocks_equals_one_pass(spark, clip, clip_config):
    regions = D.zone_regions(spark.read.parquet(clip), D.watched_zones(clip_config))
    cols = ["token", "zone_id", "frame_no", "x", "y", "w", "h"]
    want = rows_of(D.zone_motion_boxes(regions), *cols)
    assert rows_of(D.zone_motion_boxes(regions, block_rows=5), *cols) == want and want


def test_motion_stream_equals_batch(spark, clip, clip_config, tmp_path):
    frames = spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", 1).parquet(clip)
    finish(J.to_files(J.motion_stream(frames, clip_config), str(tmp_path / "m"), str(tmp_path / "ck")))
    cols = ["token", "zone_id", "frame_no", "x", "y", "w", "h"]
    batch = D.zone_motion_boxes(D.zone_regions(spark.read.parquet(clip), D.watched_zones(clip_config)))
    assert rows_of(spark.read.parquet(str(tmp_path / "m")), *cols) == rows_of(batch, *cols)


def test_logs_are_followed(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("10:00 INFO start\n10:01 ERROR bad INFO\nplain\n")
    (tmp_path / "logs" / "b.txt").write_text("10:00 WARN other\n")
    lines = SR.tail_logs(spark, str(tmp_path / "logs"), streaming=True)
    finish(J.to_files(lines, str(tmp_path / "out"), str(tmp_path / "ck")))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.level or "", r.file) for r in got) == [("", "a.log"), ("ERROR", "a.log"), ("INFO", "a.log")]
