"""Views over the given tables that the registered queries read, each in Spark and in plain SQL.

The two forms of a view follow the same written formulas; they share no code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session time zone is."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid, user = F.col("event_id"), F.col("user_id")
    lag = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).alias("batch_id")).agg(
        F.max(F.floor(F.col("value") * 1000)).cast("long").alias("behind_latest_ms")
    )
    rows = e.select(
        eid.alias("seq"),
        F.when(eid % 97 == 0, F.concat(F.lit(","), user.cast("string")))
        .otherwise(F.concat(user.cast("string"), F.lit(","), (eid % 7).cast("string")))
        .alias("partition_key"),
        F.when(eid % 50 == 0, F.lit("")).otherwise(F.col("props")).cast("binary").alias("payload"),
        F.when(eid % 83 == 0, F.lit("bad"))
        .otherwise(F.substring(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), 1, 23))
        .alias("utc_date_time"),
        F.timestamp_add("SECOND", F.floor("value").cast("int"), F.col("ts")).alias("receive_ts"),
        F.floor(eid / 100).alias("batch_id"),
        F.col("event_type"),
    )
    return rows.join(lag, "batch_id")


RECORDS = """
records AS (
  SELECT event_id AS seq,
    CASE WHEN event_id % 97 = 0 THEN ',' || user_id ELSE user_id || ',' || (event_id % 7) END AS partition_key,
    CASE WHEN event_id % 50 = 0 THEN '' ELSE props END AS payload,
    CASE WHEN event_id % 83 = 0 THEN 'bad' ELSE strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g')
      END AS utc_date_time,
    ts + to_seconds(CAST(floor(value) AS BIGINT)) AS receive_ts,
    event_id // 100 AS batch_id, event_type,
    max(CAST(floor(value * 1000) AS BIGINT)) OVER (PARTITION BY event_id // 100) AS behind_latest_ms
  FROM events),
good AS (
  SELECT *, try_strptime(utc_date_time, '%Y-%m-%d %H:%M:%S.%g') AS event_ts,
    CASE WHEN trim(split_part(partition_key, ',', 1)) <> '' THEN split_part(partition_key, ',', 1)
      ELSE partition_key END AS token,
    epoch_us(receive_ts) // 1000
      - epoch_us(try_strptime(utc_date_time, '%Y-%m-%d %H:%M:%S.%g')) // 1000 AS delay_ms
  FROM records WHERE payload <> '' AND try_strptime(utc_date_time, '%Y-%m-%d %H:%M:%S.%g') IS NOT NULL)
"""


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    zones = F.transform(
        F.sequence(F.lit(1), (1 + k % 4).cast("int")),
        lambda i: F.struct(
            i.cast("int").alias("id"),
            F.concat_ws(
                ",",
                (7 * k + 13 * i) % 60,
                (11 * k + 29 * i) % 60,
                5 + (3 * k + 17 * i) % 60,
                5 + (5 * k + 19 * i) % 60,
            ).alias("pos"),
        ),
    )
    level = F.when(k % 41 == 0, F.lit(0)).otherwise(200 + k % 900).cast("int")
    body = F.to_json(F.struct(level.alias("sensitivity"), zones.alias("dataList")))
    damaged = (
        F.when(k % 101 == 3, F.lit("{\"sensitivity\": 5, "))
        .when(k % 101 == 4, F.lit('{"sensitivity":300,"dataList":[{"name":1,"pos":"1,2,30,40"}]}'))
        .when(k % 101 == 5, F.lit('{"sensitivity":300,"dataList":[{"id":7,"area":"x"}]}'))
        .when(k % 101 == 6, F.lit('{"sensitivity":300,"dataList":[{"id":7}]}'))
        .when(k % 101 == 7, F.lit('{"sensitivity":300,"dataList":7}'))
    )
    return table(spark, sf_dir, "customer").select(
        k.alias("token"), F.coalesce(damaged, body).alias("config_json")
    )


CONFIGS = """
config_zones AS (
  SELECT c_custkey AS token, c_custkey % 101 AS damage,
    CASE WHEN c_custkey % 41 = 0 THEN 0 ELSE 200 + c_custkey % 900 END AS sensitivity,
    1 + c_custkey % 4 AS n_zones, i AS zone_id,
    (7 * c_custkey + 13 * i) % 60 AS x, (11 * c_custkey + 29 * i) % 60 AS y,
    5 + (3 * c_custkey + 17 * i) % 60 AS w, 5 + (5 * c_custkey + 19 * i) % 60 AS h
  FROM customer, LATERAL (SELECT unnest(range(1, 2 + c_custkey % 4)) AS i)),
zones AS (
  SELECT token, zone_id, x, y, w, h, n_zones, row_number() OVER (PARTITION BY token ORDER BY zone_id) AS pos_no,
    sensitivity
  FROM config_zones WHERE damage NOT IN (3, 4, 5, 6, 7) AND sensitivity > 0 AND n_zones <= 3)
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    frame = F.floor(e / 4)
    x1, y1 = (37 * e) % 80, (53 * e) % 80
    return (
        table(spark, sf_dir, "events")
        .filter(e % 4 <= frame % 4)
        .select(
            frame.alias("frame_id"),
            e.alias("box_no"),
            (1 + e % 3).cast("int").alias("zone_id"),
            x1.cast("int").alias("x1"),
            y1.cast("int").alias("y1"),
            F.least(F.lit(100), x1 + 2 + (11 * e) % 36).cast("int").alias("x2"),
            F.least(F.lit(100), y1 + 2 + (13 * e) % 36).cast("int").alias("y2"),
        )
    )


BOXES = """
boxes AS (
  SELECT event_id // 4 AS frame_id, event_id AS box_no, CAST(1 + event_id % 3 AS INTEGER) AS zone_id,
    CAST((37 * event_id) % 80 AS INTEGER) AS x1, CAST((53 * event_id) % 80 AS INTEGER) AS y1,
    CAST(least(100, (37 * event_id) % 80 + 2 + (11 * event_id) % 36) AS INTEGER) AS x2,
    CAST(least(100, (53 * event_id) % 80 + 2 + (13 * event_id) % 36) AS INTEGER) AS y2
  FROM events WHERE event_id % 4 <= (event_id // 4) % 4)
"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    x1, y1 = (41 * e) % 80, (59 * e) % 80
    names = F.array(*[F.lit(v) for v in ("person", " dog ", "car", "Person", "cat")])
    return table(spark, sf_dir, "events").select(
        F.floor(e / 4).alias("frame_id"),
        e.alias("object_no"),
        x1.cast("int").alias("x1"),
        y1.cast("int").alias("y1"),
        F.least(F.lit(100), x1 + 5 + (7 * e) % 36).cast("int").alias("x2"),
        F.least(F.lit(100), y1 + 5 + (17 * e) % 36).cast("int").alias("y2"),
        ((e % 100) / 100).alias("score"),
        F.get(names, (e % 5).cast("int")).alias("type_name"),
    )


OBJECTS = """
objects AS (
  SELECT event_id // 4 AS frame_id, event_id AS object_no,
    CAST((41 * event_id) % 80 AS INTEGER) AS x1, CAST((59 * event_id) % 80 AS INTEGER) AS y1,
    CAST(least(100, (41 * event_id) % 80 + 5 + (7 * event_id) % 36) AS INTEGER) AS x2,
    CAST(least(100, (59 * event_id) % 80 + 5 + (17 * event_id) % 36) AS INTEGER) AS y2,
    (event_id % 100) / 100.0::DOUBLE AS score,
    ['person', ' dog ', 'car', 'Person', 'cat'][1 + event_id % 5] AS type_name
  FROM events)
"""

FRAME_ZONES = """
frame_zones AS (
  SELECT frame_id, zone_id, x1, y1, x2, y2 FROM boxes)
"""


def stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = (1 + F.col("o_orderkey") % 800).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("object_key"),
        F.col("o_orderdate").alias("created"),
        hours.alias("expires_hours"),
        F.ceil(hours / 24).cast("string").alias("day_key"),
    )


STORED = """
stored_objects AS (
  SELECT o_orderkey AS object_key, o_orderdate AS created, CAST(1 + o_orderkey % 800 AS INTEGER) AS expires_hours,
    CAST((1 + o_orderkey % 800 + 23) // 24 AS VARCHAR) AS day_key
  FROM orders)
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"),
        (F.col("event_id") % 2).cast("int").alias("channel"),
        F.col("event_id").alias("seq"),
        (epoch_micros(F.col("ts")) / 1e6).alias("pts"),
        (F.col("value") / 500).alias("value"),
        (F.col("value") * 60).cast("int").alias("pcm"),
    )


SAMPLES = """
samples AS (
  SELECT user_id AS stream_id, CAST(event_id % 2 AS INTEGER) AS channel, event_id AS seq,
    epoch_us(ts) / 1e6::DOUBLE AS pts, value / 500 AS value, CAST(trunc(value * 60) AS INTEGER) AS pcm
  FROM events)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    dark = F.floor(v / 60) % 3 == 1
    luma = F.transform(
        "embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 300 * x.cast("double")))).cast("int")
    )
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("stream_id"),
        v.alias("seq"),
        (v * F.lit(0.04).cast("double")).alias("pts"),
        (v % 12 == 0).alias("is_key"),
        (v % 3 == 0).alias("is_base"),
        F.floor(v / 12).alias("packet_id"),
        F.when(dark, F.transform(luma, lambda y: F.least(y, F.lit(10)))).otherwise(luma).alias("luma"),
    )


FRAMES = """
frames AS (
  SELECT label AS stream_id, vec_id AS seq, vec_id * 0.04::DOUBLE AS pts, vec_id % 12 = 0 AS is_key,
    vec_id % 3 = 0 AS is_base, vec_id // 12 AS packet_id,
    list_transform(embedding, lambda x: CAST(least(
      CASE WHEN (vec_id // 60) % 3 = 1 THEN 10 ELSE 255 END,
      greatest(0, floor(128 + 300 * CAST(x AS DOUBLE)))) AS INTEGER)) AS luma
  FROM embeddings),
pixels AS (
  SELECT stream_id, seq, pts, is_key, i, (i % 8) AS px, (i // 8) AS py, luma[i + 1] AS v
  FROM frames, LATERAL (SELECT unnest(range(0, 64)) AS i)),
frame_pairs AS (
  SELECT *, lag(luma) OVER (PARTITION BY stream_id ORDER BY pts, seq) AS prev,
    row_number() OVER (PARTITION BY stream_id ORDER BY pts, seq) - 1 AS n
  FROM frames),
pixel_pairs AS (
  SELECT stream_id, seq, pts, n, i, i % 8 AS px, i // 8 AS py, luma[i + 1] AS v, prev[i + 1] AS pv
  FROM frame_pairs, LATERAL (SELECT unnest(range(0, 64)) AS i))
"""


def planar_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as packed bytes: an 8x8 luma plane and two 4x4 chroma planes taken from the same vector."""
    f = frames(spark, sf_dir)
    as_bytes = F.unhex(F.array_join(F.transform("luma", lambda y: F.lpad(F.hex(y), 2, "0")), ""))
    return f.select(
        "stream_id",
        "seq",
        "pts",
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        F.concat(as_bytes, F.substring(as_bytes, 1, 16), F.substring(as_bytes, 17, 16)).alias("yuv"),
    )


def clips(spark: SparkSession, sf_dir: str, width: int = 640, height: int = 360) -> DataFrame:
    """Full-size luma frames derived from the frame table, one per row: an 8x8 frame enlarged to ``width`` x ``height``.

    The frames of a stream are a camera that shows a fixed texture; the brightest cell of the small frame is drawn as
    a square over it, so that what moves from frame to frame comes from the data. The small frames are dealt anew first, since
    a table of few megabytes, or of one row group, would have all pictures drawn and cut by one task.
    """
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    f = frames(spark, sf_dir)
    place = F.array_position("luma", F.array_max("luma")) - 1
    small = f.select(F.col("stream_id").cast("string").alias("token"), F.col("seq").alias("frame_no"), place.alias("cell"))
    small = small.repartition(n, "frame_no")
    cw, ch = width // 8, height // 8
    # strings of raw bytes, since these repeat and join as they are
    quiet, lit = (F.repeat(F.unhex(F.lit(level)).cast("string"), cw) for level in ("64", "C8"))
    cx = (F.col("cell") % 8).cast("int")
    bright = F.concat(F.repeat(quiet, cx), lit, F.repeat(quiet, 7 - cx))
    cy = F.floor(F.col("cell") / 8).cast("int")
    above, below = F.repeat(quiet, 8 * ch * cy), F.repeat(quiet, 8 * ch * (7 - cy))
    return small.select(
        "token",
        "frame_no",
        F.lit(width).alias("width"),
        F.lit(height).alias("height"),
        F.concat(above, F.repeat(bright, F.lit(ch)), below).cast("binary").alias("luma"),
    )


def frames_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("seq", F.col("seq").cast("double"))
    again = f.filter(F.col("seq") % 4 == 0).withColumn("seq", F.col("seq") + 0.5)
    return f.unionByName(again)


CTE = {
    "records": RECORDS,
    "configs": CONFIGS,
    "boxes": BOXES,
    "objects": OBJECTS,
    "stored": STORED,
    "samples": SAMPLES,
    "frames": FRAMES,
}


def with_views(views: str, body: str) -> str:
    parts = [CTE[v].strip() for v in views.split()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
