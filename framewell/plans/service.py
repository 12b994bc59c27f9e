"""Queries of the camera service: admission, zones and boxes, motion, events and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.functions import boxes as B
from framewell.functions.tokens import camera_token
from framewell.operators import admission as A
from framewell.operators import events as E
from framewell.operators import geometry as G
from framewell.operators import metrics as M
from framewell.operators import motion as D
from framewell.plans import fixtures as V
from framewell.plans.registry import query, r6, rounded
from framewell.session import scratch_path
from framewell.sources import objects as SO
from framewell.sources import queue as SQ
from framewell.sources import records as SR
from framewell.sources import results as SS


# -- admission, sources and sinks ----------------------------------------------------------------------------------


def admitted(spark: SparkSession, d: str) -> DataFrame:
    good, _ = A.split_valid_malformed(A.drop_empty_payload(V.records(spark, d)))
    return A.receive_delay(A.with_token(good))


@query(
    "records",
    """SELECT seq, partition_key, CAST(strlen(payload) AS INTEGER) AS payload_bytes, utc_date_time,
       epoch_us(receive_ts) AS receive_us, behind_latest_ms, batch_id FROM records""",
)
def read_records(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "records")
    V.records(spark, d).drop("event_type").write.parquet(path)
    rows = SR.read_records(spark, path)
    return rows.select(
        "seq",
        "partition_key",
        F.length("payload").alias("payload_bytes"),
        "utc_date_time",
        V.epoch_micros(F.col("receive_ts")).alias("receive_us"),
        "behind_latest_ms",
        "batch_id",
    )


@query("records", "SELECT seq, payload FROM records WHERE strlen(payload) > 0")
def drop_empty_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = A.drop_empty_payload(V.records(spark, d))
    return rows.select("seq", F.col("payload").cast("string").alias("payload"))


@query(
    "records",
    """SELECT seq, utc_date_time, try_strptime(utc_date_time, '%Y-%m-%d %H:%M:%S.%g') IS NOT NULL AS valid,
       coalesce(epoch_us(try_strptime(utc_date_time, '%Y-%m-%d %H:%M:%S.%g')) // 1000, -1) AS event_ms FROM records""",
)
def split_valid_malformed(spark: SparkSession, d: str) -> DataFrame:
    good, bad = A.split_valid_malformed(V.records(spark, d))
    good = good.select("seq", "utc_date_time", F.lit(True).alias("valid"), (
        V.epoch_micros(F.col("event_ts")) / 1000).cast("long").alias("event_ms"))
    bad = bad.select("seq", "utc_date_time", F.lit(False).alias("valid"), F.lit(-1).cast("long").alias("event_ms"))
    return good.unionByName(bad)


@query(
    "records",
    """SELECT seq, CASE WHEN trim(split_part(partition_key, ',', 1)) <> '' THEN split_part(partition_key, ',', 1)
       ELSE partition_key END AS token FROM records""",
    name="camera_token",
)
def camera_token_query(spark: SparkSession, d: str) -> DataFrame:
    return V.records(spark, d).select("seq", camera_token(F.col("partition_key")).alias("token"))


@query("records", "SELECT seq, batch_id, behind_latest_ms FROM records WHERE behind_latest_ms <= 300000")
def lag_gate(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = A.lag_gate(V.records(spark, d))
    return kept.select("seq", "batch_id", "behind_latest_ms")


@query(
    "records",
    "SELECT batch_id, count(*) AS skipped FROM records WHERE behind_latest_ms > 300000 GROUP BY batch_id",
)
def lag_gate_skipped(spark: SparkSession, d: str) -> DataFrame:
    return A.lag_gate(V.records(spark, d))[1]


@query("records", "SELECT seq, token, CAST(delay_ms AS BIGINT) AS delay_ms FROM good")
def receive_delay(spark: SparkSession, d: str) -> DataFrame:
    return admitted(spark, d).select("seq", "token", "delay_ms")


@query("records", "SELECT seq, token, CAST(delay_ms AS BIGINT) AS delay_ms FROM good WHERE delay_ms <= 60000")
def data_delay_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = A.data_delay_gate(admitted(spark, d), A.MAX_DATA_DELAY_MS["development"])
    return rows.select("seq", "token", "delay_ms")


@query(
    "records",
    """SELECT batch_id, count(*) FILTER (delay_ms <= 300000) AS kept, count(*) FILTER (delay_ms > 300000) AS dropped
       FROM good GROUP BY batch_id""",
)
def delay_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.delay_counts(admitted(spark, d))


@query(
    "records",
    """SELECT batch_id, partition_key, row_number() OVER w - 1 AS place, seq, payload FROM good
       WINDOW w AS (PARTITION BY batch_id, partition_key ORDER BY seq)""",
)
def group_frames(spark: SparkSession, d: str) -> DataFrame:
    groups = A.group_frames(admitted(spark, d))
    rows = groups.select("batch_id", "partition_key", F.posexplode("frames").alias("at", "f"))
    return rows.select(
        "batch_id",
        "partition_key",
        F.col("at").cast("long").alias("place"),
        "f.seq",
        F.col("f.payload").cast("string").alias("payload"),
    )


@query(
    "records",
    """SELECT token, count(*) AS n, round(avg(delay_ms), 6) AS mean_delay_ms, max(delay_ms) AS max_delay_ms
       FROM good WHERE behind_latest_ms <= 300000 GROUP BY token""",
)
def delay_by_token(spark: SparkSession, d: str) -> DataFrame:
    return A.delay_by_token(A.admit(V.records(spark, d)))


def tagged_objects(spark: SparkSession, d: str) -> DataFrame:
    return E.retention_tag(V.stored_objects(spark, d), E.rules_frame(spark, E.RULES["deployed"]))


@query(
    "stored",
    """SELECT CASE WHEN day_key IN ('1', '2', '7', '30') THEN day_key ELSE '30' END AS expired,
         strftime(created, '%Y-01-01') AS event_date, count(*) AS n, CAST(sum(length('object ' || object_key)) AS BIGINT) AS bytes
       FROM stored_objects GROUP BY ALL""",
)
def object_sink(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "objects")
    body = F.concat(F.lit("object "), F.col("object_key").cast("string")).cast("binary")
    SO.object_sink(tagged_objects(spark, d).withColumn("body", body), path, grain="year")
    back = spark.read.parquet(path)
    return back.groupBy(F.col("expired").cast("string").alias("expired"), F.col("event_date").cast("string").alias("event_date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")
    )


@query(
    "stored",
    """SELECT object_key, epoch_us(created) AS created_us,
         CASE WHEN object_key % 3 = 0 THEN expires_hours + 1000 ELSE expires_hours END AS expires_hours FROM stored_objects
       WHERE object_key IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 40)""",
)
def object_source(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "objects")
    objects = tagged_objects(spark, d).withColumn("body", F.lit("x").cast("binary"))
    SO.object_sink(objects, path, grain="year")
    # every third key is put again, and that put runs twice
    again = objects.filter(F.col("object_key") % 3 == 0).withColumn("expires_hours", F.col("expires_hours") + 1000)
    for _ in range(2):
        SO.object_sink(again, path, put=1, grain="year")
    wanted = V.table(spark, d, "lineitem").filter(F.col("l_quantity") >= 40)
    rows = SO.object_source(spark, path, wanted.select(F.col("l_orderkey").alias("object_key")))
    return rows.select("object_key", V.epoch_micros(F.col("created")).alias("created_us"), "expires_hours")


@query(
    "records",
    """SELECT seq, to_base64(encode(payload)) AS body, coalesce(length(to_base64(encode(payload))) <= 16, false) AS fits
       FROM (SELECT seq, CASE WHEN seq % 13 <> 0 THEN payload END AS payload FROM records)""",
)
def queue_encode(spark: SparkSession, d: str) -> DataFrame:
    message = F.when(F.col("seq") % 13 != 0, F.col("payload"))
    ok, large = SQ.queue_encode(V.records(spark, d), message, limit=16)
    return ok.withColumn("fits", F.lit(True)).unionByName(large.withColumn("fits", F.lit(False))).select("seq", "body", "fits")


@query(
    "records",
    """SELECT seq, CASE WHEN seq % 3 = 0 THEN payload END AS raw,
         coalesce(CASE WHEN seq % 3 <> 0 THEN CAST(nullif(payload, '') ->> 'k' AS INTEGER) END, -1) AS k FROM records""",
)
def queue_decode(spark: SparkSession, d: str) -> DataFrame:
    ok, _ = SQ.queue_encode(V.records(spark, d), F.col("payload"))
    sent = ok.withColumn("serialized", F.when(F.col("seq") % 3 == 0, "no").when(F.col("seq") % 3 == 1, "yes"))
    rows = SQ.queue_decode(sent, "k INT")
    return rows.select("seq", F.col("raw").cast("string").alias("raw"), F.coalesce("message.k", F.lit(-1)).alias("k"))


@query(
    "",
    """WITH items AS (
         SELECT CAST(user_id AS VARCHAR) AS token, strftime(ts, '%Y-%m-%d') AS created, event_id AS version, props AS item
         FROM events),
       latest AS (SELECT token, created, max(version) AS version, max_by(item, version) AS item FROM items GROUP BY ALL),
       target AS (
         SELECT token, created, version + version % 3 - 1 AS version, 'old ' || item AS item FROM latest WHERE version % 2 = 0)
       SELECT coalesce(l.token, t.token) AS token, coalesce(l.created, t.created) AS created,
         CASE WHEN t.version > l.version THEN t.version ELSE l.version END AS version,
         CASE WHEN t.version > l.version THEN t.item ELSE l.item END AS item
       FROM latest l LEFT JOIN target t ON l.token = t.token AND l.created = t.created""",
)
def upsert_results(spark: SparkSession, d: str) -> DataFrame:
    items = V.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("token"),
        F.date_format("ts", "yyyy-MM-dd").alias("created"),
        F.col("event_id").alias("version"),
        F.col("props").alias("item"),
    )
    # the table holds an older, equal or newer item for every second key
    old = SS.upsert_results(items.limit(0), items).filter(F.col("version") % 2 == 0)
    target = old.withColumns(
        {"version": F.col("version") + F.col("version") % 3 - 1, "item": F.concat(F.lit("old "), F.col("item"))}
    )
    return SS.upsert_results(target, items)


@query(
    "",
    """SELECT 'algorithm' AS type, CASE WHEN event_type IN ('error') THEN 'ERROR' ELSE 'INFO' END AS level, count(*) AS n
       FROM events WHERE event_id % 11 <> 0 GROUP BY ALL""",
)
def tail_logs(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    lines = V.table(spark, d, "events").select(
        "event_id",
        F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, "props").alias("message")
    )
    # one folder holds the log files, and files of another kind that the reader passes over
    path = scratch_path(spark, "logs")
    other = F.col("event_id") % 11 == 0
    lines.filter(~other).select("message").write.text(path)
    lines.filter(other).select("message").write.mode("append").option("compression", "gzip").text(path)
    return SR.level_counts(SR.tail_logs(spark, path, streaming=False, files="*.txt"))


# -- zones and boxes -------------------------------------------------------------------------------------------------


@query(
    "configs",
    """SELECT c_custkey AS token,
         CASE damage WHEN 3 THEN 'bad_json' WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN 'bad_zone'
           WHEN 7 THEN 'bad_data_list' ELSE
           CASE WHEN c_custkey % 41 = 0 THEN 'bad_sensitivity' WHEN c_custkey % 4 = 3 THEN 'too_many_zones' END
         END AS reason,
         damage IN (4, 5) AS incomplete,
         CAST(CASE WHEN damage = 3 THEN -1 WHEN damage IN (4, 5, 6, 7) THEN 300 WHEN c_custkey % 41 = 0 THEN 0
           ELSE 200 + c_custkey % 900 END AS INTEGER) AS sensitivity,
         CAST(CASE WHEN damage IN (4, 5) THEN 1 WHEN damage IN (3, 6, 7) OR c_custkey % 41 = 0 OR c_custkey % 4 = 3
           THEN -1 ELSE 1 + c_custkey % 4 END AS INTEGER) AS n_zones
       FROM (SELECT c_custkey, c_custkey % 101 AS damage FROM customer)""",
)
def parse_motion_config(spark: SparkSession, d: str) -> DataFrame:
    rows = G.parse_motion_config(V.configs(spark, d))
    # the broken text keeps no number that SQL could read
    level = F.when(F.col("reason") == "bad_json", -1).otherwise(F.col("sensitivity"))
    n_zones = F.coalesce("n_zones", F.lit(-1))
    return rows.select("token", "reason", "incomplete", level.alias("sensitivity"), n_zones.alias("n_zones"))


def parsed_zones(spark: SparkSession, d: str) -> DataFrame:
    parsed = G.parse_motion_config(V.configs(spark, d)).filter("valid")
    return parsed.select("token", "sensitivity", "zones", "n_zones")


@query("configs", "SELECT token, CAST(zone_id AS INTEGER) AS zone_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h FROM zones")
def parse_pos(spark: SparkSession, d: str) -> DataFrame:
    return G.explode_zones(parsed_zones(spark, d)).select("token", "zone_id", *"xywh")


PRUNED = """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY token ORDER BY x, pos_no) AS by_x FROM zones),
over3 AS (
  SELECT p.token, p.by_x AS p, q.by_x AS q FROM ranked p JOIN ranked q
    ON p.token = q.token AND p.n_zones = 3 AND p.by_x < q.by_x
      AND p.y < q.y AND p.x + p.w > q.x + q.w AND p.y + p.h > q.y + q.h),
gone AS (
  SELECT p.token, p.zone_id FROM zones p JOIN zones q ON p.token = q.token AND p.n_zones = 2
    AND p.x < q.x AND p.y < q.y AND p.x + p.w > q.x + q.w AND p.y + p.h > q.y + q.h
  UNION
  SELECT r.token, r.zone_id FROM ranked r JOIN over3 o ON r.token = o.token AND r.by_x = o.q
  WHERE o.p = 1 OR NOT EXISTS (SELECT 1 FROM over3 f WHERE f.token = o.token AND f.p = 1)),
pruned AS (
  SELECT * FROM zones z WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.token = z.token AND g.zone_id = z.zone_id)),
clipped AS (
  SELECT token, zone_id, sensitivity, x, y, least(w, 100 - x) AS w, least(h, 100 - y) AS h FROM pruned WHERE w > 0 AND h > 0)
"""


def zones_sql(body: str) -> str:
    return V.with_views("configs", "") + PRUNED.strip("\n") + "\n" + body


def pruned_zones(spark: SparkSession, d: str) -> DataFrame:
    return G.explode_zones(G.prune_nested_zones(parsed_zones(spark, d)))


INT_ZONE = "CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h"


@query("", zones_sql(f"SELECT token, CAST(zone_id AS INTEGER) AS zone_id, {INT_ZONE} FROM pruned"))
def prune_nested_zones(spark: SparkSession, d: str) -> DataFrame:
    return pruned_zones(spark, d).select("token", "zone_id", *"xywh")


@query("", zones_sql(f"SELECT token, CAST(zone_id AS INTEGER) AS zone_id, {INT_ZONE} FROM clipped"))
def clip_zones(spark: SparkSession, d: str) -> DataFrame:
    return G.clip_zones(pruned_zones(spark, d)).select("token", "zone_id", *"xywh")


@query(
    "",
    zones_sql(
        """SELECT token, CAST(zone_id AS INTEGER) AS zone_id, CAST(640 * x // 100 AS INTEGER) AS x,
           CAST(360 * y // 100 AS INTEGER) AS y, CAST(640 * w // 100 AS INTEGER) AS w,
           CAST(360 * h // 100 AS INTEGER) AS h FROM clipped"""
    ),
)
def zones_to_pixels(spark: SparkSession, d: str) -> DataFrame:
    return G.zones_to_pixels(G.clip_zones(pruned_zones(spark, d))).select("token", "zone_id", *"xywh")


CORNERS = ("x1", "y1", "x2", "y2")
PX = """CAST(x1 * 640 // 100 AS INTEGER) AS x1, CAST(y1 * 360 // 100 AS INTEGER) AS y1,
  CAST(x2 * 640 // 100 AS INTEGER) AS x2, CAST(y2 * 360 // 100 AS INTEGER) AS y2"""


@query("boxes", f"SELECT frame_id, box_no, {PX} FROM boxes")
def boxes_pct_to_pixels(spark: SparkSession, d: str) -> DataFrame:
    return G.boxes_pct_to_pixels(V.boxes(spark, d)).select("frame_id", "box_no", *CORNERS)


def rectangles(df: DataFrame) -> DataFrame:
    """Corner boxes as x, y, w, h."""
    return df.withColumns(
        {"x": F.col("x1"), "y": F.col("y1"), "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")}
    ).drop(*CORNERS)


@query(
    "boxes",
    f"""SELECT box_no, CAST(x1 * 100 // 640 AS INTEGER) AS x1, CAST(y1 * 100 // 360 AS INTEGER) AS y1,
          CAST(x2 * 100 // 640 AS INTEGER) AS x2, CAST(y2 * 100 // 360 AS INTEGER) AS y2
        FROM (SELECT box_no, {PX} FROM boxes)""",
)
def boxes_pixels_to_pct(spark: SparkSession, d: str) -> DataFrame:
    pixels = rectangles(G.boxes_pct_to_pixels(V.boxes(spark, d)))
    return G.boxes_pixels_to_pct(pixels).select("box_no", *CORNERS)


@query("boxes", "SELECT box_no, x1, y1, x1 + (x2 - x1) AS x2, y1 + (y2 - y1) AS y2 FROM boxes")
def xywh_to_corners(spark: SparkSession, d: str) -> DataFrame:
    return G.xywh_to_corners(rectangles(V.boxes(spark, d))).select("box_no", *CORNERS)


SHARED = """CASE WHEN least(o.x2, b.x2) > greatest(o.x1, b.x1) AND least(o.y2, b.y2) > greatest(o.y1, b.y1)
  THEN (least(o.x2, b.x2) - greatest(o.x1, b.x1)) * (least(o.y2, b.y2) - greatest(o.y1, b.y1)) ELSE 0 END"""


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each object with the motion box of the same number, where there is one."""
    b = V.boxes(spark, d).select(F.col("box_no").alias("object_no"), *[F.col(c).alias("b" + c) for c in CORNERS])
    return V.objects(spark, d).join(b, "object_no")


@query(
    "boxes objects",
    f"SELECT o.object_no, CAST({SHARED} AS INTEGER) AS area FROM objects o JOIN boxes b ON o.object_no = b.box_no",
)
def intersection_area(spark: SparkSession, d: str) -> DataFrame:
    area = B.intersection_area(B.corners(), B.corners("b"))
    return neighbours(spark, d).select("object_no", area.alias("area"))


@query(
    "boxes objects",
    f"""SELECT o.object_no, round({SHARED} / CAST((o.x2 - o.x1) * (o.y2 - o.y1) AS DOUBLE) * 100, 6) AS pct
        FROM objects o JOIN boxes b ON o.object_no = b.box_no""",
)
def area_percent(spark: SparkSession, d: str) -> DataFrame:
    area = B.intersection_area(B.corners(), B.corners("b"))
    return neighbours(spark, d).select("object_no", r6(B.area_percent(B.corners(), area)).alias("pct"))


MERGED = """, start AS (SELECT frame_id, list_sort(list(DISTINCT [x1, y1, x2, y2])) AS b FROM boxes GROUP BY frame_id),
    merged AS (SELECT * FROM (WITH RECURSIVE walk(frame_id, cur, rest, done) AS (
      SELECT frame_id, b[1], b[2:], CAST(NULL AS INTEGER[]) FROM start
      UNION ALL
      SELECT frame_id,
        CASE WHEN hit > 0 THEN [least(cur[1], rest[hit][1]), least(cur[2], rest[hit][2]), greatest(cur[3], rest[hit][3]),
          greatest(cur[4], rest[hit][4])] ELSE rest[1] END,
        CASE WHEN hit > 0 THEN list_concat(rest[:hit - 1], rest[hit + 1:]) ELSE rest[2:] END,
        CASE WHEN hit > 0 THEN NULL ELSE cur END
      FROM (SELECT *, coalesce(list_position(list_transform(rest, lambda r: r[1] <= cur[3] AND r[2] <= cur[4]
        AND r[4] >= cur[2]), true), 0) AS hit FROM walk WHERE cur IS NOT NULL))
      SELECT frame_id, done FROM walk WHERE done IS NOT NULL))
    SELECT frame_id, CAST(done[1] AS INTEGER) AS x1, CAST(done[2] AS INTEGER) AS y1, CAST(done[3] AS INTEGER) AS x2,
      CAST(done[4] AS INTEGER) AS y2 FROM merged"""


@query("boxes", MERGED)
def merge_boxes(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_boxes(V.boxes(spark, d))


@query(
    "boxes",
    f"""SELECT frame_id, CAST(sum((x2 - x1) * (y2 - y1)) AS BIGINT) AS area FROM (SELECT frame_id, {PX} FROM boxes)
        GROUP BY frame_id HAVING sum((x2 - x1) * (y2 - y1)) >= 1474.56""",
)
def motion_area_gate(spark: SparkSession, d: str) -> DataFrame:
    return G.motion_area_gate(G.boxes_pct_to_pixels(V.boxes(spark, d)))


MATCHED = f"""SELECT o.* FROM objects o WHERE EXISTS (SELECT 1 FROM boxes b WHERE b.frame_id = o.frame_id
  AND {SHARED} > 0 AND ({SHARED} * 100.0 >= 50 * (o.x2 - o.x1) * (o.y2 - o.y1)
    OR {SHARED} * 100.0 >= 50 * (b.x2 - b.x1) * (b.y2 - b.y1)))"""


@query("boxes objects", f"SELECT frame_id, object_no FROM ({MATCHED})")
def match_objects_to_motion(spark: SparkSession, d: str) -> DataFrame:
    return G.match_objects_to_motion(V.objects(spark, d), V.boxes(spark, d)).select("frame_id", "object_no")


def zone_matches(spark: SparkSession, d: str) -> DataFrame:
    """Objects of the camera their frame belongs to, with the zones that hold them; the frames go round all cameras."""
    cameras = V.table(spark, d, "customer").count()
    objects = V.objects(spark, d).withColumn("token", 1 + F.col("frame_id") % cameras)
    zones = G.clip_zones(G.explode_zones(parsed_zones(spark, d)))
    return G.match_objects_to_zones(objects, zones.select("token", "zone_id", *"xywh"))


ZONED = """, clipped AS (
  SELECT token, CAST(zone_id AS INTEGER) AS zone_id, x AS x1, y AS y1, x + least(w, 100 - x) AS x2,
    y + least(h, 100 - y) AS y2 FROM zones),
zoned AS (
  SELECT o.*, b.token, b.zone_id FROM objects o JOIN clipped b ON 1 + o.frame_id % (SELECT count(*) FROM customer) = b.token
  WHERE """ + SHARED + " > 0 AND " + SHARED + " * 100.0 >= 20 * (o.x2 - o.x1) * (o.y2 - o.y1))\n"


def zoned_sql(body: str) -> str:
    return V.with_views("configs objects", "") + ZONED + body


@query("", zoned_sql("SELECT frame_id, object_no, token, zone_id FROM zoned"))
def match_objects_to_zones(spark: SparkSession, d: str) -> DataFrame:
    return zone_matches(spark, d).select("frame_id", "object_no", "token", "zone_id")


@query("objects", "SELECT object_no, round(score, 6) AS score FROM objects WHERE score > 0.6")
def confirm_score(spark: SparkSession, d: str) -> DataFrame:
    return G.confirm_score(V.objects(spark, d)).select("object_no", r6("score").alias("score"))


CODE = "CASE trim(type_name) WHEN 'person' THEN 1 WHEN 'dog' THEN 2 WHEN 'car' THEN 3 ELSE 0 END"


@query("objects", f"SELECT object_no, type_name, CAST({CODE} AS INTEGER) AS type_code FROM objects")
def object_type_code(spark: SparkSession, d: str) -> DataFrame:
    return G.object_type_code(V.objects(spark, d)).select("object_no", "type_name", "type_code")


BY_ZONE = f"""SELECT frame_id, zone_id, row_number() OVER (PARTITION BY frame_id, zone_id ORDER BY object_no) AS place,
  object_no, CAST({CODE} AS INTEGER) AS type_code FROM zoned"""


@query("", zoned_sql(BY_ZONE))
def objects_by_zone(spark: SparkSession, d: str) -> DataFrame:
    lists = G.objects_by_zone(G.object_type_code(zone_matches(spark, d)))
    rows = lists.select("frame_id", "zone_id", F.posexplode("objects").alias("at", "o"))
    place = (F.col("at") + 1).cast("long")
    return rows.select("frame_id", "zone_id", place.alias("place"), "o.object_no", "o.type_code")


@query(
    "boxes objects configs",
    f""", matched AS ({MATCHED}),
    layers AS (
      SELECT token AS frame_id, x AS x1, y AS y1, x + w AS x2, y + h AS y2, 1 AS layer_order, 'zone' AS layer,
        'green' AS colour FROM zones
      UNION ALL SELECT frame_id, x1, y1, x2, y2, 2, 'motion', 'yellow' FROM boxes
      UNION ALL SELECT frame_id, x1, y1, x2, y2, 3, 'object', 'red' FROM objects
      UNION ALL SELECT frame_id, x1, y1, x2, y2, 4, 'result', 'blue' FROM matched)
    SELECT frame_id, {PX}, layer_order, layer, colour FROM layers""",
)
def annotation_layers(spark: SparkSession, d: str) -> DataFrame:
    zones = G.xywh_to_corners(G.explode_zones(parsed_zones(spark, d))).withColumnRenamed("token", "frame_id")
    boxes, objects = V.boxes(spark, d), V.objects(spark, d)
    return G.annotation_layers(zones, boxes, objects, G.match_objects_to_motion(objects, boxes))


# -- motion detection ------------------------------------------------------------------------------------------------


@query(
    "frames",
    """SELECT packet_id, seq, CAST(i AS INTEGER) AS frame_index FROM (
         SELECT packet_id, seq, row_number() OVER (PARTITION BY packet_id ORDER BY seq) - 1 AS i FROM frames
         WHERE is_key OR is_base) WHERE i < 2""",
)
def sample_base_frames(spark: SparkSession, d: str) -> DataFrame:
    return D.sample_base_frames(V.frames(spark, d)).select("packet_id", "seq", "frame_index")


def _bytes_sql(low: int, high: int) -> str:
    return f"array_to_string(list_transform(luma[{low}:{high}], lambda y: printf('%02X', y)), '')"


@query(
    "frames",
    f"""SELECT seq, {_bytes_sql(1, 64)} AS y_hex, {_bytes_sql(1, 16)} AS u_hex, {_bytes_sql(17, 32)} AS v_hex
        FROM frames""",
)
def split_planes(spark: SparkSession, d: str) -> DataFrame:
    rows = D.split_planes(V.planar_frames(spark, d))
    return rows.select("seq", *[F.hex(p).alias(f"{p}_hex") for p in "yuv"])


def small_luma(spark: SparkSession, d: str) -> DataFrame:
    """The 8x8 frames as rows with size and luma bytes."""
    planes = D.split_planes(V.planar_frames(spark, d))
    return planes.select("stream_id", "seq", "width", "height", F.col("y").alias("luma"))


@query(
    "frames",
    """SELECT seq, array_to_string(list_transform(range(0, 1152),
         lambda i: printf('%02X', luma[1 + 8 * (((i // 48) * 2 + 1) * 8 // 48) + ((i % 48) * 2 + 1) * 8 // 96])), '') AS luma_hex
       FROM frames""",
)
def rescale_luma_point(spark: SparkSession, d: str) -> DataFrame:
    rows = D.rescale_luma(small_luma(spark, d), 48, 24, "point")
    return rows.select("seq", F.hex("luma").alias("luma_hex"))


@query(
    "frames",
    """SELECT seq, array_to_string(list_transform(range(0, 16), lambda i: printf('%02X', CAST(floor(
         (luma[1 + 16 * (i // 4) + 2 * (i % 4)] + luma[2 + 16 * (i // 4) + 2 * (i % 4)]
          + luma[9 + 16 * (i // 4) + 2 * (i % 4)] + luma[10 + 16 * (i // 4) + 2 * (i % 4)]) / 4.0 + 0.5) AS INTEGER))), '')
         AS luma_hex FROM frames""",
)
def rescale_luma(spark: SparkSession, d: str) -> DataFrame:
    # halving both sides puts every new centre between four old ones
    rows = D.rescale_luma(small_luma(spark, d), 4, 4)
    return rows.select("seq", F.hex("luma").alias("luma_hex"))


@query(
    "frames",
    """SELECT seq, CAST(CASE WHEN seq % 5 = 4 THEN 8 ELSE 3 END AS INTEGER) AS width,
         CASE WHEN seq % 5 = 4 THEN array_to_string(list_transform(luma, lambda y: printf('%02X', y)), '') ELSE
           array_to_string(list_transform(range(0, 12), lambda i: printf('%02X',
             luma[1 + 8 * (1 + i // 3) + seq % 5 + i % 3])), '') END AS luma_hex
       FROM frames""",
)
def crop_zone(spark: SparkSession, d: str) -> DataFrame:
    # from column 4 on three columns still fit; the zones of every fifth frame are made to reach outside
    x = F.when(F.col("seq") % 5 == 4, 7).otherwise(F.col("seq") % 5).cast("int")
    rows = small_luma(spark, d).withColumns({"x": x, "y": F.lit(1), "w": F.lit(3), "h": F.lit(4)})
    return D.crop_zone(rows).select("seq", "width", F.hex("luma").alias("luma_hex"))


@query(
    "frames",
    """SELECT stream_id, seq, CAST(i AS INTEGER) AS i, CAST(CASE WHEN abs(v - pv) > 20 THEN 255 ELSE 0 END AS INTEGER) AS mask
       FROM pixel_pairs WHERE pv IS NOT NULL""",
)
def frame_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = D.frame_difference(V.frames(spark, d))
    return rows.select("stream_id", "seq", F.posexplode("diff_mask").alias("i", "mask"))


@query(
    "frames",
    """, changed AS (SELECT stream_id, seq, px, py, i, abs(v - pv) > 20 AND v > 100 AS hit FROM pixel_pairs WHERE pv IS NOT NULL)
    SELECT a.stream_id, a.seq, CAST(a.i AS INTEGER) AS i, CAST(CASE WHEN bool_or(b.hit) THEN 255 ELSE 0 END AS INTEGER) AS mask
    FROM changed a JOIN changed b ON a.stream_id = b.stream_id AND a.seq = b.seq
      AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1
    GROUP BY a.stream_id, a.seq, a.i""",
)
def motion_mask(spark: SparkSession, d: str) -> DataFrame:
    # pixels above 100 stand for the foreground of the background model
    fg = F.transform("luma", lambda v: F.when(v > 100, 255).otherwise(0))
    rows = D.frame_difference(V.frames(spark, d)).withColumn("fg_mask", fg)
    rows = D.motion_mask(rows, 8, 8)
    return rows.select("stream_id", "seq", F.posexplode("motion_mask").alias("i", "mask"))


def clip_config(spark: SparkSession, d: str) -> DataFrame:
    """One configuration per camera of the clip table: two zones, or none for every third camera."""
    tokens = V.clips(spark, d).select("token").distinct()
    zones = F.expr("array(named_struct('zone_no', 1, 'id', 1, 'x', 0, 'y', 0, 'w', 60, 'h', 100),"
                   " named_struct('zone_no', 2, 'id', 2, 'x', 40, 'y', 10, 'w', 70, 'h', 80))")
    chosen = F.when(F.col("token").cast("int") % 3 == 0, F.slice(zones, 1, 0)).otherwise(zones)
    return tokens.select("token", F.lit(1000).alias("sensitivity"), chosen.alias("zones"))


@query()
def background_mask(spark: SparkSession, d: str) -> DataFrame:
    regions = D.zone_regions(V.clips(spark, d), D.watched_zones(clip_config(spark, d)), packed=True)
    return D.background_mask(regions).select("token", "zone_id", "frame_no", "changed_pixels")


@query()
def contour_boxes(spark: SparkSession, d: str) -> DataFrame:
    return D.zone_motion_boxes(D.zone_regions(V.clips(spark, d), D.watched_zones(clip_config(spark, d)), packed=True))


@query()
def detect_motion(spark: SparkSession, d: str) -> DataFrame:
    return D.detect_motion(V.clips(spark, d), clip_config(spark, d))


LOOKED = "SELECT DISTINCT event_id // 3 AS frame_id FROM events"
RESULT_ROWS = f"""SELECT f.frame_id, r.n_zones, r.box_sum FROM ({LOOKED}) f JOIN (
  SELECT f.frame_id, count(DISTINCT zone_id) AS n_zones, coalesce(sum(x1 + 1000 * y2), 0)::BIGINT AS box_sum
  FROM ({LOOKED}) f LEFT JOIN boxes b ON f.frame_id = b.frame_id GROUP BY f.frame_id) r ON f.frame_id = r.frame_id"""


@query("boxes", RESULT_ROWS)
def motion_result_json(spark: SparkSession, d: str) -> DataFrame:
    """One result per frame that was looked at, the frames past the last box among them."""
    looked = V.table(spark, d, "events").select(F.expr("event_id div 3").alias("frame_id"))
    results = D.motion_result_json(V.boxes(spark, d), frames=looked)
    zones = F.from_json("result", D.RESULT_SCHEMA)["motion"]
    boxes = F.flatten(F.transform(zones, lambda z: z["boxs"]))
    total = F.aggregate(boxes, F.lit(0).cast("long"), lambda a, b: a + F.get(b, F.lit(0)) + 1000 * F.get(b, F.lit(3)))
    return results.select("frame_id", F.size(zones).cast("long").alias("n_zones"), total.alias("box_sum"))


@query("boxes", "SELECT frame_id, zone_id, x1, y1, x2, y2 FROM boxes")
def motion_result_rows(spark: SparkSession, d: str) -> DataFrame:
    return D.parse_motion_result(D.motion_result_json(V.boxes(spark, d))).select("frame_id", "zone_id", *CORNERS)


@query(
    "",
    """SELECT event_id, CAST(1 + event_id % 3 AS INTEGER) AS zone_id, CAST(event_id % 50 AS INTEGER) AS x1, 2 AS y1,
         CAST(51 + event_id % 7 AS INTEGER) AS x2, 60 AS y2 FROM events WHERE event_id % 4 <> 0""",
)
def parse_motion_result(spark: SparkSession, d: str) -> DataFrame:
    # every fourth frame has empty text, that is no result
    e = F.col("event_id")
    text = F.format_string(
        '{"motion":[{"zone_id":%d,"boxs":[[%d,2,%d,60]]}]}', 1 + e % 3, e % 50, 51 + e % 7
    )
    rows = V.table(spark, d, "events").select("event_id", F.when(e % 4 == 0, "").otherwise(text).alias("result"))
    return D.parse_motion_result(rows).select("event_id", "zone_id", *CORNERS)


@query(
    "frames",
    """SELECT packet_id, seq, row_number() OVER (PARTITION BY packet_id ORDER BY seq) - 1 AS frame_index FROM frames
       WHERE seq % 5 NOT IN (0, 1)""",
)
def keep_results(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("seq") % 5 == 1, "").when(F.col("seq") % 5 > 1, '{"motion":[]}')
    rows = V.frames(spark, d).select("packet_id", "seq", text.alias("result"))
    return D.keep_results(rows).select("packet_id", "seq", "frame_index")


@query(
    "",
    """SELECT c_custkey AS token, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1000 WHEN 'MACHINERY' THEN 200
         WHEN 'HOUSEHOLD' THEN 30 ELSE -1 END AS INTEGER) AS sensitivity FROM customer""",
)
def sensitivity_level(spark: SparkSession, d: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    level = F.when(segment == "BUILDING", "high").when(segment == "MACHINERY", "normal").when(segment == "HOUSEHOLD", "low")
    rows = V.table(spark, d, "customer").select(F.col("c_custkey").alias("token"), level.alias("level"))
    out = D.sensitivity_level(rows)
    return out.select("token", F.coalesce("sensitivity", F.lit(-1)).alias("sensitivity"))


# -- events and retention ----------------------------------------------------------------------------------------------


@query(
    "boxes",
    """SELECT CAST(frame_id AS VARCHAR) AS token, CAST(zone_id AS VARCHAR) AS zone_id,
         CAST(count(*) AS INTEGER) AS n_boxes, CAST(1 + frame_id % 800 AS INTEGER) AS expires_hours,
         CAST((1 + frame_id % 800 + 23) // 24 AS INTEGER) AS expires_days
       FROM boxes GROUP BY frame_id, boxes.zone_id""",
)
def motion_events(spark: SparkSession, d: str) -> DataFrame:
    results = D.motion_result_json(V.boxes(spark, d)).select(
        F.col("frame_id").cast("string").alias("token"),
        F.lit("2024-01-01 00:00:00.000").alias("utc_date"),
        "result",
        (1 + F.col("frame_id") % 800).cast("int").alias("expires_hours"),
    )
    return E.motion_events(results).drop("utc_date")


@query("", zoned_sql("SELECT frame_id, zone_id, count(*) AS n, CAST(sum(object_no) AS BIGINT) AS object_sum FROM zoned GROUP BY ALL"))
def object_events(spark: SparkSession, d: str) -> DataFrame:
    events = E.object_events(G.object_type_code(zone_matches(spark, d)))
    rows = events.select("frame_id", F.explode("objects").alias("zone_id", "o"))
    add = F.aggregate("o", F.lit(0).cast("long"), lambda s, x: s + x["object_no"])
    return rows.select("frame_id", "zone_id", F.size("o").cast("long").alias("n"), add.alias("object_sum"))


@query("stored", "SELECT object_key, CAST((expires_hours + 23) // 24 AS INTEGER) AS expires_days FROM stored_objects")
def expiry_days(spark: SparkSession, d: str) -> DataFrame:
    return E.with_expiry_days(V.stored_objects(spark, d)).select("object_key", "expires_days")


TAG = "CASE WHEN day_key IN ('1', '2', '7', '30') THEN day_key ELSE '30' END"


@query("stored", f"SELECT object_key, day_key, {TAG} AS expired FROM stored_objects")
def retention_tag(spark: SparkSession, d: str) -> DataFrame:
    return tagged_objects(spark, d).select("object_key", "day_key", "expired")


@query(
    "stored",
    """, old AS (SELECT * FROM (VALUES ('7', 9), ('90', 90)) t(day_key, days)),
    new AS (SELECT day_key, CAST(min(expires_hours) AS INTEGER) AS days FROM stored_objects GROUP BY day_key)
    SELECT 'RULE_' || coalesce(o.day_key, n.day_key) AS rule_id, coalesce(o.day_key, n.day_key) AS day_key,
      CAST(coalesce(o.days, n.days) AS INTEGER) AS days FROM old o FULL JOIN new n ON o.day_key = n.day_key""",
)
def merge_retention_rules(spark: SparkSession, d: str) -> DataFrame:
    new = V.stored_objects(spark, d).groupBy("day_key").agg(F.min("expires_hours").alias("days"))
    return E.merge_retention_rules(E.rules_frame(spark, [("7", 9), ("90", 90)]), new)


def expired_sql(rules: str) -> str:
    return f"""SELECT object_key, expired FROM (SELECT *, {TAG} AS expired FROM stored_objects) o
      JOIN (VALUES {rules}) r(k, days) ON o.expired = r.k
      WHERE CAST(created AS DATE) + CAST(r.days AS INTEGER) <= DATE '1998-06-15'"""


@query("stored", expired_sql("('1', 1), ('2', 2), ('7', 7), ('30', 30)"))
def expired_objects(spark: SparkSession, d: str) -> DataFrame:
    rules = E.rules_frame(spark, E.RULES["deployed"])
    return E.expired_objects(tagged_objects(spark, d), rules, "1998-06-15").select("object_key", "expired")


@query("stored", expired_sql("('1', 2), ('2', 4), ('7', 9), ('30', 32)"))
def expired_objects_development(spark: SparkSession, d: str) -> DataFrame:
    rules = E.rules_frame(spark, E.RULES["development"])
    return E.expired_objects(tagged_objects(spark, d), rules, "1998-06-15").select("object_key", "expired")


@query(
    "stored",
    f"""SELECT object_key, expired FROM (SELECT *, {TAG} AS expired FROM stored_objects) o
      JOIN (VALUES ('1', 1), ('2', 2), ('7', 7), ('30', 30)) r(k, days) ON o.expired = r.k
      WHERE CAST(created AS DATE) + CAST(r.days AS INTEGER) > DATE '1998-06-15'""",
)
def live_objects(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "objects")
    SO.object_sink(tagged_objects(spark, d).withColumn("body", F.lit("x").cast("binary")), path, grain="year")
    rows = E.live_objects(spark, path, E.RULES["deployed"], "1998-06-15")
    return rows.select("object_key", F.col("expired").cast("string").alias("expired"))


#: Puts of the store: all objects; every third again, made later and with the tag of one day; a purge; every seventh again.
@query(
    "stored",
    f"""SELECT object_key, expired, put, epoch_us(created) AS created_us FROM (
      SELECT object_key, {TAG} AS expired, 0 AS put, created FROM stored_objects
      UNION ALL SELECT object_key, '1', 1, created + INTERVAL 20 DAY FROM stored_objects WHERE object_key % 3 = 0
      UNION ALL SELECT object_key, '30', 2, created FROM stored_objects WHERE object_key % 7 = 0)
    WHERE put = 2 OR (put = CASE WHEN object_key % 3 = 0 THEN 1 ELSE 0 END AND object_key % 7 <> 0
      AND CAST(created AS DATE) + CAST(expired AS INTEGER) > DATE '1996-03-01')""",
)
def purged_objects(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "objects")
    objects = tagged_objects(spark, d).select("object_key", "created", "expired")

    def put(rows: DataFrame, number: int) -> None:
        body = F.lit(str(number)).cast("binary")
        SO.object_sink(rows.withColumn("body", body), path, put=number, grain="year")

    put(objects, 0)
    later = F.col("created") + F.expr("INTERVAL 20 DAY")
    put(objects.filter("object_key % 3 = 0").withColumns({"created": later, "expired": F.lit("1")}), 1)
    E.purge_expired(spark, path, E.RULES["deployed"], "1996-03-01")
    put(objects.filter("object_key % 7 = 0").withColumn("expired", F.lit("30")), 2)
    rows = SO.object_source(spark, path, objects.select("object_key"))
    return rows.select(
        "object_key", "expired", F.col("body").cast("string").cast("int").alias("put"), V.epoch_micros(F.col("created")).alias("created_us")
    )


# -- metrics -----------------------------------------------------------------------------------------------------------


@query(
    "records",
    """SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, event_ts)) AS interval_us, count(*) AS "recordCount",
         count(*) FILTER (behind_latest_ms > 300000) AS "receiveDelayedCount",
         count(*) FILTER (delay_ms > 60000) AS "dataDelayedCount",
         count(*) FILTER (event_type = 'error') AS "s3FailureCount",
         count(*) FILTER (event_type = 'error' AND seq % 2 = 0) AS "sqsFailureCount",
         count(*) FILTER (event_type <> 'error') AS "s3SuccessfulCount",
         count(*) FILTER (event_type <> 'error' AND seq % 2 = 0) AS "sqsSuccessfulCount",
         count(*) FILTER (seq % 3 = 0) AS "objectMotionCount",
         count(*) FILTER (event_type = 'error' AND seq % 3 = 0) AS "objectErrorCount",
         count(*) FILTER (delay_ms > 60000 AND seq % 3 = 0) AS "objectDataDelayedCount"
       FROM good GROUP BY 1""",
)
def interval_counters(spark: SparkSession, d: str) -> DataFrame:
    counted = M.interval_counters(counter_events(admitted(spark, d)), "1 hour")
    start = V.epoch_micros(F.col("interval_start").cast("timestamp_ntz"))
    return counted.select(start.alias("interval_us"), *M.COUNTERS)


def counter_events(rows: DataFrame) -> DataFrame:
    """Counter increments of admitted records: one row per counter a record touches."""
    failed, late = F.col("event_type") == "error", F.col("delay_ms") > A.MAX_DATA_DELAY_MS["development"]
    queued, seen = F.col("seq") % 2 == 0, F.col("seq") % 3 == 0
    rules = {
        "recordCount": F.lit(True),
        "receiveDelayedCount": F.col("behind_latest_ms") > A.MAX_BATCH_LAG_MS,
        "dataDelayedCount": late,
        "s3FailureCount": failed,
        "sqsFailureCount": failed & queued,
        "s3SuccessfulCount": ~failed,
        "sqsSuccessfulCount": ~failed & queued,
        "objectMotionCount": seen,
        "objectErrorCount": failed & seen,
        "objectDataDelayedCount": late & seen,
    }
    touched = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))
    return rows.select(
        F.col("event_ts").alias("ts"), F.explode(touched).alias("counter"), F.lit(1).cast("long").alias("amount")
    )


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Observed values per metric: the event table with its type as the metric."""
    return V.table(spark, d, "events").select(
        F.col("event_type").alias("metric"),
        F.col("event_id").alias("seq"),
        (V.epoch_micros(F.col("ts")) / 1e6).alias("pts"),
        F.floor(F.col("value") * 1000).cast("long").alias("value"),
    )


OBSERVED = """WITH observations AS (
  SELECT event_type AS metric, event_id AS seq, epoch_us(ts) / 1e6::DOUBLE AS pts,
    CAST(floor(value * 1000) AS BIGINT) AS value FROM events)
"""


@query(
    "",
    OBSERVED
    + """SELECT metric, seq, count(*) OVER w AS count, CAST(min(value) OVER w AS DOUBLE) AS min,
      CAST(max(value) OVER w AS DOUBLE) AS max, round(avg(value) OVER w, 6) AS mean,
      round(coalesce(stddev_samp(value) OVER w, 0), 6) AS stddev
    FROM observations WINDOW w AS (PARTITION BY metric ORDER BY seq ROWS BETWEEN 1999 PRECEDING AND CURRENT ROW)""",
)
def sliding_histogram(spark: SparkSession, d: str) -> DataFrame:
    out = M.sliding_histogram(observations(spark, d))
    return rounded(out, "mean", "stddev")


QUANTILES = {"median": 0.5, "p75": 0.75, "p95": 0.95, "p98": 0.98, "p99": 0.99, "p999": 0.999}


def quantile_sql(q: float) -> str:
    at = f"({q}::DOUBLE * (len(v) + 1))"
    low = f"CAST(floor({at}) AS BIGINT)"
    return f"""CASE WHEN {low} < 1 THEN v[1] WHEN {low} >= len(v) THEN v[len(v)]
      ELSE v[{low}] + ({at} - floor({at})) * (v[{low} + 1] - v[{low}]) END"""


def summary_sql(source: str, scale: str) -> str:
    cols = ", ".join(f"round({quantile_sql(q)}, 6) AS {n}" for n, q in QUANTILES.items())
    return f"""SELECT metric, count, round(v[1], 6) AS min, round(v[len(v)], 6) AS max, round(mean, 6) AS mean,
        round(stddev, 6) AS stddev, {cols} FROM (
      SELECT metric, any_value(n) AS count, list_sort(list(value / {scale})) AS v, avg(value / {scale}) AS mean,
        coalesce(stddev_samp(value / {scale}), 0) AS stddev FROM (
        SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY seq DESC) AS r,
          count(*) OVER (PARTITION BY metric) AS n FROM {source}) WHERE r <= 2000 GROUP BY metric)"""


@query("", OBSERVED + summary_sql("observations", "1.0::DOUBLE"))
def histogram_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.histogram_summary(observations(spark, d)), "min", "max", "mean", "stddev", *QUANTILES)


@query(
    "",
    OBSERVED
    + f"""SELECT metric, seq, count, round(v[1], 6) AS min, round(v[len(v)], 6) AS max, round(mean, 6) AS mean,
      round(stddev, 6) AS stddev, {", ".join(f"round({quantile_sql(q)}, 6) AS {n}" for n, q in QUANTILES.items())} FROM (
      SELECT metric, seq, count(*) OVER w AS count, list_sort(list(value::DOUBLE) OVER w) AS v, avg(value) OVER w AS mean,
        coalesce(stddev_samp(value) OVER w, 0) AS stddev FROM observations
      WINDOW w AS (PARTITION BY metric ORDER BY seq ROWS BETWEEN 1999 PRECEDING AND CURRENT ROW))""",
)
def sliding_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.sliding_summary(observations(spark, d)), "min", "max", "mean", "stddev", *QUANTILES)


def rates_sql(source: str) -> str:
    return f"""per_minute AS (SELECT metric, CAST(floor(pts / 60) AS BIGINT) AS minute, count(*) AS c FROM {source} GROUP BY ALL),
    rates AS (SELECT metric, minute, CAST(sum(c) OVER (PARTITION BY metric ORDER BY minute) AS BIGINT) AS count,
      round(sum(c) OVER (PARTITION BY metric ORDER BY minute)
        / ((minute - min(minute) OVER (PARTITION BY metric) + 1) * 60.0::DOUBLE), 6) AS mean_rate,
      round(sum(c) OVER (PARTITION BY metric ORDER BY minute RANGE BETWEEN 0 PRECEDING AND CURRENT ROW) / 60.0::DOUBLE, 6) AS m1,
      round(sum(c) OVER (PARTITION BY metric ORDER BY minute RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) / 300.0::DOUBLE, 6) AS m5,
      round(sum(c) OVER (PARTITION BY metric ORDER BY minute RANGE BETWEEN 14 PRECEDING AND CURRENT ROW) / 900.0::DOUBLE, 6) AS m15
      FROM per_minute)
    """


@query("", OBSERVED.rstrip() + ",\n" + rates_sql("observations") + "SELECT * FROM rates")
def meter_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.meter_rates(observations(spark, d)), "mean_rate", "m1", "m5", "m15")


LAST_RATES = """SELECT metric, arg_max(mean_rate, minute) AS mean_rate, arg_max(m1, minute) AS m1,
  arg_max(m5, minute) AS m5, arg_max(m15, minute) AS m15, arg_max(count, minute) AS rate_count FROM rates GROUP BY metric"""


@query(
    "",
    OBSERVED.rstrip() + ",\n" + rates_sql("observations")
    + f", sums AS ({summary_sql('observations', '1000000.0::DOUBLE')}), last_rates AS ({LAST_RATES}) "
    + "SELECT sums.*, mean_rate, m1, m5, m15 FROM sums JOIN last_rates USING (metric)",
)
def timer_summary(spark: SparkSession, d: str) -> DataFrame:
    out = M.timer_summary(observations(spark, d))
    return rounded(out, "min", "max", "mean", "stddev", *QUANTILES, "mean_rate", "m1", "m5", "m15")


def _kind(i: int) -> str:
    return ["gauge", "counter", "histogram", "meter", "timer"][i]


def kinds(spark: SparkSession, d: str) -> DataFrame:
    """Observations of 25 metrics, five of each kind."""
    number = F.col("user_id") % 25
    names = F.array(*[F.lit(_kind(i)) for i in range(5)])
    return V.table(spark, d, "events").select(
        F.concat(F.lit("m"), number.cast("string")).alias("metric"),
        F.get(names, (number % 5).cast("int")).alias("kind"),
        F.col("event_id").alias("seq"),
        (V.epoch_micros(F.col("ts")) / 1e6).alias("pts"),
        F.floor(F.col("value") * 1000).cast("long").alias("value"),
    )


def reports_sql() -> str:
    names = "['gauge', 'counter', 'histogram', 'meter', 'timer']"
    base = f"""WITH all_kinds AS (SELECT 'm' || (user_id % 25) AS metric, {names}[1 + user_id % 25 % 5] AS kind,
      event_id AS seq, epoch_us(ts) / 1e6::DOUBLE AS pts, CAST(floor(value * 1000) AS BIGINT) AS value FROM events),
    {rates_sql("(SELECT * FROM all_kinds WHERE kind IN ('meter', 'timer'))")},
    last_rates AS ({LAST_RATES}),
    h AS ({summary_sql("(SELECT * FROM all_kinds WHERE kind = 'histogram')", "1.0::DOUBLE")}),
    t AS ({summary_sql("(SELECT * FROM all_kinds WHERE kind = 'timer')", "1000000.0::DOUBLE")}),
    kind_of AS (SELECT DISTINCT metric, kind FROM all_kinds),
    parts AS (
      SELECT metric, 'gauge' AS kind, 'value' AS col, CAST(arg_max(value, seq) AS DOUBLE) AS value FROM all_kinds
        WHERE kind = 'gauge' GROUP BY metric
      UNION ALL SELECT metric, 'counter', 'count', CAST(sum(value) AS DOUBLE) FROM all_kinds
        WHERE kind = 'counter' GROUP BY metric
      UNION ALL SELECT metric, 'meter', 'count', CAST(rate_count AS DOUBLE) FROM last_rates
        WHERE metric IN (SELECT metric FROM kind_of WHERE kind = 'meter')"""
    for c in ("mean_rate", "m1", "m5", "m15"):
        base += f"\n UNION ALL SELECT metric, kind, '{c}', {c} FROM last_rates JOIN kind_of USING (metric)"
    for kind, source in (("histogram", "h"), ("timer", "t")):
        for c in ("count", "min", "max", "mean", "stddev", *QUANTILES):
            base += f"\n UNION ALL SELECT metric, '{kind}', '{c}', CAST({c} AS DOUBLE) FROM {source}"
    return base + ") SELECT metric, kind, col, round(value, 6) AS value FROM parts"


@query("", reports_sql())
def metric_reports(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.metric_reports(kinds(spark, d)), "value")


@query(
    "",
    """WITH series AS (SELECT event_type AS name, 'value' AS col, epoch_us(ts) / 1e6::DOUBLE AS ts, value FROM events),
    newest AS (SELECT * FROM series WHERE name = 'error' ORDER BY ts DESC, value LIMIT 1024)
    SELECT name, col, round(ts, 6) AS ts, value FROM newest WHERE ts >= (SELECT max(ts) FROM newest) - 3600""",
)
def recent_series(spark: SparkSession, d: str) -> DataFrame:
    series = V.table(spark, d, "events").select(
        F.col("event_type").alias("name"),
        F.lit("value").alias("col"),
        (V.epoch_micros(F.col("ts")) / 1e6).alias("ts"),
        "value",
    )
    return rounded(M.recent_series(series, "error", "value"), "ts")
