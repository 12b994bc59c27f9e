"""Queries of the timeline operators: re-timing, combining, intervals and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.operators import channels as H
from framewell.operators import combine as C
from framewell.operators import commands as K
from framewell.operators import intervals as I
from framewell.operators import retime as R
from framewell.operators import stats as S
from framewell.operators.motion import split_planes
from framewell.ordered import ordered
from framewell.plans import fixtures as V
from framewell.plans.registry import query, r6, rounded

LINE = "WINDOW w AS (PARTITION BY stream_id ORDER BY pts, seq)"

# -- selection, re-timing, resampling ----------------------------------------------------------------------------------


@query(
    "samples",
    f"""SELECT stream_id, seq, n FROM (SELECT stream_id, seq, pts, row_number() OVER w - 1 AS n, lag(pts) OVER w AS prev,
          first_value(pts) OVER w AS start FROM samples {LINE})
        WHERE n % 5 = 0 OR pts - prev > 86400 OR pts - start < 3600""",
)
def select_rows(spark: SparkSession, d: str) -> DataFrame:
    chosen = "CASE WHEN n % 5 = 0 OR t - prev_t > 86400 OR t - start_t < 3600 THEN 1 ELSE 0 END"
    return R.select_rows(V.samples(spark, d), chosen).select("stream_id", "seq", "n")


@query(
    "frames",
    f"""SELECT stream_id, seq FROM (SELECT stream_id, seq, is_key, row_number() OVER w - 1 AS n FROM frames {LINE})
        WHERE is_key OR n = 0""",
)
def select_key_frames(spark: SparkSession, d: str) -> DataFrame:
    return R.select_rows(V.frames(spark, d), "CAST(is_key AS INT) + IF(n = 0, 1, 0)").select("stream_id", "seq")


@query(
    "samples",
    """, ranked AS (SELECT stream_id, seq, pts, row_number() OVER (PARTITION BY stream_id ORDER BY pts, seq) AS i FROM samples),
    steps AS (SELECT a.stream_id, a.i, min(b.i) AS next FROM ranked a JOIN ranked b
      ON a.stream_id = b.stream_id AND b.pts >= a.pts + 259200 GROUP BY a.stream_id, a.i),
    picked AS (SELECT stream_id, i FROM ranked WHERE i = 1),
    chain AS (SELECT * FROM steps)
    SELECT r.stream_id, r.seq FROM (WITH RECURSIVE walk(stream_id, i) AS (
        SELECT stream_id, i FROM picked
        UNION ALL SELECT w.stream_id, s.next FROM walk w JOIN chain s ON s.stream_id = w.stream_id AND s.i = w.i)
      SELECT * FROM walk) k JOIN ranked r ON r.stream_id = k.stream_id AND r.i = k.i""",
)
def select_with_gap(spark: SparkSession, d: str) -> DataFrame:
    return R.select_with_gap(V.samples(spark, d), 259200.0).select("stream_id", "seq")


@query(
    "samples",
    """, ranked AS (SELECT stream_id, seq, pts, row_number() OVER (PARTITION BY stream_id ORDER BY pts, seq) AS i FROM samples),
    steps AS (SELECT a.stream_id, a.i, min(b.i) AS next FROM ranked a JOIN ranked b
      ON a.stream_id = b.stream_id AND b.pts >= a.pts + 259200 GROUP BY a.stream_id, a.i),
    picked AS (SELECT stream_id, i FROM ranked WHERE i = 1),
    chain AS (SELECT * FROM steps)
    SELECT r.stream_id, r.seq, r.i - 1 AS n, row_number() OVER v - 1 AS selected_n, lag(r.i - 1) OVER v AS prev_selected_n,
      round(lag(r.pts) OVER v, 6) AS prev_selected_pts FROM (WITH RECURSIVE walk(stream_id, i) AS (
        SELECT stream_id, i FROM picked
        UNION ALL SELECT w.stream_id, s.next FROM walk w JOIN chain s ON s.stream_id = w.stream_id AND s.i = w.i)
      SELECT * FROM walk) k JOIN ranked r ON r.stream_id = k.stream_id AND r.i = k.i
    WINDOW v AS (PARTITION BY r.stream_id ORDER BY r.i)""",
)
def select_with_previous(spark: SparkSession, d: str) -> DataFrame:
    out = R.select_with_previous(V.samples(spark, d), 259200.0)
    return rounded(out, "prev_selected_pts").select("stream_id", "seq", "n", "selected_n", "prev_selected_n", "prev_selected_pts")


@query(
    "samples",
    """SELECT seq, CAST(CASE WHEN e < 0 THEN 0 ELSE least(ceil(e) - 1, 2) END AS INTEGER) AS out_no FROM (
         SELECT seq, (seq % 9 - 2) * 0.75::DOUBLE AS e FROM samples) WHERE e <> 0""",
)
def route_rows(spark: SparkSession, d: str) -> DataFrame:
    return R.route_rows(V.samples(spark, d), "(seq % 9 - 2) * 0.75D", 3).select("seq", "out_no")


@query(
    "frames",
    """, m AS (SELECT stream_id, seq, n, sum(abs(v - pv)) / 64.0::DOUBLE AS mafd FROM pixel_pairs GROUP BY ALL),
    p AS (SELECT *, coalesce(lag(mafd) OVER (PARTITION BY stream_id ORDER BY n), 0) AS before FROM m)
    SELECT stream_id, seq, round(coalesce(mafd, 0), 6) AS mafd,
      round(coalesce(greatest(0, least(1, least(mafd, abs(mafd - before)) / 100)), 0), 9) AS score FROM p""",
)
def scene_score(spark: SparkSession, d: str) -> DataFrame:
    rows = R.scene_score(V.frames(spark, d))
    return rows.select("stream_id", "seq", r6("mafd").alias("mafd"), F.round("score", 9).alias("score"))


@query(
    "samples",
    """, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY pts, seq) - 1 AS i FROM samples),
    begun AS (SELECT *, min(pts) OVER (PARTITION BY stream_id) AS first FROM n WHERE i >= 3 OR pts >= 1704153600),
    failed AS (SELECT *, max(CASE WHEN i < 20 OR pts - first < 864000 THEN 0 ELSE 1 END)
      OVER (PARTITION BY stream_id ORDER BY pts, seq) AS over FROM begun)
    SELECT stream_id, seq FROM failed WHERE over = 0""",
)
def trim(spark: SparkSession, d: str) -> DataFrame:
    rows = R.trim(V.samples(spark, d), start_frame=3, start_pts=1704153600.0, end_frame=20, duration=864000.0)
    return rows.select("stream_id", "seq")


@query(
    "frames",
    f"SELECT stream_id, seq FROM (SELECT stream_id, seq, row_number() OVER w - 1 AS n FROM frames {LINE}) WHERE n % 3 = 0",
)
def frame_step(spark: SparkSession, d: str) -> DataFrame:
    return R.frame_step(V.frames(spark, d), 3).select("stream_id", "seq")


def resample_sql(fps: float, rounding: str) -> str:
    return f""", f AS (SELECT stream_id, pts, seq, min(pts) OVER (PARTITION BY stream_id) AS first FROM frames),
    s AS (SELECT stream_id, CAST({rounding}((pts - first) * {fps}::DOUBLE) AS BIGINT) AS slot, first, pts, seq FROM f),
    best AS (SELECT stream_id, slot, any_value(first) AS first, arg_max(seq, pts) AS seq FROM s GROUP BY stream_id, slot),
    ahead AS (SELECT *, lead(slot) OVER (PARTITION BY stream_id ORDER BY slot) AS next FROM best)
    SELECT stream_id, k AS slot, round(first + k / {fps}::DOUBLE, 6) AS pts, seq
    FROM ahead, LATERAL (SELECT unnest(range(slot, coalesce(next, slot + 1))) AS k)"""


@query("frames", resample_sql(5.0, "round"))
def resample_fps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.resample_fps(V.frames(spark, d), 5.0), "pts")


@query("frames", resample_sql(1.5, "floor"))
def resample_fps_down(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.resample_fps(V.frames(spark, d), 1.5, "down"), "pts")


@query(
    "samples",
    f"""SELECT stream_id, seq, round(pts, 3) AS pts, round((pts - first_value(pts) OVER w) / 2 + (row_number() OVER w - 1), 4)
        AS new_pts FROM samples {LINE}""",
)
def retime(spark: SparkSession, d: str) -> DataFrame:
    rows = R.retime(V.samples(spark, d), "(pts - start_pts) / 2 + n")
    return rows.select("stream_id", "seq", F.round("pts", 3).alias("pts"), F.round("new_pts", 4).alias("new_pts"))


@query(
    "samples",
    """SELECT stream_id, seq, round(sum(least(gap, 3600)) OVER (PARTITION BY stream_id ORDER BY pts, seq), 4) AS new_pts
       FROM (SELECT stream_id, seq, pts, coalesce(pts - lag(pts) OVER (PARTITION BY stream_id ORDER BY pts, seq), 0) AS gap
         FROM samples)""",
)
def retime_accumulated(spark: SparkSession, d: str) -> DataFrame:
    rows = R.retime(V.samples(spark, d), "LEAST(COALESCE(pts - prev_pts, 0), 3600)", accumulate=True)
    return rows.select("stream_id", "seq", F.round("new_pts", 4).alias("new_pts"))


@query(
    "frames",
    """, t AS (SELECT stream_id, seq, seq AS p, row_number() OVER w - 1 AS n, lag(seq) OVER w AS p1, lag(seq, 4) OVER w AS pc,
      lag(seq, 5) OVER w AS pc1 FROM frames WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
    s AS (SELECT *, CASE WHEN n = 5 THEN p * 8 WHEN n > 5 THEN 3 * (pc1 - p1) + 5 * (p - pc) END AS step FROM t)
    SELECT stream_id, seq, CAST(CASE WHEN n < 6 THEN p * 8 ELSE sum(step) OVER (PARTITION BY stream_id ORDER BY n) END AS BIGINT)
      AS new_ticks FROM s""",
)
def dejudder(spark: SparkSession, d: str) -> DataFrame:
    ticks = V.frames(spark, d).select("stream_id", "seq", F.col("seq").alias("ticks"))
    return R.dejudder(ticks).select("stream_id", "seq", "new_ticks")


@query(
    "samples",
    """, s AS (SELECT stream_id, seq, pts, value, max(pts) OVER (PARTITION BY stream_id ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM samples),
    k AS (SELECT *, coalesce(pts - (seen + 21600), 0) AS late FROM s),
    kept AS (SELECT * FROM k WHERE late >= -10800)
    SELECT stream_id, seq, round(pts, 3) AS pts, round(value, 6) AS value, false AS filled FROM kept
    UNION ALL
    SELECT stream_id, seq, round(seen + i * 21600, 3), 0.0, true FROM kept,
      LATERAL (SELECT unnest(range(1, 1 + CAST(round(late / 21600) AS BIGINT))) AS i) WHERE late > 10800""",
)
def fill_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = R.fill_gaps(V.samples(spark, d), 21600.0, 10800.0)
    return rows.select("stream_id", "seq", F.round("pts", 3).alias("pts"), r6("value").alias("value"), "filled")


@query(
    "samples",
    """, s AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY pts, seq) - 1 AS n,
      min(pts) OVER (PARTITION BY stream_id) AS first FROM samples),
    b AS (SELECT stream_id, n // 16 AS block_no, list(value ORDER BY n) AS v, any_value(first) AS first FROM s GROUP BY ALL)
    SELECT stream_id, block_no, round(first + block_no * 16 * 3600, 3) AS pts, CAST(len(v) AS INTEGER) AS n_real, i AS at,
      round(coalesce(v[i + 1], 0), 6) AS value FROM b, LATERAL (SELECT unnest(range(0, 16)) AS i)""",
)
def rebatch(spark: SparkSession, d: str) -> DataFrame:
    blocks = R.rebatch(V.samples(spark, d), 16, 1 / 3600)
    rows = blocks.select("stream_id", "block_no", "pts", "n_real", F.posexplode("samples").alias("at", "value"))
    return rows.select(
        "stream_id", "block_no", F.round("pts", 3).alias("pts"), "n_real", F.col("at").cast("long").alias("at"), r6("value").alias("value")
    )


# -- combining -------------------------------------------------------------------------------------------------------


@query(
    "frames",
    """, e AS (SELECT stream_id, count(*) AS n, max(pts) AS last FROM frames GROUP BY stream_id),
    seg AS (SELECT max(CASE WHEN n > 1 THEN last * n / (n - 1) ELSE last END) AS e1 FROM e),
    x AS (SELECT stream_id, max(pts) + 0.04 AS e2 FROM frames GROUP BY stream_id)
    SELECT stream_id, seq, CAST(k AS INTEGER) AS input_no, round(pts + k * (SELECT e1 FROM seg), 6) AS pts
    FROM frames, LATERAL (SELECT unnest(range(0, 3)) AS k)""",
)
def concat_streams(spark: SparkSession, d: str) -> DataFrame:
    f = V.frames(spark, d).select("stream_id", "seq", "pts")
    return rounded(C.concat_streams([f, f, f]), "pts")


DUP = """, dup AS (SELECT stream_id, CAST(seq AS DOUBLE) AS seq, pts FROM frames
  UNION ALL SELECT stream_id, seq + 0.5, pts FROM frames WHERE seq % 4 = 0)
"""


@query(
    "frames",
    DUP
    + """, merged AS (SELECT stream_id, seq, pts, 0 AS input_no FROM dup
      UNION ALL SELECT stream_id, CAST(seq AS DOUBLE), pts, 1 FROM frames)
    SELECT stream_id, seq, round(pts, 6) AS pts, CAST(input_no AS INTEGER) AS input_no,
      row_number() OVER (PARTITION BY stream_id ORDER BY pts, input_no, seq) - 1 AS n FROM merged""",
)
def interleave(spark: SparkSession, d: str) -> DataFrame:
    a = V.frames_dup(spark, d).select("stream_id", "seq", "pts")
    b = V.frames(spark, d).select("stream_id", F.col("seq").cast("double").alias("seq"), "pts")
    return rounded(C.interleave([a, b]), "pts")


SECOND = """, sec AS (SELECT stream_id, seq, pts * 1.1 + 0.5 AS pts FROM frames),
  ends AS (SELECT stream_id, max(pts) AS last_main, max(pts * 1.1 + 0.5) AS last_second FROM frames GROUP BY stream_id),
  met AS (SELECT m.stream_id, m.pts, m.seq AS main_seq, s.seq AS second_seq, last_second FROM frames m
    ASOF LEFT JOIN sec s ON m.stream_id = s.stream_id AND m.pts >= s.pts JOIN ends e ON e.stream_id = m.stream_id)
"""


def synced(spark: SparkSession, d: str, **how) -> DataFrame:
    main = V.frames(spark, d).select("stream_id", "pts", "seq")
    second = main.withColumn("pts", F.col("pts") * 1.1 + 0.5)
    out = C.sync_join(main, second, **how)
    return out.select(
        "stream_id", r6("pts").alias("pts"), F.col("main.seq").alias("main_seq"), F.coalesce("second.seq", F.lit(-1)).alias("second_seq")
    )


@query(
    "frames",
    SECOND
    + """SELECT stream_id, round(pts, 6) AS pts, main_seq, coalesce(second_seq, -1) AS second_seq FROM met
    UNION ALL SELECT s.stream_id, round(s.pts, 6), (SELECT max(seq) FROM frames f WHERE f.stream_id = s.stream_id), s.seq
    FROM sec s JOIN ends e ON e.stream_id = s.stream_id WHERE s.pts > e.last_main""",
)
def sync_join(spark: SparkSession, d: str) -> DataFrame:
    return synced(spark, d)


@query(
    "frames",
    SECOND + "SELECT stream_id, round(pts, 6) AS pts, main_seq, coalesce(second_seq, -1) AS second_seq FROM met WHERE pts <= last_second",
)
def sync_join_shortest(spark: SparkSession, d: str) -> DataFrame:
    return synced(spark, d, shortest=True)


@query(
    "frames",
    """, sec AS (SELECT stream_id, seq, pts * 0.6 + 0.5 AS pts FROM frames),
    ends AS (SELECT stream_id, max(pts) AS last FROM sec GROUP BY stream_id)
    SELECT m.stream_id, round(m.pts, 6) AS pts, m.seq AS main_seq,
      CASE WHEN m.pts > e.last THEN -1 ELSE coalesce(s.seq, -1) END AS second_seq
    FROM frames m ASOF LEFT JOIN sec s ON m.stream_id = s.stream_id AND m.pts >= s.pts JOIN ends e ON e.stream_id = m.stream_id""",
)
def sync_join_no_repeat(spark: SparkSession, d: str) -> DataFrame:
    main = V.frames(spark, d).select("stream_id", "pts", "seq")
    out = C.sync_join(main, main.withColumn("pts", F.col("pts") * 0.6 + 0.5), repeat_last=False)
    return out.select(
        "stream_id", r6("pts").alias("pts"), F.col("main.seq").alias("main_seq"), F.coalesce("second.seq", F.lit(-1)).alias("second_seq")
    )


def mixed_sql(stop: str) -> str:
    return f""", a AS (SELECT stream_id, value, row_number() OVER (PARTITION BY stream_id ORDER BY pts, seq) - 1 AS n FROM samples),
    b AS (SELECT stream_id, value, row_number() OVER (PARTITION BY stream_id ORDER BY pts, seq) - 1 AS n FROM samples
      WHERE channel = 1),
    la AS (SELECT stream_id, count(*) AS la FROM a GROUP BY stream_id),
    lb AS (SELECT stream_id, count(*) AS lb FROM b GROUP BY stream_id)
    SELECT a.stream_id, a.n, round((a.value + coalesce(b.value, 0)) / CASE WHEN lb IS NULL THEN 1 ELSE
      greatest(1, CASE WHEN a.n < lb THEN 2 ELSE 2 - (a.n - lb + 1) * 0.2::DOUBLE END) END, 9) AS value
    FROM a JOIN la USING (stream_id) LEFT JOIN lb USING (stream_id) LEFT JOIN b ON b.stream_id = a.stream_id AND b.n = a.n
    WHERE {stop}"""


@query("samples", mixed_sql("true"))
def mix_streams(spark: SparkSession, d: str) -> DataFrame:
    s = V.samples(spark, d)
    mixed = C.mix_streams([s, s.filter(F.col("channel") == 1)], "longest", transition=5.0)
    return mixed.withColumn("value", F.round("value", 9))


@query("samples", mixed_sql("a.n < lb"))
def mix_streams_shortest(spark: SparkSession, d: str) -> DataFrame:
    s = V.samples(spark, d)
    mixed = C.mix_streams([s, s.filter(F.col("channel") == 1)], "shortest", transition=5.0)
    return mixed.withColumn("value", F.round("value", 9))


@query("samples", "SELECT seq, CAST(k AS INTEGER) AS out_no FROM samples, LATERAL (SELECT unnest(range(0, 3)) AS k)")
def tee(spark: SparkSession, d: str) -> DataFrame:
    return C.tee(V.samples(spark, d), 3).select("seq", "out_no")


@query(
    "samples",
    """, p AS (SELECT *, row_number() OVER (PARTITION BY stream_id, channel ORDER BY pts, seq) - 1 AS n FROM samples),
    s AS (SELECT stream_id, n, coalesce(sum(value) FILTER (channel = 0), 0) AS c0,
      coalesce(sum(value) FILTER (channel = 1), 0) AS c1 FROM p GROUP BY ALL)
    SELECT stream_id, n, CAST(0 AS INTEGER) AS out_channel, round(c0 * 0.7 + c1 * 0.3, 6) AS value FROM s
    UNION ALL SELECT stream_id, n, 1, round(c1, 6) FROM s""",
)
def channel_mix(spark: SparkSession, d: str) -> DataFrame:
    placed = ordered(V.samples(spark, d), ["stream_id", "channel"], ["pts", "seq"]).index("n").done()
    return rounded(C.channel_mix(placed, {0: {0: 0.7, 1: 0.3}, 1: {1: 1.0}}), "value")


# -- intervals and events ----------------------------------------------------------------------------------------------


def islands_sql(flag: str, source: str) -> str:
    return f""", marked AS (SELECT *, {flag} AS flagged FROM {source}),
    numbered AS (SELECT *, row_number() OVER w AS i, lead(pts) OVER w AS next_pts,
      row_number() OVER w - row_number() OVER (PARTITION BY stream_id, flagged ORDER BY pts, seq) AS island FROM marked {LINE}),
    found AS (SELECT stream_id, min(pts) AS start, max(pts) AS last, arg_max(next_pts, i) AS maybe, max(i) AS i, count(*) AS n
      FROM numbered WHERE flagged GROUP BY stream_id, island),
    ended AS (SELECT f.*, (SELECT n.pts FROM numbered n WHERE n.stream_id = f.stream_id AND n.i = f.i + 1) AS stop FROM found f)
    """


DARK = "len(list_filter(luma, lambda v: v <= 37)) / 64.0 >= 0.98"


@query(
    "frames",
    islands_sql(DARK, "frames")
    + """SELECT stream_id, round(start, 6) AS start, round(coalesce(stop, last), 6) AS "end",
      round(coalesce(stop, last) - start, 6) AS duration FROM ended WHERE coalesce(stop, last) - start >= 2""",
)
def dark_intervals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.dark_intervals(V.frames(spark, d)), "start", "end", "duration")


@query(
    "frames",
    f""", n AS (SELECT stream_id, seq, pts, is_key, row_number() OVER w - 1 AS n,
      len(list_filter(luma, lambda v: v < 32)) * 100 // 64 AS pblack FROM frames {LINE})
    SELECT stream_id, seq, n, CAST(pblack AS INTEGER) AS pblack, last_keyframe FROM (
      SELECT *, coalesce(max(CASE WHEN is_key THEN n END) OVER (PARTITION BY stream_id ORDER BY n), 0) AS last_keyframe FROM n)
    WHERE pblack >= 98""",
)
def dark_frames(spark: SparkSession, d: str) -> DataFrame:
    return I.dark_frames(V.frames(spark, d)).select("stream_id", "seq", "n", "pblack", "last_keyframe")


@query(
    "samples",
    islands_sql("value < 0.1 AND value > -0.1", "samples")
    + """SELECT stream_id, round(start, 3) AS start, round(stop, 3) AS "end", n, round(stop - start, 3) AS duration
    FROM ended WHERE last - start >= 21600""",
)
def silence_intervals(spark: SparkSession, d: str) -> DataFrame:
    out = I.silence_intervals(V.samples(spark, d), 0.1, 21600.0)
    return out.withColumns({c: F.round(c, 3) for c in ("start", "end", "duration")})


@query(
    "samples",
    f""", p AS (SELECT *, row_number() OVER w AS n, sqrt(sum(value * value) OVER (PARTITION BY stream_id ORDER BY pts, seq
        ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 5) > 0.05 AS loud FROM samples {LINE}),
    q AS (SELECT *, min(CASE WHEN loud THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY n
        ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS all_loud, count(*) OVER (PARTITION BY stream_id ORDER BY n
        ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS size FROM p),
    s AS (SELECT stream_id, min(n) AS first FROM q WHERE all_loud = 1 AND size = 3 GROUP BY stream_id)
    SELECT stream_id, seq, round(value, 6) AS value FROM p JOIN s USING (stream_id) WHERE n >= first""",
)
def trim_silence(spark: SparkSession, d: str) -> DataFrame:
    rows = I.trim_silence(V.samples(spark, d), 0.05, duration=3, window=5)
    return rows.select("stream_id", "seq", r6("value").alias("value"))


@query(
    "frames",
    """, every AS (SELECT stream_id, CAST(seq AS DOUBLE) AS seq, pts, luma FROM frames
      UNION ALL SELECT stream_id, seq + 0.5, pts, luma FROM frames WHERE seq % 4 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY pts, seq) AS i FROM every),
    steps AS (SELECT a.stream_id, a.i, min(b.i) AS next FROM ranked a JOIN ranked b ON a.stream_id = b.stream_id AND b.i > a.i
      AND list_sum(list_transform(range(1, 65), lambda k: abs(a.luma[k] - b.luma[k]))) > 320 GROUP BY a.stream_id, a.i),
    picked AS (SELECT stream_id, i FROM ranked WHERE i = 1),
    kept AS (SELECT * FROM (WITH RECURSIVE walk(stream_id, i) AS (
        SELECT stream_id, i FROM picked
        UNION ALL SELECT w.stream_id, s.next FROM walk w JOIN steps s ON s.stream_id = w.stream_id AND s.i = w.i)
      SELECT * FROM walk)),
    told AS (SELECT r.stream_id, r.seq, r.i, k.i IS NOT NULL AS keep FROM ranked r LEFT JOIN kept k
      ON k.stream_id = r.stream_id AND k.i = r.i),
    runs AS (SELECT *, i - row_number() OVER (PARTITION BY stream_id, keep ORDER BY i) AS run FROM told)
    SELECT stream_id, seq, keep, CAST(CASE WHEN keep THEN -1 ELSE 1 END
      * row_number() OVER (PARTITION BY stream_id, keep, run ORDER BY i) AS INTEGER) AS drop_count FROM runs""",
)
def near_duplicate_frames(spark: SparkSession, d: str) -> DataFrame:
    return I.near_duplicate_frames(V.frames_dup(spark, d), first_col=0).drop("pts")


@query(
    "frames",
    """, t AS (SELECT stream_id, seq, n, coalesce(sum(abs(v - pv)), 0) AS tot FROM pixel_pairs GROUP BY ALL),
    c AS (SELECT *, n // 5 AS cyc, count(*) OVER (PARTITION BY stream_id, n // 5) AS size,
      row_number() OVER (PARTITION BY stream_id, n // 5 ORDER BY tot, n) AS low,
      max(CASE WHEN tot > 2448 THEN n END) OVER (PARTITION BY stream_id, n // 5) AS scene,
      min(tot) OVER (PARTITION BY stream_id, n // 5) AS least FROM t)
    SELECT stream_id, seq FROM c WHERE size < 5
      OR CASE WHEN scene IS NOT NULL AND least >= 179 THEN n <> scene ELSE low <> 1 END""",
)
def drop_one_per_cycle(spark: SparkSession, d: str) -> DataFrame:
    return I.drop_one_per_cycle(V.frames(spark, d)).select("stream_id", "seq")


@query(
    "frames",
    """, p AS (SELECT stream_id, seq, n, n // 20 AS batch, v FROM pixel_pairs),
    h AS (SELECT stream_id, batch, n, seq, v, count(*) AS c FROM p GROUP BY ALL),
    b AS (SELECT stream_id, batch, count(DISTINCT n) AS b FROM p GROUP BY ALL),
    m AS (SELECT stream_id, batch, v, sum(c) AS s FROM h GROUP BY ALL),
    grid AS (SELECT f.stream_id, f.batch, f.n, f.seq, m.v, m.s, b.b, coalesce(h.c, 0) AS c
      FROM (SELECT DISTINCT stream_id, batch, n, seq FROM p) f JOIN m USING (stream_id, batch) JOIN b USING (stream_id, batch)
      LEFT JOIN h ON h.stream_id = f.stream_id AND h.batch = f.batch AND h.n = f.n AND h.v = m.v),
    e AS (SELECT stream_id, batch, n, seq, any_value(b) AS b, CAST(sum((b * c - s) * (b * c - s)) AS BIGINT) AS e
      FROM grid GROUP BY stream_id, batch, n, seq)
    SELECT stream_id, batch, seq, round(e / CAST(b * b AS DOUBLE), 6) AS sum_sq_err FROM (
      SELECT *, row_number() OVER (PARTITION BY stream_id, batch ORDER BY e, n) AS r FROM e) WHERE r = 1""",
)
def representative_frame(spark: SparkSession, d: str) -> DataFrame:
    rows = rounded(I.representative_frame(V.frames(spark, d), 20), "sum_sq_err")
    return rows.select("stream_id", "batch", "seq", "sum_sq_err")


FIELDS = f""", t AS (SELECT stream_id, seq, luma AS c, coalesce(lag(luma) OVER w, luma) AS p, coalesce(lead(luma) OVER w, luma) AS x
      FROM frames {LINE}),
    v AS (SELECT stream_id, seq, (i // 8) % 2 AS odd, c[i + 1] AS cv, p[i + 1] AS pv, x[i + 1] AS xv, c[i - 7] + c[i + 9] AS ends
      FROM t, LATERAL (SELECT unnest(range(16, 48)) AS i)),
    s AS (SELECT stream_id, seq, sum(abs(ends - 2 * CASE WHEN odd = 0 THEN pv ELSE xv END)) AS a0,
      sum(abs(ends - 2 * CASE WHEN odd = 1 THEN pv ELSE xv END)) AS a1, sum(abs(ends - 2 * cv)) AS delta,
      sum(CASE WHEN odd = 1 THEN 2 * abs(cv - pv) ELSE 0 END) AS g0, sum(CASE WHEN odd = 0 THEN 2 * abs(cv - pv) ELSE 0 END) AS g1
      FROM v GROUP BY stream_id, seq),
    fields AS (SELECT stream_id, seq, CASE WHEN a0 > 1.04::DOUBLE * a1 THEN 'tff' WHEN a1 > 1.04::DOUBLE * a0 THEN 'bff'
        WHEN a1 > 1.5::DOUBLE * delta THEN 'progressive' ELSE 'undetermined' END AS single,
      CASE WHEN g0 > 3 * g1 THEN 'top' WHEN g1 > 3 * g0 THEN 'bottom' ELSE 'neither' END AS repeated FROM s)"""


@query("frames", FIELDS + " SELECT * FROM fields")
def interlace_single(spark: SparkSession, d: str) -> DataFrame:
    return I.interlace_class(V.frames(spark, d)).select("stream_id", "seq", "single", "repeated")


def _totals_sql(name: str, column: str, values: list[str]) -> str:
    return ", ".join(f"CAST(sum(CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS {name}_{v}" for v in values)


@query(
    "frames",
    FIELDS
    + f""", o AS (SELECT f.*, r.pts, row_number() OVER (PARTITION BY stream_id ORDER BY r.pts, seq) AS n
      FROM fields f JOIN frames r USING (stream_id, seq))
    SELECT stream_id, seq, round(pts, 6) AS pts, single, repeated, multiple, {_totals_sql('total', 'multiple', I.TYPES)},
      {_totals_sql('total_repeat', 'repeated', I.REPEATS)}
    FROM (WITH RECURSIVE walk(stream_id, n, past, multiple) AS (
        SELECT stream_id, n, [single], single FROM o WHERE n = 1
        UNION ALL SELECT stream_id, n, past, CASE
            WHEN len(list_distinct(votes)) = 1 AND len(votes) > CASE WHEN before = 'undetermined' THEN 0 ELSE 2 END
            THEN votes[1] ELSE before END
          FROM (SELECT *, list_filter(past, lambda t: t <> 'undetermined') AS votes
            FROM (SELECT o.stream_id, o.n, list_prepend(o.single, w.past)[1:4] AS past, w.multiple AS before
              FROM walk w JOIN o ON o.stream_id = w.stream_id AND o.n = w.n + 1)))
      SELECT o.*, walk.multiple FROM walk JOIN o USING (stream_id, n)) {LINE}""",
)
def interlace_class(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.interlace_class(V.frames(spark, d)), "pts")


EDGES = """, lines AS (
  SELECT stream_id, seq, n, 'y' AS axis, py AS line_no, sum(v) // 8 > 24 AS bright FROM pixel_pairs GROUP BY ALL
  UNION ALL SELECT stream_id, seq, n, 'x', px, sum(v) // 8 > 24 FROM pixel_pairs GROUP BY ALL),
bounds AS (SELECT stream_id, seq, n, min(line_no) FILTER (bright AND axis = 'y') AS fy, max(line_no) FILTER (bright AND axis = 'y') AS ly,
    min(line_no) FILTER (bright AND axis = 'x') AS fx, max(line_no) FILTER (bright AND axis = 'x') AS lx
  FROM lines WHERE n >= 2 GROUP BY ALL),
low AS (SELECT *, least(7, coalesce(min(fy) OVER w, 7)) AS y1, least(7, coalesce(min(fx) OVER w, 7)) AS x1
  FROM bounds WINDOW w AS (PARTITION BY stream_id ORDER BY n)),
box AS (SELECT *, coalesce(max(CASE WHEN ly > y1 THEN ly END) OVER w, 0) AS y2,
    coalesce(max(CASE WHEN lx > x1 THEN lx END) OVER w, 0) AS x2
  FROM low WINDOW w AS (PARTITION BY stream_id ORDER BY n)),
even AS (SELECT *, (x1 + 1) // 2 * 2 AS ex, (y1 + 1) // 2 * 2 AS ey FROM box),
size AS (SELECT *, x2 - ex + 1 AS w0, y2 - ey + 1 AS h0 FROM even),
shrunk AS (SELECT *, w0 % 2 AS sw, h0 % 2 AS sh FROM size)
"""


@query(
    "frames",
    EDGES
    + """SELECT stream_id, seq, CAST(x1 AS INTEGER) AS x1, CAST(x2 AS INTEGER) AS x2, CAST(y1 AS INTEGER) AS y1,
      CAST(y2 AS INTEGER) AS y2, CAST(w0 - sw AS INTEGER) AS w, CAST(h0 - sh AS INTEGER) AS h,
      CAST(ex + (CAST(trunc(sw / 2) AS INTEGER) + 1) // 2 * 2 AS INTEGER) AS x,
      CAST(ey + (CAST(trunc(sh / 2) AS INTEGER) + 1) // 2 * 2 AS INTEGER) AS y FROM shrunk""",
)
def crop_bounds(spark: SparkSession, d: str) -> DataFrame:
    rows = I.crop_bounds(V.frames(spark, d), round_to=2)
    return rows.select("stream_id", "seq", "x1", "x2", "y1", "y2", "w", "h", "x", "y")


@query(
    "frames",
    """SELECT stream_id, seq, CAST(min(px) AS INTEGER) AS x1, CAST(min(py) AS INTEGER) AS y1, CAST(max(px) AS INTEGER) AS x2,
       CAST(max(py) AS INTEGER) AS y2 FROM pixels WHERE v > 170 GROUP BY stream_id, seq""",
)
def bright_bbox(spark: SparkSession, d: str) -> DataFrame:
    return I.bright_bbox(V.frames(spark, d), min_val=170).drop("pts")


# -- statistics, fingerprints, comparison --------------------------------------------------------------------------------

DB = "CASE WHEN {0} = 0 THEN 91.0::DOUBLE ELSE ln({0} / 1073741824.0::DOUBLE) * (-10 / ln(10.0::DOUBLE)) END"


@query(
    "samples",
    f""", s AS (SELECT stream_id, count(*) AS n, CAST(sum(CAST(pcm AS HUGEINT) * pcm) AS BIGINT) AS e, max(abs(pcm)) AS peak FROM samples GROUP BY stream_id),
    p AS (SELECT *, (e + n // 2) // n AS power, peak * peak AS top FROM s)
    SELECT stream_id, n AS n_samples, power, round(-({DB.format('power')}), 6) AS mean_db, round(-({DB.format('top')}), 6) AS max_db FROM p""",
)
def volume_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.volume_stats(V.samples(spark, d)), "mean_db", "max_db")


@query(
    "",
    f"""WITH samples AS (SELECT event_type AS stream_id, CAST(trunc(value * 60) AS INTEGER) AS pcm FROM events),
    b AS (SELECT stream_id, CAST(trunc({DB.format('(pcm * pcm)')}) AS INTEGER) AS db, count(*) AS c FROM samples GROUP BY ALL),
    t AS (SELECT stream_id, min(db) AS first, sum(c) AS n FROM b GROUP BY stream_id),
    g AS (SELECT t.stream_id, t.n, k AS db, coalesce(b.c, 0) AS c FROM t, LATERAL (SELECT unnest(range(first, 92)) AS k)
      LEFT JOIN b ON b.stream_id = t.stream_id AND b.db = k),
    r AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY stream_id ORDER BY db ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS before FROM g)
    SELECT stream_id, CAST(db AS INTEGER) AS db, CAST(c AS BIGINT) AS count FROM r WHERE before < n // 1000""",
)
def volume_histogram(spark: SparkSession, d: str) -> DataFrame:
    by_type = V.table(spark, d, "events").select(
        F.col("event_type").alias("stream_id"), (F.col("value") * 60).cast("int").alias("pcm")
    )
    return S.volume_histogram(by_type)


CLOSED = ["dc_offset", "min_level", "max_level", "peak_db", "rms_db", "crest_factor", "flat_factor"]

CHANNELS = """, base AS (SELECT stream_id, channel, seq, pts, round(value * 20) / 20 AS v FROM samples),
edge AS (SELECT *, min(v) OVER k AS lo, greatest(max(v) OVER k, 2.2250738585072014e-308) AS hi,
    row_number() OVER (PARTITION BY stream_id, channel ORDER BY pts, seq) AS i, count(*) OVER k AS size
  FROM base WINDOW k AS (PARTITION BY stream_id, channel)),
run AS (SELECT *, i - row_number() OVER (PARTITION BY stream_id, channel, v = lo ORDER BY i) AS a,
    i - row_number() OVER (PARTITION BY stream_id, channel, v = hi ORDER BY i) AS b FROM edge),
low AS (SELECT stream_id, channel, sum(CASE WHEN last < size THEN c * c ELSE 0 END) AS r FROM (
    SELECT stream_id, channel, a, count(*) AS c, max(i) AS last, any_value(size) AS size FROM run WHERE v = lo GROUP BY ALL)
  GROUP BY ALL),
top AS (SELECT stream_id, channel, sum(CASE WHEN last < size THEN c * c ELSE 0 END) AS r FROM (
    SELECT stream_id, channel, b, count(*) AS c, max(i) AS last, any_value(size) AS size FROM run WHERE v = hi GROUP BY ALL)
  GROUP BY ALL),
sums AS (SELECT stream_id, channel, count(*) AS n, sum(v) AS sx, sum(v * v) AS sx2, any_value(lo) AS lo, any_value(hi) AS hi,
    count(*) FILTER (v = lo) + count(*) FILTER (v = hi) AS peaks FROM edge GROUP BY ALL),
full_sums AS (SELECT s.*, coalesce(low.r, 0) + coalesce(top.r, 0) AS runs FROM sums s LEFT JOIN low USING (stream_id, channel)
  LEFT JOIN top USING (stream_id, channel))
"""


def coarse_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples on 21 levels, so that runs of equal samples occur."""
    return V.samples(spark, d).withColumn("value", F.round(F.col("value") * 20) / 20)


def db_sql(x: str) -> str:
    return f"round(CASE WHEN {x} > 0 THEN log10({x}) * 20 END, 6)"


@query(
    "samples",
    CHANNELS
    + f"""SELECT stream_id, channel, n, round(sx / n, 9) AS dc_offset, round(lo, 6) AS min_level, round(hi, 6) AS max_level,
      {db_sql('greatest(-lo, hi)')} AS peak_db, {db_sql('sqrt(sx2 / n)')} AS rms_db,
      round(CASE WHEN sx2 <> 0 THEN greatest(-lo, hi) / sqrt(sx2 / n) ELSE 1 END, 6) AS crest_factor,
      {db_sql('(runs / CAST(peaks AS DOUBLE))')} AS flat_factor, peaks AS peak_count FROM full_sums""",
)
def signal_stats(spark: SparkSession, d: str) -> DataFrame:
    out = S.signal_stats(coarse_samples(spark, d))
    out = rounded(out, *CLOSED[1:]).withColumn("dc_offset", F.round("dc_offset", 9))
    return out.select("stream_id", "channel", "n", *CLOSED, "peak_count")


@query(
    "samples",
    f""", l AS (SELECT stream_id, channel, list(round(value * 20) / 20 ORDER BY pts, seq) AS v FROM samples GROUP BY ALL),
    p AS (SELECT stream_id, channel, v, list_transform(range(11, len(v) + 1), lambda k: list_reduce(
        list_prepend(0::DOUBLE, v[1:k]), lambda p, x: p * exp(-0.5::DOUBLE) + (1 - exp(-0.5::DOUBLE)) * x * x)) AS powers FROM l),
    r AS (SELECT stream_id, channel, coalesce(list_max(powers), list_avg(list_transform(v, lambda x: x * x))) AS high,
      coalesce(list_min(powers), list_avg(list_transform(v, lambda x: x * x))) AS low FROM p)
    SELECT stream_id, channel, {db_sql('sqrt(high)')} AS rms_peak_db, {db_sql('sqrt(low)')} AS rms_trough_db FROM r""",
)
def signal_rms_range(spark: SparkSession, d: str) -> DataFrame:
    out = S.signal_stats(coarse_samples(spark, d), length=0.5, rate=4.0)
    return rounded(out, "rms_peak_db", "rms_trough_db").select("stream_id", "channel", "rms_peak_db", "rms_trough_db")


@query(
    "samples",
    CHANNELS
    + f""", o AS (SELECT stream_id, count(*) AS k, sum(n) AS n, arg_max(sx, abs(sx)) AS sx, sum(sx2) AS sx2, min(lo) AS lo,
      max(hi) AS hi, sum(runs) AS runs, sum(peaks) AS peaks FROM full_sums GROUP BY stream_id)
    SELECT stream_id, CAST(n // k AS BIGINT) AS n, round(sx / (n // k), 9) AS dc_offset, round(lo, 6) AS min_level,
      round(hi, 6) AS max_level, {db_sql('greatest(-lo, hi)')} AS peak_db, {db_sql('sqrt(sx2 / n)')} AS rms_db,
      {db_sql('(runs / CAST(peaks AS DOUBLE))')} AS flat_factor, round(peaks / CAST(k AS DOUBLE), 9) AS peak_count FROM o""",
)
def signal_stats_overall(spark: SparkSession, d: str) -> DataFrame:
    cols = [c for c in CLOSED[1:] if c != "crest_factor"]
    out = rounded(S.signal_stats_overall(coarse_samples(spark, d)), *cols)
    return out.withColumns({c: F.round(c, 9) for c in ("dc_offset", "peak_count")})


@query(
    "frames",
    """SELECT stream_id, seq, CAST(list_min(luma) AS INTEGER) AS ymin, CAST(list_sort(luma)[6] AS INTEGER) AS ylow,
         round(list_sum(luma) / 64.0::DOUBLE, 6) AS yavg, CAST(list_sort(luma)[58] AS INTEGER) AS yhigh,
         CAST(list_max(luma) AS INTEGER) AS ymax,
         round(coalesce(list_sum(list_transform(range(1, 65), lambda i: abs(luma[i] - prev[i]))), 0) / 64.0::DOUBLE, 6) AS ydif
       FROM frame_pairs""",
)
def frame_signal_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.frame_signal_stats(V.frames(spark, d)), "yavg", "ydif").drop("pts")


@query(
    "frames",
    """, c AS (SELECT stream_id, seq, luma[1:16] AS u, luma[17:32] AS v FROM frames),
    s AS (SELECT *, list_transform(range(1, 17), lambda i: CAST(floor(sqrt((u[i] - 128) ** 2 + (v[i] - 128) ** 2)) AS INTEGER) & 255) AS sat,
      list_transform(range(1, 17), lambda i: CAST(floor(degrees(atan2(u[i] - 128, v[i] - 128)) + 180) AS INTEGER)) AS hue FROM c)
    SELECT stream_id, seq, CAST(list_min(sat) AS INTEGER) AS satmin, list_sort(sat)[2] AS satlow,
      round(list_sum(sat) / 16.0::DOUBLE, 6) AS satavg, list_sort(sat)[14] AS sathigh, CAST(list_max(sat) AS INTEGER) AS satmax,
      list_sort(hue)[9] AS huemed, round(coalesce(list_sum(list_filter(hue, lambda h: h < 360)), 0) / 16.0::DOUBLE, 6) AS hueavg FROM s""",
)
def frame_chroma_stats(spark: SparkSession, d: str) -> DataFrame:
    f = V.frames(spark, d).withColumns({"u": F.slice("luma", 1, 16), "v": F.slice("luma", 17, 16)})
    out = S.frame_signal_stats(f, {"y": "luma", "u": "u", "v": "v"})
    cols = ["satmin", "satlow", "satavg", "sathigh", "satmax", "huemed", "hueavg"]
    return rounded(out, "satavg", "hueavg").select("stream_id", "seq", *cols)


def _pixel(y: str, x: str) -> str:
    return f"luma[({y}) * 8 + ({x}) + 1]"


def _sticks_out(x: str, j: int) -> str:
    up, mid, down = _pixel(f"k // 6 - {j}", x), _pixel("k // 6", x), _pixel(f"k // 6 + {j}", x)
    return f"(abs({up} - {mid}) + abs({down} - {mid})) // 2 - abs({down} - {up}) > 4"


def _three(j: int) -> str:
    return " AND ".join(_sticks_out(f"k % 6 + {dx}", j) for dx in range(3))


# k is 6 * line + column of the pixels that have both side neighbours, on pictures of 8 x 8 with chroma of 4 x 4
FLAGS = f"""SELECT stream_id, seq, pts,
  len(list_filter(range(6, 42), lambda k: ({_three(1)}) AND (k // 6 IN (1, 6) OR ({_three(2)})))) / 64.0::DOUBLE AS tout,
  len(list_filter(range(4, 8), lambda y: list_sum(list_transform(range(8),
    lambda x: abs({_pixel("y", "x")} - {_pixel("y - 4", "x")}))) < 8)) * 8 / 64.0::DOUBLE AS vrep,
  len(list_filter(range(64), lambda i: luma[i + 1] NOT BETWEEN 16 AND 235
    OR luma[i // 16 * 4 + i % 8 // 2 + 1] NOT BETWEEN 16 AND 240
    OR luma[16 + i // 16 * 4 + i % 8 // 2 + 1] NOT BETWEEN 16 AND 240)) / 64.0::DOUBLE AS brng
FROM frames"""


@query("frames", FLAGS)
def signal_flags(spark: SparkSession, d: str) -> DataFrame:
    return S.signal_flags(split_planes(V.planar_frames(spark, d)))


ADLER = """printf('%08X', CAST((list_sum(list_transform(range(1, len({0}) + 1), lambda i: CAST({0}[i] AS BIGINT) * (len({0}) - i + 1)))
  % 65521) * 65536 + list_sum({0}) % 65521 AS BIGINT))"""


@query(
    "frames",
    f"""SELECT stream_id, seq, n, is_key, 64 AS size, {ADLER.format('luma')} AS checksum, {ADLER.format('luma')} AS y_checksum,
         CAST((list_sum(luma) + 32) // 64 AS BIGINT) AS y_mean,
         round(sqrt(greatest(0, (list_sum(list_transform(luma, lambda v: v * v))
           - list_sum(luma) * CAST(list_sum(luma) AS DOUBLE) / 64) / 64)), 6) AS y_stdev FROM frame_pairs""",
)
def frame_info(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.frame_info(V.frames(spark, d)), "y_stdev").drop("pts")


def pcm_blocks(spark: SparkSession, d: str) -> DataFrame:
    whole = V.samples(spark, d).withColumn("value", F.col("pcm"))
    return R.rebatch(whole, 16, 1 / 3600, pad=False)


@query(
    "samples",
    f""", s AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY pts, seq) - 1 AS n FROM samples),
    b AS (SELECT stream_id, n // 16 AS n, min(pts) AS p, list(pcm ORDER BY n) AS v FROM s GROUP BY stream_id, n // 16),
    y AS (SELECT stream_id, n, v, flatten(list_transform(v, lambda x: [x & 255, (x >> 8) & 255])) AS bytes FROM b)
    SELECT stream_id, n, 44100.0::DOUBLE AS rate, 1 AS channels, CAST(len(v) AS INTEGER) AS n_samples, {ADLER.format('bytes')} AS checksum FROM y""",
)
def sample_block_info(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_block_info(pcm_blocks(spark, d), 44100.0).drop("pts")


HEX = "array_to_string(list_transform(luma, lambda y: printf('%02X', y)), '')"


@query(
    "frames",
    f"""SELECT stream_id, seq, round(pts, 6) AS pts, round(pts, 6) AS dts, 0.04::DOUBLE AS duration, 64 AS size,
        md5(unhex({HEX})) AS hash FROM frames""",
)
def frame_checksums(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.frame_checksums(S.packets(V.frames(spark, d), 0.04)), "pts", "dts")


@query(
    "frames",
    f"""SELECT stream_id, seq, round(pts, 6) AS pts, round(pts, 6) AS dts, 0.04::DOUBLE AS duration, 64 AS size,
        {ADLER.format('luma')} AS hash FROM frames""",
)
def frame_checksums_adler(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.frame_checksums(S.packets(V.frames(spark, d), 0.04), "adler32"), "pts", "dts")


def _tree_sql(levels: int) -> str:
    text = f""", t0 AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY pts, seq) - 1 AS i,
      md5(unhex({HEX})) AS h FROM frames)"""
    for k in range(levels):
        text += f""", t{k + 1} AS (SELECT stream_id, i // 1024 AS i, md5(string_agg(h, '' ORDER BY i)) AS h FROM (
          SELECT stream_id, i, h FROM t{k}) GROUP BY stream_id, i // 1024)"""
    return text + f" SELECT stream_id, h AS checksum FROM t{levels}"


@query("frames", _tree_sql(4))
def stream_checksum(spark: SparkSession, d: str) -> DataFrame:
    return S.stream_checksum(S.packets(V.frames(spark, d), 0.04))


BYTES = """, b AS (SELECT stream_id, flatten(list(luma ORDER BY pts, seq)) AS d FROM frames GROUP BY stream_id)"""


@query(
    "frames",
    BYTES
    + """ SELECT stream_id, lower(lpad(hex(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, d::BIGINT[]), lambda c, x:
        list_reduce(list_prepend(xor(c, x), range(8)), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)
      ))), 8, '0')) AS checksum FROM b""",
)
def stream_crc32(spark: SparkSession, d: str) -> DataFrame:
    return S.concatenated_checksum(S.packets(V.frames(spark, d), 0.04), "crc32")


@query(
    "frames",
    BYTES
    + """ SELECT stream_id, lower(lpad(hex((((len(d) + list_sum(list_transform(d, lambda x, i: x * (len(d) - i + 1)))) % 65521) * 65536
        + (1 + list_sum(d)) % 65521)::BIGINT), 8, '0')) AS checksum FROM b""",
)
def stream_adler32(spark: SparkSession, d: str) -> DataFrame:
    return S.concatenated_checksum(S.packets(V.frames(spark, d), 0.04), "adler32")


@query(
    "frames",
    "SELECT stream_id, seq, CAST(v AS INTEGER) AS value, count(*) AS n FROM pixels GROUP BY stream_id, seq, v",
)
def level_histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.level_histogram(V.frames(spark, d))


def altered(frames: DataFrame) -> DataFrame:
    """The same frames with levels raised by 0 to 6, as a lossy copy would have."""
    return frames.withColumn("luma", F.transform("luma", lambda v: F.least(F.lit(255), v + v % 7)))


COPY = ", pair AS (SELECT stream_id, seq, v AS a, least(255, v + v % 7) AS b FROM pixels)\n"


@query(
    "frames",
    COPY
    + """SELECT stream_id, count(*) AS n, CAST(sum((a - b) * (a - b)) AS BIGINT) AS sse,
      round(sqrt(sum((a - b) * (a - b)) / CAST(count(*) AS DOUBLE)), 6) AS stddev,
      round(CASE WHEN sum((a - b) * (a - b)) = 0 THEN 999.99 ELSE
        10 * log10(65025.0::DOUBLE * count(*) / sum((a - b) * (a - b))) END, 6) AS psnr,
      CAST(max(abs(a - b)) AS INTEGER) AS max_diff FROM pair GROUP BY stream_id""",
)
def psnr(spark: SparkSession, d: str) -> DataFrame:
    f = V.frames(spark, d)
    return rounded(S.psnr(f, altered(f)), "stddev", "psnr")


@query(
    "samples",
    """SELECT stream_id, count(*) AS n, CAST(sum((pcm % 11) * (pcm % 11)) AS BIGINT) AS sse,
      round(sqrt(sum((pcm % 11) * (pcm % 11)) / CAST(count(*) AS DOUBLE)), 6) AS stddev,
      round(CASE WHEN sum((pcm % 11) * (pcm % 11)) = 0 THEN 999.99 ELSE
        10 * log10(65535.0::DOUBLE * 65535.0 * count(*) / sum((pcm % 11) * (pcm % 11))) END, 6) AS psnr,
      CAST(max(pcm % 11) AS INTEGER) AS max_diff FROM samples GROUP BY stream_id""",
)
def sample_psnr(spark: SparkSession, d: str) -> DataFrame:
    s = V.samples(spark, d)
    return rounded(S.sample_psnr(s, s.withColumn("pcm", F.col("pcm") - F.col("pcm") % 11)), "stddev", "psnr")


@query(
    "frames",
    COPY
    + """, s AS (SELECT stream_id, seq, CAST(sum(a) AS DOUBLE) AS s1, CAST(sum(b) AS DOUBLE) AS s2,
      CAST(sum(a * a + b * b) AS DOUBLE) AS ss, CAST(sum(a * b) AS DOUBLE) AS s12 FROM pair GROUP BY ALL)
    SELECT stream_id, seq, round((2 * s1 * s2 + 416) * (2 * (s12 * 64 - s1 * s2) + 235963)
      / ((s1 * s1 + s2 * s2 + 416) * (ss * 64 - s1 * s1 - s2 * s2 + 235963)), 6) AS ssim FROM s""",
)
def ssim(spark: SparkSession, d: str) -> DataFrame:
    f = V.frames(spark, d)
    return rounded(S.ssim(f, altered(f)), "ssim")


# -- channel routing and commands ------------------------------------------------------------------------------------


def placed_samples(spark: SparkSession, d: str) -> DataFrame:
    return ordered(V.samples(spark, d), ["stream_id", "channel"], ["pts", "seq"]).index("n").done()


PLACED = """, p AS (SELECT stream_id, channel, value,
  row_number() OVER (PARTITION BY stream_id, channel ORDER BY pts, seq) - 1 AS n FROM samples)
"""
ROUNDED = "stream_id, CAST(channel AS INTEGER) AS channel, n, round(value, 6) AS value"


@query(
    "samples",
    PLACED
    + f"""SELECT {ROUNDED} FROM (SELECT stream_id, o AS channel, n, value FROM p
      JOIN (VALUES (0, 1), (1, 0), (2, 1)) m(o, i) ON p.channel = m.i)""",
)
def channel_map(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.channel_map(placed_samples(spark, d), {0: 1, 1: 0, 2: 1}), "value")


@query("samples", PLACED + "SELECT stream_id, n, round(value, 6) AS value FROM p WHERE channel = 1")
def channel_split(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.channel_split(placed_samples(spark, d), [0, 1])[1], "value")


SHORTEST = """, l AS (SELECT stream_id, min(len) AS len FROM (
    SELECT stream_id, channel, max(n) + 1 AS len FROM p GROUP BY ALL) GROUP BY stream_id HAVING count(*) = 2)
"""


@query(
    "samples",
    PLACED
    + SHORTEST
    + f"""SELECT {ROUNDED} FROM (SELECT p.stream_id, 1 - channel AS channel, n, value FROM p JOIN l USING (stream_id)
      WHERE n < len)""",
)
def channel_join(spark: SparkSession, d: str) -> DataFrame:
    one = [p.withColumn("channel", F.lit(0)) for p in H.channel_split(placed_samples(spark, d), [0, 1]).values()]
    return rounded(H.channel_join(one, {0: (1, 0), 1: (0, 0)}), "value")


@query(
    "samples",
    PLACED + SHORTEST + f"SELECT {ROUNDED} FROM p JOIN l USING (stream_id) WHERE n < len",
)
def channel_merge(spark: SparkSession, d: str) -> DataFrame:
    one = [p.withColumn("channel", F.lit(0)) for p in H.channel_split(placed_samples(spark, d), [0, 1]).values()]
    return rounded(H.channel_merge(one, [1, 1]), "value")


@query(
    "samples",
    PLACED
    + f""", e AS (SELECT stream_id, channel, max(n) + 1 AS len FROM p GROUP BY ALL),
    grid AS (SELECT stream_id, channel, unnest(range(len + 5)) AS n FROM e)
    SELECT {ROUNDED.replace('value, 6', 'coalesce(value, 0), 6')} FROM (SELECT g.stream_id, g.channel, g.n, p.value FROM grid g
      LEFT JOIN p ON g.stream_id = p.stream_id AND g.channel = p.channel
        AND g.n - CASE g.channel WHEN 0 THEN 2 ELSE 5 END = p.n)""",
)
def channel_delay(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.channel_delay(placed_samples(spark, d), {0: 2, 1: 5}), "value")


@query(
    "samples",
    PLACED
    + f""", e AS (SELECT stream_id, channel, greatest(max(n) + 1, 12) AS len FROM p GROUP BY ALL),
    grid AS (SELECT stream_id, channel, unnest(range(len)) AS n FROM e)
    SELECT {ROUNDED.replace('value, 6', 'coalesce(value, 0), 6')} FROM grid LEFT JOIN p USING (stream_id, channel, n)""",
)
def pad_channels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(H.pad(placed_samples(spark, d), whole=12), "value")


def watch_times(spark: SparkSession, d: str) -> DataFrame:
    """Intervals per stream: eleven hours from the time of every fourth sample on, some of them without a sample inside."""
    s = V.samples(spark, d).filter(F.col("seq") % 4 == 0)
    start = F.floor("pts") + F.when(F.col("seq") % 8 == 0, 1).otherwise(0)
    return s.select("stream_id", F.col("seq").alias("interval_no"), start.cast("double").alias("start")).withColumn(
        "end", F.col("start") + 39600
    )


@query(
    "samples",
    """, w AS (SELECT stream_id, seq AS interval_no,
      CAST(floor(pts) + CASE WHEN seq % 8 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS start FROM samples WHERE seq % 4 = 0),
    enter AS (SELECT w.stream_id, interval_no, start, min(struct_pack(pts := s.pts, seq := s.seq)) AS r FROM w
      JOIN samples s ON w.stream_id = s.stream_id AND s.pts >= start AND s.pts < start + 39600 GROUP BY ALL),
    leave AS (SELECT e.stream_id, interval_no, min(struct_pack(pts := s.pts, seq := s.seq)) AS r FROM enter e
      JOIN samples s ON e.stream_id = s.stream_id AND s.pts >= start + 39600 GROUP BY ALL)
    SELECT stream_id, interval_no, 'enter' AS flag, round(r.pts, 6) AS pts, r.seq AS seq FROM enter
    UNION ALL SELECT stream_id, interval_no, 'leave', round(r.pts, 6), r.seq FROM leave""",
)
def command_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.command_events(V.samples(spark, d), watch_times(spark, d)), "pts")
