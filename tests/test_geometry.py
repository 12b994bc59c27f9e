"""Zone and box rules at their edges."""

import pytest
from pyspark.sql import functions as F

from framewell.functions.boxes import area_percent, corners, intersection_area, parse_pos
from framewell.functions.tokens import camera_token, event_time, expiry_days
from framewell.operators import geometry as G
from framewell.operators import motion as D


def prune(spark, *zones):
    return sorted(r.zone_id for r in G.explode_zones(pruned(spark, zones)).collect())


def pruned(spark, zones, n=None):
    rows = [("cam", [(i + 1, *z) for i, z in enumerate(zones)], len(zones) if n is None else n)]
    item = "STRUCT<zone_no: INT, id: INT, x: INT, y: INT, w: INT, h: INT>"
    return G.prune_nested_zones(spark.createDataFrame(rows, f"token STRING, zones ARRAY<{item}>, n_zones INT"))


def test_of_two_zones_the_outer_goes(spark):
    assert prune(spark, (1, 0, 0, 50, 50), (2, 10, 10, 20, 20)) == [2]
    assert prune(spark, (1, 10, 10, 20, 20), (2, 0, 0, 50, 50)) == [1]


def test_two_zones_sharing_an_edge_stay(spark):
    assert prune(spark, (1, 0, 0, 50, 50), (2, 0, 10, 20, 20)) == [1, 2]
    assert prune(spark, (1, 0, 0, 50, 50), (2, 10, 10, 40, 20)) == [1, 2]


def test_of_three_zones_the_inner_goes(spark):
    assert prune(spark, (1, 0, 0, 50, 50), (2, 10, 10, 20, 20), (3, 60, 0, 10, 10)) == [1, 3]
    # equal left edges count as inside for three zones
    assert prune(spark, (1, 0, 0, 50, 50), (2, 0, 10, 20, 20), (3, 60, 0, 10, 10)) == [1, 3]


def test_second_against_third_only_when_none_has_gone(spark):
    assert prune(spark, (1, 0, 0, 5, 5), (2, 10, 10, 40, 40), (3, 20, 20, 5, 5)) == [1, 2]
    # the first holds the second, so the third inside the second stays
    assert prune(spark, (1, 0, 0, 60, 30), (2, 10, 5, 40, 20), (3, 20, 10, 35, 25)) == [1, 3]


def test_zones_of_equal_id_count_once_with_the_last_rectangle(spark):
    df = G.explode_zones(pruned(spark, [(7, 1, 1, 5, 5), (7, 2, 2, 6, 6)]))
    assert [tuple(r) for r in df.select("zone_id", *"xywh").collect()] == [(7, 2, 2, 6, 6)]


def test_zones_named_but_not_described_count(spark):
    # of two zones the outer would go; the configuration names three, so the inner one goes
    two = [(1, 5, 0, 50, 50), (2, 10, 10, 20, 20)]
    assert [r.zone_id for r in G.explode_zones(pruned(spark, two, 3)).collect()] == [1]
    assert [r.zone_id for r in G.explode_zones(pruned(spark, two, 2)).collect()] == [2]
    config = pruned(spark, [], 1).withColumn("sensitivity", F.lit(100))
    assert D.watched_zones(config).count() == 0
    assert [r.zone_id for r in D.watched_zones(config.withColumn("n_zones", F.lit(0))).collect()] == [D.WHOLE_PICTURE]


def test_pruning_needs_no_shuffle(spark):
    plan = pruned(spark, [(1, 0, 0, 5, 5)])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_pictures_without_size_stay(spark):
    rows = [(1, 2, 2, bytearray([1, 2, 3, 4])), (2, None, 2, bytearray([9])), (3, 4, 4, bytearray(range(16))), (4, 4, 4, None)]
    df = spark.createDataFrame(rows, "seq INT, width INT, height INT, luma BINARY").coalesce(1)
    got = {r.seq: r for r in D.rescale_luma(df, 2, 2).collect()}
    assert len(got) == 4 and got[2].width is None and bytes(got[2].luma) == b"\x09" and got[4].luma is None
    assert (got[3].width, got[3].height, len(got[3].luma)) == (2, 2, 4) and bytes(got[1].luma) == b"\x01\x02\x03\x04"


@pytest.mark.parametrize(
    "text,want",
    [
        ("1,2,3,4", (1, 2, 3, 4)),
        ("10, 20,x,7", (10, 20, 0, 7)),
        ("5", (5, 0, 0, 0)),
        ("", (0, 0, 0, 0)),
        ("100,100,100,100", (100, 100, 100, 100)),
        ("100,100,100,1000", (100, 100, 100, 100)),
    ],
)
def test_parse_pos(spark, text, want):
    row = spark.createDataFrame([(text,)], "pos STRING").select(parse_pos(F.col("pos")).alias("p")).first()
    assert tuple(row.p) == want


def config(spark, text):
    return G.parse_motion_config(spark.createDataFrame([(text,)], "config_json STRING")).first()


@pytest.mark.parametrize(
    "text,reason",
    [
        ("{", "bad_json"),
        ('{"dataList":[]}', "bad_sensitivity"),
        ('{"sensitivity":0,"dataList":[]}', "bad_sensitivity"),
        ('{"sensitivity":5}', "bad_data_list"),
        ('{"sensitivity":5,"dataList":{"id":1}}', "bad_data_list"),
        ('{"sensitivity":5,"dataList":[{"id":1,"pos":"1,1,1,1"},{"id":2}]}', "bad_zone"),
        ('{"sensitivity":5,"dataList":[]}', None),
    ],
)
def test_config_refusals(spark, text, reason):
    row = config(spark, text)
    assert row.reason == reason and row.valid == (reason is None)
    assert (row.zones is None) == (reason is not None)


def test_config_zone_without_id_ends_the_list(spark):
    row = config(spark, '{"sensitivity":5,"dataList":[{"id":4,"pos":"1,2,3,4"},{"a":1,"b":2},{"id":5,"pos":"1,2,3,4"}]}')
    assert row.valid and row.incomplete and row.n_zones == 3
    assert [z.id for z in row.zones] == [4]


def test_intersection_needs_overlap_and_all_corners(spark):
    rows = [(0, 0, 10, 10, 10, 0, 20, 10), (0, 0, 10, 10, 9, 9, 20, 20), (0, 0, 10, None, 5, 5, 20, 20)]
    names = ["x1", "y1", "x2", "y2", "bx1", "by1", "bx2", "by2"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} INT" for n in names))
    area = intersection_area(corners(), corners("b"))
    got = df.select(area.alias("a"), area_percent(corners(), area).alias("p")).collect()
    assert [r.a for r in got] == [0, 1, 0]
    assert [r.p for r in got] == [0.0, 1.0, 0.0]


def test_area_percent_of_an_empty_box_is_null(spark):
    df = spark.createDataFrame([(5, 5, 5, 9)], "x1 INT, y1 INT, x2 INT, y2 INT")
    assert df.select(area_percent(corners(), F.lit(3)).alias("p")).first().p is None


def test_match_uses_share_of_object_or_of_box(spark):
    box = spark.createDataFrame([(1, 0, 0, 10, 10)], "frame_id INT, x1 INT, y1 INT, x2 INT, y2 INT")
    objects = spark.createDataFrame(
        [(1, 1, 0, 0, 100, 5), (1, 2, 0, 0, 100, 4), (1, 3, 8, 8, 11, 11), (2, 4, 0, 0, 10, 10)],
        "frame_id INT, object_no INT, x1 INT, y1 INT, x2 INT, y2 INT",
    )
    got = G.match_objects_to_motion(objects, box).collect()
    assert sorted(r.object_no for r in got) == [1]


def test_area_gate_at_its_limit(spark):
    rows = [(1, 0, 0, 32, 46), (1, 100, 100, 101, 103), (2, 0, 0, 32, 46)]
    df = spark.createDataFrame(rows, "frame_id INT, x1 INT, y1 INT, x2 INT, y2 INT")
    assert [r.frame_id for r in G.motion_area_gate(df).collect()] == [1]


def test_tokens_and_times(spark):
    df = spark.createDataFrame(
        [("a,b", "2024-01-02 03:04:05.678"), (" ,b", "2024-01-02"), ("solo", "2024-13-02 03:04:05.678")],
        "k STRING, t STRING",
    )
    got = df.select(camera_token(F.col("k")).alias("k"), event_time(F.col("t")).cast("string").alias("t")).collect()
    assert [r.k for r in got] == ["a", " ,b", "solo"]
    assert [r.t for r in got] == ["2024-01-02 03:04:05.678", None, None]


def test_expiry_days_round_up(spark):
    df = spark.createDataFrame([(0,), (1,), (24,), (25,)], "h INT")
    assert [r[0] for r in df.select(expiry_days(F.col("h"))).collect()] == [0, 1, 1, 2]


def test_groups_are_nested_in_the_parts_a_caller_gives(spark):
    boxes = spark.range(25).select(
        F.lit(1).alias("frame_id"), F.lit(2).alias("zone_id"), F.col("id").cast("int").alias("x1"),
        F.lit(0).alias("y1"), F.lit(50).alias("x2"), F.lit(9).alias("y2"),
    )
    assert D.motion_result_json(boxes).count() == 1
    results = D.motion_result_json(boxes, part=F.floor(F.col("x1") / 10))
    assert sorted(r.part for r in results.collect()) == [0, 1, 2]
    assert D.parse_motion_result(results).count() == 25
