"""Zone configurations, boxes and the match of objects to motion and zones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.functions.boxes import (
    DETECT_HEIGHT,
    DETECT_WIDTH,
    area_percent,
    corners,
    idiv,
    intersection_area,
    let,
    parse_pos,
)
from framewell.operators.kernels import merge_rects
from framewell.ordered import nest

# Limits of a configuration, of an event and of the object matches.
MAX_ZONES = 3
MIN_MOTION_AREA = DETECT_WIDTH * DETECT_HEIGHT * 0.08 * 0.08
OBJECT_MOTION_PCT = 50
OBJECT_ZONE_PCT = 20
CONFIRM_SCORE = 0.6
# Object names and codes; any other name is 0.
OBJECT_TYPES = [("person", 1), ("dog", 2), ("car", 3)]
# Drawing order, name and colour of the layers over a picture.
LAYERS = {
    "zone": (1, "green"),
    "motion": (2, "yellow"),
    "object": (3, "red"),
    "result": (4, "blue"),
}

CONFIG_SCHEMA = "sensitivity DOUBLE, dataList ARRAY<MAP<STRING,STRING>>"


def parse_motion_config(df: DataFrame, json_col: str = "config_json") -> DataFrame:
    """Add sensitivity, zones (zone_no, id, x, y, w, h), reason of a refusal or null, valid and incomplete.

    A refused configuration has no zones at all. A zone without id or pos ends the zone list but is no refusal.
    """
    def zone(m: Column, i: Column) -> Column:
        number = F.coalesce(m["id"].try_cast("double").cast("int"), F.lit(0))
        return let(
            parse_pos(m["pos"]),
            lambda p: F.struct(
                (i + 1).cast("int").alias("zone_no"), number.alias("id"), *[p[c].alias(c) for c in "xywh"]
            ),
        )

    def checked(c: Column) -> Column:
        items, level = c["dataList"], c["sensitivity"].cast("int")
        reason = (
            F.when(F.try_parse_json(json_col).isNull(), "bad_json")
            .when(~F.coalesce(level > 0, F.lit(False)), "bad_sensitivity")
            .when(items.isNull(), "bad_data_list")
            .when(F.size(items) > MAX_ZONES, "too_many_zones")
            .when(F.exists(items, lambda m: F.coalesce(F.size(m), F.lit(0)) < 2), "bad_zone")
        )
        gap = F.array_position(F.transform(items, lambda m: m["id"].isNull() | m["pos"].isNull()), True)
        return F.struct(level.alias("level"), items.alias("items"), reason.alias("reason"), gap.alias("gap"))

    def result(c: Column) -> Column:
        valid, gap = c["reason"].isNull(), c["gap"]
        whole = F.when(gap > 0, F.slice(c["items"], F.lit(1), (gap - 1).cast("int"))).otherwise(c["items"])
        return F.struct(
            c["level"].alias("sensitivity"),
            c["reason"].alias("reason"),
            valid.alias("valid"),
            F.when(valid, F.size(c["items"])).alias("n_zones"),
            (valid & (gap > 0)).alias("incomplete"),
            F.when(valid, F.transform(whole, zone)).alias("zones"),
        )

    parsed = let(let(F.from_json(json_col, CONFIG_SCHEMA), checked), result)
    return df.withColumn("_r", parsed).select(*df.columns, "_r.*")


def explode_zones(df: DataFrame, zones: str = "zones") -> DataFrame:
    """One row per zone with columns zone_no, zone_id, x, y, w, h."""
    # an outer explode, since a plain one also tests the list's size below every step that made the list
    rows = df.withColumn("_z", F.explode_outer(zones)).drop(zones).filter(F.col("_z").isNotNull())
    parts = {"zone_no": F.col("_z.zone_no"), "zone_id": F.col("_z.id"), **{c: F.col(f"_z.{c}") for c in "xywh"}}
    return rows.withColumns(parts).drop("_z")


def _reaches_over(p: Column, q: Column) -> Column:
    """The upper, right and lower edge of p lie beyond those of q."""
    return (p["y"] < q["y"]) & (p["x"] + p["w"] > q["x"] + q["w"]) & (p["y"] + p["h"] > q["y"] + q["h"])


def prune_nested_zones(df: DataFrame, zones: str = "zones", n_zones: str = "n_zones") -> DataFrame:
    """Drop nested zones from each row's list (zone_no, id, x, y, w, h) of at most three.

    Of two zones the one strictly around the other goes. Of three, ordered by x, a zone inside an earlier one goes;
    the second is held against the third only while none has gone. Zones of equal id count as one, the last given.
    ``n_zones`` says how many the configuration names; those it does not describe have no place and no size. Null lists
    stay null. Each row is worked on by itself.
    """
    number = F.coalesce(F.col(n_zones), F.size(zones)) if n_zones in df.columns else F.size(zones)

    def last_of_id(z: Column) -> Column:
        last = F.element_at(F.filter(zones, lambda o: o["id"].eqNullSafe(z["id"])), -1)
        place = [last[c].alias(c) for c in "ywh"]
        return F.struct(last["x"].alias("x"), z["zone_no"].alias("zone_no"), z["id"].alias("id"), *place)

    blank = F.struct(
        F.lit(0).alias("x"),
        F.lit(1 << 20).alias("zone_no"),
        F.lit(None).cast("int").alias("id"),
        *[F.lit(0).alias(c) for c in "ywh"],
    )
    named = F.transform(zones, last_of_id)
    missing = F.greatest(number - F.size(zones), F.lit(0)).cast("int")
    rows = df.withColumn("_s", F.sort_array(F.concat(named, F.array_repeat(blank, missing))))
    at = [F.get("_s", F.lit(i)) for i in range(3)]
    pair = {(i, j): F.coalesce(_reaches_over(at[i], at[j]), F.lit(False)) for i, j in ((0, 1), (0, 2), (1, 2), (1, 0))}
    two = F.size("_s") == 2
    three = F.size("_s") == 3
    gone = [
        two & pair[0, 1] & (at[0]["x"] < at[1]["x"]),
        (two & pair[1, 0] & (at[1]["x"] < at[0]["x"])) | (three & pair[0, 1]),
        three & (pair[0, 2] | (pair[1, 2] & ~pair[0, 1])),
    ]
    gone_ids = F.transform(
        F.filter(F.array(*[F.struct(g.alias("g"), z["id"].alias("id")) for g, z in zip(gone, at)]), lambda m: m["g"]),
        lambda m: m["id"],
    )
    kind = df.schema[zones].dataType.elementType
    rows = rows.withColumn("_gone", gone_ids).withColumn(
        "_s", F.filter("_s", lambda z: z["zone_no"] < (1 << 20))
    )
    kept = F.filter(
        "_s",
        lambda z: ~F.exists("_gone", lambda i: i.eqNullSafe(z["id"]))
        & ~F.exists("_s", lambda o: o["id"].eqNullSafe(z["id"]) & (o["zone_no"] < z["zone_no"])),
    )
    listed = F.transform(kept, lambda z: F.struct(*[z[f.name].cast(f.dataType).alias(f.name) for f in kind.fields]))
    return rows.withColumn(zones, F.sort_array(listed)).drop("_s", "_gone")


def clip_zones(df: DataFrame) -> DataFrame:
    """Zones with a size, cut at the right and lower edge of the picture."""
    sized = df.filter((F.col("w") > 0) & (F.col("h") > 0))
    return sized.withColumns({"w": F.least(F.col("w"), 100 - F.col("x")), "h": F.least(F.col("h"), 100 - F.col("y"))})


def zones_to_pixels(df: DataFrame, width: int = DETECT_WIDTH, height: int = DETECT_HEIGHT) -> DataFrame:
    size = {"x": width, "y": height, "w": width, "h": height}
    return df.withColumns({c: idiv(F.col(c) * s, 100).cast("int") for c, s in size.items()})


def boxes_pct_to_pixels(df: DataFrame, width: int = DETECT_WIDTH, height: int = DETECT_HEIGHT) -> DataFrame:
    size = {"x1": width, "y1": height, "x2": width, "y2": height}
    return df.withColumns({c: idiv(F.col(c) * s, 100).cast("int") for c, s in size.items()})


def boxes_pixels_to_pct(df: DataFrame, width: int = DETECT_WIDTH, height: int = DETECT_HEIGHT) -> DataFrame:
    """Pixel rectangles x, y, w, h to percent corners."""
    return df.withColumns(
        {
            "x1": idiv(F.col("x") * 100, width).cast("int"),
            "y1": idiv(F.col("y") * 100, height).cast("int"),
            "x2": idiv((F.col("x") + F.col("w")) * 100, width).cast("int"),
            "y2": idiv((F.col("y") + F.col("h")) * 100, height).cast("int"),
        }
    )


def xywh_to_corners(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h")}
    )


def merge_boxes(df: DataFrame, key: str = "frame_id") -> DataFrame:
    """Join touching boxes of each frame: from left to right, a box takes in every later box it touches.

    The order matters, so a frame is one group. Equal boxes merge into one in any case; dropping the copies first
    keeps a group as small as the number of different boxes a picture can hold.
    """
    per_frame = df.groupBy(key).agg(F.collect_set(F.array("x1", "y1", "x2", "y2")).alias("_b"))

    @F.pandas_udf("array<array<int>>")
    def merged(lists: pd.Series) -> pd.Series:
        return lists.map(lambda boxes: merge_rects(sorted([int(v) for v in b] for b in boxes)))

    rows = per_frame.select(key, F.explode(merged("_b")).alias("_m"))
    return rows.select(key, *[F.get("_m", i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def motion_area(df: DataFrame, key: str = "frame_id") -> DataFrame:
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return df.groupBy(key).agg(F.sum(area).cast("long").alias("area"))


def motion_area_gate(df: DataFrame, key: str = "frame_id", min_area: float = MIN_MOTION_AREA) -> DataFrame:
    """Frames whose pixel boxes of all zones together cover at least ``min_area``."""
    return motion_area(df, key).filter(F.col("area") >= min_area)


def match_objects_to_motion(
    objects: DataFrame, boxes: DataFrame, pct: float = OBJECT_MOTION_PCT, key: str = "frame_id"
) -> DataFrame:
    """Objects that share at least ``pct`` percent of themselves, or of a motion box of their frame, with that box.

    A semi join: it stops at the first box that fits and emits no pairs. Copies of a box are dropped beforehand.
    """
    b = boxes.select(F.col(key).alias("_k"), *[F.col(c).alias("b" + c) for c in ("x1", "y1", "x2", "y2")]).distinct()
    shared = intersection_area(corners(), corners("b"))
    enough = (area_percent(corners(), shared) >= pct) | (area_percent(corners("b"), shared) >= pct)
    return objects.join(b, (F.col(key) == F.col("_k")) & (shared > 0) & enough, "left_semi")


def match_objects_to_zones(
    objects: DataFrame, zones: DataFrame, pct: float = OBJECT_ZONE_PCT, key: str = "token"
) -> DataFrame:
    """Objects with each zone of their camera that holds at least ``pct`` percent of them.

    A camera has at most three zones, so the join grows an object at most threefold.
    """
    z = zones.select(
        F.col(key).alias("_k"),
        "zone_id",
        F.col("x").alias("zx1"),
        F.col("y").alias("zy1"),
        (F.col("x") + F.col("w")).alias("zx2"),
        (F.col("y") + F.col("h")).alias("zy2"),
    )
    shared = intersection_area(corners(), corners("z"))
    held = area_percent(corners(), shared) >= pct
    return objects.join(z, (F.col(key) == F.col("_k")) & (shared > 0) & held).drop("_k", "zx1", "zy1", "zx2", "zy2")


def confirm_score(objects: DataFrame, score: float = CONFIRM_SCORE) -> DataFrame:
    return objects.filter(F.col("score") > score)


def object_type_code(df: DataFrame, name: str = "type_name") -> DataFrame:
    """Add the code of a trimmed type name; names are matched exactly and an unknown one is 0."""
    code = F.lit(0)
    for text, number in OBJECT_TYPES:
        code = F.when(F.trim(name) == text, number).otherwise(code)
    return df.withColumn("type_code", code.cast("int"))


def objects_by_zone(matches: DataFrame, event: str = "frame_id", part: Column | None = None) -> DataFrame:
    """Objects of each (event, zone), ordered by object number, as one array: what one picture shows. ``part`` cuts events
    that span many pictures."""
    item = F.struct("object_no", "type_code", "score", "x1", "y1", "x2", "y2")
    return nest(matches, [event, "zone_id"], ["object_no"], item, "objects", part)


def annotation_layers(zones: DataFrame, boxes: DataFrame, objects: DataFrame, matches: DataFrame) -> DataFrame:
    """The four layers drawn over a picture as rows in pixel corners; ``layer_order`` tells what lies on top."""
    sources = {"zone": zones, "motion": boxes, "object": objects, "result": matches}
    out = None
    for name, df in sources.items():
        place, colour = LAYERS[name]
        layer = boxes_pct_to_pixels(df.select("frame_id", "x1", "y1", "x2", "y2")).withColumns(
            {"layer_order": F.lit(place), "layer": F.lit(name), "colour": F.lit(colour)}
        )
        out = layer if out is None else out.unionByName(layer)
    return out
