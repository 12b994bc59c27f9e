"""Motion detection over frame streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from framewell.functions.boxes import DETECT_HEIGHT, DETECT_WIDTH, idiv, let
from framewell.operators.geometry import MIN_MOTION_AREA, boxes_pixels_to_pct, clip_zones, explode_zones
from framewell.operators.geometry import prune_nested_zones, zones_to_pixels
from framewell.operators.kernels import DIFF_THRESHOLD, ZoneDetector, contour_boxes, crop, merge_rects, rescale
from framewell.ordered import ordered
from framewell.sequential import Step, in_order

# Divisor of the picture area per named sensitivity, and the zone number of a whole picture.
SENSITIVITY_LEVELS = {"high": 1000, "normal": 200, "low": 30}
WHOLE_PICTURE = -1
#: Zones up to which their table is broadcast and numbered, and the column of the number.
FEW_STREAMS = 65_536
STREAM = "_stream"
#: Pictures that a task unpacks, and masks that it holds, at a time.
MOST_PICTURES = 100
RESULT_SCHEMA = "motion ARRAY<STRUCT<zone_id: INT, boxs: ARRAY<ARRAY<INT>>>>"
BOX_SCHEMA = "token STRING, zone_id INT, frame_no BIGINT, x INT, y INT, w INT, h INT"


def sample_base_frames(df: DataFrame, cap: int = 2, key: str = "packet_id") -> DataFrame:
    """The first ``cap`` key or base frames of each packet, numbered by ``frame_index``.

    Each shuffle partition first keeps its own first rows of a packet, so a huge packet never meets in one task whole.
    """
    chosen = df.filter(F.col("is_key") | F.col("is_base")).withColumn("_salt", F.pmod(F.hash("seq"), F.lit(64)))
    return _first_rows(chosen, key, cap)


def _first_rows(df: DataFrame, key: str, cap: int) -> DataFrame:
    some = df.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_salt").orderBy("seq")))
    few = some.filter(F.col("_r") <= cap).drop("_r", "_salt")
    place = F.row_number().over(Window.partitionBy(key).orderBy("seq")) - 1
    return few.withColumn("frame_index", place).filter(F.col("frame_index") < cap)


def split_planes(df: DataFrame, packed: str = "yuv") -> DataFrame:
    """Cut packed bytes into a luma plane and two chroma planes of a quarter of its size."""
    size = F.col("width") * F.col("height")
    quarter = idiv(size, 4).cast("int")
    data = F.col(packed)
    return df.withColumns(
        {
            "y": F.substring(data, F.lit(1), size),
            "u": F.substring(data, size + 1, quarter),
            "v": F.substring(data, size + quarter + 1, quarter),
        }
    )


def _picture(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8, count=width * height).reshape(height, width)


def rescale_luma(
    df: DataFrame, width: int = DETECT_WIDTH, height: int = DETECT_HEIGHT, method: str = "linear"
) -> DataFrame:
    """Resize the luma plane of each row whose size differs, in one pass; rows without picture or size stay as they are."""

    def resize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = pdf[["luma", "width", "height"]].notna().all(axis=1)
            other = known & ((pdf["width"] != width) | (pdf["height"] != height))
            if other.any():
                rows = pdf[other]
                pdf.loc[other, "luma"] = [
                    rescale(_picture(d, int(w), int(h)), width, height, method).tobytes()
                    for d, w, h in zip(rows["luma"], rows["width"], rows["height"])
                ]
                pdf.loc[other, ["width", "height"]] = [width, height]
            yield pdf

    return df.mapInPandas(resize, df.schema)


def crop_zone(df: DataFrame) -> DataFrame:
    """Cut the pixel rectangle x, y, w, h out of each row's luma; a bad rectangle leaves the whole picture."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [
                crop(_picture(d, fw, fh), x, y, w, h)
                for d, fw, fh, x, y, w, h in zip(*(pdf[c] for c in ("luma", "width", "height", "x", "y", "w", "h")))
            ]
            pdf["luma"] = [p.tobytes() for p in parts]
            pdf["width"] = [p.shape[1] for p in parts]
            pdf["height"] = [p.shape[0] for p in parts]
            yield pdf

    return df.mapInPandas(cut, df.schema)


def _difference(now: Column, before: Column, threshold: int) -> Column:
    return F.zip_with(now, before, lambda a, b: F.when(F.abs(a - b) > threshold, 255).otherwise(0))


def frame_difference(df: DataFrame, threshold: int = DIFF_THRESHOLD, block_rows: int | None = None) -> DataFrame:
    """Mask (0 or 255) of pixels that changed by more than the threshold since the previous frame of the stream."""
    s = ordered(df, ["stream_id"], ["pts", "seq"], block_rows).shift({"_prev": F.col("luma")})
    rows = s.done().filter(F.col("_prev").isNotNull())
    return rows.withColumn("diff_mask", _difference(F.col("luma"), F.col("_prev"), threshold)).drop("_prev")


def motion_mask(df: DataFrame, width: int, height: int, fg: str = "fg_mask", diff: str = "diff_mask") -> DataFrame:
    """Foreground that also changed, spread by one pixel in all directions, on row-major masks of 0 and 255."""
    both = F.zip_with(fg, diff, lambda a, b: a.bitwiseAND(b))
    cells = F.sequence(F.lit(0), F.lit(width * height - 1))

    def spread(mask: Column, i: Column) -> Column:
        x, y = i % width, F.floor(i / width)
        around = []
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                inside = (x + dx >= 0) & (x + dx < width) & (y + dy >= 0) & (y + dy < height)
                around.append(F.when(inside, F.get(mask, (i + dy * width + dx).cast("int"))).otherwise(0))
        return F.greatest(*around)

    return df.withColumn("motion_mask", let(both, lambda mask: F.transform(cells, lambda i: spread(mask, i))))


def background_mask(df: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Changed-foreground masks per (token, zone_id) in frame order; the frame that starts a model gives none.

    Needs token, zone_id, frame_no, x, y, w, h, width, height and luma, all of the zone's own region. ``changed_pixels``
    counts the pixels of a mask that are set.
    """

    def step(pdf: pd.DataFrame, state: bytes) -> tuple[pd.DataFrame, bytes]:
        zone, out = ZoneDetector(state), []
        for r in pdf.itertuples(index=False):
            mask = _zone_mask(zone, r)
            if mask is not None:
                out.append((r.token, r.zone_id, r.frame_no, (mask * np.uint8(255)).tobytes(), np.count_nonzero(mask)))
        return pd.DataFrame(out, columns=["token", "zone_id", "frame_no", "mask", "changed_pixels"]), zone.dump()

    schema = "token STRING, zone_id INT, frame_no BIGINT, mask BINARY, changed_pixels BIGINT"
    return _by_zone(df, step, schema)


def _by_zone(regions: DataFrame, step: Step, schema: str) -> DataFrame:
    deal = STREAM if STREAM in regions.columns else None
    return in_order(regions, ["token", "zone_id"], ["frame_no"], step, schema, deal=deal, most=MOST_PICTURES)


def _packed(data: bytes) -> bytes:
    """A picture for the shuffle: LZ4 where that is shorter, so shorter than the picture's size means packed."""
    short = pa.compress(data, "lz4_raw", asbytes=True)
    return short if len(short) < len(data) else data


def _unpacked(data: bytes, size: int) -> bytes:
    return data if len(data) >= size else pa.decompress(data, size, "lz4_raw", asbytes=True)


def _zone_mask(zone: ZoneDetector, r) -> np.ndarray | None:
    roi = _picture(_unpacked(r.luma, r.width * r.height), r.width, r.height)
    return zone.masks(roi, (r.x, r.y, r.w, r.h), r.token, int(r.zone_id), int(r.frame_no))


def _zone_boxes(zone: ZoneDetector, pdf: pd.DataFrame) -> pd.DataFrame:
    """Merged pixel boxes of the frames of one zone, in frame order."""
    out = []
    for r in pdf.itertuples(index=False):
        mask = _zone_mask(zone, r)
        if mask is None:
            continue
        limit = DETECT_WIDTH * DETECT_HEIGHT // int(r.sensitivity)
        rects = sorted(contour_boxes(mask, limit, int(r.x), int(r.y)), key=lambda b: b[:2])
        out += [
            (r.token, r.zone_id, r.frame_no, x1, y1, x2 - x1, y2 - y1) for x1, y1, x2, y2 in merge_rects(rects)
        ]
    return pd.DataFrame(out, columns=["token", "zone_id", "frame_no", "x", "y", "w", "h"])


def watched_zones(config: DataFrame) -> DataFrame:
    """Pixel rectangles to watch per camera, from one row per token: sensitivity, zones and n_zones (as parsed).

    Nested zones are dropped and zones clipped. A configuration that names no zones watches the whole picture as zone -1;
    one that names zones without describing them watches nothing there.
    """
    number = F.col("n_zones") if "n_zones" in config.columns else F.size("zones")
    rows = config.select("token", "sensitivity", "zones", number.alias("n_zones"))
    listed = clip_zones(explode_zones(prune_nested_zones(rows)))
    pixels = zones_to_pixels(listed).select("token", "sensitivity", "zone_id", *"xywh")
    whole = rows.filter(F.col("n_zones") == 0).select(
        "token",
        "sensitivity",
        F.lit(WHOLE_PICTURE).alias("zone_id"),
        F.lit(0).alias("x"),
        F.lit(0).alias("y"),
        F.lit(DETECT_WIDTH).alias("w"),
        F.lit(DETECT_HEIGHT).alias("h"),
    )
    return pixels.unionByName(whole)


def _watch(frames: DataFrame, watched: DataFrame) -> DataFrame:
    """Frames with the list ``_zones`` of their camera's zones. The table of zones is counted first: up to :data:`FEW_STREAMS`
    it is broadcast, so that no picture moves for it, and its zones are numbered, the largest first, to be dealt evenly."""
    few = watched.limit(FEW_STREAMS + 1).count() <= FEW_STREAMS
    if few:
        size = F.max(F.col("w") * F.col("h")).over(Window.partitionBy("token", "zone_id"))
        place = F.dense_rank().over(Window.orderBy(F.desc("_size"), "token", "zone_id"))
        numbered = watched.withColumn("_size", size).withColumn(STREAM, place)
    else:
        numbered = watched.withColumn(STREAM, F.hash("token", "zone_id"))
    parts = F.struct("sensitivity", "zone_id", *"xywh", STREAM)
    zones = numbered.groupBy(F.col("token").alias("_t")).agg(F.collect_list(parts).alias("_zones"))
    return frames.join(F.broadcast(zones) if few else zones, frames["token"] == F.col("_t")).drop("_t")


def zone_regions(frames: DataFrame, watched: DataFrame, packed: bool = False) -> DataFrame:
    """One row per frame and watched zone with the zone's part of the 640x360 picture; at most three per frame.

    Pictures are resized and cut in one pass. ``packed`` compresses the parts, which all steps on regions here can read.
    """
    watching = _watch(frames, watched)
    kinds = watching.schema["_zones"].dataType.elementType
    schema = StructType([f for f in watching.schema if f.name != "_zones"] + list(kinds))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            frame, zones = pc.list_parent_indices(rows["_zones"]), rows["_zones"].flatten()
            rects = [zones.field(c).to_numpy() for c in "xywh"]
            sizes = rows["width"].to_numpy(), rows["height"].to_numpy()
            last, parts = None, []
            for i, *rect in zip(frame.to_pylist(), *rects):
                if i != last:
                    picture = _picture(rows["luma"][i].as_buffer(), *(int(v[i]) for v in sizes))
                    picture, last = rescale(picture, DETECT_WIDTH, DETECT_HEIGHT), i
                parts.append(crop(picture, *rect))
            made = {
                "luma": [_packed(p.tobytes()) if packed else p.tobytes() for p in parts],
                "width": [p.shape[1] for p in parts],
                "height": [p.shape[0] for p in parts],
            }
            out = {}
            for f in rows.schema:
                if f.name != "_zones":
                    out[f.name] = pa.array(made[f.name], f.type) if f.name in made else rows[f.name].take(frame)
            yield pa.RecordBatch.from_pydict(out | {c: zones.field(c) for c in kinds.names})

    return watching.mapInArrow(cut, schema)


def zone_motion_boxes(regions: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Merged motion boxes in pixels per (token, zone_id, frame_no): one shuffle by (token, zone_id)."""

    def step(pdf: pd.DataFrame, state: bytes) -> tuple[pd.DataFrame, bytes]:
        zone = ZoneDetector(state)
        return _zone_boxes(zone, pdf), zone.dump()

    return _by_zone(regions, step, BOX_SCHEMA)


def report_motion(boxes: DataFrame) -> DataFrame:
    """Percent boxes of the frames whose boxes together are large enough to count as motion.

    The boxes of a frame do not touch each other within a zone, so a frame holds no more than its picture has room for.
    """
    frame = Window.partitionBy("token", "frame_no")
    sized = boxes.withColumn("_area", F.sum(F.col("w") * F.col("h")).over(frame))
    kept = sized.filter(F.col("_area") >= MIN_MOTION_AREA)
    return boxes_pixels_to_pct(kept).select("token", "frame_no", "zone_id", "x1", "y1", "x2", "y2")


def detect_motion(frames: DataFrame, config: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Motion boxes in percent corners of each frame (token, frame_no, width, height, luma) with motion."""
    watched = watched_zones(config)
    return report_motion(zone_motion_boxes(zone_regions(frames, watched, packed=True), block_rows))


class _ZoneProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("zone", "model BINARY")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._state.get() if self._state.exists() else None
        zone = ZoneDetector(bytes(held[0]) if held else None)
        # one camera zone of one micro-batch, whose size the source's rate limit sets
        pdf = pd.concat(list(rows)).sort_values("frame_no")
        out = _zone_boxes(zone, pdf)
        self._state.update((zone.dump(),))
        yield out

    def close(self) -> None:
        pass


def stream_motion_boxes(regions: DataFrame) -> DataFrame:
    """``zone_motion_boxes`` on a stream, with the model of each (token, zone_id) in the state store."""
    return regions.groupBy("token", "zone_id").transformWithStateInPandas(
        _ZoneProcessor(), outputStructType=BOX_SCHEMA, outputMode="Append", timeMode="None"
    )


def motion_result_json(
    boxes: DataFrame, key: str = "frame_id", frames: DataFrame | None = None, part: Column | None = None
) -> DataFrame:
    """One JSON result per frame from percent corner rows: zones in ascending id, each with its boxes.

    ``frames`` names the frames that were looked at; those without boxes have an empty result. The boxes of a frame are
    bounded by what its picture has room for; ``part`` cuts keys that stand for many pictures.
    """
    rows = boxes if part is None else boxes.withColumn("part", part)
    by = [key] if part is None else [key, "part"]
    per_zone = rows.groupBy(*by, "zone_id").agg(F.sort_array(F.collect_list(F.array("x1", "y1", "x2", "y2"))).alias("boxs"))
    per_frame = per_zone.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("zone_id", "boxs"))).alias("motion"))
    results = per_frame.select(*by, F.to_json(F.struct("motion")).alias("result"))
    if frames is None:
        return results
    looked = frames.select(key).distinct().join(results, key, "left")
    return looked.withColumn("result", F.coalesce("result", empty_result()))


def empty_result() -> Column:
    """The JSON of a frame without motion."""
    return F.lit('{"motion":[]}')


def parse_motion_result(df: DataFrame, col: str = "result") -> DataFrame:
    """JSON results back to one row per box; empty text and unreadable results give no rows."""
    zones = df.withColumn("_z", F.explode(F.from_json(col, RESULT_SCHEMA)["motion"])).drop(col)
    rows = zones.withColumns({"zone_id": F.col("_z.zone_id"), "_b": F.explode("_z.boxs")}).drop("_z")
    return rows.withColumns({c: F.get("_b", i) for i, c in enumerate(("x1", "y1", "x2", "y2"))}).drop("_b")


def keep_results(df: DataFrame, key: str = "packet_id", block_rows: int | None = None) -> DataFrame:
    """Rows with a result, numbered from 0 per packet; packets without any disappear."""
    usable = df.filter(F.col("result").isNotNull() & (F.col("result") != ""))
    return ordered(usable, [key], ["seq"], block_rows).index("frame_index").done()


def sensitivity_level(df: DataFrame, level: str = "level") -> DataFrame:
    """Add the divisor of a named level, null for an unknown name."""
    value = F.lit(None)
    for name, divisor in SENSITIVITY_LEVELS.items():
        value = F.when(F.col(level) == name, divisor).otherwise(value)
    return df.withColumn("sensitivity", value.cast("int"))
