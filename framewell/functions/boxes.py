"""Integer box arithmetic and zone text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size of the picture that detection works on.
DETECT_WIDTH, DETECT_HEIGHT = 640, 360

Corners = tuple[Column, Column, Column, Column]


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division that cuts towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def corners(prefix: str = "") -> Corners:
    return tuple(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2"))


def intersection_area(a: Corners, b: Corners) -> Column:
    """Area two boxes share, 0 unless they overlap in both directions and all corners are given."""
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    known = F.lit(True)
    for c in (*a, *b):
        known = known & c.isNotNull()
    return F.when(known & (wide > 0) & (high > 0), wide * high).otherwise(0)


def area_percent(box: Corners, area: Column) -> Column:
    """Area as percent of a box, 0 for a box without all corners and null for an empty one."""
    known = box[0].isNotNull() & box[1].isNotNull() & box[2].isNotNull() & box[3].isNotNull()
    size = ((box[2] - box[0]) * (box[3] - box[1])).cast("double")
    return F.when(~known, F.lit(0.0)).when(size != 0, area / size * 100)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once, however often the expression uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_pos(pos: Column) -> Column:
    """"x,y,w,h" text to a struct; only the first 15 characters count and missing or unreadable parts are 0."""
    numbers = F.transform(
        F.split(F.substring(pos, 1, 15), ","),
        lambda part: F.regexp_extract(part, r"^\s*([+-]?\d+)", 1).try_cast("int"),
    )
    return let(numbers, lambda n: F.struct(*[F.coalesce(F.get(n, i), F.lit(0)).alias(c) for i, c in enumerate("xywh")]))
