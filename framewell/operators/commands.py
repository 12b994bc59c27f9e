"""Time intervals against the rows of a stream: which row enters and which leaves an interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.ordered import ordered

KEY = "stream_id"


def command_events(rows: DataFrame, intervals: DataFrame, block_rows: int | None = None) -> DataFrame:
    """``(stream_id, interval_no, flag, pts, seq)`` from rows (stream_id, pts, seq) and intervals (stream_id, interval_no,
    start, end).

    In time order, the first row with start <= pts < end enters the interval; the first row at or past its end then leaves
    it. An interval that no row falls into has no events, one that the stream ends in is not left. Rows without a time are
    passed over. Rows and the ends of intervals are ordered together once; no row meets more than one interval end.
    """
    place = F.struct("pts", "seq")
    timed = rows.filter(F.col("pts").isNotNull()).select(
        KEY, (-F.col("pts")).alias("_neg"), F.lit(0).alias("_kind"), (-F.col("seq")).alias("_nseq"), place.alias("_row"),
        F.lit(None).cast("struct<no: bigint, at_end: boolean, end: double>").alias("_mark"),
    )
    both_ends = F.array(
        F.struct(F.lit(False).alias("e"), "start"), F.struct(F.lit(True).alias("e"), F.col("end").alias("start"))
    )
    mark = {"no": F.col("interval_no").cast("long"), "at_end": F.col("_e.e"), "end": F.col("end").cast("double")}
    marks = intervals.select(KEY, "interval_no", "end", F.explode(both_ends).alias("_e")).select(
        KEY,
        (-F.col("_e.start")).alias("_neg"),
        F.lit(1).alias("_kind"),
        F.lit(0).alias("_nseq"),
        F.lit(None).cast(timed.schema["_row"].dataType).alias("_row"),
        F.struct(*[c.alias(name) for name, c in mark.items()]).alias("_mark"),
    )
    # from the last time to the first, the row seen last is the next one in time
    s = ordered(timed.unionByName(marks), [KEY], ["_neg", "_kind", "_nseq"], block_rows)
    found = s.running({"_next": ("last", F.col("_row"))}).done().filter(F.col("_mark").isNotNull())
    here = F.when(F.col("_next.pts") < F.col("_mark.end"), F.col("_next"))
    pair = found.groupBy(KEY, F.col("_mark.no").alias("interval_no")).agg(
        F.max(F.when(~F.col("_mark.at_end"), here)).alias("enter"),
        F.max(F.when(F.col("_mark.at_end"), F.col("_next"))).alias("leave"),
    )
    both = F.array(
        F.struct(F.lit("enter").alias("flag"), F.col("enter").alias("row")),
        F.struct(F.lit("leave").alias("flag"), F.when(F.col("enter").isNotNull(), F.col("leave")).alias("row")),
    )
    events = pair.select(KEY, "interval_no", F.explode(both).alias("_v")).filter(F.col("_v.row").isNotNull())
    return events.select(KEY, "interval_no", F.col("_v.flag").alias("flag"), "_v.row.pts", "_v.row.seq")
