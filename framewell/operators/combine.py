"""Combining several streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewell.ordered import join_per_key, ordered

KEY = "stream_id"
MAX_INPUTS = 64


def _numbered_union(dfs: list[DataFrame]) -> DataFrame:
    if len(dfs) > MAX_INPUTS:
        raise ValueError(f"at most {MAX_INPUTS} inputs")
    return reduce(DataFrame.unionByName, [d.withColumn("input_no", F.lit(i)) for i, d in enumerate(dfs)])


def concat_streams(dfs: list[DataFrame], duration: str | None = None) -> DataFrame:
    """Put segments one after another: later times move by the sum of the ends of the segments before.

    A stream ends at its last time plus the column ``duration`` when given, else at last * n / (n - 1) for n rows. The
    longest stream ends a segment. The offsets are one row per segment, whose number is the length of the input list.
    """
    rows = _numbered_union(dfs)
    place = F.struct("pts", "seq")
    ends = rows.groupBy("input_no", KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("pts", place).alias("last"),
        (F.max_by(F.col(duration), place) if duration else F.lit(None).cast("double")).alias("d"),
    )
    mean = F.when(F.col("n") > 1, F.col("last") * F.col("n") / (F.col("n") - 1)).otherwise(F.col("last"))
    end = F.coalesce(F.col("last") + F.col("d"), mean)
    per_segment = ends.groupBy("input_no").agg(F.max(end).alias("end"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("input_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_segment.select(
        F.col("input_no").alias("_no"), F.coalesce(F.sum("end").over(earlier), F.lit(0.0)).alias("_off")
    )
    shifted = rows.join(F.broadcast(offsets), F.col("input_no") == F.col("_no"))
    return shifted.withColumn("pts", F.col("pts") + F.col("_off")).drop("_no", "_off")


def interleave(dfs: list[DataFrame], block_rows: int | None = None) -> DataFrame:
    """Merge by time, the lower input first on equal times, numbered by ``n`` per stream; rows without time go."""
    rows = _numbered_union(dfs).filter(F.col("pts").isNotNull())
    return ordered(rows, [KEY], ["pts", "input_no", "seq"], block_rows).index("n").done()


def sync_join(
    main: DataFrame,
    second: DataFrame,
    repeat_last: bool = True,
    shortest: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Each row of ``main`` with the latest row of ``second`` at or before it, as structs ``main`` and ``second``.

    Before the first second row there is none. After the last one it stays, or there is none without ``repeat_last``.
    After the end of main its last row is repeated for each later second row, unless ``shortest`` is set or
    ``repeat_last`` is not. ``shortest`` ends the output with the stream that ends first.
    """

    def side(df: DataFrame, number: int, name: str, other: str, other_type: str) -> DataFrame:
        row = F.struct(*[F.col(c) for c in df.columns])
        return df.select(
            KEY, "pts", "seq", F.lit(number).alias("_side"), row.alias(name), F.lit(None).cast(other_type).alias(other)
        )

    main_type, second_type = (d.schema.simpleString() for d in (main, second))
    rows = side(second, 0, "_second", "_main", main_type).unionByName(side(main, 1, "_main", "_second", second_type))
    s = ordered(rows, [KEY], ["pts", "_side", "seq"], block_rows)
    s = s.running({"second": ("last", F.col("_second")), "main": ("last", F.col("_main"))})
    s = s.totals({"_end_main": F.max(F.when(F.col("_side") == 1, F.col("pts"))), "_end_second": F.max(
        F.when(F.col("_side") == 0, F.col("pts")))})
    is_main, after = F.col("_side") == 1, F.col("pts") > F.col("_end_main")
    over = F.coalesce(F.col("pts") > F.col("_end_second"), F.lit(False))
    out = s.done()
    if shortest:
        out = out.filter(is_main & ~over)
    elif not repeat_last:
        out = out.filter(is_main).withColumn("second", F.when(~over, F.col("second")))
    else:
        out = out.filter(is_main | after)
    return out.select(KEY, "pts", "main", "second")


def mix_streams(
    dfs: list[DataFrame],
    duration: str = "longest",
    transition: float = 2.0,
    rate: float = 1.0,
    block_rows: int | None = None,
) -> DataFrame:
    """Sum the inputs sample by sample, each scaled by one over a norm: the number of inputs still running.

    When an input ends, the norm falls to the new number over ``transition`` seconds. The output ends with the longest,
    the shortest or the first input.
    """
    placed = [
        ordered(d.select(KEY, "pts", "seq", "value"), [KEY], ["pts", "seq"], block_rows).index("n").done() for d in dfs
    ]
    rows = _numbered_union(placed)
    summed = rows.groupBy(KEY, "n").agg(F.sum("value").alias("_sum"))
    counts = rows.groupBy(KEY, "input_no").agg((F.max("n") + 1).alias("_len"))
    ends = counts.groupBy(KEY).agg(
        F.sort_array(F.collect_list("_len")).alias("_ends"),
        F.max(F.when(F.col("input_no") == 0, F.col("_len"))).alias("_first_len"),
        F.count(F.lit(1)).alias("_k"),
    )
    both = join_per_key(summed, ends, [KEY], "n")
    fall = 1.0 / (transition * rate) if transition > 0 else float("inf")
    n = F.col("n")
    # the level with m inputs lasts up to the end of the next one and falls from there
    levels = F.transform(
        "_ends",
        lambda e, i: F.when(n < e, (F.col("_k") - i).cast("double")).otherwise(
            F.col("_k") - i - (n - e + 1) * F.lit(fall)
        ),
    )
    stop = {"longest": F.array_max("_ends"), "shortest": F.array_min("_ends"), "first": F.col("_first_len")}[duration]
    if duration == "shortest":
        stop = F.when(F.col("_k") == len(dfs), stop).otherwise(0)
    out = both.filter(n < stop)
    return out.select(KEY, "n", (F.col("_sum") / F.array_max(levels)).alias("value"))


def tee(df: DataFrame, n: int) -> DataFrame:
    """Each row once per output, told apart by ``out_no``; one pass, nothing is stored."""
    return df.withColumn("out_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def tee_batches(writers: list[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands each micro-batch, read once, to several writers."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for w in writers:
                w(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def channel_mix(df: DataFrame, matrix: dict[int, dict[int, float]], position: str = "n") -> DataFrame:
    """Output channels as weighted sums of the input channels at the same position of a stream.

    The weights are a parameter of at most 64 x 64 entries and become part of the expression, without a join.
    """
    if len(matrix) > MAX_INPUTS or any(len(row) > MAX_INPUTS for row in matrix.values()):
        raise ValueError(f"at most {MAX_INPUTS} channels")

    def weighted(row: dict[int, float]) -> Column:
        value = F.lit(None).cast("double")
        for channel, weight in row.items():
            value = F.when(F.col("channel") == channel, F.col("value") * weight).otherwise(value)
        return F.coalesce(F.sum(value), F.lit(0.0))

    outs = sorted(matrix)
    sums = df.groupBy(KEY, position).agg(*[weighted(matrix[o]).alias(f"_o{o}") for o in outs])
    pairs = F.array(*[F.struct(F.lit(o).alias("out_channel"), F.col(f"_o{o}").alias("value")) for o in outs])
    return sums.withColumn("_p", F.explode(pairs)).select(KEY, position, "_p.out_channel", "_p.value")
