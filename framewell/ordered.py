"""Windows over ordered streams in which one stream may hold a large part of all rows.

A plain ``Window.partitionBy(stream)`` sorts a whole stream in one task. ``ordered`` cuts long streams into blocks of
neighbouring rows: windows run inside (stream, block), one small row per block is aggregated, and what a row needs from
other blocks arrives by a join on (stream, block). The cuts are rows of the stream itself, each a place in the whole order
(time and second key), found from a sample that a hash of the row chooses; so each stream has its own cuts, rows of one
time are parted by the second key, and every branch of a plan that asks finds the same cuts. There is one plan for all
sizes and no job before the action. Streams of less than a block have no cut; their block is null and no row of them
takes part in what is carried between blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a block, about.
BLOCK_ROWS = 1 << 18
#: Samples of a block, about.
SAMPLES = 64
#: Cuts of a stream that are looked through at once.
FAN = 128
BLOCK = "_blk"


def same_keys(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of several column pairs."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


@dataclass(frozen=True)
class Ordered:
    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    block_rows: int
    #: The same rows with fewer columns and without what was carried between blocks; what is computed for each block
    #: starts here where it can, so that steps one after the other do not contain each other's plans.
    base: DataFrame

    @property
    def part(self) -> list[str]:
        return [*self.keys, BLOCK]

    def _in_base(self, cols: Iterable[Column]) -> bool:
        """Whether none of ``cols`` names a column that only came later."""
        later = set(self.df.columns) - set(self.base.columns)
        return not any(later & set(re.findall(r"\w+", str(c))) for c in cols)

    def long(self, *needed: Column) -> DataFrame:
        """The rows of the streams that are cut, with the columns that ``needed`` reads."""
        rows = self.base if self._in_base(needed) else self.df
        return rows.filter(F.col(BLOCK).isNotNull())

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def backwards(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*[F.col(c).desc() for c in self.order])

    def blocks_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(BLOCK)

    def only(self, cond: Column) -> Ordered:
        """The rows for which ``cond`` holds."""
        rows = self.df.filter(cond)
        return replace(self, df=rows, base=self.base.filter(cond) if self._in_base([cond]) else rows)

    def drop(self, *names: str) -> Ordered:
        return replace(self, df=self.df.drop(*names), base=self.base.drop(*names))

    def columns(self, cols: dict[str, Column]) -> Ordered:
        base = self.base.withColumns(cols) if self._in_base(cols.values()) else self.base.drop(*cols)
        return replace(self, df=self.df.withColumns(cols), base=base)

    def done(self, *drop: str) -> DataFrame:
        return self.df.drop(BLOCK, *drop)

    # -- values carried between blocks -------------------------------------------------------------------------

    def _carry(self, df: DataFrame, per_block: DataFrame, outs: dict[str, Column]) -> DataFrame:
        """Join what ``outs`` says of each block of the long streams to its rows; for rows of other streams it is null."""
        names = [f"_o_key{i}" for i in range(len(self.part))]
        carried = per_block.select(
            *[F.col(k).alias(n) for k, n in zip(self.part, names)], *[c.alias(n) for n, c in outs.items()]
        )
        return df.join(carried, same_keys(df, carried, list(zip(self.part, names))), "left").drop(*names)

    def index(self, name: str) -> Ordered:
        """Add the 0-based position of each row in its stream."""
        df = self.df.withColumn(name, F.row_number().over(self.window()).cast("long") - 1)
        per_block = self.long().groupBy(*self.part).agg(F.count(F.lit(1)).alias("_o_n"))
        before = F.sum("_o_n").over(self.blocks_window().rowsBetween(Window.unboundedPreceding, -1))
        df = self._carry(df, per_block, {"_o_before": before})
        return replace(self, df=df.withColumn(name, F.col(name) + F.coalesce("_o_before", F.lit(0))).drop("_o_before"))

    def running(self, specs: dict[str, tuple[str, Column]], inclusive: bool = True) -> Ordered:
        """Add running aggregates from the start of the stream up to (or just before) each row.

        A spec is (kind, column) with kind one of sum, min, max, first, last; the last two skip nulls.
        """
        rows = self.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        plain = {
            "sum": F.sum,
            "min": F.min,
            "max": F.max,
            "first": lambda c: F.first(c, ignorenulls=True),
            "last": lambda c: F.last(c, ignorenulls=True),
        }
        df = self.df.withColumns({n: plain[kind](c).over(rows) for n, (kind, c) in specs.items()})
        place = F.struct(*self.order)
        aggs, outs = [], {}
        earlier = self.blocks_window().rowsBetween(Window.unboundedPreceding, -1)
        for n, (kind, c) in specs.items():
            held = F.when(c.isNotNull(), place)
            whole = {"first": F.min_by(c, held), "last": F.max_by(c, held)}.get(kind)
            aggs.append((whole if whole is not None else plain[kind](c)).alias(f"_o_a_{n}"))
            outs[f"_o_c_{n}"] = plain[kind](F.col(f"_o_a_{n}")).over(earlier)
        df = self._carry(df, self.long(*[c for _, c in specs.values()]).groupBy(*self.part).agg(*aggs), outs)
        merged = {}
        for n, (kind, _) in specs.items():
            here, there = F.col(n), F.col(f"_o_c_{n}")
            merged[n] = {
                "sum": F.coalesce(here + there, here, there),
                "min": F.least(here, there),
                "max": F.greatest(here, there),
                "first": F.coalesce(there, here),
                "last": F.coalesce(here, there),
            }[kind]
        return replace(self, df=df.withColumns(merged).drop(*outs))

    def shift(self, cols: dict[str, Column], k: int = 1) -> Ordered:
        """Add the value of each column k rows back (k > 0) or -k rows ahead (k < 0), null beyond the ends."""
        return self.shifts({name: (c, k) for name, c in cols.items()})

    def shifts(self, cols: dict[str, tuple[Column, int]]) -> Ordered:
        """Add several columns at once, each with its own distance in the same direction."""
        back = all(k > 0 for _, k in cols.values())
        n = max(abs(k) for _, k in cols.values())
        toward, away = (self.window(), self.backwards()) if back else (self.backwards(), self.window())
        value = F.struct(*[c.alias(name) for name, (c, _) in cols.items()])
        steps = sorted({abs(k) for _, k in cols.values()})
        df = self.df.withColumns({f"_o_near{k}": F.lag(value, k).over(toward) for k in steps})
        edge = self.long(value).select(*self.part, *[c for c in self.order if c not in self.part], value.alias("_o_v"))
        edge = edge.withColumn("_o_e", F.row_number().over(away)).filter(F.col("_o_e") <= n)
        # nearest edge row first, so position p of a block needs element k - p of what lies beyond it
        per_block = edge.groupBy(*self.part).agg(F.sort_array(F.collect_list(F.struct("_o_e", "_o_v"))).alias("_o_edge"))
        beyond = Window.partitionBy(*self.keys).orderBy(F.col(BLOCK) if back else F.col(BLOCK).desc())
        lists = F.collect_list("_o_edge").over(beyond.rowsBetween(-n, -1))
        df = df.withColumn("_o_p", F.row_number().over(toward))
        df = self._carry(df, per_block, {"_o_far": F.flatten(F.reverse(lists))})
        place = F.col("_o_p")
        far = {k: F.get(F.col("_o_far"), F.lit(k) - place)["_o_v"] for k in steps}
        df = df.withColumns({f"_o_near{k}": F.when(place <= k, far[k]).otherwise(F.col(f"_o_near{k}")) for k in steps})
        df = df.withColumns({name: F.col(f"_o_near{abs(k)}")[name] for name, (_, k) in cols.items()})
        return replace(self, df=df.drop("_o_p", "_o_far", *[f"_o_near{k}" for k in steps]))

    def totals(self, aggs: dict[str, Column]) -> Ordered:
        """Add aggregates of the whole stream to each of its rows."""
        whole = Window.partitionBy(*self.part)
        df = self.df.withColumns({n: c.over(whole) for n, c in aggs.items()})
        rows = self.long(*aggs.values())
        per_key = rows.groupBy(*self.keys).agg(*[c.alias(n) for n, c in aggs.items()])
        names = [f"_o_tk{i}" for i in range(len(self.keys))]
        per_key = per_key.withColumnsRenamed(dict(zip(self.keys, names)))
        per_block = rows.select(*[F.col(c).alias(c) for c in self.part]).distinct()
        per_block = per_block.join(per_key, same_keys(per_block, per_key, list(zip(self.keys, names)))).drop(*names)
        df = self._carry(df, per_block, {f"_o_t_{n}": F.col(n) for n in aggs})
        cut = F.col(BLOCK).isNotNull()
        df = df.withColumns({n: F.when(cut, F.col(f"_o_t_{n}")).otherwise(F.col(n)) for n in aggs})
        return replace(self, df=df.drop(*[f"_o_t_{n}" for n in aggs]))

    def sliding(self, n: int, aggs: dict[str, Column]) -> Ordered:
        """Add aggregates over the last n rows, the row itself included."""
        # equal chunks by position; the last n - 1 rows of a chunk are also sent to the next one, as context only
        size = max(n, self.block_rows)
        df = self.index("_o_i").df.withColumn("_o_own", F.floor(F.col("_o_i") / size))
        lent = F.when(F.col("_o_i") % size >= size - (n - 1), F.array("_o_own", F.col("_o_own") + 1))
        df = df.withColumn("_o_chunk", F.explode(F.coalesce(lent, F.array("_o_own"))))
        rows = Window.partitionBy(*self.keys, "_o_chunk").orderBy("_o_i").rowsBetween(-(n - 1), 0)
        df = df.withColumns({name: c.over(rows) for name, c in aggs.items()})
        return replace(self, df=df.filter(F.col("_o_chunk") == F.col("_o_own")).drop("_o_i", "_o_own", "_o_chunk"))


def _cuts(rows: DataFrame, keys: list[str], order: list[str], block_rows: int) -> DataFrame:
    """One row for each long stream: its keys as ``_ck0``... and the places where blocks start, in lists of :data:`FAN`.

    A hash of keys and order chooses one row in ``block_rows / SAMPLES``; each time the samples of a block have passed, the
    next block starts. Only these places are gathered, one for about ``block_rows`` rows of the table.
    """
    per = min(SAMPLES, block_rows)
    names = [f"_ck{i}" for i in range(len(keys))]
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("_place")
    chosen = F.pmod(F.xxhash64(*keys, *order), F.lit(max(1, block_rows // per))) == 0
    sampled = rows.filter(chosen).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], place)
    nth = F.row_number().over(Window.partitionBy(*names).orderBy("_place"))
    starts = sampled.withColumn("_nth", nth).filter(F.col("_nth") % per == 0)
    lists = starts.groupBy(*names).agg(F.sort_array(F.collect_set("_place")).alias("_all"))
    heads = F.sequence(F.lit(1), F.size("_all"), F.lit(FAN))
    return lists.select(*names, F.transform(heads, lambda i: F.slice("_all", i, FAN)).alias("_cuts"))


def ordered(
    df: DataFrame, keys: list[str], order: list[str], block_rows: int | None = None, probe: DataFrame | None = None
) -> Ordered:
    """Streams of ``df`` by ``keys``, in the order of ``order`` (nulls first), long ones in blocks of about ``block_rows`` rows.

    Rows that are equal in keys and order stay in one block. ``probe`` may give the same keys and order from a cheaper place
    than ``df``. The cuts are broadcast: one place for about ``block_rows`` rows, 24 bytes for 262 144 rows as it stands.
    """
    limit = block_rows or BLOCK_ROWS
    cuts = _cuts(df if probe is None else probe, keys, order, limit)
    names = [f"_ck{i}" for i in range(len(keys))]
    marked = df.join(F.broadcast(cuts), same_keys(df, cuts, list(zip(keys, names))), "left").drop(*names)
    here = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    passed = F.size(F.filter("_cuts", lambda some: some[0] <= here))
    inside = F.size(F.filter(F.get("_cuts", passed - 1), lambda c: c <= here))
    block = F.when(F.col("_cuts").isNotNull(), F.when(passed > 0, (passed - 1) * FAN + inside).otherwise(0))
    rows = marked.withColumn(BLOCK, block).drop("_cuts")
    return Ordered(rows, tuple(keys), tuple(order), limit, rows)


def nest(df: DataFrame, keys: list[str], order: list[str], item: Column, name: str, part: Column | None = None) -> DataFrame:
    """Nest the rows of each group in order as one array; nulls in the order come first.

    One aggregation, whatever the size. ``part`` cuts groups that are too large for one array: each part is a row of its
    own with the column ``part``.
    """
    rows = df if part is None else df.withColumn("part", part)
    by = keys if part is None else [*keys, "part"]
    packed = rows.select(*by, F.struct(*order, item.alias("_item")).alias("_row"))
    lists = packed.groupBy(*by).agg(F.sort_array(F.collect_list("_row")).alias(name))
    return lists.withColumn(name, F.transform(name, lambda x: x["_item"]))


def join_per_key(df: DataFrame, per_key: DataFrame, keys: list[str], spread: str, salts: int = 32) -> DataFrame:
    """Left-join one row per key to many rows of that key, each key spread over ``salts`` parts by a hash."""
    names = [f"_j{i}" for i in range(len(keys))]
    small = per_key.withColumnsRenamed(dict(zip(keys, names)))
    small = small.withColumn("_sj", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = df.withColumn("_sd", F.pmod(F.hash(spread), F.lit(salts)))
    on = same_keys(rows, small, list(zip(keys, names))) & (rows["_sd"] == small["_sj"])
    return rows.join(small, on, "left").drop("_sd", "_sj", *names)


def explode_range(df: DataFrame, low: Column, high: Column, name: str, chunk: int = 10_000) -> DataFrame:
    """One row per whole number from low to high; long ranges unfold in two steps, so no array is long.

    Rows with high < low disappear.
    """
    rows = df.withColumns({"_lo": low.cast("long"), "_hi": high.cast("long")}).filter(F.col("_lo") <= F.col("_hi"))
    rows = explode_chunks(rows, chunk)
    last = F.least(F.col("_from") + (chunk - 1), F.col("_hi"))
    return rows.withColumn(name, F.explode(F.sequence(F.col("_from"), last))).drop("_lo", "_hi", "_from")


def explode_chunks(rows: DataFrame, chunk: int) -> DataFrame:
    wide = chunk * 10_000
    outer = F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.lit(wide).cast("long")))
    far = rows.withColumn("_wide", outer)
    stop = F.least(F.col("_wide") + (wide - 1), F.col("_hi"))
    inner = F.explode(F.sequence(F.col("_wide"), stop, F.lit(chunk).cast("long")))
    return far.withColumn("_from", inner).drop("_wide")
