"""Steps that must see a stream row by row, with a state handed on as bytes.

A stream is sorted inside its partition and fed batch by batch, so a task holds one Arrow batch and one state, whatever
the length of the stream. With ``block_rows`` long streams are cut into blocks of neighbouring rows: first the state each
block starts with is settled, then all blocks run in parallel from their own start. To settle the states every block
guesses that it starts afresh and is run again only while the state before it still changes (steps that forget their past
settle in a few rounds). The result is the one of the plain loop. A step whose state never forgets has nothing to guess
from; long histories of such a step run as a stream, with the state in the state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewell.ordered import BLOCK, Ordered, ordered, same_keys
from framewell.session import durable

Step = Callable[[pd.DataFrame, bytes], tuple[pd.DataFrame, bytes]]


def scan(
    s: Ordered,
    summary: Callable[[pa.Table], bytes],
    advance: Callable[[bytes, bytes], bytes],
    step: Callable[[pa.Table, bytes], pa.Table],
    schema: str,
) -> DataFrame:
    """Run ``step(rows, state) -> rows`` over each block of each stream from the state that the rows before it leave.

    ``summary`` says in a few bytes what a block of sorted rows does to any state, ``advance(state, summary)`` does it; the
    first state is empty bytes. So the states that blocks start from come from one small row for each block, and all
    blocks run at once, in one plan. A task holds one block of a long stream, or a short stream.
    """
    keys, part, order = list(s.keys), s.part, [(c, "ascending") for c in s.order]
    kinds = {f.name: f.dataType.simpleString() for f in s.df.schema.fields}
    named = ", ".join(f"`{c}` {kinds[c]}" for c in part)

    def place(rows: pa.Table, names: list[str]) -> dict[str, pa.Array]:
        return {c: rows.column(c).combine_chunks().slice(0, 1) for c in names}

    def summed(rows: pa.Table) -> pa.Table:
        rows = _sorted(rows, order)
        return pa.table({**place(rows, part), "_sum": pa.array([summary(rows)], pa.binary())})

    def started(blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by(BLOCK)
        states = [b""]
        for one in blocks.column("_sum").to_pylist()[:-1]:
            states.append(advance(states[-1], one))
        return pa.table({**{c: blocks.column(c) for c in part}, "_state": pa.array(states, pa.binary())})

    def stepped(rows: pa.Table) -> pa.Table:
        state = rows.column("_start")[0].as_py() or b""
        return step(_sorted(rows.drop_columns(["_start", BLOCK]), order), state)

    sums = s.long(*[F.col(c) for c in s.df.columns]).groupBy(*part).applyInArrow(summed, f"{named}, _sum binary")
    starts = sums.groupBy(*keys).applyInArrow(started, f"{named}, _state binary")
    rows = s._carry(s.df, starts, {"_start": F.col("_state")})
    return rows.groupBy(*part).applyInArrow(stepped, schema)


def _sorted(rows: pa.Table, order: list[tuple[str, str]]) -> pa.Table:
    """Rows in order, nulls first."""
    return rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))


def in_order(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    step: Step,
    schema: str,
    block_rows: int | None = None,
    deal: str | None = None,
    most: int | None = None,
) -> DataFrame:
    """Run ``step(rows, state) -> (rows, state)`` over each stream in order; the first state is empty bytes.

    ``deal`` is a column with the number of the stream: streams go to tasks in turn, where hashes of few keys would meet in
    some. A step sees up to ``most`` rows of a batch at once.
    """
    if block_rows is not None:
        s = ordered(df, keys, order, block_rows)
        s = s.columns({BLOCK: F.coalesce(BLOCK, F.lit(0))})
        return _run_blocks(s, _block_states(s, step), step, schema)
    # a fixed number, since partitions of well compressed pictures look small enough to be joined
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if deal is None:
        rows = df.repartition(n, *keys)
    else:
        n = max(n, 2 * df.sparkSession.sparkContext.defaultParallelism)
        rows = df.repartitionById(n, F.pmod(F.col(deal) - 1, F.lit(n)))
    rows = rows.sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, state = None, b""
        for pdf in batches if most is None else (pdf[a : a + most] for pdf in batches for a in range(0, len(pdf), most)):
            parts = []
            for own, part in _streams_in(pdf, keys):
                if own != stream:
                    stream, state = own, b""
                out, state = step(part, state)
                parts.append(out)
            if parts:
                yield pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]

    return rows.mapInPandas(run, schema)


def _streams_in(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The pieces of a sorted batch that belong to one stream each, with the key of the stream."""
    named = [pdf[k].astype(object).where(pdf[k].notna(), None).to_numpy() for k in keys]
    changed = np.zeros(max(len(pdf) - 1, 0), dtype=bool)
    for v in named:
        changed |= v[1:] != v[:-1]
    edges = [0, *(np.flatnonzero(changed) + 1), len(pdf)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield tuple(v[a] for v in named), pdf.iloc[a:b]


def _block_states(s: Ordered, step: Step) -> DataFrame:
    """One row per block with the state its first row meets."""
    part = s.part
    kinds = {f.name: f.dataType.simpleString() for f in s.df.schema.fields}
    state_schema = ", ".join(f"{k} {kinds[k]}" for k in part) + ", start BINARY, end BINARY"
    # new column identities, so that states and rows can meet again in one join
    blocks = s.df.groupBy(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(part)]).agg(
        F.lit(None).cast("binary").alias("start"), F.lit(None).cast("binary").alias("end")
    )
    blocks = blocks.select(*[F.col(f"_b{i}").alias(k) for i, k in enumerate(part)], "start", "end")
    states = durable(blocks)
    before = Window.partitionBy(*s.keys).orderBy(BLOCK)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = None
        for own, piece, first in _blocks_in(batches, part):
            if first is not None:
                if block is not None:
                    yield ended(block, start, state)
                block, start, state = own, first, first
            state = step(piece, state)[1]
        if block is not None:
            yield ended(block, start, state)

    def ended(block: tuple, start: bytes, end: bytes) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] for k, v in zip(part, block)}, "start": [start], "end": [end]})

    while True:
        known = F.when(F.row_number().over(before) == 1, F.lit(b"")).otherwise(F.lag("end").over(before))
        asked = states.withColumn("want", F.coalesce(known, F.lit(b"")))
        todo = durable(asked.filter(F.col("want").isNotNull() & ~F.col("want").eqNullSafe(F.col("start"))))
        if todo.isEmpty():
            return states.select(*part, "start")
        todo = todo.select(*part, F.col("want").alias("start"))
        fresh = _with_starts(s, todo, "inner").mapInPandas(settle, state_schema)
        kept = _only(states, todo.select(*part), part, "left_anti")
        states = durable(kept.unionByName(fresh))


def _with_starts(s: Ordered, starts: DataFrame, how: str = "left") -> DataFrame:
    """The rows of the blocks in ``starts``, sorted by block and time, the first of each with its block's state."""
    rows = s.df if how == "left" else _only(s.df, starts.select(*s.part), s.part, "left_semi")
    rows = rows.withColumn("_first", F.row_number().over(s.window()) == 1)
    names = [f"_s{i}" for i in range(len(s.part))]
    other = starts.toDF(*names, "_start")
    on = same_keys(rows, other, list(zip(s.part, names))) & rows["_first"]
    n = int(s.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.join(other, on, "left").drop("_first", *names).repartition(n, *s.part)
    return placed.sortWithinPartitions(*s.part, *s.order)


def _blocks_in(
    batches: Iterator[pd.DataFrame], part: list[str]
) -> Iterator[tuple[tuple, pd.DataFrame, bytes | None]]:
    """Pieces of blocks, the first piece of a block with the state it starts from."""
    block = None
    for pdf in batches:
        for own, piece in _streams_in(pdf, part):
            first = None
            if own != block:
                block, first = own, bytes(piece["_start"].iloc[0])
            yield own, piece.drop(columns=["_start", BLOCK]), first


def _only(df: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    other = keys.toDF(*[f"_o{i}" for i in range(len(names))])
    return df.join(other, same_keys(df, other, [(k, f"_o{i}") for i, k in enumerate(names)]), how)


def _run_blocks(s: Ordered, states: DataFrame, step: Step, schema: str) -> DataFrame:
    part = s.part

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = b""
        for _, piece, first in _blocks_in(batches, part):
            out, state = step(piece, state if first is None else first)
            yield out

    return _with_starts(s, states).mapInPandas(run, schema)
