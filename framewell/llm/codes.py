"""Vector code compression: a codebook for each part of a vector, assigned under adaptive distance bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.llm.tables import removed, stored
from framewell.session import scratch_path

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Distances that are computed at once.
STEP = 1 << 20
#: The number of kept bounds falls to the least one that fails this part of the assignments, in thousandths.
RARE = 1

_STATE = "_assigned binary, _closest binary, _bounds array<float>, _levels binary"


def finite(embedding: Column) -> Column:
    """Whether a vector has neither nulls nor non-finite components."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def fitting(embedding: Column, scale: int) -> Column:
    """Whether the integer components are so small that sums of their squared differences and products fit a long."""
    limit = F.sqrt(F.lit(float(1 << 60)) / F.size(embedding)) - 1
    return F.forall(embedding, lambda x: F.abs(x.cast("double")) * scale < limit)


def integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of a batch of vectors; the scale is a power of two, so that the product is exact."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), dims)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all entries."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # all sums are whole numbers that doubles hold
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return chosen_distances(x, entries, np.broadcast_to(np.arange(len(entries)), (len(x), len(entries))))


def chosen_distances(x: np.ndarray, entries: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to its own choice of entries, ``which`` of shape (rows, choices)."""
    found = np.empty(which.shape, dtype=np.int64)
    for c in range(which.shape[1]):
        apart = x - entries[which[:, c]]
        found[:, c] = np.einsum("ij,ij->i", apart, apart)
    return found


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, dtype=np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, dtype=np.float32), np.float32(-np.inf))


@dataclass
class Bounds:
    """The state of the vectors' parts at one position. ``closest`` names the next closest entries after the assigned one,
    ``lower`` holds a lower bound on the distance to each of these and, last, the outer bound on that to all others.
    Bounds are rounded outwards, so that they hold for the true distances."""

    assigned: np.ndarray
    closest: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    #: How far the last assignment went: 0 by bounds alone or the own distance, j by the j closest entries, one more than
    #: there are by all entries.
    level: np.ndarray


def first_bounds(x: np.ndarray, entries: np.ndarray, keep: int) -> Bounds:
    """Assignment by all distances; ties go to the lower index."""
    d = distances(x, entries)
    order = np.argsort(d, axis=1, kind="stable")
    near = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    outer = near[:, keep + 1 : keep + 2] if keep + 1 < len(entries) else np.full((len(x), 1), np.inf)
    lower = _down(np.concatenate([near[:, 1 : keep + 1], outer], axis=1))
    level = np.full(len(x), keep + 1, dtype=np.uint8)
    return Bounds(order[:, 0].astype(np.uint8), order[:, 1 : keep + 1].astype(np.uint8), _up(near[:, 0]), lower, level)


def next_bounds(x: np.ndarray, entries: np.ndarray, moves: np.ndarray, old: Bounds, keep: int) -> Bounds:
    """Assignment after the entries moved by at most ``moves``.

    The upper bound grows by the own entry's move, lower bounds shrink by those of theirs, the outer one by the largest.
    Bounds are made ascending from the right, so one comparison clears an entry and all beyond it. Parts whose own bound
    reaches the next one get the exact own distance; those still in doubt are settled by exact distances to as many
    of the closest entries as are in doubt, or to all where the outer bound does not clear the rest.
    """
    upper = _up(old.upper.astype(np.float64) + moves[old.assigned])
    far = np.full((len(x), 1), moves.max(initial=0), dtype=np.float64)
    lower = _down(old.lower.astype(np.float64) - np.concatenate([moves[old.closest], far], axis=1))
    lower = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]
    lower, closest, assigned = lower[:, : keep + 1].copy(), old.closest[:, :keep].copy(), old.assigned.copy()
    level = np.zeros(len(x), dtype=np.uint8)
    at = np.flatnonzero(upper >= lower[:, 0])
    upper[at] = _up(np.sqrt(chosen_distances(x[at], entries, assigned[at, None])[:, 0].astype(np.float64)))
    at = at[upper[at] >= lower[at, 0]]
    clear = upper[at, None] < lower[at]
    level[at] = np.where(clear.any(axis=1), clear.argmax(axis=1), keep + 1)
    for j in range(1, keep + 1):
        i = at[level[at] == j]
        if i.size:
            names = np.concatenate([assigned[i, None], closest[i, :j]], axis=1)
            d = chosen_distances(x[i], entries, names)
            order = np.lexsort((names, d), axis=-1)
            names, near = np.take_along_axis(names, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
            assigned[i], upper[i] = names[:, 0], _up(near[:, 0])
            closest[i, :j], lower[i, :j] = names[:, 1:], _down(near[:, 1:])
    i = at[level[at] == keep + 1]
    if i.size:
        fresh = first_bounds(x[i], entries, keep)
        assigned[i], closest[i], upper[i], lower[i] = fresh.assigned, fresh.closest, fresh.upper, fresh.lower
    return Bounds(assigned, closest, upper, lower, level)


def fewer_kept(levels: np.ndarray, keep: int, entries: int) -> int:
    """Bounds to keep from now on, given how many parts went to each level 0 ... ``keep + 1``: the closest entries that only
    rare parts reached are dropped, down to an eighth of the entries."""
    least = min(keep, max(1, entries // 8))
    while keep > least and 1000 * levels[keep] <= RARE * levels.sum():
        keep -= 1
    return keep


def _parts(x: np.ndarray) -> Iterator[np.ndarray]:
    """The parts of the vectors, with contiguous rows."""
    for part in np.split(x, PARTS, axis=1):
        yield np.ascontiguousarray(part)


def _binary(values: np.ndarray) -> pa.Array:
    """Rows of bytes as one binary column."""
    n, width = values.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(values, dtype=np.uint8))])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a binary column of ``width`` bytes each."""
    if not width:
        return np.zeros((len(column), 0), dtype=np.uint8)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of numbers as one list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _state(bounds: list[Bounds]) -> list[pa.Array]:
    return [
        _binary(np.stack([b.assigned for b in bounds], axis=1)),
        _binary(np.concatenate([b.closest for b in bounds], axis=1)),
        _lists(np.concatenate([np.column_stack([b.upper, b.lower]) for b in bounds], axis=1).astype(np.float32)),
        _binary(np.stack([b.level for b in bounds], axis=1)),
    ]


def _read_state(batch: pa.RecordBatch, keep: int) -> list[Bounds]:
    assigned = _bytes(batch.column("_assigned"), PARTS)
    n = batch.num_rows
    closest = _bytes(batch.column("_closest"), PARTS * keep).reshape(n, PARTS, keep)
    bounds = _numbers(batch.column("_bounds"), PARTS * (keep + 2)).reshape(n, PARTS, keep + 2)
    level = np.zeros(n, dtype=np.uint8)
    return [Bounds(assigned[:, p], closest[:, p], bounds[:, p, 0], bounds[:, p, 1:], level) for p in range(PARTS)]


def _assign_first(rows: DataFrame, books: np.ndarray, keep: int, dims: int, scale: int) -> DataFrame:
    """``rows(vec_id, label, embedding)`` as integers with their first state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column("embedding"), dims, scale)
            state = _state([first_bounds(part, books[p], keep) for p, part in enumerate(_parts(x))])
            columns = [b.column("vec_id"), b.column("label"), _lists(x.astype(np.int32)), *state]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "_x", *_NAMES])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, _x array<int>, {_STATE}")


_NAMES = ["_assigned", "_closest", "_bounds", "_levels"]


def _moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Upper bounds on how far each entry of each part moved."""
    apart = (new - old).astype(object)
    squared = (apart * apart).sum(axis=2)
    return _up(np.array([[math.sqrt(d) for d in part] for part in squared], dtype=np.float64).reshape(squared.shape))


def _assign_next(state: DataFrame, books: np.ndarray, moves: np.ndarray, kept: int, keep: int) -> DataFrame:
    """The state after the entries moved; ``kept`` bounds were kept, ``keep`` will be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _numbers(b.column("_x"), books.shape[0] * books.shape[2]).astype(np.int64)
            old = _read_state(b, kept)
            new = [next_bounds(part, books[p], moves[p].astype(np.float64), old[p], keep) for p, part in enumerate(_parts(x))]
            columns = [b.column("vec_id"), b.column("label"), b.column("_x"), *_state(new)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "_x", *_NAMES])

    return state.mapInArrow(run, state.schema)


def _totals(state: DataFrame, shape: tuple[int, int, int], keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and numbers of the parts assigned to each entry, and how many assignments went to each level. Each task gives
    one row for each of these numbers, which do not grow with the table."""
    parts, entries, width = shape
    size = parts * entries * (width + 1) + keep + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            x = _numbers(b.column("_x"), parts * width).astype(np.int64)
            assigned = _bytes(b.column("_assigned"), parts)
            sums = np.zeros((parts, entries, width + 1), dtype=np.int64)
            for p, part in enumerate(_parts(x)):
                np.add.at(sums[p], assigned[:, p], np.column_stack([part, np.ones(len(part), dtype=np.int64)]))
            levels = np.bincount(_bytes(b.column("_levels"), parts).reshape(-1), minlength=keep + 2)
            total += np.concatenate([sums.reshape(-1), levels])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["place", "n"])

    found = state.select("_x", "_assigned", "_levels").mapInArrow(run, "place long, n long")
    rows = found.groupBy("place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    total = np.zeros(size, dtype=object)
    for r in rows:
        total[r.place] = int(r.n)
    sums = total[: size - keep - 2].reshape(parts, entries, width + 1)
    return sums[:, :, :width], sums[:, :, width], total[size - keep - 2 :]


def moved_books(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each entry becomes the componentwise floor of its parts' mean; unused entries stay."""
    new = books.copy()
    for p, e in zip(*np.nonzero(counts), strict=True):
        new[p, e] = [int(s) // int(counts[p, e]) for s in sums[p, e]]
    return new


def _coded(state: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of the final state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _numbers(b.column("_x"), books.shape[0] * books.shape[2]).astype(np.int64)
            assigned = _bytes(b.column("_assigned"), PARTS)
            error = np.zeros(b.num_rows, dtype=np.int64)
            for p, part in enumerate(_parts(x)):
                error += chosen_distances(part, books[p], assigned[:, p, None])[:, 0]
            codes = [row.tobytes().hex() for row in assigned]
            columns = [b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    kinds = dict(state.dtypes)
    return state.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error)`` of the rows that take part, and the codebooks ``[part, entry, component]``.

    Components become ``floor(scale * x)``, vectors are cut into :data:`PARTS` equal parts. The codebook of a part starts
    as that part of the smallest vec_ids (null last, equal ids by the vector) and moves ``rounds`` times to the floor of
    the means. ``code`` has two hex digits for each part, ``error`` is the sum of the exact squared distances.

    Left out are null and empty vectors, such with null or non-finite components, and what has no length that
    :data:`PARTS` divides equal to that of the smallest vec_id, or components too large for a distance to fit a long.
    Repeated rows count each. With fewer rows than entries the codebooks are shorter; an empty table gives no rows and
    empty codebooks. The state of each round (assigned entry, closest entries, bounds) is a table in the shared folder, which
    the next one replaces; per round one number for each component of the codebooks reaches the driver.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding")
    )
    rows = rows.filter(finite(F.col("embedding")) & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    rows = rows.filter(fitting(F.col("embedding"), scale))
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = rows.orderBy(*order).select(F.size("embedding").alias("n")).first()
    if first is None:
        none = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.limit(0), np.zeros((PARTS, 0, 0), dtype=np.int64)
    dims = first.n
    rows = rows.filter(F.size("embedding") == dims)
    start = rows.orderBy(*order).select("embedding").limit(entries).collect()
    books = np.array([[math.floor(scale * x) for x in r.embedding] for r in start], dtype=np.int64)
    books = np.ascontiguousarray(books.reshape(len(start), PARTS, -1).transpose(1, 0, 2))
    keep = min(max(1, len(start) // 4), len(start) - 1)
    path = scratch_path(spark, "codes")
    _assign_first(rows, books, keep, dims, scale).write.parquet(path)
    for _ in range(rounds):
        state = spark.read.parquet(path)
        sums, counts, levels = _totals(state, books.shape, keep)
        new, kept = moved_books(books, sums, counts), keep
        keep = fewer_kept(levels, keep, len(start))
        after = scratch_path(spark, "codes")
        _assign_next(state, new, _moves(books, new), kept, keep).write.parquet(after)
        removed(spark, path)
        path, books = after, new
    found = stored(_coded(spark.read.parquet(path), books), "coded")
    removed(spark, path)
    return found, books
