"""Embedding near-duplicates: products of int8 tiles with error bounds, full precision where a bound leaves it open."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.llm.components import connected_components, spanning_links
from framewell.llm.tables import stored

THRESHOLD = 0.93
#: Distinct vectors of a tile; two tiles meet in a task.
TILE = 1024
#: Pairs that are computed in full precision at once.
EXACT = 1 << 15
#: Allowance for rounding of the bounds themselves, far above that of sums of doubles.
ROUNDING = 1e-9


def usable(embedding: Column, label: Column, vec_id: Column) -> Column:
    """Whether a vector can link: no nulls, no infinite or undefined component, and not zero."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    return F.coalesce(vec_id.isNotNull() & label.isNotNull() & ~odd & some, F.lit(False))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors with their scales, the lengths of the quantisation errors and of the quantised vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(unit - back, axis=1), np.linalg.norm(back, axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that the largest component is near one and no square leaves the doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of rows of ``x`` and ``y`` with a cosine of at least ``threshold``; ``same``: one tile with
    itself, each pair once.

    For unit u = s·q + e and v = t·r + f the product u·v differs from s·t·(q·r) by at most |s·q||f| + |e|. Products of int8
    codes are sums below 2**24 up to 1 040 dimensions, which single precision holds exactly; longer vectors take double.
    """
    x, y = scaled(x), scaled(y)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (q, s, e, n), (r, t, f, _) = quantised(x / nx[:, None]), quantised(y / ny[:, None])
    wide = np.float32 if x.shape[1] <= 1040 else np.float64
    upper = (q.astype(wide) @ r.astype(wide).T).astype(np.float64)
    upper *= s[:, None]
    upper *= t[None, :]
    upper += n[:, None] * f[None, :]
    upper += e[:, None]
    open_pairs = upper >= threshold - ROUNDING
    if same:
        open_pairs = np.triu(open_pairs, 1)
    a, b = np.nonzero(open_pairs)
    sure = np.zeros(a.size, dtype=bool)
    for at in range(0, a.size, EXACT):
        i, j = a[at : at + EXACT], b[at : at + EXACT]
        sure[at : at + EXACT] = np.einsum("ij,ij->i", x[i], y[j]) / (nx[i] * ny[j]) >= threshold
    return a[sure], b[sure]


def _meet(nodes: np.ndarray, copies: np.ndarray, own: np.ndarray, vectors: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Columns ``a, b, n``: links of a spanning forest (n null as -1), and for each node how many vectors it links to."""
    first = own == own.min()
    left, right = np.flatnonzero(first), np.flatnonzero(~first)
    same = right.size == 0
    if same:
        right = left
    a, b = linked_pairs(vectors[left], vectors[right], threshold, same)
    a, b = left[a], right[b]
    near = np.zeros((nodes.size, nodes.size), dtype=bool)
    near[a, b] = near[b, a] = True
    links = (near @ copies.astype(np.float64)).astype(np.int64)
    some = np.flatnonzero(links)
    part = near[np.ix_(some, some)]
    forest = np.array(spanning_links(some.size, lambda i, rest: part[i, rest]), dtype=np.int64).reshape(-1, 2)
    return [
        np.concatenate([nodes[some][forest[:, 0]], nodes[some]]),
        np.concatenate([nodes[some][forest[:, 1]], np.full(some.size, -1)]),
        np.concatenate([np.full(len(forest), -1), links[some]]),
    ]


def link_tiles(distinct: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``(a, b, n)`` over ``distinct(node, label, embedding, copies)``, by tiles of equal label and number of components.

    The vectors of a label are dealt to tiles by hash, and each two tiles meet in one task, so a hot label spreads over
    many tasks. Each vector goes to as many tasks as its label has tiles, and all products of a label are computed: the
    work grows with the square of a label, which is the price of an exact answer by this method.
    """
    dims = F.size("embedding")
    sizes = distinct.groupBy("label", dims.alias("dims")).agg(F.count("*").alias("size"))
    dealt = (
        distinct.withColumn("dims", dims)
        .join(sizes, ["label", "dims"])
        .withColumn("m", F.ceil(F.col("size") / tile).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select(
            "label", "dims", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            "own", "node", "copies", "embedding",
        )
    )

    def run(group: pa.Table) -> pa.Table:
        vectors = group.column("embedding").combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        columns = [group.column(c).to_numpy() for c in ("node", "copies", "own")]
        found = _meet(*columns, flat.reshape(group.num_rows, -1), threshold)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["a", "b", "n"])

    return dealt.groupBy("label", "dims", "i", "j").applyInArrow(run, "a long, b long, n long")


def near_duplicate_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Two vectors link if their labels are equal and not null, they have equally many components, and their cosine in double
    precision is at least ``threshold``. Vectors that are null, empty or zero, hold null or non-finite components, or have
    no vec_id link with nothing: they have no links and are their own component. ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest vec_id reachable, ``kept`` tells whether it is the row's own. Rows with equal
    label and vector are compared as one and counted as many, so groups of copies cost no pairs.
    """
    keys = ["_label", "_key", "_check"]
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"),
        F.col(label).alias("_label"),
        F.xxhash64(embedding).alias("_key"),
        F.xxhash64(F.lit("vector"), F.reverse(F.col(embedding)), F.col(embedding)).alias("_check"),
        F.col(embedding).alias("embedding"),
        usable(F.col(embedding), F.col(label), F.col(vec_id)).alias("_usable"),
    )
    distinct = stored(
        rows.filter("_usable")
        .groupBy(*keys)
        .agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    found = stored(link_tiles(distinct.withColumnRenamed("_label", "label"), threshold), "vector_links")
    direct = found.filter("n >= 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.filter("n < 0").select("a", "b"))
    labelled = distinct.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    known = stored(
        labelled.join(least, "component")
        .join(direct, "node", "left")
        .select(*keys, "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")),
        "vector_components",
    )
    keyed = rows.drop("embedding").withColumn("_label", F.when(F.col("_usable"), F.col("_label")))
    component = F.coalesce("component_id", "vec_id")
    return keyed.join(known, keys, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
