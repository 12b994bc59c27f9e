"""Hard-negative mining: windows of inner products searched through a multiway hyperplane tree with distance ranges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.llm.codes import finite, fitting
from framewell.llm.tables import stored

SCALE = 256
#: Rows that the tree is fitted on, at most; all rows are put into it.
SAMPLE = 4096
#: Split points of a node.
FAN = 16
#: Rows of a leaf, about, while the sample allows so many leaves.
LEAF_ROWS = 512
#: Rows of a leaf and anchors that meet in a task; larger leaves are cut into tiles.
TILE, ANCHORS = 2048, 1024
#: Below all scores and above.
LOW, HIGH = -(1 << 62), 1 << 62


@dataclass
class Node:
    """Split points and what lies nearest to each: a leaf (its number) or a further node. ``near[i, j]`` and ``far[i, j]``
    bound the distances of split point i to all rows below child j."""

    points: np.ndarray
    children: list = field(default_factory=list)
    near: np.ndarray | None = None
    far: np.ndarray | None = None


def spread_points(x: np.ndarray, count: int) -> np.ndarray:
    """Positions of up to ``count`` distinct rows far from each other, the first row first."""
    chosen, d = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < count and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def apart(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of rows to split points, in double precision."""
    squares = (x * x).sum(axis=1)[:, None] - 2 * (x @ points.T) + (points * points).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squares, 0))


class Tree:
    """A tree over rows of integers, held as doubles."""

    def __init__(self, sample: np.ndarray, rows: int, leaf_rows: int = LEAF_ROWS, fan: int = FAN) -> None:
        self.nodes: list[Node] = []
        self.leaves = 0
        share = max(1.0, leaf_rows * len(sample) / max(rows, 1))
        self.root = self._grown(sample.astype(np.float64), share, fan)
        self.norms: np.ndarray = np.zeros((self.leaves, 2))

    def _grown(self, x: np.ndarray, share: float, fan: int) -> Node | int:
        chosen = spread_points(x, fan) if len(x) > share else np.zeros(1, dtype=int)
        if len(chosen) < 2:
            self.leaves += 1
            return self.leaves - 1
        node = Node(x[chosen])
        self.nodes.append(node)
        nearest = apart(x, node.points).argmin(axis=1)
        node.children = [self._grown(x[nearest == j], share, fan) for j in range(len(chosen))]
        return node

    def walk(self, x: np.ndarray) -> Iterator[tuple[Node, np.ndarray, np.ndarray, np.ndarray]]:
        """Each node that rows reach, with their positions, distances to the split points and children."""
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if isinstance(node, Node) and at.size:
                d = apart(x[at], node.points)
                child = d.argmin(axis=1)
                yield node, at, d, child
                todo += [(c, at[child == j]) for j, c in enumerate(node.children)]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(x), dtype=np.int32)
        for node, at, _, child in self.walk(x):
            ends = np.array([-1 if isinstance(c, Node) else c for c in node.children])
            leaf[at] = ends[child]
        return leaf

    def survivors(self, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Mask (anchors, leaves) of the leaves that may hold a row whose inner product with the anchor lies in one of the
        anchor's windows ``low ... high`` (anchors, windows).

        A row x at distance d of anchor a has the product (|x|² + |a|² - d²) / 2, so a window is an annulus around the
        anchor for each norm. Split point i bounds the distance to all of child j by d(a, i) and the range of i to j, so a
        child whose range meets no annulus goes with all below it. Bounds are widened by more than the rounding.
        """
        alive = np.zeros((len(a), self.leaves), dtype=bool)
        own = (a * a).sum(axis=1)
        todo = [(self.root, np.arange(len(a)), np.zeros(len(a)), np.full(len(a), np.inf))]
        while todo:
            node, at, least, most = todo.pop()
            if not isinstance(node, Node):
                alive[at, node] = True
                continue
            d = apart(a[at], node.points)[:, :, None]
            slack = 1e-6 * (1 + d.max(initial=0))
            least = np.maximum(least[:, None], np.maximum(d - node.far, node.near - d).max(axis=1) - slack)
            most = np.minimum(most[:, None], (d + node.far).min(axis=1) + slack)
            for j, c in enumerate(node.children):
                inner, outer = self._norms(c)
                if inner > outer:  # no row below
                    continue
                size = np.sqrt(own[at] * outer)
                top = np.minimum((outer + own[at] - least[:, j] ** 2) / 2, size)
                floor = np.maximum((inner + own[at] - most[:, j] ** 2) / 2, -size)
                slack = 1 + 1e-6 * (outer + own[at])
                fits = ((top + slack)[:, None] >= low[at]) & ((floor - slack)[:, None] <= high[at]) & (low[at] <= high[at])
                on = fits.any(axis=1)
                if on.any():
                    todo.append((c, at[on], least[on, j], most[on, j]))
        return alive

    def _norms(self, node: Node | int) -> tuple[float, float]:
        """Range of the squared norms below a child."""
        if not isinstance(node, Node):
            return self.norms[node, 0], self.norms[node, 1]
        ranges = [self._norms(c) for c in node.children]
        return min(r[0] for r in ranges), max(r[1] for r in ranges)


def _matrix(column: pa.Array, dims: int, kind: type = np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dims)


def _routed(rows: DataFrame, tree: Tree, dims: int, scale: int) -> DataFrame:
    """``rows(row, vec_id, label, anchor, embedding)`` as integers, with their leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("embedding").value_lengths().to_numpy()
            x = np.zeros((b.num_rows, dims), dtype=np.int64)
            flat = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x[np.arange(dims) < sizes[:, None]] = np.floor(scale * flat)  # missing components are zero
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dims)
            columns = [b.column(c) for c in ("row", "vec_id", "label", "anchor")]
            lists = pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*columns, lists, pa.array(tree.leaf_of(x.astype(np.float64)))],
                names=["row", "vec_id", "label", "anchor", "x", "leaf"],
            )

    return rows.mapInArrow(run, "row long, vec_id long, label long, anchor boolean, x array<int>, leaf int")


def _measure(tree: Tree, routed: DataFrame, dims: int) -> list:
    """Set the distance ranges of all nodes and the norms of all leaves; gives the number of rows of each leaf. Each task
    gives one row for each range it has met, so as many as the tree has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {id(node): k for k, node in enumerate(tree.nodes)}
        near = [np.full((len(n.points),) * 2, np.inf) for n in tree.nodes]
        far = [np.full((len(n.points),) * 2, -1.0) for n in tree.nodes]
        norms = np.column_stack([np.full(tree.leaves, np.inf), np.full(tree.leaves, -1.0)])
        counts = np.zeros(tree.leaves, dtype=np.int64)
        for b in batches:
            x, leaf = _matrix(b.column("x"), dims), b.column("leaf").to_numpy()
            for node, _, d, child in tree.walk(x):
                k = number[id(node)]
                for j in np.unique(child):
                    near[k][:, j] = np.minimum(near[k][:, j], d[child == j].min(axis=0))
                    far[k][:, j] = np.maximum(far[k][:, j], d[child == j].max(axis=0))
            squares = (x * x).sum(axis=1)
            np.minimum.at(norms[:, 0], leaf, squares)
            np.maximum.at(norms[:, 1], leaf, squares)
            counts += np.bincount(leaf, minlength=tree.leaves)
        out = [(k, i, j, near[k][i, j], f, 0) for k, m in enumerate(far) for (i, j), f in np.ndenumerate(m) if f >= 0]
        out += [(-1, int(i), 0, norms[i, 0], norms[i, 1], int(counts[i])) for i in np.flatnonzero(counts)]
        yield pa.RecordBatch.from_pylist([dict(zip(_RANGES.names, r, strict=True)) for r in out], schema=_RANGES)

    found = routed.select("x", "leaf").mapInArrow(run, "node int, i int, j int, near double, far double, n long")
    ranges = found.groupBy("node", "i", "j").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.sum("n").alias("n"))
    for node in tree.nodes:
        node.near, node.far = np.full((len(node.points),) * 2, np.inf), np.full((len(node.points),) * 2, -1.0)
    tree.norms = np.column_stack([np.full(tree.leaves, np.inf), np.full(tree.leaves, -1.0)])
    counts = [0] * tree.leaves
    for r in ranges.collect():
        if r.node < 0:
            tree.norms[r.i] = r.near, r.far
            counts[r.i] = r.n
        else:
            tree.nodes[r.node].near[r.i, r.j], tree.nodes[r.node].far[r.i, r.j] = r.near, r.far
    return counts


_RANGES = pa.schema(
    [("node", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("n", pa.int64())]
)


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0))
    if a.shape[1] * most < 1 << 53:  # all sums are whole numbers that doubles hold
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a @ x.T


def best(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the first ``k`` that fit in each row of ``scores``, by falling score, then by position."""
    if not fits.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ranked = np.where(fits, scores, LOW)
    if ranked.shape[1] > k:
        bound = np.partition(ranked, ranked.shape[1] - k, axis=1)[:, ranked.shape[1] - k]
        fits = fits & (scores >= bound[:, None])
    i, j = np.nonzero(fits)
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(i.size) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


def _search(anchors: DataFrame, rows: DataFrame, dims: int, same_label: bool, k: int) -> DataFrame:
    """``(anchor_row, window, score, vec_id, row, place)``: of each window of ``anchors(row, label, x, low, high, tile)`` the
    first ``k`` rows of the anchors' tiles of ``rows(row, vec_id, label, x, tile)`` with the same label or another one.

    Tiles and groups of anchors have bounded sizes and meet two by two; each meeting gives ``k`` rows for a window at most.
    """
    key = ["tile", "part"]
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of its own beside those of the rows
    wanted = anchors.select(*[F.col(c).alias(c) for c in key]).distinct()
    met = rows.join(wanted, "tile").groupBy(*key).cogroup(anchors.groupBy(*key))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, dtype=np.int64)] * 5
        if left.num_rows and right.num_rows:
            left = left.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls last
            x, a = (_matrix(t.column("x").combine_chunks(), dims, np.int64) for t in (left, right))
            row, own = left.column("row").to_numpy(), right.column("row").to_numpy()
            low, high = (right.column(c).combine_chunks() for c in ("low", "high"))
            widths = low.value_lengths().to_numpy()
            starts = np.concatenate([[0], np.cumsum(widths)])
            low, high = low.flatten().to_numpy(), high.flatten().to_numpy()
            scores = products(a, x)
            equal = right.column("label").to_numpy()[:, None] == left.column("label").to_numpy()[None, :]
            open_ = (equal if same_label else ~equal) & (own[:, None] != row[None, :])
            found = []
            for w in range(int(widths.max(initial=0))):
                at = np.flatnonzero(widths > w)
                bounds = starts[at] + w
                s = scores[at]
                i, j = best(s, open_[at] & (s >= low[bounds][:, None]) & (s <= high[bounds][:, None]), k)
                found.append((own[at[i]], np.full(i.size, w), s[i, j], j, row[j]))
            out = [np.concatenate(c) for c in zip(*found, strict=True)] if found else out
            ids = left.column("vec_id").take(pa.array(out[3], pa.int64()))
        else:
            ids = pa.nulls(0, pa.int64())
        columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), ids]
        return pa.table([*columns, pa.array(out[4], pa.int64())], names=["anchor_row", "window", "score", "vec_id", "row"])

    found = met.applyInArrow(run, "anchor_row long, window int, score long, vec_id long, row long")
    order = Window.partitionBy("anchor_row", "window").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"
    )
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _with_tiles(anchors: DataFrame, tree: Tree, tiles: list[tuple[int, int]], dims: int) -> DataFrame:
    """``anchors(row, label, part, x, low, high)`` once for each tile of each leaf that the tree cannot rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [np.arange(first, first + n, dtype=np.int32) for first, n in tiles]
        for b in batches:
            widths = b.column("low").value_lengths().to_numpy()
            inside = np.arange(int(widths.max(initial=0))) < widths[:, None]
            low, high = np.full(inside.shape, np.inf), np.full(inside.shape, -np.inf)
            low[inside] = b.column("low").flatten().to_numpy(zero_copy_only=False)
            high[inside] = b.column("high").flatten().to_numpy(zero_copy_only=False)
            alive = tree.survivors(_matrix(b.column("x"), dims), low, high)
            lists = [np.concatenate([np.zeros(0, np.int32), *(names[leaf] for leaf in np.flatnonzero(on))]) for on in alive]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*b.schema.names, "tiles"]
            )

    kinds = ", ".join(f"{c} {t}" for c, t in anchors.dtypes)
    found = anchors.mapInArrow(run, f"{kinds}, tiles array<int>")
    return found.select("row", "label", "part", "x", "low", "high", F.explode("tiles").alias("tile"))


def mine(
    vectors: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 3,
    scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``; the score of a row is its integer product with the anchor, higher scores come
    first, then smaller vec_ids (null last, then in the order of the stored rows). The positives of an anchor are its first
    ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels between 50 % and 95 % of its
    score are returned. Fewer are returned where there are fewer, none for an empty table.

    Rows with a null label, a null or empty vector, null or non-finite components or such that a product may not fit a long
    take no part; a shorter vector counts as filled with zeros. Repeated rows count each, also as anchors. Labels are whole
    numbers. Only the named columns and those of ``anchor`` are read.

    A tree is fitted on at most :data:`SAMPLE` rows, and all rows are put into it. A first search in each anchor's own
    tile gives a score that the last positive reaches; only leaves whose distances allow that score are searched
    for the positives. Negatives go the same way, with a window for each positive. Copies share a leaf, which is cut into tiles.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col(embedding).alias("embedding"),
    ).filter(F.col("label").isNotNull() & finite(F.col("embedding")) & (F.size("embedding") > 0))
    rows = stored(
        rows.filter(fitting(F.col("embedding"), scale)).select("*", F.monotonically_increasing_id().alias("row")), "vectors"
    )
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims"), F.count_if("anchor").alias("a")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts.a:
        return spark.createDataFrame([], schema)
    dims = facts.dims
    chosen = rows.orderBy(F.xxhash64("vec_id", "embedding"), "row").select("embedding").limit(SAMPLE).collect()
    sample = np.zeros((len(chosen), dims))
    for i, r in enumerate(chosen):
        sample[i, : len(r.embedding)] = np.floor(scale * np.array(r.embedding, dtype=np.float64))
    tree = Tree(sample, facts.n)
    routed = stored(_routed(rows, tree, dims, scale), "routed")
    counts = _measure(tree, routed, dims)
    sizes = [max(1, -(-n // TILE)) for n in counts]
    firsts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    tiles = list(zip(firsts[:-1], sizes, strict=True))
    leaves = spark.createDataFrame([(i, first, n) for i, (first, n) in enumerate(tiles)], "leaf int, first int, n int")
    tile = F.col("first") + F.pmod(F.xxhash64("row"), F.col("n")).cast("int")
    tiled = routed.join(F.broadcast(leaves), "leaf").select("row", "vec_id", "label", "anchor", "x", tile.alias("tile"))
    base = tiled.drop("anchor")
    parts = -(-facts.a // ANCHORS)
    anchors = tiled.filter("anchor").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))

    def first_windows(low: list[int], high: list[int]) -> list[Column]:
        return [F.array(*map(F.lit, low)).cast("array<long>").alias("low"), F.array(*map(F.lit, high)).cast("array<long>").alias("high")]

    # positives: the own tile gives a score that the last of them reaches
    near = anchors.select("row", "label", "part", "x", "tile", *first_windows([LOW], [HIGH]))
    reached = _search(near, base, dims, True, positives).filter(F.col("place") == positives)
    reached = stored(reached.select(F.col("anchor_row").alias("row"), F.col("score").alias("reached")), "reached")
    known = anchors.join(reached, "row", "left").select(
        "row", "label", "part", "x",
        F.array(F.coalesce("reached", F.lit(LOW))).alias("low"), F.array(F.lit(HIGH)).cast("array<long>").alias("high"),
    )
    found = stored(_search(_with_tiles(known, tree, tiles, dims), base, dims, True, positives), "positives")

    # negatives: a window for each positive, narrowed by what the own tile reaches
    windows = found.groupBy(F.col("anchor_row").alias("row")).agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("vec_id").alias("positive_id"), "score"))).alias("found")
    )
    # whole numbers from 50 to 95 % of the score, by steps that stay in a long
    low = F.expr("transform(found.score, s -> s - shiftright(s, 1))")
    high = F.expr("transform(found.score, s -> (s - pmod(s, 20)) div 20 * 19 + (19 * pmod(s, 20)) div 20)")
    opened = stored(
        anchors.join(windows, "row").select("row", "vec_id", "label", "part", "x", "tile", "found", low.alias("low"), high.alias("high")),
        "windows",
    )
    reached = _search(opened.select("row", "label", "part", "x", "low", "high", "tile"), base, dims, False, negatives)
    reached = reached.filter(F.col("place") == negatives).groupBy(F.col("anchor_row").alias("row"))
    reached = stored(reached.agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached")), "reached")
    narrowed = opened.drop("tile").join(reached, "row", "left").withColumn(
        "low", F.transform("low", lambda v, w: F.coalesce(F.try_element_at("reached", w), v))
    )
    last = _search(
        _with_tiles(narrowed.select("row", "label", "part", "x", "low", "high"), tree, tiles, dims), base, dims, False, negatives
    )
    named = opened.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"), F.posexplode("found").alias("window", "p"))
    return last.join(named, ["anchor_row", "window"]).select(
        "anchor_id",
        F.col("p.positive_id").alias("positive_id"),
        F.col("place").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )

