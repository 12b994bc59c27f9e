"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm.tables import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for all nodes of ``links(a, b)``; ``component`` is the smallest node reachable.

    Links have no nulls and may repeat, run in both directions or lead from a node to itself. Each round hangs all larger
    neighbours of a node on its smallest one and then all smaller ones too, which needs a number of rounds that grows with
    the logarithm of the longest path. A round keeps at most as many links as before; minima are taken before the
    shuffle, so a node with very many links is no large group. The rounds end when a round changes nothing, which a count
    and a sum of hashes tell; only these two numbers reach the driver.
    """
    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    while True:
        count, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not count or (count, mark) == before:
            break
        before = (count, mark)
        edges = stored(_small_star(_large_star(edges)), "links")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def spanning_links(n: int, near) -> list[tuple[int, int]]:
    """Links of a spanning forest over the nodes 0..n-1 of one bounded block; ``near(i, rest)`` tells by a mask which of
    the nodes ``rest`` have a link to node ``i``. There are fewer links than nodes, however dense the block is."""
    rest, links, todo = np.arange(n), [], []
    while rest.size or todo:
        if todo:
            i = todo.pop()
        else:
            i, rest = int(rest[0]), rest[1:]
        if rest.size:
            mask = near(i, rest)
            if mask.any():
                found = rest[mask].tolist()
                links += [(i, j) for j in found]
                todo += found
                rest = rest[~mask]
    return links
