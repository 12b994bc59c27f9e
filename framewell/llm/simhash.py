"""SimHash near-duplicates: fingerprints that differ in few bits share whole blocks of bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm.components import connected_components, spanning_links
from framewell.llm.tables import LOWER, UPPER, shielded, stored, with_groups

SHINGLE = 3
DISTANCE = 3
BLOCKS = 6
SEED = 42
#: Fingerprints of one block key that meet in one task; larger keys are cut into tiles that meet two by two.
TILE = 2048
#: Shingles whose bits are counted at once.
STEP = 1 << 16

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text: a bit is one if it is set in over half of the shingles' hashes."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    parts = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[w] for w in words]
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(b" ".join(s), seed) for s in zip(*parts, strict=False)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, hashes.size, STEP):
        part = hashes[at : at + STEP].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > hashes.size, bitorder="little").view("<u8")[0])


def with_fingerprints(documents: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The other columns of ``documents`` and ``fp``, the fingerprint as a signed long."""
    keep = [c for c in documents.columns if c not in (text, "fp")]
    source = documents.select(*keep, F.col(text).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            prints = np.array([fingerprint(t.as_py() or b"", shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints)], names=[*keep, "fp"])

    fields = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c != "_text")
    return source.mapInArrow(run, f"{fields}, fp long" if fields else "fp long")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks of all choices of ``blocks - distance`` blocks: differing bits lie in at most ``distance`` blocks, so close
    fingerprints agree in all of at least one choice."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def close_pairs(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct fingerprints of ``prints(fp)`` as all pairs within ``distance`` would.

    Fingerprints are joined on the masked bits and the kept links are verified. A key that many fingerprints share is cut
    into tiles by hash, and each two tiles meet in a task of bounded size, which returns a spanning forest, not all pairs.
    """
    masks = block_masks(blocks, distance)
    keyed = prints.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("choice", "bits"),
    )
    shared = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    m = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    meeting = (
        keyed.join(shared, ["choice", "bits"])
        .withColumn("m", m)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .groupBy("choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list("fp").alias("prints"))
        .select("prints")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            left, right = [], []
            for group in np.split(values, ends[:-1]):
                x = np.sort(group)
                if x.size == 2:
                    if int(x[0] ^ x[1]).bit_count() <= distance:
                        left.append(x[0])
                        right.append(x[1])
                    continue
                for i, j in spanning_links(
                    x.size, lambda i, rest, x=x: np.bitwise_count(x[rest] ^ x[i]) <= distance
                ):
                    left.append(x[i])
                    right.append(x[j])
            columns = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in (left, right)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return meeting.mapInArrow(run, "a long, b long")


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """``(fp, component)`` for the fingerprints of ``prints(fp)`` that link to another one."""
    return connected_components(close_pairs(prints)).select(F.col("node").alias("fp"), "component")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``documents``: ``doc_id, fp, fingerprint, component_id``.

    Words are runs of characters other than ASCII white space, A-Z in lower case; a text of fewer than three words is one
    shingle; null and empty texts have fingerprint zero and link like any other. ``component_id`` is the smallest doc_id
    reachable over fingerprints that differ in three bits or fewer; null if all of them are null. Repeated rows are
    returned each. Copies share a fingerprint and are one node of the link graph, however many they are.
    """
    prints = stored(with_fingerprints(documents.select(F.col(doc_id).alias("doc_id"), text), text), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    linked = link_fingerprints(nodes.select("fp"))
    firsts = linked.join(nodes, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    labels = linked.join(firsts, "component").select("fp", "component_id")
    known = nodes.join(labels, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return with_groups(prints, stored(known, "components"), "fp", "n").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@shielded
def keep_first(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row of each group of near-duplicates: that of the smallest doc_id, nulls last; of equal ids
    the one with the smaller hash of the row. Of wholly equal rows one stays."""
    row = [F.col(c) for c in documents.columns]
    keyed = documents.withColumns({"_key": F.xxhash64(*row), "_check": F.xxhash64(F.lit("row"), *reversed(row))})
    prints = stored(
        with_fingerprints(keyed.select(F.col(doc_id).alias("_id"), "_key", "_check", text), text), "fingerprints"
    )
    order = F.struct(F.col("_id").isNull().alias("late"), "_id", "_key", "_check")
    nodes = prints.groupBy("fp").agg(F.min(order).alias("first"))
    linked = link_fingerprints(nodes.select("fp"))
    firsts = (
        nodes.join(linked, "fp", "left")
        .groupBy(F.coalesce("component", "fp").alias("_group"))
        .agg(F.min("first").alias("first"))
        .select("first._key", "first._check")
    )
    kept = keyed.join(firsts, ["_key", "_check"], "left_semi").dropDuplicates(["_key", "_check"])
    return kept.select(*documents.columns)
