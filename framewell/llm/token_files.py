"""Token-id files: texts are encoded, compressed by shard and read back with the place of each document."""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from framewell.llm.chunks import ChunkMemo
from framewell.llm.files import read_file, write_file
from framewell.llm.repair import Shard, pack_shard
from framewell.llm.tables import stored
from framewell.session import scratch_path

#: Distinct chunks whose ids a worker keeps.
MEMO = 1_000_000
#: A shard ends with the document that reaches so many ids.
SHARD_IDS = 1 << 20

_SHARDS = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("start", pa.int64()), ("n_ids", pa.int64())]
)


@functools.cache
def _encoder(path: str) -> tuple[int, ChunkMemo]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    coder = Tokenizer.from_file(path)

    def solve(chunks: list[str]) -> list[bytes]:
        found = coder.encode_batch_fast(chunks, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    return coder.get_vocab_size(), ChunkMemo(solve, MEMO)


def write_tokens(
    documents: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> tuple[str, DataFrame]:
    """Encode whole texts, end each with ``end_id`` and write them in ascending doc_id order (nulls first, equal ids by a
    hash of the text). Gives the folder and the table of its shards ``(part, shard, file, start, n_ids)``.

    Texts are dealt by ranges, so part ``k`` lies before part ``k + 1``; ``start`` counts the ids of the part before the
    shard. A task holds one shard, that is whole documents of about :data:`SHARD_IDS` ids.
    """
    folder = scratch_path(documents.sparkSession, "tokens")
    ordered = (
        documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terminals, memo = _encoder(tokenizer_path)
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        for names, encoded in _shards(batches, memo, np.array([end_id], dtype="<u4")):
            ends = np.cumsum([sum(p.size for p in parts) for parts in encoded])
            ids = np.concatenate([p for parts in encoded for p in parts])
            known = np.array([n is not None for n in names])
            data = pack_shard(ids, ends, np.array([n or 0 for n in names]), known, terminals)
            name = write_file(folder, f"part-{part:06d}-{shard:06d}", ".ids", [data])
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "shard": [shard], "file": [name], "start": [start], "n_ids": [ids.size]}, schema=_SHARDS
            )
            shard, start = shard + 1, start + ids.size

    rows = ordered.mapInArrow(run, "part int, shard int, file string, start long, n_ids long")
    return folder, stored(rows, "shards")


def _shards(batches: Iterator[pa.RecordBatch], memo: ChunkMemo, end: np.ndarray) -> Iterator[tuple[list, list[list]]]:
    """Names and encoded texts of whole documents, about a shard at a time; a text is a list of pieces."""
    names: list = []
    encoded: list[list] = []
    size = 0
    for b in batches:
        ids = b.column(0).to_pylist()
        for i, parts in _texts(b.column(1), memo):
            names.append(ids[i])
            encoded.append([*parts, end])
            size += sum(p.size for p in encoded[-1])
            if size >= SHARD_IDS:
                yield names, encoded
                names, encoded, size = [], [], 0
    if names:
        yield names, encoded


def _texts(texts: pa.Array, memo: ChunkMemo) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each text number with the ids of its segments."""
    at, parts = 0, []
    for i, ids in memo.ids(texts):
        if i != at:
            yield at, parts
            at, parts = i, []
        parts.append(ids)
    if len(texts):
        yield at, parts


def read_tokens(folder: str, shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of all documents from the files of ``shards``.

    ``start`` counts the ids of all documents before it. The parts' sums are one number for each part and are added up in
    one task, and meet the few rows of shards before any document is read.
    """
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = shards.join(bases, "part").select("file", (F.col("base") + F.col("start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(read_file(folder, file))
                starts = np.concatenate([[0], shard.ends[:-1]])
                ids = shard.ids(0, int(shard.ends[-1]))
                sums = [zlib.crc32(ids[a:z]) for a, z in zip(starts.tolist(), shard.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.names, mask=~shard.named),
                        pa.array(starts + start),
                        pa.array(shard.ends - starts),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    cores = shards.sparkSession.sparkContext.defaultParallelism  # shards are few rows of much work
    spread = placed.repartition(cores, "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_to_files(
    documents: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write ``documents`` by :func:`write_tokens` and return what :func:`read_tokens` reads back. Null and empty texts
    hold the end id alone; rows that repeat are written each; an empty table writes no shard."""
    return read_tokens(*write_tokens(documents, tokenizer_path, end_id, doc_id, text))
