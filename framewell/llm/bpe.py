"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, all others by merges from a heap over linked bytes."""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm.chunks import ChunkMemo

#: Distinct chunks whose ids a worker keeps.
MEMO = 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash over a fixed set of keys: each key has a slot of its own among as many slots as keys.

    Keys fall into buckets by one half of a 128-bit hash. Buckets are placed from the largest: a displacement is searched
    that sends all keys of the bucket to free slots. Buckets of one key name their slot directly.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.buckets, self.seed = len(keys), len(keys) // 3 + 1, 0
        while not self._place(keys):
            self.seed += 1

    def _place(self, keys: list[bytes], most: int = 1 << 14) -> bool:
        """False if some bucket found no place within ``most`` displacements."""
        n, members = self.n, [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(key, self.seed)
            members[(h >> 64) % self.buckets].append((i, h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF | 1))
        free = bytearray(b"\x01") * n
        self.shift, self.slot_of_key = [0] * self.buckets, [0] * n
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) < 2:
                break
            for d in range(most):
                slots = [(low + d * step & 0xFFFFFFFF) * n >> 32 for _, low, step in members[b]]
                if all(free[x] for x in slots) and len(set(slots)) == len(slots):
                    break
            else:
                return False
            self.shift[b] = d
            for (i, _, _), slot in zip(members[b], slots, strict=True):
                self.slot_of_key[i], free[slot] = slot, 0
        rest = (slot for slot in range(n) if free[slot])
        for b, alone in enumerate(members):
            if len(alone) == 1:
                slot = next(rest)
                self.shift[b], self.slot_of_key[alone[0][0]] = -slot - 1, slot
        return True

    def slot(self, key: bytes) -> int:
        """The slot of a key of the set; some slot for any other."""
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        d = self.shift[(h >> 64) % self.buckets]
        return -d - 1 if d < 0 else ((h & 0xFFFFFFFF) + d * (h >> 32 & 0xFFFFFFFF | 1) & 0xFFFFFFFF) * self.n >> 32


class BytePairs:
    """Encoder and decoder over the ranks of a public vocabulary, which must hold all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.find = regex.compile(pattern).findall
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.slot_key: list[bytes] = [b""] * len(keys)
        self.slot_id = [0] * len(keys)
        for key, slot in zip(keys, self.hash.slot_of_key, strict=True):
            self.slot_key[slot], self.slot_id[slot] = key, ranks[key]
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.token = {i: k for k, i in ranks.items()}
        #: Rank of each pair of ranks whose joined bytes are a token.
        self.pair = {
            ranks[k[:i]] << 32 | ranks[k[i:]]: r
            for k, r in ranks.items()
            for i in range(1, len(k))
            if k[:i] in ranks and k[i:] in ranks
        }

    def whole(self, data: bytes) -> int | None:
        """First tier: the id of a pre-token that is a token."""
        slot = self.hash.slot(data)
        return self.slot_id[slot] if self.slot_key[slot] == data else None

    def merged(self, data: bytes) -> list[int]:
        """Second tier: the pair of lowest rank is joined first, of equal ones the leftmost, until none is a token."""
        ids = list(map(self.byte_id.__getitem__, data))
        n, pair = len(ids), self.pair.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = pair(ids[i] << 32 | ids[i + 1])
            if r is not None:
                heap.append(r << 32 | i)
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if j >= n or ids[i] < 0 or pair(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                new = pair(r << 32 | ids[k])
                if new is not None:
                    heappush(heap, new << 32 | i)
            p = before[i]
            if p >= 0:
                new = pair(ids[p] << 32 | r)
                if new is not None:
                    heappush(heap, new << 32 | p)
        return [x for x in ids if x >= 0]

    def piece(self, data: bytes) -> list[int]:
        known = self.whole(data)
        return self.merged(data) if known is None else [known]

    def encode(self, text: str) -> list[int]:
        return [x for p in self.find(text) for x in self.piece(p.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@functools.cache
def _coder(path: str, pattern: str) -> tuple[BytePairs, ChunkMemo]:
    coder = BytePairs(read_ranks(path), pattern)

    def solve(chunks: list[str]) -> list[bytes]:
        pieces: dict[str, bytes] = {}
        out = []
        for found in map(coder.find, chunks):
            for p in found:
                if p not in pieces:
                    pieces[p] = array("I", coder.piece(p.encode())).tobytes()
            out.append(b"".join(map(pieces.__getitem__, found)))
        return out

    return coder, ChunkMemo(solve, MEMO)


def encode_decode(documents: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """The other columns of ``documents`` with ``n_tokens, ids_sha256, decoded_sha256``.

    The ids are those of the rank file for each match of ``pattern``, without special tokens; ``ids_sha256`` is over them as
    little-endian unsigned 32-bit integers, ``decoded_sha256`` over the bytes that the ids decode to. Null and empty texts
    have no ids. Texts are coded where they lie, without a shuffle; each worker keeps a bounded memo of chunks and holds
    one group of segments at a time, however long a text is. Rows that repeat are coded each; columns of ``documents``
    with the added names are replaced. The rank file must have the same path on all executors.
    """
    keep = [c for c in documents.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
    source = documents.select(*keep, F.col(text).alias("_text"))
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, memo = _coder(ranks_path, pattern)
        for b in batches:
            counts = [0] * b.num_rows
            ids_sha = [hashlib.sha256() for _ in counts]
            text_sha = [hashlib.sha256() for _ in counts]
            for i, packed in memo.joined(b.column(len(keep))):
                counts[i] += len(packed) // 4
                ids_sha[i].update(packed)
                text_sha[i].update(coder.decode(np.frombuffer(packed, dtype="<u4").tolist()))
            added = [
                pa.array(counts, pa.int64()),
                pa.array([h.hexdigest() for h in ids_sha], pa.string()),
                pa.array([h.hexdigest() for h in text_sha], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *added], names=names)

    fields = [f"`{c}` {t}" for c, t in source.dtypes if c != "_text"]
    return source.mapInArrow(run, ", ".join([*fields, "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]))
