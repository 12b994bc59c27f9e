"""Re-Pair grammars over token ids: frequent neighbours become nonterminals, with expansion lengths for random access."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd

_MAGIC = b"RPR1"


def _apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the ascending ``places`` of pairs of two equal symbols do not overlap the one before: of each run of places
    that follow each other every second one, from the first on."""
    run = np.ones(places.size, dtype=bool)
    run[1:] = after[places[:-1]] != places[1:]
    at = np.arange(places.size)
    return (at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 0


def _recurring(code: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places whose code recurs, a number from zero on for each such code, and the codes by number."""
    which, codes = pd.factorize(code)  # by a hash table, in order of appearance
    again = np.bincount(which, minlength=codes.size) > 1
    number = np.cumsum(again, dtype=np.int32) - 1
    kept = np.flatnonzero(again[which])
    return places[kept], number[which[kept]], codes[again]


def compress(ids: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(symbols, rules, lengths)``: ``rules[i]`` are the two symbols of nonterminal ``terminals + i``, which stands for
    ``lengths[i]`` ids.

    In each round the pairs that recur are counted, a run of one symbol by the pairs that fit into it side by side. A
    place is replaced if its pair comes before both pairs that overlap it: the more frequent first, of equal ones
    by the pair's number, so that copies of a passage are parted alike. The first pair of all keeps all its places, so each
    round names one at least. The rounds end when no pair recurs.

    The symbols are linked, and the lists hold the places of pairs that recur, with the number of the pair. A replaced place
    changes the pairs beside it, and these hold a new symbol: they are new pairs, so only they are counted among themselves.
    Other pairs lose places and gain none, so what no longer recurs is left for good.
    """
    n = ids.size
    seq = ids.astype(np.uint32)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    places, pair, codes = _recurring(_codes(seq[:-1], seq[1:]), after[:-1] - 1)
    rules, lengths = [np.zeros((0, 2), np.int64)], np.ones(terminals, dtype=np.int64)
    here = np.zeros(n + 2, dtype=np.int64)  # of the pair at each place; the last two are beyond both ends
    gone = np.zeros(n, dtype=bool)
    while places.size:
        two = np.stack([codes >> 32, codes & 0xFFFFFFFF], axis=1)
        counts = np.bincount(pair, minlength=codes.size)
        over = np.zeros(0, dtype=np.int64)  # pairs of a run of one symbol that overlap a counted one
        if (equal := two[:, 0] == two[:, 1]).any():
            twin = np.flatnonzero(equal[pair])
            twin = twin[np.argsort(places[twin])]
            over = twin[~_apart(places[twin], after)]
            counts -= np.bincount(pair[over], minlength=codes.size)
        rank = (counts << 32) | (np.arange(codes.size) * 0x9E3779B1 & 0xFFFFFFFF)  # an odd factor: no two are equal
        rank[counts < 2] = 0
        own = rank[pair]
        own[over] = 0
        here[places] = own
        right = after[places]
        wins = np.flatnonzero((own > here[right]) & (own > here[before[places]]))
        here[places] = 0
        won = pair[wins]
        named = np.bincount(won, minlength=codes.size) > 1
        if not named.any():
            break
        kept = named[won]
        wins, won = wins[kept], won[kept]
        at, right = places[wins], right[wins]
        name = np.cumsum(named) - 1
        two = two[named]
        rules.append(two)
        seq[at] = lengths.size + name[won]
        lengths = np.concatenate([lengths, lengths[two].sum(axis=1)])
        after[at] = beyond = after[right]
        inner = beyond < n
        before[beyond[inner]] = at[inner]
        gone[right] = True
        # pairs at and before a new symbol are new, all others keep their number while they recur
        beside = np.zeros(n + 1, dtype=bool)
        beside[at] = beside[before[at]] = True
        stale = beside[:n] | gone
        again = counts > 1
        left = np.flatnonzero(again[pair] & ~stale[places])
        fresh = np.flatnonzero(beside[:n]).astype(np.int32)
        fresh = fresh[(after[fresh] < n) & ~gone[fresh]]
        new, number, more = _recurring(_codes(seq[fresh], seq[after[fresh]]), fresh)
        old = np.cumsum(again, dtype=np.int32) - 1
        codes = codes[again]
        places = np.concatenate([places[left], new])
        pair = np.concatenate([old[pair[left]], np.int32(codes.size) + number])
        codes = np.concatenate([codes, more])
    return seq[~gone], np.concatenate(rules), lengths[terminals:]


def _codes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Both symbols of each pair in one number."""
    return (left.astype(np.int64) << 32) | right


def _width(symbols: int) -> int:
    """Bytes of a symbol."""
    return 3 if symbols <= 1 << 24 else 4


def _packed(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 4), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return wide.view("<u4").reshape(-1).astype(np.int64 if width == 4 else np.int32)


def pack_shard(ids: np.ndarray, ends: np.ndarray, names: np.ndarray, named: np.ndarray, terminals: int) -> bytes:
    """One shard: names of its documents (64-bit integers, and which are null), their ends in ids, the rules with their
    expansion lengths, the symbols."""
    symbols, rules, lengths = compress(ids, terminals)
    head = struct.pack("<4sIQQQ", _MAGIC, terminals, ends.size, len(rules), symbols.size)
    columns = [names.astype("<i8"), ends.astype("<i8"), named.astype("u1")]
    columns = [c.tobytes() for c in columns]
    width = _width(terminals + len(rules))
    return b"".join(
        [head, *columns, _packed(rules.reshape(-1), width), lengths.astype("<u4").tobytes(), _packed(symbols, width)]
    )


class Shard:
    """A shard in memory; any range of its ids is decoded from the symbols that cover it."""

    def __init__(self, data: bytes) -> None:
        magic, terminals, docs, rules, symbols = struct.unpack_from("<4sIQQQ", data)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<4sIQQQ")
        self.names = np.frombuffer(data, "<i8", docs, at)
        self.ends = np.frombuffer(data, "<i8", docs, at + 8 * docs)
        self.named = np.frombuffer(data, "u1", docs, at + 16 * docs).astype(bool)
        at += 17 * docs
        width = _width(terminals + rules)
        self.left, self.right = _unpacked(data[at : at + 2 * width * rules], width).reshape(-1, 2).T.copy()
        at += 2 * width * rules
        own = np.frombuffer(data, "<u4", rules, at).astype(np.int64)
        at += 4 * rules
        self.symbols = _unpacked(data[at : at + width * symbols], width)
        self.terminals = terminals
        self.lengths = np.concatenate([np.ones(terminals, dtype=np.int64), own])
        self.stops = np.cumsum(self.lengths[self.symbols])
        small = np.int32 if not self.stops.size or self.stops[-1] < 1 << 31 else np.int64
        self.lengths = self.lengths.astype(small)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids ``start`` to ``stop`` of the shard.

        The rules of the symbols that cover the range are descended level by level; the expansion length of a left half
        tells where the right one starts, so halves outside the range are left and no other rule is touched.
        """
        out = np.empty(max(stop - start, 0), dtype="<u4")
        if not out.size:
            return out
        a = int(np.searchsorted(self.stops, start, side="right"))
        b = int(np.searchsorted(self.stops, stop, side="left")) + 1
        part = self.symbols[a:b]
        place = (self.stops[a:b] - self.lengths[part] - start).astype(self.lengths.dtype)
        clipped = place[0] < 0 or self.stops[b - 1] > stop
        while part.size:
            named = part >= self.terminals
            done, rest = np.flatnonzero(~named), np.flatnonzero(named)
            out[place[done]] = part[done]
            rule, place = part[rest] - self.terminals, place[rest]
            left, right = self.left[rule], self.right[rule]
            part, place = np.concatenate([left, right]), np.concatenate([place, place + self.lengths[left]])
            if clipped:
                inside = (place < out.size) & (place + self.lengths[part] > 0)
                part, place = part[inside], place[inside]
        return out
