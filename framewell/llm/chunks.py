"""Texts as chunks that a pattern tokenizer treats independently, with a bounded memo per Python worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A cut lies before a single blank or line feed between two characters that are not white space. The public pattern
#: ends a match there and starts the next one there, whatever stands further away.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Texts in which some blank or line feed is no cut, or with other white space.
_ODD = (
    r"[ \n][ \n]|^[ \n]|[ \n]$"
    r"|[\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
#: Bytes of texts whose chunks are held at once.
GROUP = 1 << 23


def segments(text: str, size: int | None = None) -> Iterator[str]:
    """Pieces of a long text that end at cuts."""
    at, size = 0, size or GROUP
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def groups(texts: pa.Array) -> Iterator[tuple[list[int], pa.Array]]:
    """Text numbers and segments in order, in groups of bounded size; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    sizes = pc.binary_length(texts).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if size > GROUP:
            if i > start:
                yield list(range(start, i)), texts.slice(start, i - start)
            for part in segments(texts[i].as_py()):
                yield [i], pa.array([part], pa.large_string())
            start, held = i + 1, 0
            continue
        held += size
        if held >= GROUP:
            yield list(range(start, i + 1)), texts.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(sizes):
        yield list(range(start, len(sizes))), texts.slice(start)


#: Marks the key of a chunk that is not led by a single blank; other keys leave the blank out, or start with a line feed.
_AS_IS = "\0"


def chunk_of(key: str) -> str:
    if key[:1] == _AS_IS:
        return key[1:]
    return key if key[:1] == "\n" else f" {key}"


class ChunkMemo:
    """Values of chunks; ``solve`` gives the values of chunks not known. The first ``limit`` distinct chunks stay for the
    life of the worker, others are solved anew for each group of texts that holds them."""

    def __init__(self, solve: Callable[[list[str]], list], limit: int = 400_000) -> None:
        self.solve, self.limit, self.known = solve, limit, {}

    def solved(self, texts: pa.Array) -> Iterator[tuple[list[int], list, np.ndarray, list[int]]]:
        """For each group of segments the text numbers, the values of its distinct chunks, the codes of all its chunks and
        the bounds of each segment among these."""
        for numbers, parts in groups(texts):
            keys, codes, bounds = _split(parts)
            values = list(map(self.known.get, keys))
            fresh = [i for i, v in enumerate(values) if v is None]
            if fresh:
                solved = self.solve([chunk_of(keys[i]) for i in fresh])
                room = self.limit - len(self.known)
                for i, value in zip(fresh, solved, strict=True):
                    values[i] = value
                if room > 0:
                    self.known.update((keys[i], values[i]) for i in fresh[:room])
            yield numbers, values, codes, bounds

    def run(self, texts: pa.Array) -> Iterator[tuple[int, list, np.ndarray]]:
        """``(text number, values, codes)`` in order: ``values[c] for c in codes`` are those of the chunks of a segment.
        A long text has several segments."""
        for numbers, values, codes, bounds in self.solved(texts):
            for i, a, b in zip(numbers, bounds[:-1], bounds[1:], strict=True):
                yield i, values, codes[a:b]

    def ids(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """``(text number, ids)`` of each segment, for values that are bytes of ids; a group is put together at once."""
        for numbers, values, codes, bounds in self.solved(texts):
            flat = np.frombuffer(b"".join(values), dtype="<u4")
            sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
            starts, taken = np.cumsum(sizes) - sizes, sizes[codes]
            stops = np.concatenate([[0], np.cumsum(taken)])
            found = flat[np.arange(stops[-1]) + np.repeat(starts[codes] - stops[:-1], taken)]
            edges = stops[bounds].tolist()
            for i, a, b in zip(numbers, edges[:-1], edges[1:], strict=True):
                yield i, found[a:b]

    def joined(self, texts: pa.Array) -> Iterator[tuple[int, bytes]]:
        """``(text number, joined values)`` of each segment, for values that are bytes."""
        for i, values, codes in self.run(texts):
            yield i, b"".join(map(values.__getitem__, codes.tolist()))


def _split(parts: pa.Array) -> tuple[list[str], np.ndarray, list[int]]:
    """Keys of the distinct chunks of a group, the codes of all chunks in order, and the bounds of each part among them."""
    odd = pc.match_substring_regex(parts, _ODD)
    special = odd.to_numpy(zero_copy_only=False)
    plain = parts.filter(pc.invert(odd)) if special.any() else parts
    lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary
    one = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct)
    keys = pc.binary_join(one, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if len(distinct) else []
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    heads = np.cumsum(sizes) - sizes
    keys += [_AS_IS + keys[c] for c in codes[heads].tolist()]
    codes[heads] = len(keys) - heads.size + np.arange(heads.size)
    if not special.any():
        return keys, codes, [0, *np.cumsum(sizes).tolist()]
    out, bounds, rest = [], [0], iter(np.split(codes, heads[1:]) if heads.size else [])
    for i, apart in enumerate(special.tolist()):
        if apart:
            own = CUT.split(parts[i].as_py())
            out.append(np.arange(len(keys), len(keys) + len(own)))
            keys += [_AS_IS + c for c in own]
        else:
            out.append(next(rest))
        bounds.append(bounds[-1] + out[-1].size)
    return keys, np.concatenate(out), bounds
