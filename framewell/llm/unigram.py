"""Token counts of a unigram model: forward scores over a trie of pre-tokens, once for each shared prefix."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm.bpe import read_ranks
from framewell.llm.chunks import ChunkMemo

#: Offset of the Zipf-Mandelbrot law that gives the token of rank r the weight 1 / (r + offset).
OFFSET = 2.7


def log_weights(ranks: dict[bytes, int], offset: float = OFFSET) -> dict[bytes, float]:
    """Log probabilities of the tokens of a public vocabulary by their ranks."""
    total = math.log(math.fsum(1 / (r + offset) for r in ranks.values()))
    return {t: -math.log(r + offset) - total for t, r in ranks.items()}


class Vocabulary:
    """Tokens as a trie of their reversed bytes: walking back from a place meets all tokens that end there."""

    def __init__(self, weights: dict[bytes, float]) -> None:
        self.child: dict[int, int] = {}
        self.weight: list[float | None] = [None]
        for token, w in weights.items():
            state = 0
            for b in reversed(token):
                step = state << 8 | b
                state = self.child.get(step, 0)
                if not state:
                    state = self.child[step] = len(self.weight)
                    self.weight.append(None)
            self.weight[state] = w


class PretokenTrie:
    """Trie of distinct pre-tokens. A node holds the best score of its prefix over all ways to cut it into tokens, and how
    many tokens that way has (of equal scores, the fewest). Both are set when the node is made, so a prefix that many
    pre-tokens share is scored once; at the end of a pre-token they are its terminal counts."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def insert(self, data: bytes) -> int:
        """The node at the end of ``data``."""
        child, best, count = self.child, self.best, self.count
        back, weight = self.vocabulary.child.get, self.vocabulary.weight
        node, path = 0, [0]
        for j, b in enumerate(data):
            step = node << 8 | b
            node = child.get(step, 0)
            if not node:
                top, fewest, state = -math.inf, 0, 0
                for i in range(j, -1, -1):
                    state = back(state << 8 | data[i])
                    if state is None:
                        break
                    w = weight[state]
                    if w is not None:
                        before = path[i]
                        score = best[before] + w
                        if score > top or score == top and count[before] + 1 < fewest:
                            top, fewest = score, count[before] + 1
                node = child[step] = len(best)
                best.append(top)
                count.append(fewest)
            path.append(node)
        return node


@functools.cache
def _counter(path: str, pattern: str) -> ChunkMemo:
    vocabulary = Vocabulary(log_weights(read_ranks(path)))
    find = regex.compile(pattern).findall

    def solve(chunks: list[str]) -> list[bytes]:
        trie, ends = PretokenTrie(vocabulary), {}
        values = []
        for found in map(find, chunks):
            for p in found:
                if p not in ends:
                    ends[p] = trie.insert(p.encode())
            nodes = [ends[p] for p in found]
            value = (len(nodes), sum(trie.count[n] for n in nodes), sum(trie.best[n] for n in nodes))
            values.append(np.array(value, dtype="<f8").tobytes())
        return values

    return ChunkMemo(solve)


def token_counts(documents: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """The other columns of ``documents`` with ``n_pretokens, n_tokens, score``.

    ``pattern`` cuts a whole text into pre-tokens. Each is cut into the tokens of the rank file that give the highest sum of
    log probabilities, of equal sums into the fewest; ``n_tokens`` and ``score`` add up over the pre-tokens. The vocabulary
    must hold all single bytes. Null and empty texts count nothing. Texts are counted where they lie, without a shuffle: a
    trie holds the new pre-tokens of one group of texts, and a bounded memo keeps terminal counts for the next groups. Rows
    that repeat are counted each; columns of ``documents`` with the added names are replaced.
    """
    added = ["n_pretokens", "n_tokens", "score"]
    keep = [c for c in documents.columns if c not in (text, *added)]
    source = documents.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _counter(ranks_path, pattern)
        for b in batches:
            sums = np.zeros((b.num_rows, 3))
            for i, packed in memo.joined(b.column(len(keep))):
                sums[i] += np.frombuffer(packed, dtype="<f8").reshape(-1, 3).sum(axis=0)
            counts = [pa.array(sums[:, k].astype(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], *counts, pa.array(sums[:, 2])], names=[*keep, *added]
            )

    fields = [f"`{c}` {t}" for c, t in source.dtypes if c != "_text"]
    return source.mapInArrow(run, ", ".join([*fields, "n_pretokens long", "n_tokens long", "score double"]))
