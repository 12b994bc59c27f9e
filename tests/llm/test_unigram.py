import math
import random

import public_tokenizers
import pytest
import regex

from framewell.llm import unigram
from framewell.llm.bpe import read_ranks

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def weights():
    return unigram.log_weights(read_ranks(RANKS))


def brute(data, weights):
    best = [(0.0, 0)] + [None] * len(data)
    for j in range(1, len(data) + 1):
        ways = [(best[i][0] + weights[data[i:j]], -best[i][1] - 1) for i in range(j) if data[i:j] in weights]
        score, fewest = max(ways)
        best[j] = score, -fewest
    return best[-1]


def test_trie_scores_equal_scoring_each_word_alone(weights):
    assert math.fsum(map(math.exp, weights.values())) == pytest.approx(1)
    rng = random.Random(6)
    words = {" ".join(rng.choices(["th", "er", "on", "é", "1", "!", "ing"], k=rng.randrange(1, 6))).encode() for _ in range(300)} | {b"a" * 300}
    trie = unigram.PretokenTrie(unigram.Vocabulary(weights))
    for w in sorted(words, key=lambda _: rng.random()):
        node = trie.insert(w)
        assert (trie.best[node], trie.count[node]) == pytest.approx(brute(w, weights), abs=1e-9)
    assert len(trie.best) == len({w[:i] for w in words for i in range(len(w) + 1)})


def test_counts_of_documents(spark, sf_dir, weights):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows += [(None, None), (900, ""), (901, " \n\n x  y\t"), (901, " \n\n x  y\t"), (902, "don't   stop " * 2000)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    got = unigram.token_counts(df, RANKS, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_pretokens", "n_tokens", "score"]
    known = {}
    want = []
    for i, t in rows:
        found = regex.findall(public_tokenizers.PATTERN, t or "")
        for p in found:
            if p not in known:
                known[p] = brute(p.encode(), weights)
        want.append((i, len(found), sum(known[p][1] for p in found), round(sum((known[p][0] for p in found), 0.0), 4)))
    mine = [(r.doc_id, r.n_pretokens, r.n_tokens, round(r.score, 4)) for r in got.collect()]
    assert sorted(map(str, mine)) == sorted(map(str, want))
    assert unigram.token_counts(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
