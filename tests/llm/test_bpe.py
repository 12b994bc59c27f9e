import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from framewell.llm import bpe, chunks
from framewell.llm.chunks import CUT, ChunkMemo, segments

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "  ", "a  b", "\n\n a\n b \n", "don't we'll\tx", "\x1c!\x1d a", "é  x  y", "12 34,5 !? #$%", "日本語 テキスト", "a" * 5000, " \n" * 300, "<|endoftext|> x"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.BytePairs(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


def test_perfect_hash_gives_each_key_its_slot():
    for n in (1, 2, 7, 1000):
        keys = [f"k{i}".encode() for i in range(n)]
        h = bpe.PerfectHash(keys)
        assert sorted(h.slot(k) for k in keys) == list(range(n))


def test_encode_equals_public_library(coder, reference):
    rng = random.Random(3)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "1", "22", ",", "'s", "'", "!", " ", "\x1c", "word", "日", "🙂"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(1500)]
    for t in texts:
        ids = reference.encode_ordinary(t)
        assert coder.encode(t) == ids, repr(t)
        assert [x for c in CUT.split(t) for x in coder.encode(c)] == ids, repr(t)
        assert coder.decode(ids) == t.encode()


def test_memo_is_bounded_and_parts_join(monkeypatch):
    memo = ChunkMemo(lambda chunks: [c.encode() for c in chunks], limit=3)
    texts = ["a b c d e", "", "a x\ny", "e d c b a", "p  q \n r", " lead", "trail ", "\ta", "x\u2003y z", "\n", "a\n\nb c"]
    for size in (1 << 22, 4):
        monkeypatch.setattr(chunks, "GROUP", size)
        out = [b""] * len(texts)
        for i, part in memo.joined(pa.array(texts)):
            out[i] += part
        assert [x.decode() for x in out] == texts
        assert len(memo.known) == 3
    long = "ab cd\n" * 7_000
    parts = list(segments(long, 1000))
    assert len(parts) > 1 and "".join(parts) == long


def test_chunks_of_odd_and_plain_texts_agree_with_cuts():
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choices(["a", "b ", " ", "\n", "\t", "c\n", "\u00a0", "\x1d"], k=rng.randrange(9))) for _ in range(2000)]
    found, codes, bounds = chunks._split(pa.array(texts, pa.large_string()))
    for t, a, b in zip(texts, bounds, bounds[1:]):
        assert [chunks.chunk_of(found[c]) for c in codes[a:b]] == CUT.split(t), repr(t)


def test_encode_decode_over_documents(spark, sf_dir, reference):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, None), (1, "same"), (1, "same")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    got = bpe.encode_decode(df, RANKS, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert bpe.encode_decode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
