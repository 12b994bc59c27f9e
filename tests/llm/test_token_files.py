import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from framewell.llm import repair, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_grammar_round_trip_and_random_access():
    rng = random.Random(2)
    words = [[rng.randrange(50_000) for _ in range(rng.randrange(1, 9))] for _ in range(40)]
    cases = [[], [5], [7] * 1000, [1, 2] * 500 + [2, 1] * 500, [x for _ in range(3000) for x in rng.choice(words)]]
    for ids in cases:
        a = np.array(ids, dtype="<u4")
        symbols, rules, _ = repair.compress(a, 50_257)
        data = repair.pack_shard(a, np.array([a.size]), np.array([3]), np.array([True]), 50_257)
        shard = repair.Shard(data)
        assert shard.ids(0, a.size).tolist() == ids
        for _ in range(50):
            i, j = sorted((rng.randrange(a.size + 1), rng.randrange(a.size + 1)))
            assert shard.ids(i, j).tolist() == ids[i:j]
    assert symbols.size < len(cases[-1]) // 3 and rules.size


def test_files_give_back_all_documents(spark, sf_dir, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(None, None), (999, ""), (999, "x"), (-5, "a  b\n\n c"), (7, rows[7][1]), (10**12, "word thing " * 150_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(7)
    coder = Tokenizer.from_file(PATH)
    want, crc = [], {}
    for i, t in rows:
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = token_files.tokenize_to_files(df, PATH, 2).collect()
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(str, want))
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (last is None or r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id
    assert token_files.tokenize_to_files(df.limit(0), PATH, 2).count() == 0


def test_no_pair_recurs_in_the_symbols():
    rng = random.Random(5)
    phrases = [[rng.randrange(50_000) for _ in range(6)] for _ in range(3000)]
    cases = [[1, 2, 3, 1, 2], [7] * 1001, [x for p in phrases * 2 for x in p], [rng.randrange(30) for _ in range(5000)]]
    for ids in cases:
        symbols, rules, _ = repair.compress(np.array(ids, dtype="<u4"), 50_257)
        last, places = {}, {}
        for i, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist())):
            if last.get(pair) != i - 1:  # overlapping pairs of one symbol count once
                last[pair] = i
                places[pair] = places.get(pair, 0) + 1
        assert max(places.values(), default=0) < 2
        assert rules.size
