import random
from collections import Counter

import numpy as np
import xxhash

from framewell.llm import simhash
from framewell.llm.components import connected_components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    group = {p: p for p in prints}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                group[root(a)] = root(b)
    return {p: root(p) for p in prints}


def check(rows, got):
    prints = {i: brute_print(t) for i, t in rows}
    groups = brute_groups(set(prints.values()))
    least = {}
    for i, p in prints.items():
        if i is not None:
            least[groups[p]] = min(i, least.get(groups[p], i))
    assert Counter((i, f"{brute_print(t):016x}", least.get(groups[brute_print(t)])) for i, t in rows) == Counter(
        (r.doc_id, r.fingerprint, r.component_id) for r in got
    )


def test_near_duplicates_match_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    base = next(t for _, t in rows if len(t.split()) > 300).split()
    rng = random.Random(5)
    for k in range(60):
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(len(near))] = f"odd{k}"
        rows.append((1000 + k, " ".join(near)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "Two Words"), (2004, "two words"), (2003, "Two Words"), (2005, "é É " * 20000)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    check(rows, got)


def test_null_ids_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a b c", 1), (None, "a b c", 1), (None, "x y z w", 2)], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    assert [r.component_id for r in got] == [None] * 3
    assert simhash.keep_first(df).count() == 2
    assert simhash.keep_first(df).columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_close_pairs_find_all_links_across_tiles(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 300:
        prints.add(rng.choice(sorted(prints)) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    prints |= {rng.getrandbits(64) for _ in range(300)}
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    for tile in (2048, 7):
        found = connected_components(simhash.close_pairs(df, tile=tile)).collect()
        mine = {r.node % 2**64: r.component for r in found}
        groups = brute_groups(prints)
        sizes = Counter(groups.values())
        assert set(mine) == {p for p in prints if sizes[groups[p]] > 1}
        assert Counter(Counter(mine.values()).values()) == Counter(n for n in sizes.values() if n > 1)


def test_keep_first_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (9, "other words stand here", "c"), (None, text, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.lang) for r in simhash.keep_first(df).collect()) == [(3, "b"), (9, "c")]


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 400)] + [(1, i) for i in range(2, 50)] + [(7, 7), (1000, 999), (999, 1000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 401)} | {i: 1 for i in range(1, 50)} | {999: 999, 1000: 999}
