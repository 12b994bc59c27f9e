import math

import numpy as np
import pytest

from framewell.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, _x int, error int"


def exact_distances(x, c):
    return ((x.astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(axis=2)


def nearest(x, c):
    d = exact_distances(x, c)
    return np.array([min(range(len(c)), key=lambda j: (row[j], j)) for row in d]), d


def means(x, c, assigned):
    new = c.copy()
    for e in set(assigned.tolist()):
        own = x[assigned == e].astype(object).sum(axis=0)
        new[e] = [int(s) // int((assigned == e).sum()) for s in own]
    return new


def brute(rows, scale=codes.SCALE):
    """``rows`` that take part, in order of vec_id: codes, errors and codebooks."""
    x = np.array([[math.floor(scale * v) for v in e] for _, e, _ in rows], dtype=np.int64)
    out, errors, books = [], 0, []
    for part in np.split(x, 8, axis=1):
        book = part[:16].copy()
        for _ in range(6):
            book = means(part, book, nearest(part, book)[0])
        a, d = nearest(part, book)
        out.append(a)
        errors = errors + d[np.arange(len(a)), a]
        books.append(book)
    return ["".join(f"{a[i]:02x}" for a in out) for i in range(len(rows))], [int(e) for e in errors], np.array(books)


def clustered(rng, n, dims):
    centres = rng.normal(size=(20, dims)) / 8
    vectors = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, dims)) * rng.choice([0, 0.01, 0.1], (n, 1))
    return [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(vectors)]


@pytest.mark.parametrize(("n", "dims"), [(300, 16), (9, 8), (1, 24)])
def test_codes_match_brute_force(spark, n, dims):
    rows = clustered(np.random.default_rng(n), n, dims)
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA).repartition(3)
    found, books = codes.compress(df)
    want_codes, want_errors, want_books = brute(rows)
    got = {r.vec_id: (r.code, r.error, r.label) for r in found.collect()}
    assert got == {i: (c, e, label) for (i, _, label), c, e in zip(rows, want_codes, want_errors)}
    assert (books == want_books).all()


def test_rows_that_take_no_part_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1] * 8, 0), (1, [0.1] * 8, 0), (2, [-0.1] * 8, None), (None, [0.5] * 8, 1), (None, [0.5] * 8, 1)]
    odd = [(3, None, 0), (4, [], 0), (5, [None] * 8, 0), (6, [nan] * 8, 0), (7, [inf] * 8, 0), (8, [1.0] * 16, 0), (9, [1.0] * 7, 0), (0, [1e300] * 8, 0)]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in good + odd], SCHEMA)
    found, books = codes.compress(df)
    want, errors, want_books = brute(good)
    assert sorted(str((r.vec_id, r.code, r.error)) for r in found.collect()) == sorted(str((r[0], c, e)) for r, c, e in zip(good, want, errors))
    assert (books == want_books).all()
    none, empty = codes.compress(df.filter("vec_id = 6"))
    assert none.count() == 0 and empty.size == 0 and none.columns == found.columns


def test_bounds_hold_and_save_distances():
    """Over rounds of moving entries, with many ties and with components so large that doubles do not hold the sums."""
    rng, spared, all_parts = np.random.default_rng(3), 0, 0
    for _ in range(40):
        n, k, d = int(rng.integers(1, 300)), int(rng.integers(1, 17)), int(rng.integers(1, 9))
        size = int(rng.choice([3, 50, 2000, 1 << 27]))
        x = rng.integers(-size, size, (n, d)).astype(np.int64)
        c = x[rng.integers(0, n, k)].copy()
        keep = min(max(1, k // 4), k - 1)
        state = codes.first_bounds(x, c, keep)
        for _ in range(6):
            want, dist = nearest(x, c)
            assert (state.assigned == want).all()
            true = np.sqrt(dist.astype(np.float64))
            assert (state.upper >= true[np.arange(n), want]).all()
            for j in range(keep):
                assert (state.lower[:, j] <= true[np.arange(n), state.closest[:, j]]).all()
            rest = true.copy()
            rest[np.arange(n), want] = np.inf
            for j in range(keep):
                rest[np.arange(n), state.closest[:, j]] = np.inf
            assert (state.lower[:, -1] <= rest.min(axis=1)).all()
            new = means(x, c, want)
            fewer = codes.fewer_kept(np.bincount(state.level, minlength=keep + 2), keep, k)
            state = codes.next_bounds(x, new, codes._moves(c[None], new[None])[0].astype(np.float64), state, fewer)
            c, keep = new, fewer
            spared, all_parts = spared + (state.level == 0).sum(), all_parts + n
    assert 2 * spared > all_parts


def test_bounds_that_only_rare_parts_reach_are_dropped():
    assert codes.fewer_kept(np.array([5000, 900, 100, 2, 0, 0]), 4, 16) == 2
    assert codes.fewer_kept(np.array([5000, 900, 0, 0, 900, 9]), 4, 16) == 4
    assert codes.fewer_kept(np.array([5000, 0, 0, 0, 0, 900]), 4, 16) == 2
