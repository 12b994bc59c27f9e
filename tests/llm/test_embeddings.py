import numpy as np

from framewell.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int"


def brute(rows):
    def fine(i, v, label):
        return i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    good = [fine(*r[:3]) for r in rows]
    vecs = [np.array(r[1], dtype=np.float32).astype(np.float64) if g else None for r, g in zip(rows, good)]
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(vecs[i]) == len(vecs[j]):
                if vecs[i] @ vecs[j] / np.sqrt((vecs[i] @ vecs[i]) * (vecs[j] @ vecs[j])) >= 0.93:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), least, least is not None and least == rows[i][0]))
    return sorted(map(str, out))


def test_links_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(30):
            rows.append((len(rows), (centre + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.42])).tolist(), c % 3))
    rows += [(1000 + k, rows[5][1], 0) for k in range(40)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [None] + [1.0] * 15, 1)]
    rows += [(2005, [float("inf")] * 16, 1), (2006, rows[0][1], None), (None, rows[0][1], 0), (3, rows[3][1], rows[3][2]), (2007, [1.0, 2.0], 0)]
    rows += [(2008, [x * 1e-30 for x in rows[0][1]], 0), (2009, [x * 1e30 for x in rows[0][1]], 0), (2010, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA).repartition(4)
    monkeypatch.setattr(embeddings, "EXACT", 64)
    for tile in (1024, 16):
        monkeypatch.setattr(embeddings.link_tiles, "__defaults__", (0.93, tile))
        got = embeddings.near_duplicate_vectors(df).collect()
        assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == brute(rows)
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_bounds_hold_and_no_pair_is_missed():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 24))
    x[200:] = x[:200] + rng.normal(size=(200, 24)) * np.linspace(0.01, 0.8, 200)[:, None]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    codes, scale, error, length = embeddings.quantised(u)
    near = (codes.astype(int) @ codes.T.astype(int)) * scale[:, None] * scale
    assert (np.abs(u @ u.T - near) <= length[:, None] * error + error[:, None] + 1e-12).all()
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.93, 1)))}
    assert set(zip(*embeddings.linked_pairs(x, x, 0.93, True))) == want and want


def test_very_large_and_very_small_vectors_link(spark):
    base = [[1.0, 1.0], [1.0, 1.1], [1.0, -1.0]]
    rows = [(10 * k + i, [x * size for x in v], k) for k, size in enumerate((1.0, 1e200, 1e-200, 1e-310)) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(df).collect()}
    assert got == {10 * k + i: (1, 10 * k) if i < 2 else (0, 10 * k + 2) for k in range(4) for i in range(3)}
