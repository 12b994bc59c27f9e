import brute
import numpy as np
import pytest

from framewell.llm import mixing


def data(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    return rows, labels


def test_rates_match_brute_force(spark):
    rows, labels = data(spark, "/root/testdata/sf0.01")
    rows += [(None, None), (7777, ""), (7778, " \n"), (3, rows[3][1]), (7779, "# | " * 4000), (None, "null id")]
    labels += [(None, 1, 1), (5, None, None), (labels[0][0], 0, 1), (123_456_789, 1, 0)]
    df = spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id long, text string, rate string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = mixing.mixture_rates(df, lab)
    assert got.columns == ["doc_id", "n_tokens", "p_good", "p_low", "p_toxic", "rate", "copies"]
    want = brute.mixture(rows, labels)
    mine = sorted(((str(r.doc_id), r.n_tokens, [round(100 * r[f"p_{d}"]) for d in mixing.DOMAINS], r.rate, r.copies) for r in got.collect()), key=str)
    plain = sorted(((str(d), *w) for (d, _), w in zip(rows, want)), key=str)
    assert [m[:3] for m in mine] == [p[:3] for p in plain]
    assert [m[3] for m in mine] == pytest.approx([p[3] for p in plain], abs=1e-6)
    assert [m[4] for m in mine] == [p[4] for p in plain]
    drawn = mixing.mix(df, lab)
    assert drawn.columns == df.columns
    assert sorted(str((r.doc_id, r.text)) for r in drawn.collect()) == sorted(
        str(row) for row, w in zip(rows, want) for _ in range(w[3])
    )


def test_targets_are_met_and_the_classifier_holds_out(spark):
    folder = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = mixing.mixture_rates(documents, labels.filter("doc_id % 2 = 0")).cache()
    for d, share in mixing.SHARES.items():
        base, now = got.selectExpr(f"sum(n_tokens * p_{d})", f"sum(n_tokens * p_{d} * rate)").first()
        assert now == pytest.approx(share * base, rel=1e-4)
    held = got.join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("quality = 1")
    right = held.selectExpr("avg(cast((p_toxic >= p_good) = (toxic = 1) as int))").first()[0]
    assert right > 0.9


def test_empty_tables_and_no_labels(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.copies >= 0 for r in mixing.mixture_rates(df, none).collect()] == [True, True]
    assert mixing.mixture_rates(df.limit(0), none).count() == 0
    assert mixing.mix(df.limit(0), none).count() == 0


def stationary(cells, shares, pull):
    """Largest violation of the conditions of a least-squares answer over rates of at least zero."""
    p, tokens = np.array([q for q, _ in cells]) / 100, np.array([n for _, n in cells], float)
    base = tokens @ p
    rates = np.maximum(0, 1 - p @ np.array(pull))
    gaps = ((tokens * rates) @ p - np.array(shares) * base) / np.where(base > 0, base, 1)
    slope = p @ gaps
    return rates, gaps, np.abs(np.where(rates > 0, slope, np.minimum(slope, 0))).max()


@pytest.mark.parametrize(
    ("cells", "met"),
    [
        ([((100, 0, 0), 1000), ((97, 3, 0), 100), ((5, 0, 95), 50)], True),
        ([((43, 57, 0), 70), ((57, 43, 0), 90)], False),
        ([((43, 57, 0), 70), ((57, 43, 0), 90), ((0, 0, 100), 0)], False),
        ([((99, 1, 0), 10**12), ((1, 99, 0), 3), ((0, 1, 99), 10**7)], False),
        ([((100, 0, 0), 0)], True),
    ],
)
def test_steps_end_at_a_least_squares_answer(spark, cells, met):
    shares = list(mixing.SHARES.values())
    df = spark.createDataFrame([(list(q), n) for q, n in cells], "q array<int>, n_tokens long")
    pull, told = mixing.fit_rates(df, shares)
    rates, gaps, violation = stationary(cells, shares, pull)
    assert violation < 1e-5 and told == pytest.approx(list(gaps), abs=1e-9)
    assert (np.abs(gaps).max() < 1e-4) == met
    rng = np.random.default_rng(1)
    p, tokens = np.array([q for q, _ in cells]) / 100, np.array([n for _, n in cells], float)
    base = tokens @ p

    def loss(r):
        return (((tokens * r) @ p - np.array(shares) * base) ** 2 / np.where(base > 0, base, 1)).sum()

    for _ in range(200):  # no other rates do better
        other = np.maximum(0, rates + rng.normal(size=len(rates)) * rng.choice([1e-3, 0.1, 1]))
        assert loss(rates) <= loss(other) + 1e-5 * base.sum()


def test_targets_that_cannot_be_met_are_reported(spark):
    docs = spark.createDataFrame([(i, "plain words of a text") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="target of domain low not met"):
        mixing.mixture_rates(docs, labels).collect()
