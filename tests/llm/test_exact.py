import re

from pyspark.sql import functions as F

from framewell.llm import exact, tables

SCHEMA = "doc_id long, text string, bits int, word long, full string, n int, first int"


def plain(rows):
    norms = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for k, ((d, _), n) in enumerate(zip(rows, norms, strict=True)):
        groups.setdefault(n, []).append((d is None, d or 0, k))
    out = []
    for (d, _), n in zip(rows, norms, strict=True):
        late, keep, _ = min(groups[n])
        out.append((d, None if late else keep, len(groups[n])))
    return sorted(map(str, out)), len(groups)


def rows():
    long = "word " * 3000
    return [
        (5, "a  b"), (2, "a\tb"), (9, "a\n\x0b b"), (1, " a b"), (3, "a b "), (4, None), (7, ""), (8, " "), (6, "\r\n"),
        (10, long + "x"), (11, long + "y"), (12, long + " x"),  # equal prefixes and lengths, other ends
        (None, "only null"), (None, "only null"), (20, "same row"), (20, "same row"), (21, "A b"), (22, "a b"), (23, "a b"),
        (30, "one more"), (None, "one more"),
    ]


def test_copies_match_plain_form(spark, monkeypatch):
    df = spark.createDataFrame([(*r, 1, 2, "f", 3, 4) for r in rows()], SCHEMA).repartition(3)
    want, groups = plain(rows())
    for words, parts in ((1, 2), (1 << 17, 4096)):  # a full filter and few hot keys, or none of that
        monkeypatch.setattr(exact, "FILTER_WORDS", words)
        monkeypatch.setattr(tables, "HOT_PARTS", parts)
        got = exact.exact_copies(df).collect()
        assert sorted(str((r.doc_id, r.keep_id, r.group_size)) for r in got) == want
        assert sum(r.kept for r in got) == groups
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_full_text_is_hashed_for_surviving_groups_alone(spark):
    df = spark.createDataFrame([(i, f"{i:05d} text") for i in range(500)] + [(600, "twice"), (601, "twice")], "doc_id long, text string")
    measured = df.select(F.length("text").alias("length"), F.xxhash64("text").alias("prefix"))
    assert sum(bin(r.bits & (1 << 64) - 1).count("1") for r in exact.surviving(measured).collect()) == 1


def test_keep_first_keeps_all_columns(spark):
    df = spark.createDataFrame([(*r, 1, 2, "f", 3, 4) for r in rows()], SCHEMA)
    kept = exact.keep_first(df)
    assert kept.columns == df.columns
    assert kept.count() == plain(rows())[1]
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4, 6, 20, 30}
    assert {(r.bits, r.word, r.full, r.n, r.first) for r in kept.collect()} == {(1, 2, "f", 3, 4)}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_copies(none).count() == 0 and exact.keep_first(none).count() == 0
