import random
from pathlib import Path

import brute

from framewell.llm import lines
from framewell.session import shared_folder


def test_dropped_lines_match_brute_force(spark, sf_dir):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for i in range(40):
        parts = [f"Page {i} of {i * 7} seen by user{i} on the site today", f"Visit count is {rng.choice(['high', 'low', f'n{i}', 'new'])} for this page now"]
        parts += [" ".join(rng.choices(["red", "blue", "green", "one", "two", "three"], k=rng.randrange(6))) for _ in range(6)]
        parts += ["All rights reserved.", "", "  All   rights\treserved. ", f"unique line of document x{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} here"]
        rng.shuffle(parts)
        rows.append((5000 + i, "\n".join(parts)))
    rows += [(None, None), (6000, ""), (6001, "\n\n"), (6002, "All rights reserved.\n" * 3000), (5003, rows[-40 + 3][1])]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_lines int").repartition(4)
    got = lines.drop_template_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    want = [(d, *out) for (d, _), out in zip(rows, brute.drop_lines(rows))]
    mine = [tuple(r) for r in got.collect()]
    assert sorted(map(str, mine)) == sorted(map(str, want))
    assert sum(r[3] for r in mine) > 100
    assert lines.drop_template_lines(df.limit(0)).count() == 0


def test_first_document_keeps_the_line_and_rare_ones_stay(spark):
    rows = [(i, f"Share this article with 3 friends\nown text {i}\nonly nine have this line" if i < 9 else "Share this article with 5 friends") for i in range(12)]
    got = {r.doc_id: r.text for r in lines.drop_template_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[11] == ""
    assert got[4].split("\n")[-1] == "only nine have this line"


def test_templates_that_exact_counting_misses(spark):
    """Fields without digits, also among the leading tokens; passages, short lines and constant digits."""
    name = ["".join(random.Random(i).choices("abcdefghijk", k=8)) for i in range(40)]
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [
        (
            i,
            f"own first line {name[i]} {name[-i]}\n{name[i]} wrote on the wall of this page\nThe visitor {name[i]} likes all of it"
            f"\nMenu\nTel 0800 1234 5678\n{'x' * i} is short" + (f"\n{passage}" if i in (3, 7) else f"\n{passage} {name[i]}" if i == 9 else ""),
        )
        for i in range(30)
    ]
    rows += [(100 + i, "one text in copies\n" + passage.replace("word", "other")) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.drop_template_lines(df).collect()}
    assert got == {d: out[0] for (d, _), out in zip(rows, brute.drop_lines(rows))}
    assert got[0] == rows[0][1] and got[3].split("\n")[-1] == passage
    for i in (1, 5, 7, 29):
        assert not any(part in got[i] for part in ("wrote on", "The visitor", "Menu", "0800", passage)), got[i]
    assert passage in got[9]  # one word more is another line
    assert all(got[100 + i] == rows[-5 + i][1] for i in range(5))  # copies of one text are not passages shared by texts


def test_only_the_dropped_lines_stay_stored(spark):
    folder = Path(shared_folder(spark))
    before = set(folder.iterdir()) if folder.exists() else set()
    rows = [(i, f"Share this article with 3 friends\nown text {i}\nMenu") for i in range(12)]
    df = lines.drop_template_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before] == ["dropped_lines"]
    assert sum(r.n_dropped for r in df.collect()) == sum(r.n_dropped for r in df.collect()) == 33


def varied_rows(n):
    """Texts whose lines share a leaf and differ in their words; the first four of ten documents share a template."""
    rng = random.Random(5)
    pool = ["".join(rng.choices("abcdefghijk", k=6)) for _ in range(4000)]
    rows = []
    for i in range(n):
        own = " ".join(rng.sample(pool, 36))
        fixed = " ".join(f"{pool[0]}{'abcdefghij'[k % 10]}{k // 10 * 'z'}" for k in range(30))
        rows.append((i, f"read all about {own}" + (f"\nread all about {fixed} {' '.join(rng.sample(pool, 6))}" if i % 10 < 4 else "")))
    return rows


def test_leaves_dealt_by_token_match_brute_force(spark, monkeypatch):
    rows = varied_rows(60)
    want = {d: out for (d, _), out in zip(rows, brute.drop_lines(rows))}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(out[2] for out in want.values()) == 23
    for most in (lines.LEAF_TOKENS, 100):
        monkeypatch.setattr(lines, "LEAF_TOKENS", most)
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.drop_template_lines(df).collect()}
        assert got == want


def shuffled(spark):
    """Rows that all stages of the session have written to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = store.stageList(None, False, False, none, None)
    found = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in found)


def test_tokens_are_laid_out_after_the_shuffle(spark):
    """The lines of a leaf move as they are: rows in shuffles go with lines and not with tokens."""
    rows = varied_rows(300)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n_lines = sum(t.count("\n") + 1 for _, t in rows)
    before = shuffled(spark)
    lines.drop_template_lines(df)
    assert n_lines < shuffled(spark) - before < 30 * n_lines  # 39 tokens a line, in three shuffles before


def test_no_shuffle_files_stay_of_the_tables_on_the_way(spark):
    rows = [(i, f"Share this article with 3 friends\nown text {i}\nMenu") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles())}

    before = files()
    found = lines.drop_template_lines(df)
    assert not [f for f in files() - before if f.startswith("shuffle_")]
    assert sum(r.n_dropped for r in found.collect()) == 33
