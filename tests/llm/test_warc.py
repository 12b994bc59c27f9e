import gzip
import hashlib
import os

from framewell.llm import warc
from framewell.session import scratch_path


def test_round_trip_matches_brute_force(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    page = "x" * 150
    rows += [(900, None, None), (901, "", ""), (902, "http://a b\r\n.c/é\tq", page), (903, "no scheme", page), (800, "http://z.org", page)]
    rows += [(800, "http://z.org", page), (None, "http://z.org", page), (904, rows[0][1], rows[0][2]), (905, "http://z.org", "é" * 50), (906, "u://z", "é" * 50)]
    rows += [(907, "http://s.org", "short"), (908, "http://s.org", "short"), (909, "http://s.org", "long " * 100_000), (None, None, "null" * 40)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string").repartition(5)
    least = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            least[h] = min(i, least.get(h, i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = least.get(h) if len(data) >= 100 else None
        refers = first if first is not None and first != i else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    got = [tuple(r) for r in warc.archive_round_trip(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_index_finds_captures_over_block_and_shard_borders(spark):
    rows = [(f"org,h{i % 7})/", i // 3, f"f{i}", i, 1) for i in range(500)] + [("org,h1)/", None, "n", 0, 1)]
    df = spark.createDataFrame(rows, "key string, page_id long, file string, at long, length long").repartition(6)
    folder = scratch_path(spark, "index-test")
    shards = warc.write_index(df, folder, block_lines=4)
    found = warc.look_up(folder, shards, df.select("key", "page_id"), 3).collect()
    assert sorted(r.file for r in found) == sorted(r[2] for r in rows)
    index = warc.CaptureIndex(folder, sorted((r.key, r.page_id, r.shard) for r in shards.collect()))
    assert index.find("org,h9)/", 3) == [] and index.find("a", None) == [] and index.find("zzz", 5) == []
    assert index.find("org,h1)/", None)[0][2] == "n"


def test_archives_are_gzip_members_with_warc_heads(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", "p" * 200), (2, "http://b.org/", "p" * 200)], "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    captures = warc.write_archives(warc.with_revisits(df).coalesce(1), folder).collect()
    (name,) = {c.file for c in captures}
    data = gzip.open(os.path.join(folder.removeprefix("file://"), name)).read()
    assert data.count(b"WARC/1.1\r\n") == 2 and data.count(b"WARC-Type: revisit") == 1 and b"WARC-Refers-To: <urn:page:1>" in data
    assert sorted(c.key for c in captures) == ["org,a)/x", "org,b)/"]
