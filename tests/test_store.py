"""The object store over puts, purges and puts again."""

from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from framewell.operators import events as E
from framewell.sources import objects as SO

RULES = [("1", 1), ("30", 30), ("a b", 5)]


def put(spark, path, number, rows):
    df = spark.createDataFrame([(k, datetime(2024, *day), tag, str(number).encode()) for k, day, tag in rows], "object_key long, created timestamp_ntz, expired string, body binary")
    SO.object_sink(df, path, put=number, grain="month")


def current(spark, path):
    keys = spark.range(20).select(F.col("id").alias("object_key"))
    return {r.object_key: int(r.body.decode()) for r in SO.object_source(spark, path, keys).collect()}


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def test_a_purge_brings_nothing_back_and_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    put(spark, path, 0, [(1, (3, 1), "30"), (2, (3, 1), "30"), (3, (1, 5), "30"), (4, (3, 9), "1"), (5, (2, 25), "30"), (6, (2, 1), "30"), (8, (3, 1), None)])
    put(spark, path, 1, [(1, (3, 2), "1"), (3, (3, 9), "30"), (7, (2, 2), "a b")])
    before = files(path)
    assert current(spark, path) == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1, 8: 0}
    for _ in range(2):  # a purge that runs again changes nothing
        E.purge_expired(spark, path, RULES, "2024-03-09")
        # 1: its current object is gone, and the older one with time left must not come back
        assert current(spark, path) == {2: 0, 3: 1, 4: 0, 5: 0, 8: 0}
    after = files(path)
    folders = {str(Path(f).parent) for f in after}
    assert not any("expired=a b" in f or "event_date=2024-01" in f or "put=1/expired=1/" in f for f in folders)
    kept = {f for f in before if "put=0/expired=30/event_date=2024-03" in f or "put=1/expired=30" in f or "put=0/expired=1/" in f}
    assert kept and kept <= after
    edge = {f for f in after if "put=0/expired=30/event_date=2024-02" in f}
    assert edge and not edge & before
    put(spark, path, 2, [(1, (3, 8), "30"), (7, (3, 8), "a b")])
    assert current(spark, path) == {1: 2, 2: 0, 3: 1, 4: 0, 5: 0, 7: 2, 8: 0}
    assert {r.object_key for r in E.live_objects(spark, path, RULES, "2024-03-20").collect()} == {1, 2, 3, 5, 8}


def test_an_emptied_table_can_still_be_read_and_takes_puts(spark, tmp_path):
    path = str(tmp_path / "store")
    put(spark, path, 0, [(1, (1, 1), "1"), (2, (1, 3), "1")])
    E.purge_expired(spark, path, RULES, "2024-03-01")
    assert current(spark, path) == {}
    E.purge_expired(spark, path, RULES, "2024-03-01")
    put(spark, path, 1, [(1, (3, 1), "1")])
    assert current(spark, path) == {1: 1}
