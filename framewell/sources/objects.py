"""Keyed object store as Parquet tables of puts, partitioned by retention tag and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.session import scratch_path

PARTITION = ["put", "expired", "event_date"]
#: Folder of the tombstones below the table; its name keeps it out of the table's own partitions.
TOMBSTONES = "_tombstones"


def object_sink(df: DataFrame, path: str, put: int = 0, grain: str = "day") -> None:
    """Put objects (object_key, created, expired tag, body) with their length, partitioned by tag and ``event_date``.

    Each put has a number and a folder of its own: a higher one replaces the objects of equal key, and a put that runs
    again replaces itself. ``event_date`` is the first day of the object's day, month or year. Rebalancing gives each
    (tag, date) a file, or several of a sensible size when it is large.
    """
    first_day = F.to_date(F.date_trunc(grain, F.col("created").cast("timestamp_ntz")))
    rows = df.withColumns({"length": F.length("body"), "event_date": first_day})
    rows = rows.hint("rebalance", "expired", "event_date")
    rows.write.mode("overwrite").partitionBy("expired", "event_date").parquet(f"{path}/put={put}")


def object_versions(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table, replaced ones too, less those that a tombstone hides."""
    rows = spark.read.parquet(path)
    rows = rows.withColumns({"put": F.col("put").cast("long"), "expired": F.col("expired").cast("string")})
    hidden = _tombstones(spark, path)
    return rows if hidden is None else rows.join(hidden, "object_key", "left").filter(
        F.col("_last").isNull() | (F.col("put") > F.col("_last"))
    ).drop("_last")


def _tombstones(spark: SparkSession, path: str) -> DataFrame | None:
    """Of each buried key the last put that is gone."""
    folder = f"{path}/{TOMBSTONES}"
    if not _exists(spark, folder):
        return None
    return spark.read.parquet(folder).groupBy("object_key").agg(F.max("put").alias("_last"))


def _file_system(spark: SparkSession, path: str, encoded: bool = False):
    """File system and place of a path, or of one that a file's metadata gives with its odd characters encoded."""
    place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path) if encoded else path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def newest_objects(objects: DataFrame) -> DataFrame:
    """Of each key the object of the last put; of objects that one put brings twice the one created last."""
    kept = [c for c in objects.columns if c not in ("object_key", "put")]
    row = F.struct(*kept)
    best = objects.groupBy("object_key").agg(F.max_by(row, F.struct("put", "created", row)).alias("_row"))
    return best.select("object_key", "_row.*")


def object_source(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The current objects of the keys that are asked for; a key that repeats is asked once."""
    asked = keys.select("object_key").distinct()
    return newest_objects(object_versions(spark, path).join(asked, "object_key", "left_semi"))


def purge(spark: SparkSession, path: str, gone: Column, may_hold: Column) -> None:
    """Remove the rows of ``gone`` from the table, so that no replaced object comes back.

    A key whose current object goes, while an older one would stay, is buried first: a tombstone hides all its puts up to the
    current one, and a later put of the key counts again. Then partitions that are gone as a whole are deleted, and
    those that keep some rows are written anew in their place; all others are neither read nor touched. ``may_hold`` tells by
    the partition columns alone which partitions can hold such rows. A purge that stops half way is run again: tombstones
    that repeat and partitions that are gone already change nothing.
    """
    rows = object_versions(spark, path).withColumn("_gone", F.coalesce(gone, F.lit(False)))
    reached = rows.filter(may_hold)
    # only keys with a row that goes can lose their current object; of these all versions are looked at
    losing = reached.filter("_gone").select("object_key").distinct()
    known = rows.select("object_key", "put", "created", "_gone").join(losing, "object_key", "left_semi")
    last = known.groupBy("object_key").agg(
        F.max_by("_gone", F.struct("put", "created", "_gone")).alias("_gone"),
        F.max("put").alias("put"),
        F.count_if(~F.col("_gone")).alias("_left"),
    )
    buried = last.filter(F.col("_gone") & (F.col("_left") > 0)).select("object_key", "put")
    buried.write.mode("append").parquet(f"{path}/{TOMBSTONES}")

    all_rows = spark.read.parquet(path).withColumn("_gone", F.coalesce(gone, F.lit(False)))
    touched = all_rows.filter(may_hold).withColumn("_folder", F.regexp_replace("_metadata.file_path", "/[^/]*$", ""))
    parts = touched.groupBy(*PARTITION, "_folder").agg(F.count(F.lit(1)).alias("n"), F.count_if("_gone").alias("g"))
    parts = parts.filter("g > 0").collect()  # one row for each partition, as Spark lists them on the driver anyway
    edges = [p for p in parts if p.g < p.n]
    if edges:
        by = spark.createDataFrame([(p._folder,) for p in edges], "_folder string")
        left = touched.join(by, "_folder", "left_semi").filter(~F.col("_gone")).drop("_folder", "_gone")
        aside = scratch_path(spark, "purge")
        left.hint("rebalance", *PARTITION).write.partitionBy(*PARTITION).parquet(aside)
        back = spark.read.schema(left.schema).parquet(aside).hint("rebalance", *PARTITION)
        back.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path)
        _delete(spark, aside)
    whole = [p._folder for p in parts if p.g == p.n]
    if len(whole) == len(parts) and whole and not all_rows.filter(~F.col("_gone")).limit(1).count():
        # the table is empty from now on; one file without rows keeps its columns
        none = spark.read.parquet(path).drop(*PARTITION).limit(0)
        none.write.mode("overwrite").parquet(_file_system(spark, whole.pop(), True)[1].toString())
    for folder in whole:
        _delete(spark, folder, True)


def _delete(spark: SparkSession, path: str, encoded: bool = False) -> None:
    system, place = _file_system(spark, path, encoded)
    system.delete(place, True)
