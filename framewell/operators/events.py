"""Events, retention tags and the expiry of stored objects."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.functions.tokens import expiry_days
from framewell.operators.geometry import objects_by_zone
from framewell.operators.motion import RESULT_SCHEMA
from framewell.sources.objects import newest_objects, object_versions, purge

# Retention rules (day key, days kept) as deployed and in the development set-up, and the default key.
RULES = {
    "deployed": [("1", 1), ("2", 2), ("7", 7), ("30", 30)],
    "development": [("1", 2), ("2", 4), ("7", 9), ("30", 32)],
}
DEFAULT_DAY_KEY = "30"


def rules_frame(spark: SparkSession, rules: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(rules, "day_key STRING, days INT")


def motion_events(results: DataFrame) -> DataFrame:
    """One event per zone of a motion result: token, utc_date, zone_id as text, expiry hours and days."""
    zones = results.withColumn("_z", F.explode(F.from_json("result", RESULT_SCHEMA)["motion"]))
    return zones.select(
        "token",
        "utc_date",
        F.col("_z.zone_id").cast("string").alias("zone_id"),
        F.size("_z.boxs").alias("n_boxes"),
        "expires_hours",
        expiry_days(F.col("expires_hours")).cast("int").alias("expires_days"),
    )


def object_events(matches: DataFrame, event: str = "frame_id", part: Column | None = None) -> DataFrame:
    """One event per frame with its objects by zone, of at most three zones; ``part`` cuts events as in objects_by_zone."""
    lists = objects_by_zone(matches, event, part)
    by = [event] if part is None else [event, "part"]
    entry = F.struct("zone_id", "objects")
    return lists.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("objects"))


def with_expiry_days(df: DataFrame) -> DataFrame:
    return df.withColumn("expires_days", expiry_days(F.col("expires_hours")).cast("int"))


def retention_tag(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Add the tag ``expired``: the object's day key when a rule exists for it, otherwise "30"."""
    known = rules.select(F.col("day_key").alias("_rule")).distinct()
    tagged = df.join(known, df["day_key"] == F.col("_rule"), "left")
    return tagged.withColumn("expired", F.coalesce("_rule", F.lit(DEFAULT_DAY_KEY))).drop("_rule")


def merge_retention_rules(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All rules by id; a rule that exists already is kept over a new one of the same id."""
    old = existing.select(F.concat(F.lit("RULE_"), "day_key").alias("rule_id"), F.struct("day_key", "days").alias("_o"))
    add = new.select(F.concat(F.lit("RULE_"), "day_key").alias("rule_id"), F.struct("day_key", "days").alias("_n"))
    both = old.join(add, "rule_id", "full_outer").withColumn("_r", F.coalesce("_o", "_n"))
    return both.select("rule_id", "_r.day_key", "_r.days")


def expired_objects(objects: DataFrame, rules: DataFrame, as_of: datetime.date | str) -> DataFrame:
    """Tagged objects whose days have passed by ``as_of``, counted from the day they were made."""
    kept = rules.select(F.col("day_key").alias("_key"), "days")
    rows = objects.join(kept, objects["expired"] == F.col("_key")).drop("_key")
    return rows.filter(F.date_add(F.to_date("created"), F.col("days")) <= F.lit(as_of).cast("date"))


def _passed(rules: list[tuple[str, int]], as_of: datetime.date | str) -> tuple[Column, Column]:
    """Whether an object's days have passed, and whether its partition can hold such an object: its ``event_date`` is the
    first day of what it holds, whatever the grain. An object whose tag or day is not known stays."""
    tag, day = F.col("expired").cast("string"), F.lit(as_of).cast("date")
    gone, reached = F.lit(False), F.lit(False)
    for key, days in rules:
        last = F.date_sub(day, days)
        gone = gone | ((tag == key) & (F.to_date("created") <= last))
        reached = reached | ((tag == key) & (F.col("event_date") <= last))
    return gone, F.coalesce(reached, F.lit(False))


def live_objects(
    spark: SparkSession, path: str, rules: list[tuple[str, int]], as_of: datetime.date | str
) -> DataFrame:
    """The current objects of the table whose days have not passed. An object that has expired stays gone, also where the
    put that it replaced would still have time."""
    gone, _ = _passed(rules, as_of)
    return newest_objects(object_versions(spark, path)).filter(~F.coalesce(gone, F.lit(False)))


def purge_expired(
    spark: SparkSession, path: str, rules: list[tuple[str, int]], as_of: datetime.date | str
) -> None:
    """Remove the objects of the table whose days have passed; puts and purges may follow in any order."""
    purge(spark, path, *_passed(rules, as_of))
