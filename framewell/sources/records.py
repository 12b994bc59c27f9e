"""Keyed record streams and log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = (
    "partition_key STRING, payload BINARY, utc_date_time STRING, receive_ts TIMESTAMP_NTZ, "
    "behind_latest_ms BIGINT, seq BIGINT, batch_id BIGINT"
)

# Level names that a log line may carry.
LOG_LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]


def read_records(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    fmt: str = "parquet",
    schema: str = RECORD_SCHEMA,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Records from a folder of files, as a batch or as a stream that picks up new files."""
    if not streaming:
        return spark.read.schema(schema).format(fmt).load(path)
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def read_kafka_records(spark: SparkSession, servers: str, topic: str, streaming: bool = True) -> DataFrame:
    """Records from a Kafka topic whose value is the JSON form of a record; needs Spark's Kafka package."""
    source = (spark.readStream if streaming else spark.read).format("kafka")
    raw = source.option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    body = F.from_json(F.col("value").cast("string"), RECORD_SCHEMA.replace("payload BINARY", "payload STRING"))
    return raw.select(F.col("key").cast("string").alias("_key"), F.col("timestamp"), body.alias("r")).select(
        F.coalesce("r.partition_key", "_key").alias("partition_key"),
        F.unbase64("r.payload").alias("payload"),
        F.col("r.utc_date_time"),
        F.coalesce(F.col("r.receive_ts"), F.col("timestamp").cast("timestamp_ntz")).alias("receive_ts"),
        F.col("r.behind_latest_ms"),
        F.col("r.seq"),
        F.col("r.batch_id"),
    )


def tail_logs(
    spark: SparkSession, path: str, streaming: bool = True, kind: str = "algorithm", files: str = "*.log"
) -> DataFrame:
    """Lines of the log files of a folder from their beginning, with file name and parsed level."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.option("pathGlobFilter", files).text(path)
    return parse_log_lines(
        lines.select(F.col("value").alias("message"), F.col("_metadata.file_name").alias("file")), kind
    )


def parse_log_lines(df: DataFrame, kind: str = "algorithm") -> DataFrame:
    """Add the type and the level, the first level word standing alone in the line, or null."""
    level = F.regexp_extract("message", r"\b(" + "|".join(LOG_LEVELS) + r")\b", 1)
    return df.withColumns({"type": F.lit(kind), "level": F.nullif(level, F.lit(""))})


def level_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("type", "level").agg(F.count(F.lit(1)).alias("n"))
