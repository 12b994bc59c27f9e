"""Queue messages: text bodies with a size limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: largest encoded message in characters.
MESSAGE_LIMIT = 262_144


def queue_encode(df: DataFrame, message: Column, limit: int = MESSAGE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Add the Base64 ``body`` of a message and part the rows into sendable ones and others: too large or without message."""
    bodies = df.withColumn("body", F.base64(message.cast("binary")))
    fits = F.coalesce(F.length("body") <= limit, F.lit(False))
    return bodies.filter(fits), bodies.filter(~fits)


def queue_decode(df: DataFrame, schema: str) -> DataFrame:
    """Decode bodies: raw bytes when the attribute ``serialized`` is "no", otherwise a JSON message."""
    raw = F.try_to_binary("body", F.lit("base64"))
    plain = F.coalesce(F.col("serialized"), F.lit("yes")) == "no"
    return df.withColumns(
        {
            "raw": F.when(plain, raw),
            "message": F.when(~plain, F.from_json(raw.cast("string"), schema)),
        }
    )
