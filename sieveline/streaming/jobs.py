"""The same operators on streams, and windows over events.

Stateless scans run on a stream as on a table. State is bounded by a watermark everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spans
from ..sources.prompts import prompt_id


def scan_stream(turns: DataFrame, text: str = "text", zones: bool = True) -> DataFrame:
    """Findings, zones and redacted text of a stream of (conv_id, turn, role, text): user turns only."""
    users = turns.where("role = 'user' AND trim(text) <> ''").withColumn("prompt_id", prompt_id(F.col("conv_id"), F.col("turn")))
    return spans.detect(users, text, zones=zones)


def once(turns: DataFrame, time: str, delay: str = "1 hour", key: str = "prompt_id") -> DataFrame:
    """Each prompt once, however often it arrives within ``delay``."""
    return turns.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts(events: DataFrame, time: str = "ts", kind: str = "event_type", size: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events of each kind in tumbling (or sliding) windows; later ones than ``delay`` are dropped."""
    df = events.withWatermark(time, delay) if events.isStreaming else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return df.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events no further than ``gap`` apart."""
    df = events.withWatermark(time, delay) if events.isStreaming else events
    return df.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def rolling_profile(values: DataFrame, time: str, size: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Windowed profile of a stream of (column_id, value, time): counts, lengths, approximate distinct values."""
    df = values.withWatermark(time, delay) if values.isStreaming else values
    n = F.length("value")
    return df.groupBy(F.window(time, size).alias("w"), "column_id").agg(
        F.count("*").alias("n_values"), F.count("value").alias("n_filled"), F.approx_count_distinct("value").alias("n_distinct"), F.avg(n).alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(F.col("value").rlike("^[0-9]+$").cast("int")).alias("digit_ratio")
    ).select("column_id", F.col("w.start").alias("start"), "n_values", "n_filled", "n_distinct", "mean_length", "min_length", "max_length", "digit_ratio")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream now holds, written once into the shared folder, as a table."""
    import uuid

    from ..plans.sql import shared_dir

    at = f"{shared_dir(stream.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")
