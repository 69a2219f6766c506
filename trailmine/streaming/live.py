"""Running counts over events that keep arriving.

The batch operators read an artifact; these keep the parts that can be kept up
incrementally: event files are read as a stream, late and repeated events are
handled by watermark, and counts go to a table after each trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT, conform


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Event files (parquet, schema.EVENT) as they arrive."""
    return conform(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def once(events: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Each event once, also if it is delivered again within the lateness."""
    seen = events.withWatermark("t", lateness)
    return seen.dropDuplicatesWithinWatermark(["p", "s", "a", "f", "i", "seg"])


def windowed_health(events: DataFrame, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Counts of events, failures and retries by project and window of time."""
    rows = events.withWatermark("t", lateness).groupBy(F.window("t", window).alias("w"), "p")
    counts = rows.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("st") == "fail").alias("fails"), F.count_if("rt").alias("retries"))
    return counts.select("w.start", "w.end", "p", "events", "fails", "retries")


def write(counts: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that works off what is there and ends."""
    return counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
