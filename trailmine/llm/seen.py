"""Problem 5: has this key been seen before?

Method: streaming state store. Rows arrive in micro-batches in their order;
a batch is reduced to the first row of each key, and a keyed state on disk
(RocksDB, with checkpoints, without watermark, so that nothing expires) lets
a key pass once. A row is a first if it is the row that passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .canon import uuid_form

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.parquet.enableVectorizedReader": "true",
}


class SeenFilter:
    """Keys seen so far, kept under `path` (state, checkpoint, passed rows).

    add(batch) takes the next micro-batch with the columns key and place; all
    places of a batch come after those of earlier ones. Later calls, also of
    another session on the same path, go on from the state there.
    """

    def __init__(self, spark, path: str):
        self.spark = spark.newSession()
        for key, value in STATE_CONF.items():
            self.spark.conf.set(key, value)
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            self.spark.conf.set(key, spark.conf.get(key))
        self.path = path
        self.owner = spark

    def add(self, batch: DataFrame) -> None:
        firsts = batch.where("key is not null").groupBy("key").agg(F.min("place").alias("place"))
        firsts.write.mode("append").parquet(f"{self.path}/arrived")
        arrived = self.spark.readStream.schema("key string, place long").parquet(f"{self.path}/arrived")
        query = (
            arrived.dropDuplicates(["key"])
            .writeStream.format("parquet")
            .option("path", f"{self.path}/passed")
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def passed(self) -> DataFrame:
        """key, place of the first row of each key."""
        return self.owner.read.schema("key string, place long").parquet(f"{self.path}/passed")


def mark_seen(rows: DataFrame, key: Column, place: str, batches: int = 4) -> DataFrame:
    """The rows' places (unique) with seen: was the key in a row of smaller
    place? A null key was never seen before, nor was a row without a place;
    repeated rows get the same answer.

    The rows pass through the filter in `batches` ranges of place, in order;
    answers don't depend on their number. No rows give no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "seen")
    keyed = scratch.save(rows.select(key.alias("key"), F.col(place).cast("long").alias("place")), "rows")
    low, high = keyed.agg(F.min("place"), F.max("place")).first()
    if low is None:
        return keyed.select(F.col("place").alias(place), F.lit(False).alias("seen"))
    seen = SeenFilter(spark, scratch.at("state"))
    width = max(1, -(-(high - low + 1) // batches))
    for start in range(low, high + 1, width):
        seen.add(keyed.where((F.col("place") >= start) & (F.col("place") < start + width)))
    first = seen.passed().select("place", F.lit(True).alias("first"))
    # By place, which is unique: a key that a third of the rows share is no hot key here.
    marked = keyed.join(first, "place", "left")
    return marked.select(F.col("place").alias(place), (F.col("key").isNotNull() & F.col("place").isNotNull() & F.col("first").isNull()).alias("seen"))


def seen_lines(raw_line: DataFrame, batches: int = 4) -> DataFrame:
    """line_id, seen for each line: did its uuid occur in an earlier line?
    Identifiers are compared as 128 bits; nulls, blanks, the all-zero one and
    values that are none were never seen."""
    return mark_seen(raw_line, uuid_form(raw_line["uuid"]), "line_id", batches)


def wrong_rate(raw_line: DataFrame, answers: DataFrame) -> DataFrame:
    """Rate of wrong answers against the exact first line of each key:
    lines, seen, wrong_seen, wrong_new, wrong_rate. One row, also for no lines."""
    keyed = raw_line.select("line_id", uuid_form(raw_line["uuid"]).alias("key"))
    first = keyed.where("key is not null").groupBy("key").agg(F.min("line_id").alias("line_id"))
    truth = keyed.join(first.select("line_id", F.lit(True).alias("first")), "line_id", "left").select("line_id", (F.col("key").isNotNull() & F.col("first").isNull()).alias("truth"))
    both = truth.join(answers, "line_id", "left")
    said = F.coalesce(F.col("seen"), F.lit(False))
    counts = both.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(said).alias("seen"), F.count_if(said & ~F.col("truth")).alias("wrong_seen"), F.count_if(~said & F.col("truth")).alias("wrong_new")
    )
    rate = F.when(F.col("lines") > 0, (F.col("wrong_seen") + F.col("wrong_new")) / F.col("lines")).otherwise(F.lit(0.0))
    return counts.select("*", rate.alias("wrong_rate"))
