"""Contiguous n-grams and the model of gram counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .streams import around

#: A longer gram closes a shorter one from so many tenths of its count on.
CLOSED_TENTHS = 8


def uniform(gram: Column) -> Column:
    return F.size(F.array_distinct(gram)) == 1


def count_grams(token_rows: DataFrame, shortest: int = 2, longest: int = 5) -> DataFrame:
    """gram, n, streams, exemplar (stream, pos, seq of the first occurrence in
    the order of the streams) of all windows of shortest to longest tokens."""
    rows = around(token_rows, after={"rest": ("tok", longest - 1)}) if longest > 1 else token_rows.withColumn("rest", F.array().cast("array<string>"))
    line = F.concat(F.array("tok"), F.col("rest"))
    rows = rows.select("stream", "first", "pos", "seq", line.alias("line")).where(F.size("line") >= shortest)
    sizes = F.sequence(F.lit(shortest), F.least(F.lit(longest), F.size("line")))
    grams = rows.select("stream", "first", "pos", "seq", F.explode(F.transform(sizes, lambda n: F.slice("line", F.lit(1), n))).alias("gram"))
    per = grams.groupBy("gram", "stream").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("first", "pos", "seq", "stream")).alias("at"))
    return per.groupBy("gram").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("streams"), F.min("at").alias("at")).select("gram", "n", "streams", F.struct("at.stream", "at.pos", "at.seq").alias("exemplar"))


def passing(grams: DataFrame, min_count: int, min_streams: int) -> DataFrame:
    return grams.where((F.col("n") >= min_count) & (F.col("streams") >= min_streams))


def frequent_grams(grams: DataFrame, min_count: int = 5, min_streams: int = 3) -> DataFrame:
    """Grams above the floor, without uniform ones and without those that a
    gram of one token more, itself above the floor, closes: one that has at
    least 8 tenths of their count. Most streams first."""
    kept = passing(grams, min_count, min_streams)
    size = F.size("gram")
    ends = F.array(F.slice("gram", F.lit(1), size - 1), F.slice("gram", F.lit(2), size - 1))
    closers = kept.where(size > 1).select(F.explode(ends).alias("gram"), F.col("n").alias("by")).groupBy("gram").agg(F.max("by").alias("by"))
    open_ = kept.join(closers, "gram", "left").where(F.col("by").isNull() | (10 * F.col("by") < CLOSED_TENTHS * F.col("n"))).drop("by")
    return open_.where(~uniform(F.col("gram"))).orderBy(F.desc("streams"), F.desc("n"), F.desc(F.size("gram")), "gram")


def gram_model(token_rows: DataFrame, order: int = 3) -> DataFrame:
    """gram, n for all grams of 1 to order + 1 tokens."""
    return count_grams(token_rows, 1, order + 1).select("gram", "n")
