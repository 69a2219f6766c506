"""Counts and rates of a corpus, its projects or sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole)


def grain_key(by: str) -> Column:
    if by not in ("corpus", "project", "session"):
        raise ValueError(f"unknown grain {by!r}; there are corpus, project, session")
    return {"corpus": lambda: F.lit("corpus"), "project": lambda: F.col("p"), "session": lambda: F.concat("p", F.lit("/"), "s")}[by]()


def summarize(events: DataFrame, by: str = "corpus") -> DataFrame:
    """key, events, by_kind, sessions, fails, cfails, unpaired, retries and
    their rates in percent, most events first.

    Sessions are distinct session ids whatever their project or agent. No
    events give no rows.
    """
    kinds = events.groupBy(grain_key(by).alias("key"), "k", "s").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("st") == "fail").alias("fails"), F.count_if(F.col("st") == "cfail").alias("cfails"),
        F.count_if((F.col("st") == "none") & (F.col("k") != "prompt")).alias("unpaired"), F.count_if("rt").alias("retries"),
    )
    sums = ("n", "fails", "cfails", "unpaired", "retries")
    sessions = kinds.groupBy("key", "s").agg(*[F.sum(c).alias(c) for c in sums]).groupBy("key").agg(F.count(F.lit(1)).alias("sessions"), *[F.sum(c).alias(c) for c in sums])
    by_kind = kinds.groupBy("key", "k").agg(F.sum("n").alias("n")).groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("by_kind"))
    out = sessions.join(by_kind, "key").withColumnRenamed("n", "events")
    return out.select(
        "key", "events", "by_kind", "sessions", "fails", "cfails", "unpaired", "retries",
        percent(F.col("fails"), F.col("events")).alias("fail_pct"), percent(F.col("retries"), F.col("events")).alias("retry_pct"),
    ).orderBy(F.desc("events"), "key")


def top_actions(events: DataFrame) -> DataFrame:
    """action, n, fails of what is no prompt; shell commands with sh: before
    them; a compound's failure is not counted. Most frequent first."""
    name = F.when(F.col("k") == "shell", F.concat(F.lit("sh:"), "act")).otherwise(F.col("act"))
    rows = events.where("k <> 'prompt'").groupBy(name.alias("action")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("st") == "fail").alias("fails"))
    return rows.orderBy(F.desc("n"), "action")
