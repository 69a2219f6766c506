"""Problem 7: most frequent values in bounded memory.

Method: three-phase threshold top-k. Nodes hold local counts; they exchange
their local leaders, which gives a lower bound for the k-th value; they then
send every value above its share of that bound; what can still be among the
first k is resolved exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .canon import act_form, target_form


def local_counts(rows: DataFrame, node: Column, fields: dict[str, Column]) -> DataFrame:
    """(node, field, item, n); summed up in the map task before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), value.cast("string").alias("item")) for name, value in fields.items()])
    return (
        rows.select(node.alias("node"), F.explode(pairs).alias("x"))
        .where("x.item is not null")
        .groupBy("node", F.col("x.field").alias("field"), F.col("x.item").alias("item"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def threshold_top(counts: DataFrame, top: dict[str, int]) -> DataFrame:
    """field, item, n: the top[field] most frequent items of each field over
    all nodes, ties to the smaller item; counts is (node, field, item, n).

    Counts of what is returned are exact. Only values that can be among the
    first k leave their node whole. Fewer items than asked for: all of them.
    """
    spark = counts.sparkSession
    k = F.element_at(F.create_map(*[x for f, n in top.items() for x in (F.lit(f), F.lit(n))]), F.col("field"))
    counts = counts.where(F.col("field").isin(*top))
    nodes = counts.select("node").distinct().count()
    if not nodes:
        return counts.groupBy("field", "item").agg(F.sum("n").alias("n")).select("field", "item", "n")
    most_asked = max(top.values())

    def first_k(df: DataFrame, *by: str) -> DataFrame:
        """The first k of each field (and node), with their place r. The literal limit lets every task keep
        its own first ones only, before anything meets in one place."""
        best = Window.partitionBy(*by).orderBy(F.desc("n"), "item")
        return df.select("*", F.row_number().over(best).alias("r")).where(F.col("r") <= most_asked).where(F.col("r") <= k)

    def kth(partial: DataFrame) -> dict[str, int]:
        """The k-th largest partial sum of each field: no true k-th count is lower."""
        ranked = first_k(partial.select("field", "item", "n"), "field")
        return {r["field"]: r["n"] for r in ranked.groupBy("field").agg(F.max("r").alias("r"), F.min("n").alias("n")).where(F.col("r") == k).collect()}

    def bound(values: dict[str, float]) -> Column:
        known = [x for f in top for x in (F.lit(f), F.lit(float(values.get(f, 0))))]
        return F.element_at(F.create_map(*known), F.col("field"))

    # 1: leaders of each node.
    leaders = first_k(counts, "node", "field")
    low = kth(leaders.groupBy("field", "item").agg(F.sum("n").alias("n")))
    # 2: everything that reaches its share of the bound; an item that is in no node at its share is below the bound.
    share = {f: v / nodes for f, v in low.items()}
    sent = counts.where(F.col("n") >= bound(share)).groupBy("field", "item").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("at"))
    sent = Scratch(spark, "topk").save(sent, "sent")
    low = kth(sent)
    # 3: what may still reach the bound is fetched from all nodes.
    most = F.col("n") + (F.lit(nodes) - F.col("at")) * bound(share)
    able = sent.where(most >= bound(low)).select("field", "item")
    exact = counts.join(able, ["field", "item"], "left_semi").groupBy("field", "item").agg(F.sum("n").alias("n"))
    return first_k(exact, "field").select("field", "item", "n")


def top_values(events: DataFrame, acts: int = 20, targets: int = 40) -> DataFrame:
    """field ('act' or 'tgt'), item, n: the most frequent acts and targets of
    the events. Copies of an event (p, s, a, i, seg) count once, with the
    smallest spelling of its target; events without an act are left out, and
    null or blank targets. Nulls in the key count as values. The nodes are the
    partitions that the shuffle of the copies gives, as many as the data needs."""
    keys = ["p", "s", "a", "i", "seg"]
    rows = events.select(*keys, act_form(events["act"]).alias("act"), target_form(events["tgt"]).alias("tgt")).where("act is not null")
    # Copies are reduced in the map tasks, so that an event with very many is no hot key.
    once = rows.groupBy(*keys).agg(F.min("act").alias("act"), F.min("tgt").alias("tgt")).withColumn("node", F.spark_partition_id())
    counts = Scratch(events.sparkSession, "topk").save(local_counts(once, F.col("node"), {"act": F.col("act"), "tgt": F.col("tgt")}), "counts")
    return threshold_top(counts, {"act": acts, "tgt": targets})
