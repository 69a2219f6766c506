"""What a card costs and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lens import is_failed
from ..session import Scratch
from .rank import card_order
from .streams import around

BYTES_PER_TOKEN = 4
#: Kind and action by bucket, fixed values.
KINDS = {"script": ("routine", "script"), "friction": ("friction", "hook"), "loop": ("loop", "trim"), "watch": ("noise", "trim")}


def occurrences(token_rows: DataFrame, patterns: DataFrame, max_gap: int = 3) -> DataFrame:
    """pattern, stream, start, end, bytes: for each place of a pattern's first
    token, each further token at its nearest place within max_gap. There is no
    going back: where the nearest ones lead nowhere, nothing is found."""
    scratch = Scratch(token_rows.sparkSession, "occurrences")
    rows = scratch.save(around(token_rows, after={"next": ("tok", max_gap), "next_bytes": ("bytes", max_gap)}), "rows")
    patterns = scratch.save(patterns.select("pattern").distinct(), "patterns")
    longest = patterns.agg(F.max(F.size("pattern"))).first()[0] or 0
    at = rows.join(patterns.withColumn("tok", F.col("pattern")[0]), "tok")
    at = at.select("pattern", "stream", F.col("pos").alias("start"), F.col("pos").alias("end"), "bytes", "next", "next_bytes")
    done = []
    for k in range(1, longest + 1):
        done.append(at.where(F.size("pattern") == k).select("pattern", "stream", "start", "end", "bytes"))
        if k == longest:
            break
        step = F.array_position("next", F.col("pattern")[k])
        going = at.where((F.size("pattern") > k) & (step > 0))
        going = going.select("pattern", "stream", "start", (F.col("end") + step).alias("end"), (F.col("bytes") + F.get("next_bytes", (step - 1).cast("int"))).alias("bytes"))
        if k + 1 < longest:
            going = going.join(rows.select("stream", F.col("pos").alias("end"), "next", "next_bytes"), ["stream", "end"])
        else:
            going = going.withColumn("next", F.array().cast("array<string>")).withColumn("next_bytes", F.array().cast("array<bigint>"))
        at = going
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def measure(token_rows: DataFrame, patterns: DataFrame, max_gap: int = 3) -> DataFrame:
    """pattern, n, streams, bytes: occurrences that don't overlap, taken from
    left to right; the bytes are those of the members.

    Occurrences fall into islands that no other one reaches across; what is
    taken in one doesn't depend on the others, so islands are folded apart.
    """
    found = occurrences(token_rows, patterns, max_gap)
    along = Window.partitionBy("pattern", "stream").orderBy("start")
    so_far = along.rowsBetween(Window.unboundedPreceding, -1)
    cut = F.when(F.col("start") > F.coalesce(F.max("end").over(so_far), F.lit(-1)), 1).otherwise(0)
    islands = found.withColumn("cut", cut).withColumn("island", F.sum("cut").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("pattern", "stream", "island").agg(F.array_sort(F.collect_list(F.struct("start", "end", "bytes"))).alias("all"))
    zero = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bytes"))
    take = lambda acc, x: F.when(x["start"] > acc["end"], F.struct(x["end"].alias("end"), (acc["n"] + 1).alias("n"), (acc["bytes"] + x["bytes"]).alias("bytes"))).otherwise(acc)
    taken = islands.select("pattern", "stream", F.aggregate("all", zero, take).alias("x"))
    per = taken.groupBy("pattern", "stream").agg(F.sum("x.n").alias("n"), F.sum("x.bytes").alias("bytes"))
    return per.groupBy("pattern").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("streams"), F.sum("bytes").alias("bytes"))


def fail_rate(pattern: Column) -> Column:
    return F.when(F.size(pattern) > 0, F.size(F.filter(pattern, is_failed)) / F.size(pattern)).otherwise(0.0)


def findings(token_rows: DataFrame, cards: DataFrame, max_gap: int = 3) -> DataFrame:
    """kind, action, pattern, n, streams, fail_rate, burn (tokens), exemplar of
    the cards that occur, the most expensive first, then the most frequent,
    then in the order of the cards."""
    measured = measure(token_rows, cards, max_gap)
    rows = cards.join(measured, "pattern")
    pick = lambda k: F.element_at(F.create_map(*[x for b, v in KINDS.items() for x in (F.lit(b), F.lit(v[k]))]), F.col("bucket"))
    rows = rows.withColumn("burn", F.expr(f"bytes div {BYTES_PER_TOKEN}"))
    rows = rows.orderBy(F.desc("burn"), F.desc("n"), *card_order())
    return rows.select(pick(0).alias("kind"), pick(1).alias("action"), "pattern", "n", "streams", fail_rate(F.col("pattern")).alias("fail_rate"), "burn", "exemplar")


def of_kind(rows: DataFrame, kind: str = "") -> DataFrame:
    """One kind, or all but noise. A kind that there isn't is an error."""
    known = [v[0] for v in KINDS.values()]
    if kind and kind not in known:
        raise ValueError(f"no such kind: {kind}; there are {', '.join(sorted(known))}")
    return rows.where(F.col("kind") == kind) if kind else rows.where("kind <> 'noise'")
