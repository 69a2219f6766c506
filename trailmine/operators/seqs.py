"""Gapped frequent subsequences, grown level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .ngrams import CLOSED_TENTHS, uniform
from .streams import around

#: Patterns given at most, in the order of growth.
MAX_PATTERNS = 10_000


class Mined:
    """patterns: pattern, support, exemplar; truncated: were there more?"""

    def __init__(self, patterns: DataFrame, truncated: bool):
        self.patterns, self.truncated = patterns, truncated


def pattern_levels(token_rows: DataFrame, min_support: int, max_gap: int = 3, max_len: int = 5) -> DataFrame:
    """pattern, support (streams), first (of the exemplar's stream), start, of
    all patterns of 1 to max_len tokens, each at most max_gap places after the
    one before, in at least min_support streams.

    Each level keeps, for each stream and end, the earliest start. Extensions
    are looked up by (stream, place); only frequent patterns and frequent
    tokens go on.
    """
    scratch = Scratch(token_rows.sparkSession, "seqs")
    rows = scratch.save(around(token_rows, after={"next": ("tok", max_gap)}), "rows")

    def supported(spans: DataFrame) -> DataFrame:
        per = spans.groupBy("pattern", "stream").agg(F.min(F.struct("first", "start", "stream")).alias("at"))
        return per.groupBy("pattern").agg(F.count(F.lit(1)).alias("support"), F.min("at").alias("at")).where(F.col("support") >= min_support)

    spans = rows.select(F.array("tok").alias("pattern"), "stream", "first", F.col("pos").alias("end"), F.col("pos").alias("start"))
    level = scratch.save(supported(spans), "level1")
    items = level.select(F.col("pattern")[0].alias("tok"))
    found = [level]
    for k in range(2, max_len + 1):
        spans = spans.join(level.select("pattern"), "pattern", "left_semi")
        ahead = rows.where(F.size("next") > 0).select("stream", F.col("pos").alias("end"), "next")
        grown = spans.join(ahead, ["stream", "end"]).select("pattern", "stream", "first", "start", "end", F.posexplode("next").alias("gap", "tok")).join(items, "tok", "left_semi")
        grown = grown.groupBy(F.concat("pattern", F.array("tok")).alias("pattern"), "stream", (F.col("end") + F.col("gap") + 1).alias("end"))
        spans = scratch.save(grown.agg(F.min("first").alias("first"), F.min("start").alias("start")), f"spans{k}")
        level = scratch.save(supported(spans), f"level{k}")
        found.append(level)
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    lines = rows.select(F.col("stream").alias("in_stream"), F.col("pos").alias("start"), "seq")
    out = out.select("pattern", "support", F.col("at.stream").alias("in_stream"), F.col("at.start").alias("start"), F.col("at.first").alias("first"))
    return out.join(lines, ["in_stream", "start"]).select("pattern", "support", F.struct(F.col("in_stream").alias("stream"), F.col("start").alias("pos"), "seq").alias("exemplar"))


def closed_patterns(levels: DataFrame, max_patterns: int = MAX_PATTERNS) -> Mined:
    """Patterns of at least two tokens that no frequent extension by one token
    to the right closes (has 8 tenths of their support) and that aren't
    uniform, the highest support first. At most max_patterns, in the order in
    which depth-first growth would give them: a pattern after its extensions."""
    size = F.size("pattern")
    parents = levels.where(size > 1).select(F.slice("pattern", F.lit(1), size - 1).alias("pattern"), F.col("support").alias("child"))
    parents = parents.groupBy("pattern").agg(F.max("child").alias("child"))
    kept = levels.where(size >= 2).join(parents, "pattern", "left")
    kept = kept.where(F.col("child").isNull() | (10 * F.col("child") < CLOSED_TENTHS * F.col("support"))).drop("child").where(~uniform(F.col("pattern")))
    kept = Scratch(levels.sparkSession, "closed").save(kept, "kept")
    # Post-order: a pattern sorts behind what it is a prefix of, as nothing sorts before the largest end mark.
    capped = kept.orderBy(F.concat("pattern", F.array(F.lit("\U0010ffff")))).limit(max_patterns)
    return Mined(capped.orderBy(F.desc("support"), F.desc(size), "pattern"), kept.count() > max_patterns)


def mine(token_rows: DataFrame, min_support: int = 20, max_gap: int = 3, max_len: int = 5, max_patterns: int = MAX_PATTERNS) -> Mined:
    return closed_patterns(pattern_levels(token_rows, min_support, max_gap, max_len), max_patterns)
