"""From patterns to a short list of cards: score, fold, bucket, family."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lens import base_token, is_failed
from ..session import Scratch
from .ngrams import gram_model
from .surprise import score_grams

#: Buckets in the order in which they are shown.
BUCKETS = ("friction", "loop", "script", "watch")


@dataclass(frozen=True)
class RankOptions:
    """What is not above 0 stands for the default."""

    order: int = 3
    script_bits: float = 1.0
    noise_bits: float = 3.0
    delta: float = 0.8

    def filled(self) -> RankOptions:
        plain = RankOptions()
        return RankOptions(*[v if v > 0 else d for v, d in zip(vars(self).values(), vars(plain).values())])


class Ranked:
    """cards, best first; noise: watch patterns without a score, only counted."""

    def __init__(self, cards: DataFrame, noise: int):
        self.cards, self.noise = cards, noise


def is_subsequence(part: Column, whole: Column) -> Column:
    """Does `part` stand in `whole` in order, with or without gaps?"""
    step = lambda k, x: F.when((k < F.size(part)) & (F.get(part, k) == x), k + 1).otherwise(k)
    return F.aggregate(whole, F.lit(0), step) == F.size(part)


def fold(patterns: DataFrame, delta: float = 0.8, max_len: int | None = None) -> DataFrame:
    """patterns (pattern, support, ...) without those that a longer kept
    pattern explains, with folded: how many it took in.

    A pattern goes to the first kept one, by length, support and tokens, that
    contains it and has at least delta of its support. Only longer ones can,
    so the lengths are done one after another. Candidates meet by the first
    token of the shorter pattern.
    """
    scratch = Scratch(patterns.sparkSession, "fold")
    patterns = scratch.save(patterns, "patterns")
    if max_len is None:
        max_len = patterns.agg(F.max(F.size("pattern"))).first()[0] or 0
    kept = patterns.where(F.size("pattern") == max_len).select("pattern", "support")
    taken = None
    for n in range(max_len - 1, 0, -1):
        here = patterns.where(F.size("pattern") == n).select("pattern", "support")
        holders = kept.select(F.col("pattern").alias("holder"), F.col("support").alias("holds"), F.explode(F.array_distinct("pattern")).alias("tok"))
        pairs = here.withColumn("tok", F.col("pattern")[0]).join(holders, "tok")
        pairs = pairs.where((F.col("holds").cast("double") >= delta * F.col("support").cast("double")) & is_subsequence(F.col("pattern"), F.col("holder")))
        into = pairs.groupBy("pattern").agg(F.min(F.struct((-F.size("holder")).alias("size"), (-F.col("holds")).alias("holds"), "holder")).alias("x"))
        into = scratch.save(into.select("pattern", F.col("x.holder").alias("holder")), f"into{n}")
        taken = into if taken is None else taken.unionByName(into)
        kept = scratch.save(kept.unionByName(here.join(into, "pattern", "left_anti")), f"kept{n}")
    out = patterns.join(kept.select("pattern"), "pattern", "left_semi")
    if taken is None:
        return out.withColumn("folded", F.lit(0).cast("long"))
    counts = taken.groupBy(F.col("holder").alias("pattern")).agg(F.count(F.lit(1)).alias("folded"))
    return out.join(counts, "pattern", "left").withColumn("folded", F.coalesce("folded", F.lit(0).cast("long")))


def pattern_bits(patterns: DataFrame, model: DataFrame, total: int, order: int) -> DataFrame:
    """pattern, bits: mean surprise of a pattern's transitions, taken as if its
    tokens followed directly; 0 for a single token."""
    size = F.size("pattern")
    steps = patterns.where(size > 1).select("pattern", F.explode(F.sequence(F.lit(2), size)).alias("k"))
    from_ = F.greatest(F.lit(1), F.col("k") - order)
    steps = steps.select("pattern", F.slice("pattern", from_, F.col("k") - from_ + 1).alias("gram"))
    bits = score_grams(steps, model, total).groupBy("pattern").agg(F.avg("bits").alias("bits"))
    return patterns.select("pattern").distinct().join(bits, "pattern", "left").select("pattern", F.coalesce("bits", F.lit(0.0)).alias("bits"))


def bucket_of(pattern: Column, bits: Column, script_bits: float) -> Column:
    """The first failed or repeated token decides; else the bits."""
    n = F.size(pattern)
    failed = F.array_position(F.transform(pattern, is_failed), True)
    again = F.array_position(F.transform(pattern, lambda x, k: F.array_position(pattern, x) - 1 < k), True)
    first_fail, first_again = F.when(failed > 0, failed).otherwise(n + 1), F.when(again > 0, again).otherwise(n + 1)
    return (
        F.when((first_fail <= n) & (first_fail <= first_again), "friction").when(first_again <= n, "loop").when(bits <= script_bits, "script").otherwise("watch")
    )


def card_order() -> list[Column]:
    rank = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    by_support = F.col("bucket").isin("friction", "loop")
    return [rank, F.desc(F.when(by_support, F.col("support").cast("double")).otherwise(F.col("score"))), F.desc("support"), F.asc("pattern")]


def merge_families(cards: DataFrame) -> DataFrame:
    """Cards of a bucket over the same set of tokens, marks aside, as the best
    one, with variants (others taken in) and their folds. Families are first
    reduced by aggregation, so that a large one is no large group."""
    family = F.array_sort(F.array_distinct(F.transform("pattern", base_token)))
    lead = F.struct((-F.when(F.col("bucket").isin("friction", "loop"), F.col("support").cast("double")).otherwise(F.col("score"))).alias("by"), (-F.col("support")).alias("down"), F.col("pattern").alias("pattern"))
    rest = [c for c in cards.columns if c not in ("bucket", "pattern", "folded")]
    best = F.min_by(F.struct("pattern", *rest), lead).alias("x")
    merged = cards.groupBy("bucket", family.alias("family")).agg(best, (F.count(F.lit(1)) - 1).alias("variants"), F.sum("folded").alias("folded"))
    return merged.select("bucket", "x.*", "variants", "folded")


def rank_patterns(token_rows: DataFrame, patterns: DataFrame, options: RankOptions = RankOptions()) -> Ranked:
    """Cards (bucket, pattern, support, bits, score, variants, folded,
    exemplar) in the order in which they are shown. Equal cards are ordered by
    token."""
    o = options.filled()
    spark = token_rows.sparkSession
    kept = Scratch(spark, "rank").save(fold(patterns, o.delta), "folded")
    bits = pattern_bits(kept, gram_model(token_rows, o.order), token_rows.count(), o.order)
    cards = kept.join(bits, "pattern")
    score = F.log2(F.col("support").cast("double")) * (o.noise_bits - F.least(F.col("bits"), F.lit(o.noise_bits)))
    cards = cards.withColumn("score", score).withColumn("bucket", bucket_of(F.col("pattern"), F.col("bits"), o.script_bits))
    cards = Scratch(spark, "rank").save(cards, "cards")
    noise = (F.col("bucket") == "watch") & (F.col("score") <= 0)
    return Ranked(merge_families(cards.where(~noise)).orderBy(*card_order()), cards.where(noise).count())


def top_per_bucket(cards: DataFrame, top: int) -> DataFrame:
    """The first `top` cards of each bucket, with the number left out; all if top is 0."""
    if top <= 0:
        return cards.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(*card_order()[1:]))).withColumn("left_out", F.lit(0).cast("long")).orderBy(*card_order())
    by = Window.partitionBy("bucket").orderBy(*card_order()[1:])
    rows = cards.withColumn("place", F.row_number().over(by))
    totals = cards.groupBy("bucket").agg(F.greatest(F.count(F.lit(1)) - top, F.lit(0)).alias("left_out"))
    return rows.where(F.col("place") <= top).join(totals, "bucket").orderBy(*card_order())
