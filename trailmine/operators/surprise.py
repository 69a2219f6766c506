"""How predictable streams are under the corpus' own gram model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import gram_model
from .streams import around

BACKOFF = 0.4


def score_grams(grams: DataFrame, model: DataFrame, total: int) -> DataFrame:
    """grams with the column gram (the last token after its context) and bits:
    minus log2 of the backed-off score. The longest context whose gram was
    counted wins, each step back costs 0.4, the last is the token's share."""
    distinct = grams.select("gram").distinct()
    size = F.size("gram")
    steps = distinct.select("gram", F.explode(F.sequence(F.lit(1), size)).alias("k")).select("gram", "k", F.slice("gram", size - F.col("k") + 1, F.col("k")).alias("tail"))
    steps = steps.withColumn("context", F.slice("tail", F.lit(1), F.col("k") - 1))
    counted = steps.join(model.select(F.col("gram").alias("tail"), F.col("n").alias("hits")), "tail")
    counted = counted.join(model.select(F.col("gram").alias("context"), F.col("n").alias("of")), "context", "left")
    share = F.col("hits") / F.when(F.col("k") == 1, F.lit(float(total))).otherwise(F.col("of").cast("double"))
    best = counted.groupBy("gram").agg(F.max_by(F.struct("k", share.alias("share")), F.col("k")).alias("x"))
    score = F.col("x.share") * F.pow(F.lit(BACKOFF), F.size("gram") - F.col("x.k"))
    return grams.join(best.select("gram", (-F.log2(score)).alias("bits")), "gram")


def surprise(token_rows: DataFrame, order: int = 3, min_tokens: int = 20) -> DataFrame:
    """stream, tokens, bits: mean surprise of each token given up to order
    tokens before it; streams below min_tokens are left out. Most predictable
    first. The streams are their own model, so that a gram was always seen."""
    model = gram_model(token_rows, order)
    rows = around(token_rows, before={"past": ("tok", order)}) if order else token_rows.withColumn("past", F.array().cast("array<string>"))
    per = rows.select("stream", F.concat("past", F.array("tok")).alias("gram")).groupBy("stream", "gram").agg(F.count(F.lit(1)).alias("times"))
    total = token_rows.count()
    scored = score_grams(per, model, total)
    out = scored.groupBy("stream").agg(F.sum("times").alias("tokens"), (F.sum(F.col("bits") * F.col("times")) / F.sum("times")).alias("bits"))
    return out.where(F.col("tokens") >= min_tokens).orderBy("bits", "stream")


def extremes(scored: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """The most predictable and the most surprising streams, half of the limit
    each; they overlap where there are few streams."""
    half = max(1, limit // 2)
    return scored.orderBy("bits", "stream").limit(half), scored.orderBy(F.desc("bits"), F.desc("stream")).limit(half)
