"""Problem 9: mixing sources to target weights.

Method: Efraimidis-Spirakis sampling. A document's key is exponential with its
quality weight as rate; within a source documents are taken in the order of
their keys up to the source's token budget. A source whose budget exceeds its
size is used whole that many times first, and only the rest is selected.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .canon import strip

#: Vocabulary of the public tokenizer that sizes are counted in.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting pattern of that vocabulary, fixed values.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ranges of keys in which a source is summed up; a range, not a source, is sorted in one task.
RANGES = 512


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def _count_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            sizes = [len(encoder.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            rest = [b.column(k) for k in b.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes, pa.int64())], names=[*[k for k in b.schema.names if k != "text"], "tokens"])

    return run


def source_form(source: Column) -> Column:
    """Lower case, without outer blanks, with _ for inner blanks and hyphens."""
    return F.nullif(F.regexp_replace(F.lower(strip(source)), r"[\s\-]+", "_"), F.lit(""))


def quality(text: Column) -> Column:
    """Weight of a document from 0.1 to 1: the share of letters in it times
    how different its words are, as documents of marks or repeats count less."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / F.greatest(F.length(text), F.lit(1))
    words = F.split(text, r"\s+")
    fresh = F.sqrt(F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)))
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), letters * fresh))


def exponential_key(unique: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u uniform in (0, 1) from a hash of the document and
    the seed, so that a task that runs again draws the same."""
    u = (F.shiftrightunsigned(F.xxhash64(unique, F.lit(seed)), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


class Mix:
    """selection: doc_id, source, tokens, copies. shares: one row for each
    target and each source without one."""

    def __init__(self, selection: DataFrame, shares: DataFrame):
        self.selection, self.shares = selection, shares


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, tokenizer: str = TOKENIZER, ranges: int = RANGES) -> Mix:
    """Documents of several sources at target shares of the total tokens.

    Weights are taken relative to those of the sources that have tokens, so
    that a target without documents leaves its share to the others. Without
    total_tokens the total is the largest at which no document is needed more
    than max_repeat times; with a larger one sources that can't fill their
    budget give what they have. A null or negative weight or max_repeat counts
    as 0, repeated targets of a source as one with their sum and the largest
    repeat. Sources are compared by source_form; documents without a source,
    without a target or without tokens are not selected. Each doc_id is one
    document; repeated rows of it are each used. The document that crosses a
    budget is taken if half of it or more lies within, so a source misses its
    budget by at most half of one document.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mix")
    sized = documents.select("doc_id", source_form(documents["source"]).alias("source"), quality(F.coalesce(documents["text"], F.lit(""))).alias("quality"), "text")
    id_type = documents.schema["doc_id"].dataType.simpleString()
    sized = sized.mapInArrow(_count_rows(tokenizer), f"doc_id {id_type}, source string, quality double, tokens long")
    # The key's place in the source: 1 - exp(-key) rises with the key and lies in (0, 1), so equal ranges of it part a source of any size.
    key = exponential_key(F.col("doc_id"), F.col("quality"), seed)
    sized = sized.withColumn("key", key).withColumn("range", F.least(F.lit(ranges - 1), F.floor((1 - F.exp(-F.col("key"))) * ranges)).cast("int"))
    sized = scratch.save(sized, "sized")
    plan = targets.select(source_form(targets["source"]).alias("source"), F.greatest(F.coalesce(targets["weight"].cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce(targets["max_repeat"].cast("int"), F.lit(0)), F.lit(0)).alias("max_repeat"))
    plan = plan.where("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeat").alias("max_repeat"))
    parts = scratch.save(sized.groupBy("source", "range").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")), "parts")
    have = parts.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    plan = plan.join(have, "source", "full").select("source", "weight", "max_repeat", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    able = (F.col("weight") > 0) & (F.col("max_repeat") > 0) & (F.col("tokens") > 0)
    plan = plan.withColumn("use", F.coalesce(able, F.lit(False)))
    every = Window.partitionBy(F.lit(0))  # one row a source
    plan = plan.withColumn("aim", F.when(F.col("use"), F.col("weight") / F.sum(F.when(F.col("use"), F.col("weight"))).over(every)))
    most = F.min(F.when(F.col("use"), F.col("tokens") * F.col("max_repeat") / F.col("aim"))).over(every)
    plan = plan.withColumn("total", most if total_tokens is None else F.lit(float(total_tokens)))
    budget = F.floor(F.col("total") * F.col("aim") + F.lit(1e-6)).cast("long")
    plan = plan.withColumn("budget", F.when(F.col("use"), F.least(budget, F.col("tokens") * F.col("max_repeat"))).otherwise(F.lit(0).cast("long")))
    plan = plan.withColumn("epochs", F.when(F.col("use"), F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.when(F.col("use"), F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0).cast("long")))
    plan = scratch.save(plan, "plan")
    # Prefix sums in two steps: over the ranges of a source, then within a range.
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.withColumn("before", before).join(plan.where("use").select("source", "epochs", "rest"), "source")
    offsets = offsets.select("source", "range", "before", "epochs", "rest", (F.col("before") + F.col("tokens")).alias("after"))
    tagged = sized.where("tokens > 0").join(offsets, ["source", "range"])
    inner = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # Only the range in which the budget ends is sorted.
    cut = (F.col("after") > F.col("rest")) & (F.col("before") < F.col("rest"))
    whole = tagged.where(~cut).withColumn("taken", (F.col("after") <= F.col("rest")).cast("long"))
    split = tagged.where(cut).withColumn("taken", (2 * (F.col("before") + F.sum("tokens").over(inner)) - F.col("tokens") <= 2 * F.col("rest")).cast("long"))
    chosen = whole.unionByName(split).withColumn("copies", F.col("epochs") + F.col("taken")).where("copies > 0")
    selection = scratch.save(chosen.select("doc_id", "source", "tokens", "copies"), "selection")
    got = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.count(F.lit(1)).alias("used_docs"), F.max("copies").alias("most_copies"))
    all_used = F.sum(F.coalesce("used", F.lit(0))).over(every)
    shares = plan.join(got, "source", "left").select(
        "source", F.col("weight").alias("target_share"), "aim", "max_repeat", "docs", "tokens", "budget",
        F.coalesce("used", F.lit(0)).alias("used_tokens"), F.coalesce("used_docs", F.lit(0)).alias("used_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.when(all_used > 0, F.coalesce("used", F.lit(0)) / all_used).otherwise(0.0).alias("actual_share"),
    )
    return Mix(selection, shares)
