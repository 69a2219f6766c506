"""Queries of the llm operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, data: str) -> DataFrame:
    from .patterns import frequent_patterns

    return frequent_patterns(table(spark, data, "session_event")).select(F.array_join("pattern", " > ").alias("pattern"))


def p1_patterns(spark: SparkSession, data: str) -> DataFrame:
    from .patterns import frequent_patterns

    return frequent_patterns(table(spark, data, "session_event")).select(F.array_join("pattern", " > ").alias("pattern"), "streams")


def _conversations(spark: SparkSession, data: str):
    from .chats import needed, rebuild
    from .linkage import link_batches

    lines, files = table(spark, data, "raw_line"), table(spark, data, "source_file")
    index, prepared = link_batches(lines, files, more=needed())
    index.drop(lines=False)
    return rebuild(lines, files, index.links().select(F.col("dup_id").alias("line_id")), lines=prepared)


def p3_found(spark: SparkSession, data: str) -> DataFrame:
    return _conversations(spark, data).defects


def p3_turns(spark: SparkSession, data: str) -> DataFrame:
    return _conversations(spark, data).turns


def p4_found(spark: SparkSession, data: str) -> DataFrame:
    from .linkage import rejected_lines

    return rejected_lines(table(spark, data, "raw_line"), table(spark, data, "source_file")).select("first_id", "dup_id")


def p5_found(spark: SparkSession, data: str) -> DataFrame:
    from .seen import seen_lines

    return seen_lines(table(spark, data, "raw_line")).where("seen").select("line_id")


def p5_seen(spark: SparkSession, data: str) -> DataFrame:
    from .seen import seen_lines

    return seen_lines(table(spark, data, "raw_line"))


def p5_rate(spark: SparkSession, data: str) -> DataFrame:
    from .seen import seen_lines, wrong_rate

    lines = table(spark, data, "raw_line")
    return wrong_rate(lines, seen_lines(lines))


def p6_found(spark: SparkSession, data: str) -> DataFrame:
    from .runs import collapse_runs

    return collapse_runs(table(spark, data, "session_event"), 2).select("s", "a", "first_i", "first_seg", "last_i", "last_seg")


def p6_runs(spark: SparkSession, data: str) -> DataFrame:
    from .runs import collapse_runs

    return collapse_runs(table(spark, data, "session_event")).drop("duration_ms")


def p7_found(spark: SparkSession, data: str) -> DataFrame:
    from .topk import top_values

    return top_values(table(spark, data, "session_event")).select("field", "item")


def p7_counts(spark: SparkSession, data: str) -> DataFrame:
    from .topk import top_values

    return top_values(table(spark, data, "session_event"))


def p8_found(spark: SparkSession, data: str) -> DataFrame:
    from .leaks import leaked

    return leaked(table(spark, data, "documents"), table(spark, data, "eval_item")).select("doc_id", "item_id")


def p8_spans(spark: SparkSession, data: str) -> DataFrame:
    from .leaks import leaked, removal_spans

    spans = removal_spans(leaked(table(spark, data, "documents"), table(spark, data, "eval_item")))
    return spans.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def p9_shares(spark: SparkSession, data: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, data, "documents"), table(spark, data, "mix_target")).shares


def p9_selection(spark: SparkSession, data: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, data, "documents"), table(spark, data, "mix_target")).selection


def p10_found(spark: SparkSession, data: str) -> DataFrame:
    from .residue import residue

    return residue(table(spark, data, "documents")).select("doc_id")


def p10_clean(spark: SparkSession, data: str) -> DataFrame:
    from .residue import clean

    return clean(table(spark, data, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        p1_found, p1_patterns, p3_found, p3_turns, p4_found, p5_found, p5_seen, p5_rate, p6_found, p6_runs, p7_found, p7_counts,
        p8_found, p8_spans, p9_selection, p9_shares, p10_found, p10_clean,
    )}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return dict(ORACLES)
