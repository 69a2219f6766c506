"""What follows directly on what, and bounces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .streams import around


def edges(token_rows: DataFrame) -> DataFrame:
    """src, dst, n: how often one token directly follows another."""
    rows = around(token_rows, after={"next": ("tok", 1)}).where(F.size("next") == 1)
    return rows.groupBy(F.col("tok").alias("src"), F.col("next")[0].alias("dst")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src", "dst")


def bounces(token_rows: DataFrame) -> DataFrame:
    """a, b, n: how often a stream goes from one token to another and back; the
    smaller token is a."""
    rows = around(token_rows, after={"next": ("tok", 2)}).where((F.size("next") == 2) & (F.col("next")[1] == F.col("tok")) & (F.col("next")[0] != F.col("tok")))
    pair = F.least("tok", F.col("next")[0]).alias("a"), F.greatest("tok", F.col("next")[0]).alias("b")
    return rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "a", "b")
