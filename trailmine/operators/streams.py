"""Event streams as numbered token streams.

A stream is never gathered in one task: its events are parted by (f, i div
BUCKET), each part is numbered alone, and a small table with a row for each
part carries the offsets. So a stream with a third of all events is cut into
as many parts as its length asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lens import lens as lens_token
from ..functions.lens import marked

BUCKET = 4096
#: Columns of a token stream: key, first place of the stream, place from 0, token, line, bytes.
TOKENS = ("stream", "first", "pos", "tok", "seq", "bytes")


def stream_key() -> Column:
    return F.concat(F.col("p"), F.lit("/"), F.col("s"), F.lit("@"), F.col("a"))


def visible(events: DataFrame, lens: str = "tool", mark_fail: bool = True, no_sidechain: bool = False) -> DataFrame:
    """Events that the lens sees, with their token; sidechain ones dropped first."""
    rows = events.where(~F.col("sc")) if no_sidechain else events
    token = marked(lens_token(lens)) if mark_fail else lens_token(lens)
    rows = rows.select(stream_key().alias("stream"), "f", "i", "seg", F.col("b").alias("bytes"), token.alias("tok"))
    return rows.where("tok is not null")


def tokens(events: DataFrame, lens: str = "tool", mark_fail: bool = True, collapse: bool = True, no_sidechain: bool = False, bucket: int = BUCKET) -> DataFrame:
    """Token streams of event tables (schema.EVENT).

    With collapse a run of at least two equal tokens becomes one token with +,
    at the line of its first and with the bytes of all. Equal places are
    ordered by token. No events give no tokens.
    """
    rows = visible(events, lens, mark_fail, no_sidechain).withColumn("part", F.expr(f"i div {bucket}"))
    keys = ["stream", "f", "part"]
    inner = Window.partitionBy(*keys).orderBy("i", "seg", "tok")
    before = F.lag("tok").over(inner)
    rows = rows.withColumn("rank", F.row_number().over(inner)).withColumn("turn", (before.isNotNull() & (before != F.col("tok"))).cast("int"))
    at = F.struct("i", "seg", "tok")
    parts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("turn").alias("turns"), F.min(F.struct("f", "i", "seg")).alias("low"), F.min_by("tok", at).alias("head"), F.max_by("tok", at).alias("tail")
    )
    along = Window.partitionBy("stream").orderBy("f", "part")
    so_far = along.rowsBetween(Window.unboundedPreceding, -1)
    joins = F.lag("tail").over(along) == F.col("head")
    parts = parts.withColumn("opens", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    parts = parts.select(
        *keys, F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("n_before"), F.first("low").over(along).alias("first"),
        (F.coalesce(F.sum(F.col("turns") + F.col("opens")).over(so_far), F.lit(0)) + F.col("opens")).alias("runs_before"),
    )
    rows = rows.join(parts, keys)
    if not collapse:
        return rows.select("stream", "first", (F.col("n_before") + F.col("rank") - 1).cast("long").alias("pos"), "tok", F.col("i").alias("seq"), "bytes")
    run = F.col("runs_before") + F.sum("turn").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - 1
    runs = rows.withColumn("pos", run.cast("long")).groupBy("stream", "pos").agg(
        F.min("first").alias("first"), F.min("tok").alias("tok"), F.count(F.lit(1)).alias("n"), F.min(F.struct("f", "i")).alias("at"), F.sum("bytes").alias("bytes")
    )
    return runs.select("stream", "first", "pos", F.when(F.col("n") > 1, F.concat("tok", F.lit("+"))).otherwise(F.col("tok")).alias("tok"), F.col("at.i").alias("seq"), "bytes")


def around(rows: DataFrame, before: dict[str, tuple[str, int]] | None = None, after: dict[str, tuple[str, int]] | None = None, chunk: int = BUCKET) -> DataFrame:
    """Token rows with arrays of the column's next (after) or last (before)
    values in the stream, up to the number given: {name: (column, number)}.
    Chunks of places overlap by that number, so that a chunk is a task's unit."""
    before, after = before or {}, after or {}
    back, ahead = max([n for _, n in before.values()], default=0), max([n for _, n in after.values()], default=0)
    if max(back, ahead) >= chunk:
        raise ValueError(f"at most {chunk - 1} neighbours")
    home = F.expr(f"pos div {chunk}")
    inside = F.col("pos") % chunk
    copies = F.array(home, F.when((inside < ahead) & (home > 0), home - 1), F.when(inside >= chunk - back, home + 1))
    rows = rows.withColumn("chunk", F.explode(F.array_compact(copies)))
    by = Window.partitionBy("stream", "chunk").orderBy("pos")
    out = rows
    for name, (column, n) in after.items():
        out = out.withColumn(name, F.collect_list(column).over(by.rowsBetween(1, n)))
    for name, (column, n) in before.items():
        out = out.withColumn(name, F.collect_list(column).over(by.rowsBetween(-n, -1)))
    return out.where(F.col("chunk") == home).drop("chunk")


def vocabulary(token_rows: DataFrame) -> DataFrame:
    """tok, n, id: distinct tokens numbered in the order in which they are
    first seen; tokens of runs come after the plain ones, as they arise later.

    Tokens are parted by the first place's file and line before they are
    numbered, as in tokens().
    """
    place = F.struct(F.col("tok").endswith("+").alias("late"), F.col("first.f").alias("f"), F.col("seq").alias("i"), F.col("first").alias("first"), F.col("pos").alias("pos"))
    seen = token_rows.groupBy("tok").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"))
    seen = seen.withColumn("part", F.expr(f"at.i div {BUCKET}"))
    keys = ["late", "f", "part"]
    seen = seen.select("tok", "n", "at.late", "at.f", "part", "at")
    sizes = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("shift", F.coalesce(F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("at", "tok"))
    return seen.join(sizes, keys).select("tok", "n", (F.col("shift") + rank - 1).cast("long").alias("id"))


def session_tokens(token_rows: DataFrame, session: str, limit: int = 200) -> DataFrame:
    """The tokens of streams whose session@agent begins with `session`, or
    whose key contains it, in order."""
    part = F.substring_index("stream", "/", -1).startswith(session)
    return token_rows.where(part | F.col("stream").contains(session)).orderBy("stream", "pos").limit(limit)
