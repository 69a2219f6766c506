"""Problem 6: runs of alike consecutive events.

Method: associative run summaries. Range-sorted chunks encode their runs
locally; only the first and the last run of a chunk can go on in another one,
and a prefix merge over those edge runs joins the compatible ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .canon import NO_POSITION
from .chunks import batches_of_streams, sorted_events

MAX_STEP = 10
SCHEMA = (
    "sid long, sid2 long, p string, s string, a string, act string, first_i long, first_seg long, first_b long, "
    "last_i long, last_seg long, last_b long, n long, from_us long, to_us long, opens boolean, closes boolean"
)
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
ARROW = pa.schema([(x.split()[0], KINDS[x.split()[1]]) for x in SCHEMA.split(", ")])


def _alike(i0, b0, i1, b1, step: int) -> bool:
    """The rule for neighbours of one act; None for an unknown size."""
    return b0 is not None and b1 is not None and i1 - i0 <= step and 10 * abs(b1 - b0) <= max(b0, b1)


def _encode(min_count: int, step: int):
    def merge(x: dict, y: dict) -> dict:
        low = [v for v in (x["from_us"], y["from_us"]) if v is not None]
        high = [v for v in (x["to_us"], y["to_us"]) if v is not None]
        return x | {k: y[k] for k in ("last_i", "last_seg", "last_b", "closes")} | {"n": x["n"] + y["n"], "from_us": min(low, default=None), "to_us": max(high, default=None)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # the run that may go on in the next batch
        opened = False
        for t, other in batches_of_streams(batches):
            n = t.num_rows
            i = t["i"].to_numpy()
            b_null = pc.is_null(t["b"]).to_numpy()
            b = pc.fill_null(t["b"], 0).to_numpy()
            us_null = pc.is_null(t["us"]).to_numpy()
            us = pc.fill_null(t["us"], 0).to_numpy()
            act = t["act"].combine_chunks()
            brk = np.ones(n, bool)
            if n > 1:
                same = pc.equal(act.slice(1), act.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                near = (i[1:] - i[:-1] <= step) & (10 * np.abs(b[1:] - b[:-1]) <= np.maximum(b[1:], b[:-1])) & ~b_null[1:] & ~b_null[:-1]
                brk[1:] = other[1:] | ~(same & near)
            at = np.flatnonzero(brk)
            end = np.append(at[1:], n) - 1
            low = np.minimum.reduceat(np.where(us_null, np.iinfo(np.int64).max, us), at)
            high = np.maximum.reduceat(np.where(us_null, np.iinfo(np.int64).min, us), at)
            none = low == np.iinfo(np.int64).max
            first, last = t.take(pa.array(at)), t.take(pa.array(end))
            columns = {k: first[k] for k in ("sid", "sid2", "p", "s", "a", "act")}
            columns |= {"first_i": first["i"], "first_seg": first["seg"], "first_b": first["b"], "last_i": last["i"], "last_seg": last["seg"], "last_b": last["b"]}
            columns |= {"n": pa.array(end - at + 1), "from_us": pa.array(low, mask=none), "to_us": pa.array(high, mask=none)}
            flags = pa.array(np.zeros(len(at), bool))
            columns |= {"opens": flags, "closes": flags}
            runs = pa.table({k: columns[k] for k in FIELDS}).cast(ARROW)
            head = runs.slice(0, 1).to_pylist()[0]
            joined = held is not None and not other[0] and held["act"] == head["act"] and _alike(held["last_i"], held["last_b"], head["first_i"], head["first_b"], step)
            if joined:
                head = merge(held, head)
            elif held is not None:
                if held["n"] >= min_count or held["opens"]:
                    yield pa.RecordBatch.from_pylist([held], schema=ARROW)
            if not opened:
                head["opens"] = opened = True
            if runs.num_rows == 1:
                held = head
                continue
            if head["n"] >= min_count or head["opens"]:
                yield pa.RecordBatch.from_pylist([head], schema=ARROW)
            inner = runs.slice(1, runs.num_rows - 2)
            yield from inner.filter(pc.greater_equal(inner["n"], min_count)).to_batches()
            held = runs.slice(runs.num_rows - 1).to_pylist()[0]
        if held is not None:
            yield pa.RecordBatch.from_pylist([held | {"closes": True}], schema=ARROW)

    return run


def collapse_runs(events: DataFrame, min_count: int = 1, max_step: int = MAX_STEP) -> DataFrame:
    """Each run of alike neighbouring events of a stream (p, s, a) as one row:
    p, s, a, act, first_i, first_seg, last_i, last_seg, events, duration_ms.

    Neighbours are alike if they have the same act, i rises by at most
    max_step and 10 times the difference of b is at most the larger b. An
    event without b is like no other. duration_ms spans the known times of the
    run (t may step back), null if there is none. Events without an act are
    left out; copies of an event count once. Runs shorter than min_count are
    not given. An empty table gives no rows; columns besides those named are
    ignored.
    """
    rows = sorted_events(
        events,
        {"p": events["p"], "s": events["s"], "a": events["a"], "b": events["b"].cast("long"), "us": F.unix_micros(events["t"].cast("timestamp")), "arrived": F.unix_micros(events["loaded_at"].cast("timestamp"))},
        ties=("arrived", "us", "b"),
    ).drop("arrived")
    parts = Scratch(events.sparkSession, "runs").save(rows.mapInArrow(_encode(min_count, max_step), SCHEMA), "parts")
    edge = F.col("opens") | F.col("closes")
    whole = parts.where(~edge)
    # At most two edge runs a chunk: the merge sees rows in proportion to the chunks, not to the events.
    by = Window.partitionBy("sid", "sid2").orderBy("first_i", "first_seg")
    before = F.lag(F.struct("act", "last_i", "last_b", "closes")).over(by)
    goes_on = (
        F.col("opens") & F.col("before.closes") & (F.col("before.act") == F.col("act")) & (F.col("first_i") - F.col("before.last_i") <= max_step)
        & (10 * F.abs(F.col("first_b") - F.col("before.last_b")) <= F.greatest("first_b", "before.last_b"))
    )
    edges = parts.where(edge).withColumn("before", before)
    edges = edges.withColumn("run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = edges.groupBy("sid", "sid2", "run").agg(
        F.first("p").alias("p"), F.first("s").alias("s"), F.first("a").alias("a"), F.first("act").alias("act"),
        F.min(F.struct("first_i", "first_seg")).alias("x"), F.max(F.struct("last_i", "last_seg")).alias("y"),
        F.sum("n").alias("n"), F.min("from_us").alias("from_us"), F.max("to_us").alias("to_us"),
    )
    merged = merged.select("p", "s", "a", "act", "x.first_i", "x.first_seg", "y.last_i", "y.last_seg", "n", "from_us", "to_us").where(F.col("n") >= min_count)
    out = whole.select(merged.columns).unionByName(merged)
    place = lambda c: F.when(F.col(c) != NO_POSITION, F.col(c)).alias(c)
    return out.select(
        "p", "s", "a", "act", place("first_i"), place("first_seg"), place("last_i"), place("last_seg"),
        F.col("n").alias("events"), F.expr("(to_us - from_us) div 1000").alias("duration_ms"),
    )
