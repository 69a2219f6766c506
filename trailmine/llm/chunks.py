"""Events as range-sorted chunks: each partition holds a contiguous range of
(stream, i, seg), whatever the size of a stream, so that a hot stream is split
over many tasks instead of being gathered in one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canon import NO_POSITION, act_form, stream_ids

ORDER = ("sid", "sid2", "i", "seg")


def sorted_events(events: DataFrame, extra: dict[str, Column] | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Events with an act, sorted by (stream, i, seg) inside range partitions.

    Copies of an event have equal keys, so they are neighbours in one
    partition; the first in the order of `ties` and then the act stands for
    them. Null i or seg sort first and count as a place of their own.
    """
    act = act_form(events["act"])
    kept = events.where(act.isNotNull()).select(
        *stream_ids(events),
        F.coalesce(events["i"], F.lit(NO_POSITION)).cast("long").alias("i"),
        F.coalesce(events["seg"], F.lit(NO_POSITION)).cast("long").alias("seg"),
        act.alias("act"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    ordered = [*ORDER, *[F.col(t).asc_nulls_last() for t in ties], "act"]
    return kept.repartitionByRange(*ORDER).sortWithinPartitions(*ordered)


def batches_of_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table without copies, mask: row begins another stream than the row
    before it in the partition) for each batch; state goes from batch to batch."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in ORDER]
        n = batch.num_rows
        equal = [np.empty(n, bool) for _ in keys]
        for k, (e, v) in enumerate(zip(equal, keys)):
            e[1:] = v[1:] == v[:-1]
            e[0] = last is not None and v[0] == last[k]
        copy = equal[0] & equal[1] & equal[2] & equal[3]
        other = ~(equal[0] & equal[1])
        last = tuple(v[-1] for v in keys)
        if copy.any():
            keep = ~copy
            batch, other = batch.filter(pa.array(keep)), other[keep]
            if not batch.num_rows:
                continue
        yield pa.Table.from_batches([batch]), other


def codes_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, list]:
    """Dictionary codes and their values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = pc.dictionary_encode(column)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
