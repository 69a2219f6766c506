"""Problem 1: frequent subsequences with gaps.

Method: finite-state transducer mining. The constraints (items allowed, gap,
length, no item twice) are compiled into a transducer over the frequent items;
each piece of a stream is run through it, the accepted candidates of a stream
are split by their pivot (rarest item) into automata, written as sorted prefix
trees; equal automata of a pivot are added up as weights and shuffled by
pivot; the weighted automata are mined there and the counts added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .chunks import batches_of_streams, codes_of, sorted_events

#: Events of a stream in one piece, besides the overlap. Only the size of rows depends on it.
PIECE = 1024
#: Events whose states are held at once; a piece is never cut.
HELD = 1 << 13
#: Patterns whose weights a task holds before it gives them out to be added up.
WEIGHTS = 1 << 17


@dataclass(frozen=True)
class Constraint:
    """Patterns of shortest to longest items, all different, each at most gap
    places after the one before, in at least min_streams streams and
    min_percent % of all streams."""

    shortest: int = 3
    longest: int = 5
    gap: int = 3
    min_streams: int = 5
    min_percent: float = 4.0

    @property
    def reach(self) -> int:
        return (self.longest - 1) * self.gap


PIECES = "kind string, sid long, sid2 long, i long, seg long, split boolean, acts array<string>, act string, n long"


def _pieces(reach: int, gap: int):
    """Streams of a range-sorted chunk as pieces that overlap by `reach`
    events, the distinct acts of whole streams counted, and of the chunk's
    first and last stream, which may go on in other chunks, the ends."""
    schema = pa.schema([("kind", pa.string()), ("sid", pa.int64()), ("sid2", pa.int64()), ("i", pa.int64()), ("seg", pa.int64()), ("split", pa.bool_()), ("acts", pa.list_(pa.string())), ("act", pa.string()), ("n", pa.int64())])

    def lists(acts: pa.Array, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        sizes = ends - starts
        offsets = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, sizes)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), acts.take(pa.array(at)))

    def rows(kind: str, size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * size) if f.name == "kind" else columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        streams = 0
        held: pa.Table | None = None  # the stream that may go on in the next batch
        first = True  # it began before this chunk, or may have

        def flush(t: pa.Table, starts: np.ndarray, split: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Pieces and counts of the streams that begin at starts."""
            nonlocal streams
            n = t.num_rows
            acts = t["act"].combine_chunks()
            codes, names = codes_of(acts)
            stops = np.append(starts[1:], n)
            # A stream of several pieces counts as split, as each of them can hold the same pattern.
            per = np.maximum(1, -(-(stops - starts - reach) // PIECE))
            stream = np.repeat(np.arange(len(starts)), per)
            k = np.arange(len(stream)) - np.repeat(np.cumsum(per) - per, per)
            from_, to = starts[stream] + k * PIECE, np.minimum(starts[stream] + (k + 1) * PIECE + reach, stops[stream])
            sid, sid2 = t["sid"].to_numpy(), t["sid2"].to_numpy()
            yield rows("piece", len(stream), sid=pa.array(sid[from_]), sid2=pa.array(sid2[from_]), split=pa.array((split | (per > 1))[stream]), acts=lists(acts, from_, to))
            # distinct acts of each stream
            own = np.unique(np.repeat(np.arange(len(starts)), stops - starts) * len(names) + codes)
            whole = ~split[own // len(names)]
            for c, x in zip(*np.unique(own[whole] % len(names), return_counts=True)):
                counts[names[c]] = counts.get(names[c], 0) + int(x)
            streams += int((~split).sum())
            part = own[~whole]
            if len(part):
                at = starts[part // len(names)]
                yield rows("part_item", len(part), sid=pa.array(sid[at]), sid2=pa.array(sid2[at]), act=pa.array(names).take(pa.array(part % len(names))))

        def ends(t: pa.Table, start: int, end: int) -> Iterator[pa.RecordBatch]:
            """The first and last events of a split stream in this chunk."""
            nonlocal head
            one = t.slice(start, end - start)
            acts = one["act"].to_pylist()
            if head is not None:
                at, acts = head[0], [*head[1], *[None] * (gap + 1), *acts[-reach:]]
            else:
                at = {k: one[k][0].as_py() for k in ("sid", "sid2", "i", "seg")}
                if len(acts) > 2 * reach:
                    acts = [*acts[:reach], *[None] * (gap + 1), *acts[-reach:]]
            head = None
            yield rows("ends", 1, acts=pa.array([acts], pa.list_(pa.string())), **{k: pa.array([v], pa.int64()) for k, v in at.items()})

        head: tuple[dict, list[str]] | None = None
        for t, other in batches_of_streams(batches):
            t = t.select(["sid", "sid2", "i", "seg", "act"])
            if held is not None:
                other = np.concatenate([np.arange(held.num_rows) == 0, other])
                t = pa.concat_tables([held, t])
            elif first:
                other = other.copy()
                other[0] = True
            starts = np.flatnonzero(other)
            last = int(starts[-1])
            split = np.zeros(len(starts), bool)
            split[0] = first
            if t.num_rows - last > 64 * PIECE:
                # A very long stream is given out in parts, which overlap by reach.
                split[-1] = True
                yield from flush(t, starts, split)
                if split[0] and len(starts) > 1:
                    yield from ends(t, 0, int(starts[1]))
                if head is None:
                    head = ({k: t[k][last].as_py() for k in ("sid", "sid2", "i", "seg")}, t["act"].slice(last, reach).to_pylist())
                held, first = t.slice(t.num_rows - reach), True
                continue
            if len(starts) > 1:
                yield from flush(t.slice(0, last), starts[:-1], split[:-1])
                if first:
                    yield from ends(t, 0, int(starts[1]))
                first = False
            held = t.slice(last)
        if held is not None:
            yield from flush(held, np.array([0]), np.array([True]))
            yield from ends(held, 0, held.num_rows)
            yield rows("streams", 1, n=pa.array([streams]))
        if counts:
            yield rows("item", len(counts), act=pa.array(list(counts)), n=pa.array(list(counts.values())))

    return run


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most HELD events or one piece: a batch has
    a fixed number of pieces, but those of a long stream are long."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("acts")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + HELD, "right")))
            yield batch.slice(at, to - at)
            at = to


def _coded(batch: pa.RecordBatch, rank: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Flat item codes of the pieces, -1 where no frequent item is, and the
    number of the piece of each."""
    acts = batch.column("acts")
    sizes = pc.fill_null(pc.list_value_length(acts), 0).to_numpy(zero_copy_only=False)
    codes, names = codes_of(pc.fill_null(acts.flatten(), ""))
    to = np.array([rank.get(x, -1) for x in names] or [-1], np.int64)
    return to[codes] if len(codes) else codes, np.repeat(np.arange(batch.num_rows), sizes)


def _pairs(rank: dict[str, int], gap: int):
    """In how many streams one frequent item follows another within the gap:
    counts for whole streams, the streams themselves for split ones."""
    m = len(rank)
    schema = pa.schema([("pair", pa.int64()), ("sid", pa.int64()), ("sid2", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m * m, np.int64)
        for batch in _portions(batches):
            codes, piece = _coded(batch, rank)
            found = []
            for d in range(1, gap + 1):
                a, b = codes[:-d], codes[d:]
                ok = (piece[d:] == piece[:-d]) & (a >= 0) & (b >= 0) & (a != b)
                found.append(piece[d:][ok] * (m * m) + a[ok] * m + b[ok])
            own = np.unique(np.concatenate(found))
            at, pair = own // (m * m), own % (m * m)
            split = batch.column("split").to_numpy(zero_copy_only=False).astype(bool)[at]
            total += np.bincount(pair[~split], minlength=m * m)
            if split.any():
                s = pa.array(at[split])
                yield pa.RecordBatch.from_arrays([pa.array(pair[split]), batch.column("sid").take(s), batch.column("sid2").take(s), pa.nulls(len(s), pa.int64())], schema=schema)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.array(total[some])], schema=schema)

    return run


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Places of the distinct rows, sorted by the columns."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return order[new]


def _automata(rank: dict[str, int], follows: np.ndarray, c: Constraint):
    """Runs each piece through the transducer and writes, for each pivot of a
    stream, the accepted patterns as one automaton: the sorted patterns as
    digits, each cut by the prefix it shares with the one before."""
    m = len(rank)
    base = m + 1
    if base**c.longest >= 1 << 62:
        raise ValueError(f"{m} frequent items: patterns of {c.longest} don't fit in a key; raise min_percent")
    schema = pa.schema([("pivot", pa.int32()), ("automaton", pa.binary()), ("sid", pa.int64()), ("sid2", pa.int64())])
    wide = np.uint8 if base <= 250 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            codes, piece = _coded(batch, rank)
            n = len(codes)
            if not n or not m:
                continue
            steps = []  # the transducer's live transitions, by gap
            for d in range(1, c.gap + 1):
                live = np.zeros(n, bool)
                if n > d:
                    a, b = codes[:-d], codes[d:]
                    live[:-d] = (piece[d:] == piece[:-d]) & (a >= 0) & (b >= 0)
                    live[:-d] &= follows[np.maximum(a, 0), np.maximum(b, 0)]
                steps.append(live)
            # States are the items so far; a state moves on along each live transition to an item that it has not.
            at = np.flatnonzero(codes >= 0)
            items = codes[at][:, None]
            accepted = []
            for length in range(2, c.longest + 1):
                grown, ends = [], []
                for d, live in enumerate(steps, 1):
                    go = np.flatnonzero(live[at])
                    new = codes[at[go] + d]
                    fresh = (items[go] != new[:, None]).all(axis=1)
                    grown.append(np.column_stack([items[go][fresh], new[fresh]]))
                    ends.append(at[go][fresh] + d)
                items, at = np.concatenate(grown), np.concatenate(ends)
                key = np.zeros(len(items), np.int64)
                for k in range(length):
                    key = key * base + items[:, k]
                # One state for each (end, items): paths that meet are merged.
                one = _distinct(at, key)
                items, at = items[one], at[one]
                if length >= c.shortest:
                    padded = np.full((len(items), c.longest), m, np.int64)
                    padded[:, :length] = items
                    accepted.append(np.column_stack([piece[at], items.max(axis=1) if len(items) else at, padded]))
            rows = np.concatenate(accepted)
            if not len(rows):
                continue
            key = np.zeros(len(rows), np.int64)
            for k in range(c.longest):
                key = key * base + rows[:, 2 + k]
            rows = rows[_distinct(rows[:, 0], rows[:, 1], key)]
            group = np.ones(len(rows), bool)
            group[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            digits = rows[:, 2:]
            shared = np.zeros(len(rows), np.int64)
            shared[1:] = np.cumprod(digits[1:] == digits[:-1], axis=1).sum(axis=1)
            shared[group] = 0
            length = (digits < m).sum(axis=1)
            # each pattern: shared prefix, length, then the digits after the prefix
            cells = np.column_stack([shared, length, digits])
            used = np.arange(c.longest)[None, :]
            mask = np.column_stack([np.ones((len(rows), 2), bool), (used >= shared[:, None]) & (used < length[:, None])])
            flat = cells[mask].astype(wide)
            size = mask.sum(axis=1)
            starts = np.flatnonzero(group)
            offsets = np.append(np.add.reduceat(size, starts).cumsum() - np.add.reduceat(size, starts), size.sum()) * flat.itemsize
            automaton = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            stream = pa.array(rows[starts, 0])
            split = batch.column("split").take(stream)
            null = pa.scalar(None, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[starts, 1].astype(np.int32)), automaton, pc.if_else(split, batch.column("sid").take(stream), null), pc.if_else(split, batch.column("sid2").take(stream), null)], schema=schema
            )

    return run


def _mine(m: int, c: Constraint):
    """Adds up the weights of the patterns that the automata accept. Patterns
    of split streams keep their stream, as several automata can hold them.
    Sums are given out whenever there are WEIGHTS of them, so that a task holds no
    more however many patterns it meets; they are added up after it."""
    base = m + 1
    wide = np.uint8 if base <= 250 else np.uint16
    schema = pa.schema([("pattern", pa.list_(pa.int32())), ("sid", pa.int64()), ("sid2", pa.int64()), ("n", pa.int64())])

    def patterns(automaton: bytes) -> list[tuple[int, ...]]:
        cells, k, path, out = np.frombuffer(automaton, wide).tolist(), 0, [], []
        while k < len(cells):
            shared, length = cells[k], cells[k + 1]
            k += 2
            path = path[:shared] + cells[k : k + length - shared]
            k += length - shared
            out.append(tuple(path))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight: dict[tuple[int, ...], int] = {}
        own: set[tuple] = set()  # (pattern, stream) of split streams

        def sums() -> Iterator[pa.RecordBatch]:
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*zip(*own), [None] * len(own)], schema.types)], schema=schema)
            if weight:
                none = pa.nulls(len(weight), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(weight), schema.types[0]), none, none, pa.array(list(weight.values()), pa.int64())], schema=schema)
            own.clear()
            weight.clear()

        for b in batches:
            for batch in (b.slice(k, 1000) for k in range(0, b.num_rows, 1000)):
                for automaton, sid, sid2, n in zip(*(batch.column(x).to_pylist() for x in ("automaton", "sid", "sid2", "weight"))):
                    if sid is None:
                        for p in patterns(automaton):
                            weight[p] = weight.get(p, 0) + n
                    else:
                        own.update((p, sid, sid2) for p in patterns(automaton))
                    if len(weight) + len(own) >= WEIGHTS:
                        yield from sums()
        yield from sums()

    return run


def _supports(df: DataFrame, key: str) -> DataFrame:
    """Streams by key: sums of counts and, for split streams, distinct streams."""
    split = df.where("sid is not null").groupBy(key, "sid", "sid2").agg(F.lit(1).cast("long").alias("n")).select(key, "n")
    return df.where("sid is null").select(key, "n").unionByName(split).groupBy(key).agg(F.sum("n").alias("streams"))


def frequent_patterns(events: DataFrame, constraint: Constraint = Constraint(), salts: int = 8) -> DataFrame:
    """pattern array<string>, streams: ordered patterns of acts with gaps and
    the number of streams (p, s, a ordered by i, seg) each occurs in.

    Every pattern that meets the constraint is given, those within longer ones
    too. Copies of an event count once, events without an act not at all; acts
    are compared without letter case and outer white space. No events, or no
    act in enough streams: no rows. The driver gets only the frequent items
    and pairs; an item counts if it is in min_percent % of all streams, so
    there are at most 100 / min_percent times the mean number of acts a stream.
    """
    spark = events.sparkSession
    c = constraint
    scratch = Scratch(spark, "patterns")
    rows = scratch.save(sorted_events(events).mapInArrow(_pieces(c.reach, c.gap), PIECES), "pieces")
    ends = rows.where("kind = 'ends'").groupBy("sid", "sid2").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "seg", "acts"))), lambda x: x["acts"])).alias("acts"))
    pieces = rows.where("kind = 'piece'").select("sid", "sid2", "split", "acts").unionByName(ends.select("sid", "sid2", F.lit(True).alias("split"), "acts"))
    n_streams = rows.where("kind = 'streams'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + rows.where("kind = 'ends'").select("sid", "sid2").distinct().count()
    least = max(c.min_streams, int(-(-n_streams * c.min_percent // 100)), 1)
    items = _supports(rows.where("kind in ('item', 'part_item')").select("act", "sid", "sid2", "n"), "act").where(F.col("streams") >= least)
    ranked = [r[0] for r in items.orderBy(F.desc("streams"), "act").collect()]
    rank = {x: k for k, x in enumerate(ranked)}
    m = len(rank)
    empty = spark.createDataFrame([], "pattern array<string>, streams long")
    if not m:
        return empty
    pairs = _supports(pieces.mapInArrow(_pairs(rank, c.gap), "pair long, sid long, sid2 long, n long"), "pair").where(F.col("streams") >= least)
    follows = np.zeros((m, m), bool)
    for r in pairs.select("pair").collect():
        follows[r[0] // m, r[0] % m] = True
    automata = pieces.mapInArrow(_automata(rank, follows, c), "pivot int, automaton binary, sid long, sid2 long")
    # Equal automata are counted before the shuffle by pivot; a pivot with many different ones is salted.
    weighted = automata.groupBy("pivot", "automaton", "sid", "sid2").agg(F.count(F.lit(1)).alias("weight"))
    weighted = weighted.repartition(F.col("pivot"), F.pmod(F.xxhash64("automaton"), F.lit(salts)))
    mined = weighted.mapInArrow(_mine(m, c), "pattern array<int>, sid long, sid2 long, n long")
    out = _supports(mined, "pattern").where(F.col("streams") >= least)
    names = F.array(*[F.lit(x) for x in ranked])
    return out.select(F.transform("pattern", lambda x: F.element_at(names, x + 1)).alias("pattern"), "streams")


