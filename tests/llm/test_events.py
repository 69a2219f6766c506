"""Problems 1, 6 and 7: against brute force, at chunk borders and on dirty rows."""

import random
import tracemalloc
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest

from trailmine.llm import patterns
from trailmine.llm.chunks import batches_of_streams
from trailmine.llm.patterns import Constraint, frequent_patterns
from trailmine.llm.runs import _encode, collapse_runs
from trailmine.llm.topk import threshold_top, top_values

SCHEMA = "p string, s string, a string, i long, seg long, act string, tgt string, b long, t timestamp_ntz, loaded_at timestamp_ntz, sid string, node string, n string"
T = datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA) if rows else spark.createDataFrame([], SCHEMA)


def streams(lists, again=False):
    rows = [("p", f"s{k}", "", i, 0, act, None, 10, T, T) for k, acts in enumerate(lists) for i, act in enumerate(acts)]
    if again:
        rows += [(p, s, a, i, g, f" {x.upper()}\t", t, b, None, None) for p, s, a, i, g, x, t, b, _, _ in rows]
    random.Random(1).shuffle(rows)
    return rows


def brute(lists, c):
    support = Counter()
    for acts in lists:
        seen = set()

        def grow(path, at, acts=acts, seen=seen):
            if len(path) >= c.shortest:
                seen.add(path)
            if len(path) < c.longest:
                for k in range(at + 1, min(at + c.gap + 1, len(acts))):
                    if acts[k] not in path:
                        grow((*path, acts[k]), k)

        for k, x in enumerate(acts):
            grow((x,), k)
        support.update(seen)
    return {p: n for p, n in support.items() if n >= max(c.min_streams, c.min_percent * len(lists) / 100)}


def test_patterns_against_brute_force_with_split_streams(spark, monkeypatch):
    monkeypatch.setattr(patterns, "PIECE", 8)  # the driver's part only; the pieces below are cut by the partitions
    rng = random.Random(2)
    lists = [[rng.choice("abcdefg") for _ in range(rng.randrange(0, 20))] for _ in range(30)] + [[rng.choice("abcdefg") for _ in range(700)]]
    c = Constraint(min_streams=6, min_percent=10)
    rows = streams(lists, again=True) + [("p", "s0", "", 500, 0, None, None, 1, T, T), ("p", "only-blank", "", 1, 0, "  ", None, 1, T, T)]
    got = {tuple(r["pattern"]): r["streams"] for r in frequent_patterns(frame(spark, rows), c).collect()}
    assert got == brute([x for x in lists if x], c)


@pytest.mark.parametrize("chunk", [1, 5, 40, 10_000])
def test_pieces_and_automata_give_the_same_for_any_chunks(monkeypatch, chunk):
    monkeypatch.setattr(patterns, "PIECE", 7)
    rng = random.Random(chunk)
    lists = [[rng.choice("abcde") for _ in range(rng.randrange(1, 30))] for _ in range(9)] + [[rng.choice("abcde") for _ in range(900)]]
    c = Constraint(shortest=2, longest=4, min_streams=4, min_percent=0)
    flat = [(k, i, x) for k, acts in enumerate(lists) for i, x in enumerate(acts)]
    pieces, part_ends = [], {}
    for at in range(0, len(flat), 257):  # partitions
        own = flat[at : at + 257]
        batches = [pa.RecordBatch.from_pydict({"sid": [r[0] for r in own[k : k + chunk]], "sid2": [0] * len(own[k : k + chunk]), "i": [r[1] for r in own[k : k + chunk]], "seg": [0] * len(own[k : k + chunk]), "act": [r[2] for r in own[k : k + chunk]]}) for k in range(0, len(own), chunk)]
        for b in patterns._pieces(c.reach, c.gap)(iter(batches)):
            for r in b.to_pylist():
                if r["kind"] == "piece":
                    pieces.append((r["sid"], r["split"], r["acts"]))
                elif r["kind"] == "ends":
                    part_ends.setdefault(r["sid"], []).append((r["i"], r["acts"]))
    pieces += [(k, True, [x for _, acts in sorted(v, key=lambda x: x[0]) for x in acts]) for k, v in part_ends.items()]
    rank = {x: k for k, x in enumerate("abcde")}
    batch = pa.RecordBatch.from_pydict({"sid": [p[0] for p in pieces], "sid2": [0] * len(pieces), "split": [p[1] for p in pieces], "acts": [p[2] for p in pieces]})
    follows = ~np.eye(5, dtype=bool)
    weight, split = Counter(), set()
    for b in patterns._automata(rank, follows, c)(iter([batch])):
        table = pa.Table.from_batches([b]).append_column("weight", pa.array([1] * b.num_rows))
        for m in patterns._mine(5, c)(iter(table.to_batches())):
            for r in m.to_pylist():
                if r["sid"] is None:
                    weight[tuple(r["pattern"])] += r["n"]
                else:
                    split.add((tuple(r["pattern"]), r["sid"]))
    weight.update(p for p, _ in split)
    got = {tuple("abcde"[k] for k in p): n for p, n in weight.items() if n >= 4}
    assert got == brute(lists, c)


def test_pattern_tasks_hold_little_however_long_the_streams(monkeypatch):
    """A batch of long pieces is run in portions; weights are given out before there are too many."""
    rng = random.Random(5)
    pieces = [[rng.choice("abcdefgh") for _ in range(1000)] for _ in range(150)]
    rank = {x: k for k, x in enumerate("abcdefgh")}
    batch = pa.RecordBatch.from_pydict({"sid": list(range(150)), "sid2": [0] * 150, "split": [k % 3 == 0 for k in range(150)], "acts": pieces})
    make = lambda: patterns._automata(rank, ~np.eye(8, dtype=bool), Constraint())
    tracemalloc.start()
    automata = [b for b in make()(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6

    def mined():
        sums, sizes = Counter(), []
        for m in patterns._mine(8, Constraint())(pa.RecordBatch.from_arrays([*b.columns, pa.array([1] * b.num_rows)], names=[*b.schema.names, "weight"]) for b in automata):
            sizes.append(m.num_rows)
            rows = m.to_pylist()
            assert len({(tuple(r["pattern"]), r["sid"]) for r in rows}) == len(rows)
            for r in rows:
                key = tuple(r["pattern"]), r["sid"]
                sums[key] = sums[key] + r["n"] if r["sid"] is None else 1
        return sums, max(sizes)

    whole, _ = mined()
    monkeypatch.setattr(patterns, "WEIGHTS", 2_000)
    parts, most = mined()
    assert parts == whole and most < 12_000


def test_patterns_of_nothing(spark):
    assert frequent_patterns(frame(spark, [])).collect() == []
    assert frequent_patterns(frame(spark, streams([list("abc")]))).collect() == []


def runs_of(rows):
    out, last = [], None
    for key, i, seg, act, b in rows:
        ok = last and last[0] == key and last[3] == act and i - last[1] <= 10 and b is not None and last[4] is not None and 10 * abs(b - last[4]) <= max(b, last[4])
        if ok:
            out[-1][3:] = [i, seg, out[-1][5] + 1]
        else:
            out.append([key, i, seg, i, seg, 1])
        last = (key, i, seg, act, b)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("size", [1, 3, 50])
def test_runs_in_batches(size):
    rng = random.Random(size)
    rows, at = [], {}
    for _ in range(400):
        k = rng.randrange(3)
        at[k] = at.get(k, 0) + rng.choice([0, 1, 5, 11])
        rows.append((k, at[k], len(rows), rng.choice("ab"), rng.choice([100, 105, 50, None])))
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    columns = lambda own: {"sid": [r[0] for r in own], "sid2": [0] * len(own), "i": [r[1] for r in own], "seg": [r[2] for r in own], "act": [r[3] for r in own], "p": [""] * len(own), "s": [str(r[0]) for r in own], "a": [""] * len(own), "b": pa.array([r[4] for r in own], pa.int64()), "us": pa.array([None] * len(own), pa.int64())}
    batches = [pa.RecordBatch.from_pydict(columns(rows[k : k + size])) for k in range(0, len(rows), size)]
    got = [(int(r["s"]), r["first_i"], r["first_seg"], r["last_i"], r["last_seg"], r["n"]) for b in _encode(1, 10)(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == runs_of(rows)


def test_runs_with_dirt(spark):
    second = T.replace(second=5)
    rows = [
        ("p", "s", "", 1, 0, "Read", None, 100, T, T), ("p", "s", "", 1, 0, " READ\t", None, 100, None, second), ("p", "s", "", 1, 1, "read", None, 110, second, T), ("p", "s", "", 11, 0, "read", None, 100, None, T),
        ("p", "s", "", 22, 0, "read", None, 100, None, T), ("p", "s", "", 23, 0, "read", None, None, None, T), ("p", "s", "", 24, 0, None, None, 1, T, T), (None, None, None, None, None, "x", None, 1, T, T), (None, None, None, None, None, "x", None, 1, T, T),
    ]
    got = collapse_runs(frame(spark, rows)).orderBy("first_i").collect()
    assert [(r["act"], r["first_i"], r["last_i"], r["last_seg"], r["events"], r["duration_ms"]) for r in got] == [("x", None, None, None, 1, 0), ("read", 1, 11, 0, 3, 5000), ("read", 22, 22, 0, 1, None), ("read", 23, 23, 0, 1, None)]
    assert collapse_runs(frame(spark, [])).collect() == []
    hot = streams([["same"] * 3000, ["one"]])
    assert [(r["s"], r["events"]) for r in collapse_runs(frame(spark, hot), 2).collect()] == [("s0", 3000)]


def test_copies_over_batches_count_once():
    row = {"sid": [1], "sid2": [1], "i": [1], "seg": [1]}
    got = [t.num_rows for t, _ in batches_of_streams(iter([pa.RecordBatch.from_pydict(row)] * 3))]
    assert sum(got) == 1


def test_top_values(spark):
    targets = [" ./a//b.go", "a/b.go", "a\\b.go", "http://x//y", "", None, " ", "z" * 50_000]
    rows = [("p", "s", "", k, 0, "Read" if k % 2 else "EDIT ", x, 1, T, T) for k, x in enumerate(targets)]
    rows += [("p", "s", "", 1, 0, "read", "a/b.go", 1, T, T), ("p", "s", "", 99, 0, " ", "zz", 1, T, T), ("p", None, None, None, None, "read", None, None, None, None)]
    got = {(r["field"], r["item"]): r["n"] for r in top_values(frame(spark, rows)).collect()}
    assert got == {("act", "edit"): 4, ("act", "read"): 5, ("tgt", "a/b.go"): 3, ("tgt", "http://x//y"): 1, ("tgt", "z" * 50_000): 1}
    assert top_values(frame(spark, [])).collect() == []


def test_threshold_top_is_exact_where_leaders_mislead(spark):
    # "m" leads no node, but is the most frequent of all.
    rows = [(n, "f", f"{n}-{k}", 10) for n in range(6) for k in range(3)] + [(n, "f", "m", 9) for n in range(6)] + [(0, "f", "tie", 10)]
    got = [(r["item"], r["n"]) for r in threshold_top(spark.createDataFrame(rows, "node int, field string, item string, n long"), {"f": 3}).orderBy("n", "item").collect()]
    assert got == [("0-0", 10), ("0-1", 10), ("m", 54)]
