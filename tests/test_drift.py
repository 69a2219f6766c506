import json

from trailmine.operators.drift import TARGET, Field, Target, cast_value, compare, consistent_table, ingest, kind_of, parse, promote, schema_changes, shape_of, walk

LOG_FILE = "file_id long, series_id long, ordinal long, path string, opened timestamp, change string, fields string"
LOG_LINE = "file_id long, line_no long, body string, names string, rescued string"


def fields(rows, lines=None):
    out = {}
    for r in rows:
        for p, v in walk(r):
            f = out.setdefault(p, Field(p, [], 0, {}, set(), lines or len(rows)))
            f.kinds = sorted({*f.kinds, kind_of(v)})
            f.n += 1
            f.shapes[shape_of(v)] = f.shapes.get(shape_of(v), 0) + 1
            f.sketch.add(hash(str(v)))
    return list(out.values())


def test_lines_that_cannot_be_read():
    assert [parse(x) for x in (None, "", "  ", "{", "[1]", "5", "null", "\x00", '{"a":')] == [None] * 9
    assert parse(' {"a": 1} ') == {"a": 1}
    assert parse('{"a":' * 100_000) is None


def test_walk_gives_paths_without_what_is_opaque():
    got = dict(walk({"a": {"b": [{"c": 1}, {"d": None}]}, "input": {"x": 1}, "n": None}))
    assert set(got) == {"a", "a.b", "a.b[].c", "input"}


def test_each_change():
    ids = [f"{k:08x}-0000-0000-0000-000000000000" for k in range(20)]
    old = fields([{"id": i, "who": "user" if k % 2 else "bot", "n": k, "gone": "x y"} for k, i in enumerate(ids)])
    new = fields([{"key": i[::-1].replace("-", "0")[:8] + i[8:], "speaker": "bot" if k % 2 else "user", "n": str(k), "more": True} for k, i in enumerate(ids)])
    assert sorted(compare(old, new)) == [("added", "", "more"), ("removed", "gone", ""), ("renamed", "id", "key"), ("renamed", "who", "speaker"), ("retyped", "n", "n")]


def test_what_lies_below_a_change_is_not_reported():
    old = fields([{"m": {"c": [{"t": "a"}]}}] * 9)
    assert compare(old, fields([{"m": {"c": "a"}}] * 9)) == [("retyped", "m.c", "m.c")]
    assert compare(old, fields([{"x": 1}] * 9)) == [("removed", "m", ""), ("added", "", "x")]
    assert compare([], []) == []


def test_other_values_are_no_rename():
    old = fields([{"entry": ("batch", "cli")[k % 2]} for k in range(20)])
    new = fields([{"user": ("staff", "external")[k % 2]} for k in range(20)])
    assert sorted(c for c, _, _ in compare(old, new)) == ["added", "removed"]


def test_casts():
    assert cast_value("no", "boolean") is False and cast_value(1, "boolean") is True and cast_value("x", "boolean") is None
    assert cast_value("12", "long") == 12 and cast_value("12 ms", "long") is None and cast_value(True, "long") is None and cast_value(2**70, "long") is None
    assert cast_value("2025-01-01T00:00:01Z", "timestamp") == cast_value(1735689601000, "timestamp") == 1735689601000000
    assert cast_value({"a": 1}, "string") is None and cast_value([1], "json") == "[1]"


def test_ingest_keeps_every_line_and_replays(spark):
    lines = [(1, 1, json.dumps({"type": "user", "isSidechain": "yes", "durationMs": "7", "message": {"role": "user", "content": "x", "extra": 1}}), "clash", "clash"), (1, 2, "{cut", None, None), (1, 3, None, None, None), (None, None, '{"timestamp": "never"}', None, None)]
    df = spark.createDataFrame(lines * 2, LOG_LINE)
    table = ingest(df)
    got = {(r["file_id"], r["line_no"]): r for r in table.collect()}
    assert table.count() == 8
    assert got[1, 1]["is_sidechain"] is True and json.loads(got[1, 1]["rescued"]) == {"durationMs": "7", "message": {"extra": 1}}
    assert got[1, 2]["readable"] is False and got[1, 2]["rescued"] == "{cut" and got[1, 3]["rescued"] is None
    assert json.loads(got[None, None]["rescued"]) == {"timestamp": "never"}
    replayed = {(r["file_id"], r["line_no"]): r for r in promote(table, (Target("duration_ms", "durationMs", "long"),)).collect()}
    assert replayed[1, 1]["duration_ms"] == 7 and json.loads(replayed[1, 1]["rescued"]) == {"message": {"extra": 1}}


def test_changes_and_table_of_a_series(spark):
    files = [(k, 1, k, None, None, "clash", "clash") for k in (1, 2, 3)] + [(9, None, None, None, None, None, None)]
    ids = [f"{k:08x}-1111-2222-3333-444444444444" for k in range(12)]
    lines = [(1, k, json.dumps({"uuid": i, "type": "user"}), None, None) for k, i in enumerate(ids)] * 2
    lines += [(2, k, json.dumps({"lineKey": i.replace("2222", "abcd"), "type": "user"}), None, None) for k, i in enumerate(ids)]
    lines += [(3, 1, "", None, None), (3, 2, "{", None, None), (77, 1, "{}", None, None), (None, 1, "{}", None, None), (2, 99, json.dumps({"type": "x" * 100_000, "lineKey": ids[0]}), None, None)]
    line_df, file_df = spark.createDataFrame(lines, LOG_LINE), spark.createDataFrame(files, LOG_FILE)
    got = sorted(tuple(r) for r in schema_changes(line_df, file_df).collect())
    assert got == [(2, "renamed", "uuid", "lineKey"), (3, "removed", "lineKey", ""), (3, "removed", "type", "")]
    table = consistent_table(line_df, file_df)
    assert table.count() == len(lines)
    assert table.where("file_id = 2 and uuid is not null").count() == 13
    empty = schema_changes(line_df.limit(0), file_df.limit(0))
    assert empty.collect() == [] and empty.columns == ["file_id", "change", "old_field", "new_field"]
    assert consistent_table(line_df.limit(0), file_df.limit(0)).count() == 0
    assert {t.column for t in TARGET} <= set(table.columns)


def test_renamed_approved_fields_and_parents(spark):
    files = [(k, 1, k, None, None, None, None) for k in (1, 2, 3)]
    line = lambda k, branch, parent: json.dumps({"type": "user", branch: f"topic/{k:04d}-x", parent: {"role": ("user", "assistant")[k % 2], "content": f"text {k}", "model": f"model-{k % 3}"}})
    lines = [(f, k, line(k, branch, parent), None, None) for f, branch, parent in ((1, "gitBranch", "message"), (2, "branch", "message"), (3, "branch", "msg")) for k in range(20)]
    line_df, file_df = spark.createDataFrame(lines, LOG_LINE), spark.createDataFrame(files, LOG_FILE)
    assert sorted(tuple(r) for r in schema_changes(line_df, file_df).collect()) == [(2, "renamed", "gitBranch", "branch"), (3, "renamed", "message", "msg")]
    got = consistent_table(line_df, file_df).select("file_id", "line_no", "git_branch", "role", "content", "model", "rescued").collect()
    want = [(f, k, f"topic/{k:04d}-x", ("user", "assistant")[k % 2], json.dumps(f"text {k}"), f"model-{k % 3}", None) for f in (1, 2, 3) for k in range(20)]
    assert sorted(map(tuple, got)) == want


def test_changes_come_from_ingested_rows(spark):
    """Strict ingestion keeps what comes in another JSON type in the rescue column, where the profile finds its type."""
    from trailmine.operators.drift import ingest, profiles

    body = ['{"type": "a", "timestamp": 1700000000000, "isSidechain": "true", "message": {"role": "user", "content": [{"id": 1}]}, "x": {"y": 1}}', '{"type": 5, "timestamp": "2024-01-01T00:00:00Z", "isSidechain": true}', "{", None]
    df = spark.createDataFrame([(1, k, b, 9) for k, b in enumerate(body)], "file_id long, line_no long, body string, type long")
    rows = ingest(df, strict=True).orderBy("line_no").collect()
    assert [(r["readable"], r["type"], r["is_sidechain"], r["timestamp"] is not None) for r in rows] == [(True, "a", None, False), (True, None, True, True), (False, None, None, False), (False, None, None, False)]
    found = {r["path"]: (r["kinds"], r["n"]) for r in profiles(df).collect()}
    assert found == {
        "type": (["number", "string"], 2), "timestamp": (["number", "string"], 2), "isSidechain": (["boolean", "string"], 2), "message": (["object"], 1), "message.role": (["string"], 1), "message.content": (["array"], 1),
        "message.content[].id": (["number"], 1), "x": (["object"], 1), "x.y": (["number"], 1),
    }


def test_tasks_hold_few_files_at_once(monkeypatch):
    """Whole files are given out as they end, one of very many fields in parts; a batch of many files is compared a few at a time."""
    import tracemalloc

    import pyarrow as pa

    from trailmine.operators import drift

    lines = [(f, json.dumps({"type": "user", f"k{k % 7}": k, "t": [{"a": f}]})) for f in range(40) for k in range(9)] + [(99, json.dumps({f"x{k}": k, "y": k})) for k in range(300)]

    def profiled(held, size):
        monkeypatch.setattr(drift, "HELD", held)
        batches = (pa.RecordBatch.from_pydict({"file_id": [f for f, _ in lines[at : at + size]], "body": [b for _, b in lines[at : at + size]]}) for at in range(0, len(lines), size))
        found, most = {}, 0
        for b in drift._profile_rows(batches):
            rows = b.to_pylist()
            most = max(most, sum(len(r["fields"]) for r in rows))
            for r in rows:
                found.setdefault(r["file_id"], []).extend(r["fields"])
        return {f: {x.path: x for x in drift._fields(rows)} for f, rows in found.items()}, most

    whole, _ = profiled(10_000, 10_000)
    parts, most = profiled(20, 13)
    assert parts == whole and len(whole) == 41 and most < 100

    def of(k):
        return [{"path": f"f{x}", "kinds": ["string"], "n": 9, "shapes": [("s:a", 9)], "sketch": [k * 10_000_000 + x * 1_000 + h for h in range(64)]} for x in range(20)]

    field = pa.struct([("path", pa.string()), ("kinds", pa.list_(pa.string())), ("n", pa.int64()), ("shapes", pa.map_(pa.string(), pa.int64())), ("sketch", pa.list_(pa.int64()))])
    count = pa.array([9] * 600, pa.int64())
    fields_ = pa.array([of(k) for k in range(600)], pa.list_(field))
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), fields_, count, fields_, count], names=["file_id", "old", "old_lines", "new", "new_lines"])
    tracemalloc.start()
    assert sum(b.num_rows for b in drift._compare_rows(iter([batch]))) == 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
