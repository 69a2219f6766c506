"""Schemas that drift between files (problem 2).

Method: rescue-column ingestion. Each line is read against a target schema;
fields it lacks and values that don't fit are kept as JSON in a rescue
column; approved fields are promoted and rescued values replayed into the typed
columns. The changes between the files of a series come from profiles of the
ingested rows: what stands in the typed columns and what had to be rescued. They
are summed up before they are shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Below these nothing is reported field by field.
OPAQUE = ("input",)
#: A rename must score so much of 1.
RENAME_SCORE = 0.5
#: Values of a field are sampled by hash: those whose hash is among the lowest
#: so many in a file and field. A bottom-k sketch, the same for any order of rows.
SKETCH = 64

#: Fields of whole files that a task holds before it gives them out; a file with more is given out in parts.
HELD = 2000
#: Files that are compared at once.
FILES = 50

FILE_PROFILE = "file_id long, fields array<struct<path:string,kinds:array<string>,n:long,shapes:map<string,long>,sketch:array<long>>>"

_SHAPES = [
    ("uuid", re.compile(r"\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?", re.I)),
    ("time", re.compile(r"\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?)?(Z|[+-]\d\d:?\d\d)?")),
    ("number", re.compile(r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?")),
    ("version", re.compile(r"v?\d+(\.\d+)+([-+][\w.]+)?")),
    ("bool", re.compile(r"true|false|yes|no", re.I)),
]
_RUNS = [(re.compile(r"[^\W_]*\d[^\W_]*"), "0"), (re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\s+"), " ")]
#: Words that say nothing about a field's meaning.
_COMMON = {"is", "has", "id", "type", "name", "at", "the", "field", "value"}


def kind_of(value) -> str:
    """JSON type of a value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def shape_of(value) -> str:
    """What a value looks like: its type, and for strings their form; for
    numbers the digits, for objects the keys, for arrays what they hold."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "bool" if value in (0, 1) else "time" if 1e11 < value < 1e13 else "number"
    if isinstance(value, str):
        for name, form in _SHAPES:
            if form.fullmatch(value.strip()):
                return name
        if len(value.split()) >= 4:
            return "text"
        for form, mark in _RUNS:
            value = form.sub(mark, value)
        return "s:" + value[:24]
    if isinstance(value, list):
        return "text" if any(isinstance(x, dict) and "text" in x for x in value) else "list"
    if isinstance(value, dict):
        return "o:" + ",".join(sorted(value))[:60]
    return "null"


def parse(line: str | None) -> dict | None:
    """The object of a readable line; None for blank, cut-off and other lines."""
    if not line or not line.strip():
        return None
    try:
        value = json.loads(line)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def walk(value, path: str = "") -> Iterator[tuple[str, object]]:
    """(dotted path, value) of all fields with a value that is not null;
    elements of arrays are under [], what lies below OPAQUE is left out."""
    items = [("", value)] if not path else [(path, value)]
    todo = items
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                if x is None:
                    continue
                to = f"{at}.{k}" if at else k
                yield to, x
                if k not in OPAQUE and isinstance(x, (dict, list)):
                    todo.append((to, x))
        elif isinstance(v, list):
            todo.extend((at + "[]", x) for x in v if isinstance(x, (dict, list)))


def _profile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the fields of each file, from lines that are sorted by file;
    several for a file of very many fields. Each line is ingested (strictly) and
    profiled as it is, so that nothing has to be written and read in between."""
    field = pa.struct([("path", pa.string()), ("kinds", pa.list_(pa.string())), ("n", pa.int64()), ("shapes", pa.map_(pa.string(), pa.int64())), ("sketch", pa.list_(pa.int64()))])
    files: dict[int, dict[str, list]] = {}
    held = 0

    def rows() -> pa.RecordBatch:
        made = [[{"path": p, "kinds": sorted(k), "n": n, "shapes": list(s.items()), "sketch": sorted(h)[:SKETCH]} for p, (k, n, s, h) in fields.items()] for fields in files.values()]
        out = pa.RecordBatch.from_arrays([pa.array(list(files), pa.int64()), pa.array(made, pa.list_(field))], names=["file_id", "fields"])
        files.clear()
        return out

    for b in batches:
        for file_id, body in zip(b.column("file_id").to_pylist(), b.column("body").to_pylist()):
            value = parse(body)
            if file_id is None or value is None:
                continue
            if held >= HELD and file_id not in files or held >= 4 * HELD:
                yield rows()
                held = 0
            typed = _fill(value, TARGET, {}, strict=True)
            for t in TARGET:
                if typed.get(t.column) is not None:
                    _put(value, t.path, _untyped(typed[t.column], t.type))
            fields = files.setdefault(file_id, {})
            held -= len(fields)
            for path, v in walk(value):
                own = fields.get(path)
                if own is None:
                    own = fields[path] = [set(), 0, {}, set()]
                own[0].add(kind_of(v))
                own[1] += 1
                s = shape_of(v)
                own[2][s] = own[2].get(s, 0) + 1
                own[3].add(xxhash.xxh64_intdigest(v if isinstance(v, str) else json.dumps(v, sort_keys=True)) >> 1)
                if len(own[3]) > 4 * SKETCH:
                    own[3] = set(sorted(own[3])[:SKETCH])
            held += len(fields)
    if files:
        yield rows()


def _by_file(log_line: DataFrame) -> DataFrame:
    """FILE_PROFILE: lines go to ranges of (file, line), so that a file's lines
    meet in one task before they are summed up, and a hot file is cut over many.
    A file that is cut has a row in each."""
    lines = log_line.select(F.col("file_id").cast("long").alias("file_id"), F.col("line_no").cast("long").alias("line_no"), "body").where("file_id is not null")
    lines = lines.repartitionByRange("file_id", "line_no").sortWithinPartitions("file_id").drop("line_no")
    return lines.mapInArrow(_profile_rows, FILE_PROFILE)


def profiles(log_line: DataFrame) -> DataFrame:
    """A row for each file and field: JSON types, number of values, shapes with
    counts, and the values with the lowest hashes, from the lines as ingested:
    a target's column has the values of the JSON type that it is for, the rescue
    column has all others. Summed up for each file before the shuffle."""
    rows = _by_file(log_line).select("file_id", F.explode("fields").alias("x")).select("file_id", "x.*")
    return rows.groupBy("file_id", "path").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"),
        F.sum("n").alias("n"),
        F.flatten(F.collect_list(F.map_entries("shapes"))).alias("shapes"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("sketch")))), 1, SKETCH).alias("sketch"),
    )


def _name_score(x: str, y: str) -> float:
    """How alike two names are, by their words and by a shared end or begin."""
    parts = lambda s: {w for w in re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", s).lower().split("_") if w} - _COMMON
    a, b = parts(x), parts(y)
    if a & b:
        return len(a & b) / min(len(a), len(b))
    p, q = "".join(sorted(a)), "".join(sorted(b))
    return 0.5 if p and q and (p in q or q in p) else 0.0


@dataclass
class Field:
    path: str
    kinds: list[str]
    n: int
    shapes: dict[str, int]
    sketch: set[int]
    lines: int

    @property
    def parent(self) -> str:
        return self.path.rpartition(".")[0]

    @property
    def name(self) -> str:
        return self.path.rpartition(".")[2]


def rename_score(old: Field, new: Field) -> float:
    """Do the values go on? Shapes alike or values shared, at a like rate;
    alike names help where two fields look the same."""
    if old.parent != new.parent:
        return 0.0
    total_a, total_b = sum(old.shapes.values()), sum(new.shapes.values())
    shapes = sum(min(old.shapes.get(s, 0) / total_a, n / total_b) for s, n in new.shapes.items())
    shared = len(old.sketch & new.sketch) / max(1, min(len(old.sketch), len(new.sketch)))
    rate_a, rate_b = old.n / max(1, old.lines), new.n / max(1, new.lines)
    rate = min(rate_a, rate_b) / max(rate_a, rate_b)
    few = len(old.sketch) <= 4 and len(new.sketch) <= 4 and old.n + new.n >= 12 and all(s.startswith("s:") for s in old.shapes)
    # Few values that differ are other values, not other spellings.
    value = shared if few else max(shared, shapes)
    if old.kinds != new.kinds and _name_score(old.name, new.name) == 1 and rate >= 0.8:
        value = max(value, 0.7)  # goes on under a longer name and in another type
    return value * (0.55 + 0.45 * rate) * (0.8 + 0.2 * _name_score(old.name, new.name)) + 0.05 * shared + 0.05 * _name_score(old.name, new.name)


def compare(old: list[Field], new: list[Field], least: float = RENAME_SCORE) -> list[tuple[str, str, str]]:
    """(change, old_field, new_field) from the fields of one file to those of the next."""
    before, after = {f.path: f for f in old}, {f.path: f for f in new}
    gone = {p for p in before if p not in after}
    fresh = {p for p in after if p not in before}
    changes = [("retyped", p, p) for p in before if p in after and before[p].kinds != after[p].kinds]
    changed = {p for _, p, _ in changes}

    def below(path: str, tops: set[str]) -> bool:
        """Does a field above it change?"""
        at = path
        while "." in at or at.endswith("[]"):
            at = at[:-2] if at.endswith("[]") else at.rpartition(".")[0]
            if at in tops:
                return True
        return False

    gone_tops = {p for p in gone if not below(p, gone | changed)}
    fresh_tops = {p for p in fresh if not below(p, fresh | changed)}
    pairs = sorted(((rename_score(before[a], after[b]), a, b) for a in gone_tops for b in fresh_tops), key=lambda x: (-x[0], x[1], x[2]))
    used: set[str] = set()
    for score, a, b in pairs:
        if score >= least and a not in used and b not in used:
            used |= {a, b}
            changes.append(("renamed", a, b))
    changes += [("removed", a, "") for a in gone_tops if a not in used]
    changes += [("added", "", b) for b in fresh_tops if b not in used]
    tops = {x for c, a, b in changes for x in (a, b) if x}
    return [c for c in changes if not below(c[1] or c[2], tops)]


def _fields(rows) -> list[Field]:
    """Fields of a file; what several parts of it say is added up."""
    out: dict[str, Field] = {}
    for r in rows or ():
        f = out.setdefault(r["path"], Field(r["path"], [], 0, {}, set(), 0))
        f.kinds = sorted({*f.kinds, *r["kinds"]})
        f.n += r["n"]
        for k, n in r["shapes"]:
            f.shapes[k] = f.shapes.get(k, 0) + n
        f.sketch |= set(r["sketch"])
    lines = max((f.n for f in out.values() if "." not in f.path), default=0)
    for f in out.values():
        f.lines = lines
        if len(f.sketch) > SKETCH:
            f.sketch = set(sorted(f.sketch)[:SKETCH])
    return list(out.values())


def _compare_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of each file, of FILES files at a time: as Python objects the fields of
    a batch of files take many times the memory that they have in it."""
    schema = pa.schema([("file_id", pa.int64()), ("change", pa.string()), ("old_field", pa.string()), ("new_field", pa.string())])
    for b in batches:
        for at in range(0, b.num_rows, FILES):
            out = []
            for r in b.slice(at, FILES).to_pylist():
                for change, old, new in compare(_fields(r["old"]), _fields(r["new"])):
                    out.append({"file_id": r["file_id"], "change": change, "old_field": old, "new_field": new})
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def schema_changes(log_line: DataFrame, log_file: DataFrame) -> DataFrame:
    """file_id, change, old_field, new_field: how each file differs from the
    one of the preceding ordinal in its series; of files with the same place in a
    series the one with the smallest file_id stands for all.

    change is added, removed, renamed or retyped. Files without a preceding
    one have no changes; a file without readable lines has no fields, so that
    its fields count as removed, and those of the next as added. What lies
    below a changed field or below `input` is not reported. Lines of unknown
    files, repeated rows and extra columns change nothing.
    """
    files = log_file.where("file_id is not null and series_id is not null and ordinal is not null").groupBy("series_id", "ordinal").agg(F.min("file_id").alias("file_id"))
    wide = files.join(_by_file(log_line).groupBy("file_id").agg(F.flatten(F.collect_list("fields")).alias("fields")), "file_id", "left")
    wide = wide.select(F.col("file_id").cast("long").alias("file_id"), "series_id", "ordinal", F.coalesce("fields", F.array().cast(wide.schema["fields"].dataType)).alias("new"))
    # A file meets the one before it in its series; both go through one shuffle.
    at = Window.partitionBy("series_id").orderBy("ordinal")
    both = wide.withColumn("old", F.when(F.lag("ordinal").over(at) == F.col("ordinal") - 1, F.lag("new").over(at))).where("old is not null")
    return both.select("file_id", "old", "new").mapInArrow(_compare_rows, "file_id long, change string, old_field string, new_field string")


# ---- one consistent table -----------------------------------------------------------


@dataclass(frozen=True)
class Target:
    """A column of the target table: where its value is found and its type
    (string, boolean, long, double, timestamp or json)."""

    column: str
    path: str
    type: str


#: The target schema of transcript lines; what else they hold is rescued.
TARGET = (
    Target("type", "type", "string"), Target("uuid", "uuid", "string"), Target("session_id", "sessionId", "string"), Target("timestamp", "timestamp", "timestamp"),
    Target("version", "version", "string"), Target("is_sidechain", "isSidechain", "boolean"), Target("cwd", "cwd", "string"),
    Target("role", "message.role", "string"), Target("content", "message.content", "json"),
)
#: Fields that are promoted from the rescue column to columns of their own.
APPROVED = (
    Target("git_branch", "gitBranch", "string"), Target("is_meta", "isMeta", "boolean"), Target("request_id", "requestId", "string"), Target("duration_ms", "durationMs", "long"),
    Target("user_type", "userType", "string"), Target("entrypoint", "entrypoint", "string"), Target("slug", "slug", "string"),
    Target("model", "message.model", "string"), Target("stop", "message.stop", "string"), Target("usage", "message.usage", "json"),
)

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_TRUE, _FALSE = {"true", "1", "yes"}, {"false", "0", "no"}


def _iso_micros(text: str) -> int | None:
    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    span = at - _EPOCH
    return (span.days * 86400 + span.seconds) * 1_000_000 + span.microseconds


def cast_value(value, to: str):
    """The value in the type, or None if it doesn't cast without loss of meaning."""
    if value is None:
        return None
    if to == "json":
        return json.dumps(value, ensure_ascii=False)
    if to == "string":
        if isinstance(value, str):
            return value
        return json.dumps(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if to == "boolean":
        word = str(value).strip().lower() if isinstance(value, (bool, str, int, float)) else ""
        return True if word in _TRUE else False if word in _FALSE else None
    if to in ("long", "double"):
        if isinstance(value, bool) or not isinstance(value, (int, float, str)):
            return None
        try:
            number = float(value)
        except (ValueError, OverflowError):
            return None
        if to == "double":
            return number
        whole = int(value) if isinstance(value, int) or (isinstance(value, str) and re.fullmatch(r"\s*[+-]?\d+\s*", value)) else int(number) if number == number and abs(number) < 2**53 and number == int(number) else None
        return whole if whole is not None and -(2**63) <= whole < 2**63 else None
    if to == "timestamp":
        if isinstance(value, str):
            return _iso_micros(value) if not re.fullmatch(r"\s*\d{10,14}\s*", value) else cast_value(int(value), to)
        if isinstance(value, (int, float)) and not isinstance(value, bool) and 1e8 < value < 1e14:
            return int(value * 1_000) if value >= 1e11 else int(value * 1_000_000)
    return None


#: The JSON type that a target's values have as they come.
_COMES_AS = {"string": "string", "timestamp": "string", "boolean": "boolean", "long": "number", "double": "number"}


def _untyped(value, of: str):
    """The JSON value of a typed one."""
    if of == "json":
        return json.loads(value)
    if of == "timestamp":
        return (_EPOCH + timedelta(microseconds=value)).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    return value


def _take(row: dict, path: str):
    """(found, value) under a path; takes it out of the row if it is there, and
    the objects above it that it leaves empty."""
    name, _, rest = path.partition(".")
    if name not in row:
        return False, None
    if not rest:
        return True, row.pop(name)
    if not isinstance(row[name], dict):
        return False, None
    found, value = _take(row[name], rest)
    if found and not row[name]:
        del row[name]
    return found, value


def _put(row: dict, path: str, value) -> None:
    parts = path.split(".")
    for p in parts[:-1]:
        row = row.setdefault(p, {})
    row[parts[-1]] = value


_ARROW = {"string": pa.string(), "json": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64(), "timestamp": pa.timestamp("us", tz="UTC")}
_SPARK = {"json": "string", "long": "bigint"}


def _fill(row: dict, targets: tuple[Target, ...], names: dict[str, str], strict: bool = False) -> dict:
    """Typed values of the targets, under their path or the name it has in this
    file; what doesn't cast stays in the row, if strict also what comes in
    another JSON type than the target's."""
    out = {}
    for t in targets:
        for path in dict.fromkeys((t.path, names.get(t.path, t.path))):
            found, value = _take(row, path)
            if not found:
                continue
            fits = not strict or value is None or _COMES_AS.get(t.type, kind_of(value)) == kind_of(value)
            typed = cast_value(value, t.type) if fits else None
            if typed is None and value is not None:
                _put(row, path, value)
            elif out.get(t.column) is None:
                out[t.column] = typed
    return out


def _ingest_rows(targets: tuple[Target, ...], strict: bool):
    schema = pa.schema([("file_id", pa.int64()), ("line_no", pa.int64()), ("readable", pa.bool_()), *[(t.column, _ARROW[t.type]) for t in targets], ("rescued", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            names_of = b.column("names").to_pylist()
            for file_id, line_no, body, names in zip(b.column("file_id").to_pylist(), b.column("line_no").to_pylist(), b.column("body").to_pylist(), names_of):
                row = parse(body)
                if row is None:
                    out.append({"file_id": file_id, "line_no": line_no, "readable": False, "rescued": body})
                    continue
                typed = _fill(row, targets, dict(names or ()), strict)
                out.append({"file_id": file_id, "line_no": line_no, "readable": True, **typed, "rescued": json.dumps(row, ensure_ascii=False) if row else None})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _columns(targets: tuple[Target, ...]) -> str:
    return ", ".join(f"{t.column} {_SPARK.get(t.type, t.type)}" for t in targets)


def ingest(log_line: DataFrame, renames: DataFrame | None = None, targets: tuple[Target, ...] = TARGET, strict: bool = False) -> DataFrame:
    """All lines as one table: file_id, line_no, readable, the targets typed,
    and rescued: as JSON what the target schema lacks or what doesn't cast, or
    the line itself if it can't be read. No row is lost or added.

    renames (file_id, names map of a target's path to its name in the file)
    leads a target's values under other names into its column. strict: values
    that would cast but come in another JSON type are rescued as well.
    """
    lines = log_line.select(F.col("file_id").cast("long").alias("file_id"), F.col("line_no").cast("long").alias("line_no"), "body")
    if renames is not None:
        lines = lines.join(renames, "file_id", "left")
    else:
        lines = lines.withColumn("names", F.lit(None).cast("map<string,string>"))
    return lines.mapInArrow(_ingest_rows(targets, strict), f"file_id long, line_no long, readable boolean, {_columns(targets)}, rescued string")


def _promote_rows(names: list[str], targets: tuple[Target, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {t.column: [] for t in targets}
            rescued = []
            for ok, text, moved in zip(b.column("readable").to_pylist(), b.column("rescued").to_pylist(), b.column("names").to_pylist()):
                row = json.loads(text) if ok and text else {}
                typed = _fill(row, targets, dict(moved or ()))
                rescued.append(text if not ok else json.dumps(row, ensure_ascii=False) if row else None)
                for t in targets:
                    out[t.column].append(typed.get(t.column))
            columns = [b.column(n) for n in names] + [pa.array(out[t.column], _ARROW[t.type]) for t in targets] + [pa.array(rescued, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*[b.schema.field(n) for n in names], *[(t.column, _ARROW[t.type]) for t in targets], ("rescued", pa.string())]))

    return run


def promote(table: DataFrame, approved: tuple[Target, ...] = APPROVED, renames: DataFrame | None = None) -> DataFrame:
    """Columns for approved fields, filled by replaying the rescued values;
    what doesn't cast stays rescued. renames as in ingest()."""
    names = [c for c in table.columns if c != "rescued"]
    if clash := {t.column for t in approved} & set(names):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    types = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in names)
    table = table.join(renames, "file_id", "left") if renames is not None else table.withColumn("names", F.lit(None).cast("map<string,string>"))
    return table.mapInArrow(_promote_rows(names, approved), f"{types}, {_columns(approved)}, rescued string")


def renamed_path(path: str, moved: dict[str, str]) -> str:
    """The path with its longest renamed prefix replaced."""
    parts = path.split(".")
    for k in range(len(parts), 0, -1):
        if (to := moved.get(".".join(parts[:k]))) is not None:
            return ".".join([to, *parts[k:]])
    return path


def file_names(changes: DataFrame, log_file: DataFrame, targets: tuple[Target, ...] = TARGET + APPROVED) -> DataFrame:
    """file_id, names: for each file the name that a target's path has there,
    following the renames of it and of what it lies in from the first file of
    its series on."""
    renamed = changes.where("change = 'renamed'").select("file_id", "old_field", "new_field")
    files = log_file.where("file_id is not null and series_id is not null").select("file_id", "series_id", "ordinal")
    steps = files.join(renamed.groupBy("file_id").agg(F.collect_list(F.struct("old_field", "new_field")).alias("renames")), "file_id", "left")
    # A row a file; a series' files are few, its lines are not touched here.
    series = steps.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "file_id", F.coalesce("renames", F.array().cast("array<struct<old_field:string,new_field:string>>")).alias("renames")))).alias("files"))
    paths = [t.path for t in targets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_id", pa.int64()), ("names", pa.map_(pa.string(), pa.string()))])
        for b in batches:
            out = []
            for files_ in b.column("files").to_pylist():
                now = {p: p for p in paths}
                for f in files_:
                    moved = {r["old_field"]: r["new_field"] for r in f["renames"]}
                    now = {p: renamed_path(n, moved) for p, n in now.items()}
                    if any(p != n for p, n in now.items()):
                        out.append({"file_id": f["file_id"], "names": [(p, n) for p, n in now.items() if p != n]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return series.select("files").mapInArrow(run, "file_id long, names map<string,string>")


def consistent_table(log_line: DataFrame, log_file: DataFrame) -> DataFrame:
    """All lines in the target schema with the approved fields promoted,
    renamed fields led back to their columns."""
    scratch = Scratch(log_line.sparkSession, "drift")
    names = scratch.save(file_names(schema_changes(log_line, log_file), log_file), "names")
    names = names.groupBy("file_id").agg(F.first("names").alias("names"))
    return promote(ingest(log_line, names), renames=names)


__all__ = ["APPROVED", "TARGET", "Target", "compare", "consistent_table", "file_names", "ingest", "profiles", "promote", "schema_changes"]
