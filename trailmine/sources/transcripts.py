"""Transcripts (JSON lines in files) as canonical events.

A file is <project>/<session>.jsonl or <project>/<session>/subagents/
agent-<id>.jsonl below a root. Lines are decoded in one Arrow pass; deduping,
pairing of calls and results and retries are windows over narrow keys.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shell import split
from ..schema import conform

RETRY_SECONDS = 120
TEXT_BYTES = 160
#: Input fields that tell a call's target, the first that is not empty.
TARGET_KEYS = ("file_path", "path", "notebook_path", "pattern", "query", "url", "skill", "subagent_type")

_STRINGS = ("type", "uuid", "sessionId", "timestamp", "version", "attributionSkill", "attributionPlugin", "attributionMcpServer")
_BLOCK_STRINGS = ("type", "text", "id", "name", "tool_use_id")
_ZONED = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)")


class Undecodable(ValueError):
    pass


def cut(text: str, most: int = TEXT_BYTES) -> str:
    """At most so many bytes, never part of a character."""
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode(errors="ignore")


# ---- raw spans of JSON values --------------------------------------------------------

_SPACE = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_SCALAR = re.compile(r"[^\s,\]}]+")
_NEST = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)


def _end(s: str, i: int) -> int:
    """Where the value that begins at i ends."""
    if s[i] == '"':
        return _STRING.match(s, i).end()
    if s[i] not in "[{":
        return _SCALAR.match(s, i).end()
    depth = 0
    for m in _NEST.finditer(s, i):
        c = m[0]
        depth += c in "[{"
        depth -= c in "]}"
        if not depth:
            return m.end()
    raise Undecodable("open bracket")


def _members(s: str, i: int) -> Iterator[tuple[str | int, int, int]]:
    """(key or number, start, end) of what an object or array holds."""
    is_object, n = s[i] == "{", 0
    i = _SPACE.match(s, i + 1).end()
    while s[i] not in "]}":
        key: str | int = n
        if is_object:
            m = _STRING.match(s, i)
            key = json.loads(m[0])
            i = _SPACE.match(s, _SPACE.match(s, m.end()).end() + 1).end()
        end = _end(s, i)
        yield key, i, end
        n += 1
        i = _SPACE.match(s, end).end()
        if s[i] == ",":
            i = _SPACE.match(s, i + 1).end()


def raw_sizes(line: str) -> dict[int, dict[str, int]]:
    """Bytes of the raw `input` and `content` of each block of message.content."""
    out: dict[int, dict[str, int]] = {}
    start = _SPACE.match(line).end()
    for key, a, _ in _members(line, start):
        if key != "message" or line[a] != "{":
            continue
        for k, b, _ in _members(line, a):
            if k != "content" or line[b] != "[":
                continue
            for n, c, _ in _members(line, b):
                if line[c] == "{":
                    out[n] = {x: len(line[y:z].encode()) for x, y, z in _members(line, c) if x in ("input", "content")}
    return out


# ---- decoding --------------------------------------------------------------------------


def _typed(obj: dict, keys: tuple[str, ...], kind: type) -> dict:
    out = {}
    for k in keys:
        v = obj.get(k)
        if v is not None and (not isinstance(v, kind) or (kind is not bool and isinstance(v, bool))):
            raise Undecodable(k)
        out[k] = v
    return out


def _micros(text: str | None) -> int | None:
    if not text or not _ZONED.fullmatch(text):
        return None
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00").replace(",", "."))
    except ValueError:
        return None
    span = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (span.days * 86400 + span.seconds) * 1_000_000 + span.microseconds


def _steps(name: str, raw: dict | None, size: int) -> tuple[list[tuple], bool]:
    """(kind, act, tgt, d, b, cp) of the events of a tool call."""
    given = raw if isinstance(raw, dict) else {}
    if name == "Bash":
        command = given.get("command")
        command = command if isinstance(command, str) else ""
        found, crude = split(command)
        if not found:
            return [("shell", "sh", "", cut(command), len(command.encode()), False)], crude
        return [("shell", act, "", cut(src), len(src.encode()), len(found) > 1) for act, src in found], crude
    target = next((given[k] for k in TARGET_KEYS if isinstance(given.get(k), str) and given[k]), "")
    return [("tool", name, cut(target), "", size, False)], False


def decode(line: str) -> dict:
    """What a line holds: type, whether it could be read, and of user and
    assistant lines the fields and steps (calls, results). A declared field of
    another type makes the line undecodable."""
    try:
        obj = json.loads(line)
    except (ValueError, RecursionError):
        return {"error": True}
    if obj is None:
        return {"error": False, "type": ""}
    if not isinstance(obj, dict) or not isinstance(obj.get("type"), (str, type(None))):
        return {"error": True}
    kind = obj.get("type") or ""
    if kind not in ("assistant", "user"):
        return {"error": False, "type": kind}
    try:
        top = _typed(obj, _STRINGS, str) | _typed(obj, ("isSidechain", "isMeta"), bool)
        message = obj.get("message")
        if message is not None and not isinstance(message, dict):
            raise Undecodable("message")
        blocks = []
        if message:
            _typed(message, ("role",), str)
            content = message.get("content")
            if isinstance(content, str):
                blocks = [{"type": "text", "text": content}]
            elif isinstance(content, list):
                blocks = content
            elif content is not None:
                raise Undecodable("content")
        for b in blocks:
            if b is not None and not isinstance(b, dict):
                raise Undecodable("block")
            _typed(b or {}, _BLOCK_STRINGS, str)
            _typed(b or {}, ("is_error",), bool)
    except Undecodable:
        return {"error": True, "type": kind, "counted": True}
    sizes = raw_sizes(line) if any(b and b.get("type") in ("tool_use", "tool_result") for b in blocks) else {}
    steps, crude = [], 0
    results = text = False
    for n, b in enumerate(blocks):
        b = b or {}
        size = sizes.get(n, {})
        if kind == "assistant" and b.get("type") == "tool_use":
            made, rough = _steps(b.get("name") or "", b.get("input"), size.get("input", 0))
            crude += rough
            steps += [{"block": n, "seg": k, "id": b.get("id") or "", "call": True, "k": x[0], "act": x[1], "tgt": x[2], "d": x[3], "b": x[4], "cp": x[5], "of": len(made)} for k, x in enumerate(made)]
        elif kind == "user" and b.get("type") == "tool_result":
            results = True
            steps.append({"block": n, "seg": 0, "id": b.get("tool_use_id") or "", "call": False, "failed": bool(b.get("is_error")), "b": size.get("content", 0)})
        elif kind == "user" and b.get("type") == "text" and b.get("text"):
            text = True
    if text and not results and not top["isMeta"]:
        steps.append({"block": 0, "seg": 0, "id": "", "call": True, "k": "prompt", "act": "prompt", "tgt": "", "d": "", "b": 0, "cp": False, "of": 1})
    fields = {"uuid": top["uuid"] or "", "session": top["sessionId"] or "", "us": _micros(top["timestamp"]), "v": top["version"] or "", "side": bool(top["isSidechain"])}
    fields |= {"skill": top["attributionSkill"] or "", "plug": top["attributionPlugin"] or "", "mcp": top["attributionMcpServer"] or ""}
    return {"error": False, "type": kind, "empty": message is None, "crude": crude, "steps": steps, **fields}


_STEP = pa.struct([("block", pa.int32()), ("seg", pa.int32()), ("id", pa.string()), ("call", pa.bool_()), ("failed", pa.bool_()), ("k", pa.string()), ("act", pa.string()), ("tgt", pa.string()), ("d", pa.string()), ("b", pa.int64()), ("cp", pa.bool_()), ("of", pa.int32())])
_LINE = pa.schema([("path", pa.string()), ("i", pa.int64()), ("error", pa.bool_()), ("counted", pa.bool_()), ("type", pa.string()), ("uuid", pa.string()), ("session", pa.string()), ("us", pa.int64()), ("v", pa.string()), ("side", pa.bool_()), ("skill", pa.string()), ("plug", pa.string()), ("mcp", pa.string()), ("empty", pa.bool_()), ("crude", pa.int32()), ("steps", pa.list_(_STEP))])
_LINE_SQL = (
    "path string, i long, error boolean, counted boolean, type string, uuid string, session string, us long, v string, side boolean, skill string, plug string, mcp string, empty boolean, crude int, "
    "steps array<struct<block:int,seg:int,id:string,call:boolean,failed:boolean,k:string,act:string,tgt:string,d:string,b:bigint,cp:boolean,of:int>>"
)


def _decode_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, text in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist()):
            lines = text.split("\n")
            if lines and not lines[-1]:
                lines.pop()
            for start in range(0, len(lines), 2000):
                rows = []
                for n, line in enumerate(lines[start : start + 2000], start + 1):
                    d = decode(line)
                    d["counted"] = d.get("counted", not d["error"])
                    rows.append({"path": path, "i": n, **d})
                yield pa.RecordBatch.from_pylist(rows, schema=_LINE)


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), value of each transcript file. Files that lie
    directly in the root have no project and are skipped, as is a root that
    is itself a file."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), r"^file:(//)?", "")
    rows = rows.select(path.alias("full"), "value").where(F.col("full").startswith(base + "/"))
    return rows.select(F.substr("full", F.lit(len(base) + 2)).alias("path"), "value").where(F.col("path").contains("/"))


def located(rows: DataFrame) -> DataFrame:
    """With project, session and agent that a path tells, and the parts of the
    path by which files are ordered: a folder before the file of its name."""
    parts = F.split("path", "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl\z", "")
    is_agent = (F.size(parts) >= 4) & (F.get(parts, F.size(parts) - 2) == "subagents")
    return rows.select(
        "*", parts.alias("parts"), parts[0].alias("p"),
        F.when(is_agent, F.get(parts, F.size(parts) - 3)).otherwise(name).alias("file_session"), F.when(is_agent, F.regexp_replace(name, "^agent-", "")).otherwise("").alias("a"),
    )


class Ingested:
    """events (schema.EVENT) and lines, from which health() counts."""

    def __init__(self, events: DataFrame, lines: DataFrame, dropped: DataFrame):
        self.events, self.lines, self.dropped = events, lines, dropped

    def health(self) -> dict:
        """Counts of files, lines, decode errors, types, dropped copies, crude
        command lines, events, prompts and unpaired calls."""
        one = self.lines.agg(
            F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("lines"), F.count_if("error").alias("decode_errors"), F.coalesce(F.sum("crude"), F.lit(0)).alias("crude")
        ).first()
        types = {r["type"] or "": r["n"] for r in self.lines.where("counted").groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
        out = self.events.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("k") == "prompt").alias("prompts"), F.count_if((F.col("st") == "none") & (F.col("k") != "prompt")).alias("unpaired")).first()
        return one.asDict() | {"types": dict(sorted(types.items(), key=lambda x: (-x[1], x[0]))), "deduped": self.dropped.count()} | out.asDict()


def ingest(spark: SparkSession, root: str, project: str = "", keep: str | None = None) -> Ingested:
    """Events of all transcripts below root whose project contains `project`.

    keep: a folder for the decoded lines, which several counts read; without
    one they are decoded again for each.
    """
    rows = files(spark, root)
    if project:
        rows = rows.where(F.split("path", "/")[0].contains(project))
    # The file's number: files in the order of their paths' parts. One row a file.
    lines = rows.mapInArrow(_decode_files, _LINE_SQL)
    if keep:
        lines.write.mode("overwrite").parquet(keep)
        lines = spark.read.schema(lines.schema).parquet(keep)
    order = located(rows.select("path"))
    numbers = order.withColumn("f", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("parts")).cast("long")).drop("parts")
    lines = lines.join(numbers, "path")
    use = lines.where(~F.col("error") & F.col("type").isin("assistant", "user"))
    # The first line of an identifier stands for all, over the whole ingest; it counts even if it has no message.
    first = use.where("uuid <> ''").groupBy("uuid").agg(F.min(F.struct("f", "i")).alias("at"))
    known = use.where("uuid <> ''").join(first, "uuid")
    copies = known.where((F.struct("f", "i") != F.col("at"))).drop("at")
    kept = known.where(F.struct("f", "i") == F.col("at")).drop("at").unionByName(use.where("uuid = ''")).where(~F.col("empty"))
    return Ingested(events_of(kept), lines, copies)


def events_of(lines: DataFrame) -> DataFrame:
    """Events of decoded lines (f, i, p, file_session, a and the fields of
    decode), with statuses, latencies, bytes and retries."""
    t = F.timestamp_micros("us")
    own = ["f", "i", t.alias("t"), "p", F.coalesce(F.nullif("session", F.lit("")), "file_session").alias("s"), "a", F.col("side").alias("sc"), "skill", "plug", "mcp", "v"]
    steps = lines.select(*own, F.explode("steps").alias("x")).select("*", "x.*").drop("x")
    calls = steps.where("call")
    # A call is answered if the next that uses its id in the file is a result; a later call with the same id takes its place.
    ids = steps.where("id <> '' and seg = 0").select("f", "id", "i", "block", "call", "failed", F.col("b").alias("size"), "t")
    by = Window.partitionBy("f", "id").orderBy("i", "block")
    nxt = F.lead(F.struct("call", "failed", "size", "t")).over(by)
    answers = ids.withColumn("nxt", nxt).where("call and not nxt.call").select("f", "i", "block", F.col("nxt.failed").alias("bad"), F.col("nxt.size").alias("size"), F.col("nxt.t").alias("done"), F.lit(True).alias("answered"))
    rows = calls.join(answers, ["f", "i", "block"], "left")
    status = (
        F.when(F.col("k") == "prompt", "").when(F.col("answered").isNull(), "none").when(F.coalesce("bad", F.lit(False)), F.when(F.col("of") > 1, "cfail").otherwise("fail")).otherwise("ok")
    )
    rows = rows.withColumn("st", status).withColumn("ms", F.when(F.col("k") != "prompt", F.expr("(unix_micros(done) - unix_micros(t)) div 1000")))
    rows = rows.withColumn("b", F.col("b") + F.coalesce(F.expr("size div of"), F.lit(0))).withColumn("at", F.col("block") * 100_000 + F.col("seg"))
    # A retry follows an open failure of the same action and target in the file within the window; ok closes it.
    before = Window.partitionBy("f", "act", "tgt").orderBy("i", "at").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("st") == "ok", F.struct(F.lit(None).cast("timestamp").alias("t"))).when((F.col("st") == "fail") & F.col("t").isNotNull(), F.struct("t"))
    rows = rows.withColumn("open", F.last(mark, ignorenulls=True).over(before))
    late = F.unix_micros("t") - F.unix_micros("open.t") <= RETRY_SECONDS * 1_000_000
    rows = rows.withColumn("rt", F.coalesce(late, F.lit(False))).withColumn("seg", F.col("at"))
    return conform(rows)


def from_table(raw_line: DataFrame, source_file: DataFrame) -> DataFrame:
    """Events of transcript lines that lie in tables (raw_line, source_file).

    Content is decoded as in files; sizes are those of the content as stored.
    The first line of an identifier, in the order of (file_id, line_no,
    line_id), stands for all; lines of unknown files keep their own session
    only.
    """
    lines = raw_line.join(source_file.select("file_id", F.col("project").alias("p"), F.col("session").alias("file_session"), F.col("agent").alias("a")).dropDuplicates(["file_id"]), "file_id", "left")
    pick = lambda c: F.col(c) if c in raw_line.columns else F.lit(None).cast("string")
    whole = F.to_json(F.struct(F.col("type"), F.col("uuid"), F.col("sessionid").alias("sessionId"), F.col("timestamp"), F.col("version"), F.col("issidechain").alias("isSidechain"), F.col("ismeta").alias("isMeta"), pick("attributionskill").alias("attributionSkill"), pick("attributionplugin").alias("attributionPlugin"), pick("attributionmcpserver").alias("attributionMcpServer")))
    flat = lines.select("file_id", "line_no", "line_id", "p", "file_session", "a", whole.alias("head"), F.col("message").isNull().alias("no_message"), F.col("message.role").alias("role"), F.col("message.content").alias("content"))
    decoded = flat.mapInArrow(_decode_rows, f"f long, i long, line_id long, p string, file_session string, a string, {_LINE_SQL.partition('i long, ')[2]}")
    use = decoded.where(~F.col("error") & F.col("type").isin("assistant", "user"))
    first = use.where("uuid <> ''").groupBy("uuid").agg(F.min(F.struct("f", "i", "line_id")).alias("at"))
    kept = use.where("uuid <> ''").join(first, "uuid").where(F.struct("f", "i", "line_id") == F.col("at")).drop("at").unionByName(use.where("uuid = ''"))
    return events_of(kept.where(~F.col("empty")))


def _decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("f", pa.int64()), ("i", pa.int64()), ("line_id", pa.int64()), ("p", pa.string()), ("file_session", pa.string()), ("a", pa.string()), *list(_LINE)[2:]])
    for b in batches:
        out = []
        for r in b.to_pylist():
            head = r["head"] or "{}"
            if not r["no_message"]:
                role = "" if r["role"] is None else f'"role":{json.dumps(r["role"])},'
                head = head[:-1] + ("," if len(head) > 2 else "") + f'"message":{{{role}"content":{r["content"] or "null"}}}}}'
            d = decode(head)
            d["counted"] = d.get("counted", not d["error"])
            out.append({"f": r["file_id"], "i": r["line_no"], "line_id": r["line_id"], "p": r["p"], "file_session": r["file_session"], "a": r["a"] or "", **d})
        yield pa.RecordBatch.from_pylist(out, schema=schema)
