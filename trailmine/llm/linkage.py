"""Problem 4: new batches against all accepted lines.

Method: incremental record linkage. The blocking-key tables of accepted lines
are keyed state on disk (a streaming aggregation over RocksDB with checkpoints):
a batch looks up its own keys there and nothing else, so that what it reads
follows the batch and not the history. Candidate pairs of texts are scored
field by field with learned weights; those that reach the threshold are checked
exactly. A representative mapping (links) leads from a rejected line to the
accepted one; only the clusters that a batch touches are changed.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, product

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .lines import has_tools, plain_text, read_lines, tool_ids
from .seen import STATE_CONF

MIN_WORDS = 8
EDITS = 2
#: A substitution touches two classes of words, so EDITS of them leave one.
CLASSES = 2 * EDITS + 1
#: Lines for each partition of the state, at least.
STATE_ROWS = 150_000
#: A call of so many lines and bytes of files is linked by one task in one pass; larger ones by joins.
ROWS = 100_000
BYTES = 64_000_000
#: From so many texts on, a block's texts are looked up by their word classes in that pass.
FEW = 16
#: A block (session and type) of more texts than that is split by word classes;
#: both ways compare the same pairs.
GROUP = 200


def word_class(word: str) -> int:
    return xxhash.xxh32_intdigest(word) % CLASSES


@lru_cache(maxsize=1 << 14)
def class_of(word: str) -> int:
    return word_class(word)


def parts_of(words: list[str]) -> tuple[str, ...]:
    """The words of each class in their order. Texts within EDITS word edits
    have at least one part in common."""
    parts: list[list[str]] = [[] for _ in range(CLASSES)]
    for w in words:
        parts[class_of(w)].append(w)
    return tuple(" ".join(p) for p in parts)


def part_keys(block: str, words: list[str]) -> list[str]:
    return [f"c{xxhash.xxh128_hexdigest(f'{block} {k} {p}')}" for k, p in enumerate(parts_of(words))]


def within_edits(x: list[str], y: list[str], most: int = EDITS) -> int:
    """Word edits between the texts, most + 1 if there are more."""
    if abs(len(x) - len(y)) > most:
        return most + 1
    a = 0
    while a < min(len(x), len(y)) and x[a] == y[a]:
        a += 1
    x, y = x[a:], y[a:]
    while x and y and x[-1] == y[-1]:
        x, y = x[:-1], y[:-1]
    if not x or not y:
        return min(most + 1, len(x) + len(y))
    if most == 0:
        return 1
    return min(most + 1, 1 + min(within_edits(x[1:], y[1:], most - 1), within_edits(x[1:], y, most - 1), within_edits(x, y[1:], most - 1)))


# ---- weights ---------------------------------------------------------------------------

#: Levels of the compared fields: difference in words (0, 1, 2, more), word classes in
#: common (0 to CLASSES), same two first words.
LEVELS = (EDITS + 2, CLASSES + 1, 2)
PATTERNS = list(product(*(range(k) for k in LEVELS)))
PLACES = {p: k for k, p in enumerate(PATTERNS)}


def possible(pattern: tuple[int, ...]) -> bool:
    """Can a pair with this pattern be within EDITS edits? A word more or less
    touches one class, a changed word two."""
    more, common = pattern[:2]
    return more <= EDITS and CLASSES - common <= more + 2 * (EDITS - more)


def pattern_of(x: list[str], y: list[str], a: tuple[str, ...], b: tuple[str, ...]) -> int:
    common = sum(p == q for p, q in zip(a, b))
    return PLACES[min(abs(len(x) - len(y)), EDITS + 1), common, int(x[:2] == y[:2])]


class Weights:
    """Fellegi-Sunter weights of the compared fields, learned by expectation
    maximization from how often each pattern occurred among the candidate
    pairs of all batches so far. A pair goes to the exact check if its score is
    at least the lowest score of any pattern that can be a link, so that the
    weights spare checks and lose no link."""

    def __init__(self, seen: list[int] | None = None) -> None:
        self.seen = np.array(seen or [0] * len(PATTERNS), float)
        self.learn([0] * len(PATTERNS))

    def learn(self, counts: list[int], rounds: int = 30) -> None:
        self.seen += np.array(counts, float)
        # Before anything is seen every pattern counts once, and the possible ones as likely links.
        n = self.seen + 1 / len(PATTERNS)
        levels = np.array(PATTERNS)
        can = np.array([possible(p) for p in PATTERNS])
        share = np.where(can, 0.9, 0.0)
        for _ in range(rounds):
            prior = np.clip(share @ n / n.sum(), 1e-6, 1 - 1e-6)
            m = [np.array([(share * n)[levels[:, f] == v].sum() + 0.01 for v in range(k)]) for f, k in enumerate(LEVELS)]
            u = [np.array([((1 - share) * n)[levels[:, f] == v].sum() + 0.01 for v in range(k)]) for f, k in enumerate(LEVELS)]
            self.weights = [np.log2((a / a.sum()) / (b / b.sum())) for a, b in zip(m, u)]
            self.scores = sum(w[levels[:, f]] for f, w in enumerate(self.weights))
            share = np.where(can, 1 / (1 + np.exp2(-np.clip(np.log2(prior / (1 - prior)) + self.scores, -60, 60))), 0.0)
        self.threshold = float(self.scores[can].min())

    @property
    def passing(self) -> frozenset[int]:
        return frozenset(int(k) for k in np.flatnonzero(self.scores >= self.threshold))


# ---- lines -----------------------------------------------------------------------------

#: Columns of a line besides those that linking needs.
PLACE = ("file_id", "line_no", "session", "kind", "role", "meta", "side")
KEYS = "line_id long, u string, t string, block string, ckey string, text string"


def short_key(kind: str, digits: Column) -> Column:
    """A key of a kind from 128 bits in hex: the same bits in 22 letters instead of 32."""
    return F.concat(F.lit(kind), F.substring(F.base64(F.unhex(digits)), 1, 22))


def prepare(raw_line: DataFrame, source_file: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """line_id, batch_no and what a line is compared by: u (identifier), t (tool
    blocks in their session and type), block (session and type), text (its words)
    and ckey (block and text), the last three only where there are enough words;
    with `more` also PLACE and those columns, for those who go on with the lines."""
    more = more or {}
    rest = [*PLACE, *more] if more else []
    derived = {
        "tools": F.when(~F.col("meta"), F.array_join(tool_ids(F.col("blocks")), "\x1f")),
        "plain": F.when(~F.col("meta") & ~has_tools(F.col("blocks")), plain_text(F.col("text"))),
    }
    lines = read_lines(raw_line, source_file, derived | more)
    known = F.col("session").isNotNull() & F.col("kind").isNotNull()
    block = F.md5(F.concat_ws("\x1e", "session", "kind"))
    enough = known & (F.size(F.split("plain", " ")) >= MIN_WORDS - EDITS)
    return lines.select(
        "line_id", "batch_no", short_key("u", F.col("key")).alias("u"),
        F.when(known & (F.col("tools") != ""), short_key("t", F.md5(F.concat_ws("\x1d", block, "tools")))).alias("t"),
        F.when(enough, short_key("b", block)).alias("block"), F.when(enough, short_key("x", F.md5(F.concat_ws("\x1d", block, "plain")))).alias("ckey"),
        F.when(enough, F.col("plain")).alias("text"), *rest,
    )


#: Stands for the line of a text all of whose lines are rejected already: it leads no other.
LAST = (1 << 63) - 1

# ---- texts of a group --------------------------------------------------------------------

PAIRS = "block string, ckey string, low long, old boolean, pattern int, n long"
_PAIRS = pa.schema([("block", pa.string()), ("ckey", pa.string()), ("low", pa.int64()), ("old", pa.bool_()), ("pattern", pa.int32()), ("n", pa.int64())])


def _leaders(passing: frozenset[int]):
    """For groups of texts sorted by (group, line): each text is held against
    the leaders before it, which are texts near none before them, and accepted
    ones of earlier batches. A row for each text that is near one, with the
    smallest such leader, and a row for each pattern with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: str | None = None
        leaders: list[tuple] = []
        for b in batches:
            found: list[tuple] = []
            counts: dict[int, int] = {}
            for g, block, line, ckey, text, old in zip(*(b.column(c).to_pylist() for c in ("gkey", "block", "line", "ckey", "text", "old"))):
                if g != group:
                    group, leaders = g, []
                words = text.split(" ")
                parts = parts_of(words)
                near = None
                if not old:
                    for at, known, known_parts, of_old in leaders:
                        if line == LAST and not of_old:
                            break
                        k = pattern_of(words, known, parts, known_parts)
                        counts[k] = counts.get(k, 0) + 1
                        if k in passing and within_edits(words, known) <= EDITS:
                            near = at, of_old
                            break
                if near:
                    found.append((block, ckey, near[0], near[1], None, None))
                elif len(words) >= MIN_WORDS and line != LAST:
                    leaders.append((line, words, parts, old))
            found += [(None, None, None, None, k, n) for k, n in counts.items()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), _PAIRS)], schema=_PAIRS)

    return run


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = pa.array([part_keys(g, t.split(" ")) for g, t in zip(b.column("block").to_pylist(), b.column("text").to_pylist())], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*b.columns, keys], names=[*b.schema.names, "parts"])


def by_parts(texts: DataFrame) -> DataFrame:
    """Texts once for each of their word classes, with its key as gkey."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(_part_rows, f"{schema}, parts array<string>").withColumn("gkey", F.explode("parts")).drop("parts")


def _members(lines: DataFrame) -> DataFrame:
    """line_id, gkey for all groups of lines that repeat each other."""
    long_ = F.size(F.split("text", " ")) >= MIN_WORDS
    return lines.select("line_id", F.explode(F.array_compact(F.array("u", "t", F.when(long_, F.col("ckey"))))).alias("gkey"))


def observed(seen: Observation) -> dict:
    """What was observed; nothing where the plan turned out to have no rows at all."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


ENTRY = "struct<line:long,text:string>"
LINK = "first_id long, dup_id long"

# ---- a call in one pass --------------------------------------------------------------------


class Text:
    __slots__ = ("line", "words", "_parts")

    def __init__(self, text: str, line: int = LAST) -> None:
        self.line, self.words, self._parts = line, text.split(" "), None

    @property
    def parts(self) -> tuple[str, ...]:
        if self._parts is None:
            self._parts = parts_of(self.words)
        return self._parts


class Group:
    """Texts of a block, and which of them a text has to be held against: all of
    a few, of more those that have a word class in common with it."""

    def __init__(self) -> None:
        self.texts: list[Text] = []
        self.index: dict[tuple[int, str], list[int]] | None = None

    def add(self, text: Text) -> None:
        self.texts.append(text)
        if self.index is not None:
            self._put(len(self.texts) - 1)
        elif len(self.texts) > FEW:
            self.index = {}
            for n in range(len(self.texts)):
                self._put(n)

    def _put(self, n: int) -> None:
        for k in enumerate(self.texts[n].parts):
            self.index.setdefault(k, []).append(n)

    def like(self, text: Text) -> list[Text]:
        """In the order in which they were added."""
        if self.index is None:
            return self.texts
        return [self.texts[n] for n in sorted({n for k in enumerate(text.parts) for n in self.index.get(k, ())})]


#: Rows that one pass takes, sorted by kind and line, and gives.
SPLIT, LINE, OLD = range(3)
GIVEN = f"what string, {LINK}, gkey string, entry {ENTRY}, block string, counts array<long>"
_ENTRY = pa.struct([("line", pa.int64()), ("text", pa.string())])
_GIVEN = pa.schema([("what", pa.string()), ("first_id", pa.int64()), ("dup_id", pa.int64()), ("gkey", pa.string()), ("entry", _ENTRY), ("block", pa.string()), ("counts", pa.list_(pa.int64()))])


def _given(**columns: list) -> pa.RecordBatch:
    n = len(columns["what"])
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name) or [None] * n, f.type) for f in _GIVEN], schema=_GIVEN)


def _one_pass(passing: frozenset[int], group: int):
    """For the rows of a call: the split blocks, its lines in order, and the
    accepted lines of earlier calls that the state has for its keys, of which one
    batch at a time is held. The lines are decided one after the other. Rows of
    links, of keys of the lines accepted, of blocks that are to be split from now
    on, and one row of the counts of the patterns (seen)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: set[str] = set()
        lines: list[tuple] = []
        texts: dict[str, Text] = {}
        blocks: dict[str, Group] = {}
        looking: dict[str, list[str]] = {}  # part key -> ckeys
        ckeys: dict[int, str] = {}
        accepted: dict[str, int] = {}  # identifier or tool blocks -> line
        near: dict[str, int] = {}  # ckey -> smallest accepted line near it
        old_texts: Counter[str] = Counter()
        counts = [0] * len(PATTERNS)

        def alike(x: Text, y: Text) -> bool:
            k = pattern_of(x.words, y.words, x.parts, y.parts)
            counts[k] += 1
            return k in passing and within_edits(x.words, y.words) <= EDITS

        for b in batches:
            for kind, gkey, line, text, u, t, block, ckey in zip(*(b.column(c).to_pylist() for c in ("kind", "gkey", "line", "text", "u", "t", "block", "ckey"))):
                if kind == SPLIT:
                    split.add(gkey)
                elif kind == LINE:
                    lines.append((line, u, t, block, ckey, text))
                    if block is not None and ckey not in texts:
                        x = texts[ckey] = Text(text)
                        ckeys[id(x)] = ckey
                        blocks.setdefault(block, Group()).add(x)
                        if block in split:
                            for k in part_keys(block, x.words):
                                looking.setdefault(k, []).append(ckey)
                elif text is None:
                    accepted[gkey] = min(line, accepted.get(gkey, line))
                else:
                    y = Text(text)
                    if gkey in blocks:
                        old_texts[gkey] += 1
                        found = blocks[gkey].like(y)
                    else:
                        found = [texts[c] for c in looking.get(gkey, ())]
                    for x in found:
                        c = ckeys[id(x)]
                        if near.get(c, LAST) > line and alike(x, y):
                            near[c] = line

        fresh = [b for b, x in blocks.items() if b not in split and (len(x.texts) > group or old_texts[b] >= group)]
        split.update(fresh)
        here: dict[str, Group] = {}  # block -> its texts that are accepted in this call
        links: list[tuple[int, int]] = []
        keys: list[tuple[str, dict]] = []
        for line, rows in groupby(lines, key=lambda r: r[0]):
            rows = list(dict.fromkeys(rows))
            found = [accepted[k] for r in rows for k in r[1:3] if k in accepted]
            for _, _, _, block, ckey, _ in rows:
                if block is None:
                    continue
                if ckey not in near:
                    for y in here[block].like(texts[ckey]) if block in here else ():
                        if alike(texts[ckey], y):
                            near[ckey] = y.line
                            break
                if ckey in near:
                    found.append(near[ckey])
            if found:
                links.append((min(found), line))
                continue
            for _, u, t, block, ckey, text in rows:
                for k in (u, t):
                    if k is not None:
                        accepted[k] = line
                        keys.append((k, {"line": line, "text": None}))
                if block is not None and len(texts[ckey].words) >= MIN_WORDS:
                    near[ckey] = line
                    x = Text(text, line)
                    x._parts = texts[ckey]._parts
                    here.setdefault(block, Group()).add(x)
                    keys += [(k, {"line": line, "text": text}) for k in (part_keys(block, x.words) if block in split else [block])]
        yield _given(what=["links"] * len(links), first_id=[x for x, _ in links], dup_id=[x for _, x in links])
        for k in range(0, len(keys), 10_000):
            part = keys[k : k + 10_000]
            yield _given(what=["keys"] * len(part), gkey=[x for x, _ in part], entry=[x for _, x in part])
        yield _given(what=["split"] * len(fresh), block=fresh)
        yield _given(what=["seen"], counts=[counts])

    return run


# ---- index -------------------------------------------------------------------------------

ARRIVING = f"{KEYS}, gkey string, entry {ENTRY}"


class LinkIndex:
    """Accepted lines as keyed state below `path`: key -> accepted lines that
    have it (one for identifiers and tool blocks, the block's texts for blocks).

    A call's lines go into `in/call=n` together with the keys of the lines that
    the call before accepted; the running query takes the two in one
    micro-batch and writes what the state has for the call's own keys to
    `hits/call=n`. `links/call=n` has the rejected lines with the accepted ones.
    close() puts in the last keys and the weights; an index can be opened again
    on its path.
    """

    def __init__(self, spark: SparkSession, path: str, partitions: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = Scratch.at_path(spark, self.path)
        self.calls, self.heavy, self.weights = 0, False, Weights()
        self.pending: DataFrame | None = None
        if kept := self.folder.read_text("about.json"):
            about = json.loads(kept)
            self.calls, self.heavy, self.weights = about["calls"], about["heavy"], Weights(about["seen"])
        self.folder.make("in")
        self.folder.make("links")
        self.single = spark.newSession()
        for key, value in {"shuffle.partitions": "1", "adaptive.enabled": "false", "autoBroadcastJoinThreshold": "-1", "codegen.wholeStage": "false", "codegen.factoryMode": "NO_CODEGEN", "session.timeZone": spark.conf.get("spark.sql.session.timeZone")}.items():
            self.single.conf.set(f"spark.sql.{key}", value)
        self.query = self._start()

    def _start(self):
        own = self.spark.newSession()
        for key, value in STATE_CONF.items():
            own.conf.set(key, value)
        own.conf.set("spark.sql.shuffle.partitions", str(self.partitions))
        own.conf.set("spark.sql.session.timeZone", self.spark.conf.get("spark.sql.session.timeZone"))
        # Lists of a few lines are merged by hash instead of being sorted.
        own.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
        arriving = own.readStream.schema(f"{ARRIVING}, call int").parquet(f"{self.path}/in")
        none = F.lit(None).cast(ENTRY)
        rows = F.array(*[F.struct(F.col(k).alias("gkey"), none.alias("entry"), F.col("call").alias("asked")) for k in ("u", "t", "block")], F.struct("gkey", "entry", F.when(F.col("entry").isNull(), F.col("call")).alias("asked")))
        keyed = arriving.select(F.explode(rows).alias("x")).select("x.*").where("gkey is not null")
        state = keyed.groupBy("gkey").agg(F.collect_list("entry").alias("entries"), F.max("asked").alias("asked"))

        def take(df: DataFrame, _: int) -> None:
            hits = df.where((F.col("asked") == self.calls) & (F.size("entries") > 0)).select("gkey", "entries")
            seen = Observation()
            hits = hits.observe(seen, F.max(F.when(F.col("gkey").startswith("b"), F.size("entries"))).alias("most"))
            hits.write.mode("overwrite").parquet(f"{self.path}/hits/call={self.calls}")
            self.most = observed(seen).get("most") or 0

        return state.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{self.path}/checkpoint").start()

    # -- a call

    def add(self, lines: DataFrame) -> None:
        """Links the next lines (as of prepare), all of which come after those added before."""
        n = self.calls + 1
        seen = Observation()
        # Keys that the call before left may lie there already.
        lines.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{self.path}/stage/call={n}")
        rows = observed(seen).get("n", 0)
        if self._is_small(n, rows):
            self.add_staged(None, rows)
            return
        texts = self.spark.read.schema(KEYS).parquet(f"{self.path}/stage/call={n}").where("block is not null")
        busy = texts.groupBy("block").agg(F.countDistinct("ckey").alias("n")).where(F.col("n") > GROUP).select("block")
        busy = Scratch(self.spark, "busy").save(busy, "busy")
        self.add_staged(busy if busy.head(1) else None, rows)

    def _is_small(self, call: int, rows: int) -> bool:
        return rows <= ROWS and self.folder.bytes_of(f"stage/call={call}") <= BYTES

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def _at_once(self, path: str, schema: str) -> DataFrame:
        """In one partition of a session in which nothing is sent around or compiled."""
        return self.single.read.schema(schema).parquet(path).coalesce(1)

    def add_staged(self, busy: DataFrame | None, rows: int) -> None:
        """The same for `rows` lines that lie in stage/call=n, n being the next
        call. busy: the blocks with more than GROUP texts in this call, if any."""
        if self.pending is not None:
            self.pending.write.mode("append").parquet(f"{self.path}/stage/call={self.calls + 1}")
            self.pending = None
        self.calls += 1
        n, stage = self.calls, f"{self.path}/stage/call={self.calls}"
        small = self._is_small(n, rows)
        if self.heavy:
            self._ask_parts(stage, small)
        # Renaming a folder publishes all its files at once.
        self.folder.rename(f"stage/call={n}", f"in/call={n}")
        self.staged = False
        self.query.processAllAvailable()
        if small:
            self._link_at_once()
            return
        scratch = Scratch(self.spark, f"link{n}")
        plain = lines = self._read(f"{self.path}/in/call={n}", KEYS).where("line_id is not null")
        hits = self._read(f"{self.path}/hits/call={n}", f"gkey string, entries array<{ENTRY}>")
        split = self._split(busy, hits)
        firsts = hits.where(~F.col("gkey").startswith("b") & ~F.col("gkey").startswith("c")).select("gkey", F.col("entries")[0]["line"].alias("first"))
        for k in ("u", "t"):
            lines = lines.join(firsts.select(F.col("gkey").alias(k), F.col("first").alias(f"{k}_first")), k, "left")
        lines = lines.withColumn("known", F.least("u_first", "t_first")).drop("u_first", "t_first")
        rest, turn = lines, 0
        while True:
            turn += 1
            pairs, counts, followers = self._pairs(rest, hits, split, scratch, turn)
            self.weights.learn(counts)
            if not self._decide(rest, pairs, followers, scratch, turn):
                break
            # Rejected lines leave their groups; what waits is held against what is left there.
            open_ = self._read(f"{self.path}/links/call={n}/turn={turn}", LINK).where("first_id is null").select(F.col("dup_id").alias("line_id"))
            left = lines.where("known is null").join(self.links(n).select(F.col("dup_id").alias("line_id")), "line_id", "left_anti")
            groups = left.select("line_id", F.explode(F.array_compact(F.array("u", "t", "ckey", "block"))).alias("gkey"))
            near = groups.join(groups.join(open_, "line_id", "left_semi").select("gkey").distinct(), "gkey", "left_semi").select("line_id").distinct()
            rest = scratch.save(left.join(near, "line_id", "left_semi"), f"rest{turn}")
        self.pending = self._accepted(plain, self.links(n), split)
        if self.work is not None:
            self.work.remove()
        self.work = scratch

    work: Scratch | None = None
    most = 0
    staged = False

    def _link_at_once(self) -> None:
        """Links the call whose lines are in `in` and whose keys are in `hits` in one pass."""
        n = self.calls
        none = [F.lit(None).cast("string").alias(k) for k in ("u", "t", "block", "ckey")]
        lines = self._at_once(f"{self.path}/in/call={n}", KEYS).where("line_id is not null")
        rows = lines.select(F.lit(LINE).alias("kind"), F.lit(None).cast("string").alias("gkey"), F.col("line_id").alias("line"), "text", "u", "t", "block", "ckey")
        old = self._at_once(f"{self.path}/hits/call={n}", f"gkey string, entries array<{ENTRY}>").select("gkey", F.explode("entries").alias("e"))
        rows = rows.unionByName(old.select(F.lit(OLD).alias("kind"), "gkey", F.col("e.line").alias("line"), F.col("e.text").alias("text"), *none))
        if self.heavy:
            split = self._at_once(f"{self.path}/split", "block string")
            rows = rows.unionByName(split.select(F.lit(SPLIT).alias("kind"), F.col("block").alias("gkey"), F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("text"), *none))
        rows = rows.coalesce(1).sortWithinPartitions("kind", "line")
        seen = Observation()
        given = rows.mapInArrow(_one_pass(self.weights.passing, GROUP), GIVEN)
        given = given.observe(seen, F.max("counts").alias("counts"), F.count("block").alias("split"))
        given.where("what <> 'seen'").drop("counts").write.partitionBy("what").mode("overwrite").parquet(f"{self.path}/given")
        got = observed(seen)
        self.weights.learn(got.get("counts") or [0] * len(PATTERNS))
        self.heavy = self.heavy or bool(got.get("split"))
        for what, to in (("links", f"links/call={n}/turn=1"), ("keys", f"stage/call={n + 1}"), ("split", "split")):
            moved = self.folder.move_files(f"given/what={what}", to)
            self.staged = self.staged or what == "keys" and moved > 0
        self.folder.remove(f"hits/call={n}")
        if self.work is not None:
            self.work.remove()
            self.work = None

    def links(self, call: int | None = None) -> DataFrame:
        """first_id, dup_id of all calls or of one."""
        if call is None:
            found = self.spark.read.schema(LINK).parquet(f"{self.path}/links")
        else:
            found = self._read(f"{self.path}/links/call={call}", LINK)
        # Rows without a first_id are lines that waited for another turn.
        return found.where("first_id is not null").select("first_id", "dup_id")

    def close(self) -> None:
        """Puts in what is still to be put in and ends the query."""
        if self.pending is not None or self.staged:
            self.calls += 1
            if self.pending is not None:
                self.pending.write.mode("append").parquet(f"{self.path}/stage/call={self.calls}")
            self.folder.rename(f"stage/call={self.calls}", f"in/call={self.calls}")
            self.query.processAllAvailable()
            self.pending, self.staged = None, False
        self.stop()
        self.folder.write_text("about.json", json.dumps({"calls": self.calls, "heavy": self.heavy, "seen": self.weights.seen.tolist()}))

    def stop(self) -> None:
        self.query.stop()
        if self.work is not None:
            self.work.remove()

    def drop(self, lines: bool = True) -> None:
        """Removes all but the links, without `lines` also what came in."""
        for name in (*["in"] * lines, "stage", "hits", "given", "asked", "split", "checkpoint"):
            self.folder.remove(name)

    # -- its parts

    def _split(self, busy: DataFrame | None, hits: DataFrame) -> DataFrame | None:
        """The blocks that are split by word classes, kept in `split`; None if there are none."""
        fresh = [busy] if busy is not None else []
        if self.most >= GROUP:
            fresh.append(hits.where(F.col("gkey").startswith("b") & (F.size("entries") >= GROUP)).select(F.col("gkey").alias("block")))
        for df in fresh:
            df.write.mode("append").parquet(f"{self.path}/split")
            self.heavy = True
        return self._read(f"{self.path}/split", "block string").distinct() if self.heavy else None

    def _ask_parts(self, stage: str, small: bool) -> None:
        """Keys of word classes for the texts of split blocks."""
        read = self._at_once if small else self._read
        split = read(f"{self.path}/split", "block string").distinct()
        texts = read(stage, KEYS).where("block is not null").select("block", "ckey", "text").dropDuplicates(["ckey"])
        asked = by_parts(texts.join(split, "block", "left_semi").select("block", "text")).select("gkey", F.lit(None).cast(ENTRY).alias("entry"))
        asked = Scratch.at_path(asked.sparkSession, f"{self.path}/asked").save(asked, f"call={self.calls}")
        asked.write.mode("append").parquet(stage)

    def _pairs(self, lines: DataFrame, hits: DataFrame, split: DataFrame | None, scratch: Scratch, turn: int) -> tuple[DataFrame, list[int], int]:
        """(texts near a leader, counts of the patterns, number of texts near one of this call)."""
        # Texts of lines that are rejected anyway still look for the smallest accepted line.
        line = F.coalesce(F.min(F.when(F.col("known").isNull(), F.col("line_id"))), F.lit(LAST)).alias("line")
        texts = lines.where("block is not null").groupBy("ckey").agg(F.first("block").alias("block"), F.first("text").alias("text"), line)
        texts = texts.select("block", "line", "ckey", "text", F.lit(False).alias("old"))
        there = hits.where(F.col("gkey").startswith("b") | F.col("gkey").startswith("c")).select("gkey", F.explode("entries").alias("e"))
        there = there.select("gkey", F.col("gkey").alias("block"), F.col("e.line").alias("line"), F.lit(None).cast("string").alias("ckey"), F.col("e.text").alias("text"), F.lit(True).alias("old"))
        if split is None:
            rows = texts.withColumn("gkey", F.col("block")).unionByName(there)
        else:
            every = texts.withColumn("gkey", F.col("block")).unionByName(there.where(F.col("gkey").startswith("b")))
            apart = by_parts(every.join(split, "block", "left_semi").drop("gkey"))
            rows = every.join(split, "block", "left_anti").unionByName(apart).unionByName(there.where(F.col("gkey").startswith("c")))
        at = Window.partitionBy("gkey").orderBy("line")
        # A text that is alone in its group has nothing to be held against.
        rows = rows.withColumn("after", F.lead("line").over(at)).withColumn("before", F.lag("line").over(at))
        rows = rows.where("after is not null or before is not null").drop("after", "before")
        pairs = rows.mapInArrow(_leaders(self.weights.passing), PAIRS)
        seen = Observation()
        counts = [F.sum(F.when(F.col("pattern") == k, F.col("n"))).alias(f"p{k}") for k in range(len(PATTERNS))]
        pairs = pairs.observe(seen, F.count_if(F.col("old") == F.lit(False)).alias("followers"), *counts)
        scratch.save(pairs, f"pairs{turn}")
        saved = self._read(scratch.at(f"pairs{turn}"), PAIRS).where("low is not null")
        got = observed(seen)
        return saved, [got.get(f"p{k}") or 0 for k in range(len(PATTERNS))], got.get("followers", 0)

    def _decide(self, lines: DataFrame, pairs: DataFrame, followers: int, scratch: Scratch, turn: int) -> int:
        """Writes the turn's links: rejected lines with the accepted one, and
        lines that have to wait (first_id null). How many wait?"""
        near = pairs.groupBy("ckey").agg(F.min(F.when(F.col("old"), F.col("low"))).alias("near_old"), F.min(F.when(~F.col("old"), F.col("low"))).alias("near_new"))
        held = lines.join(near, "ckey", "left").withColumn("first", F.least("known", "near_old"))
        fresh = held.where("first is null")
        lowest = _members(fresh).groupBy("gkey").agg(F.min("line_id").alias("low"), F.max("line_id").alias("high")).where("low < high").drop("high")
        low = _members(fresh).join(lowest, "gkey").where("low < line_id").groupBy("line_id").agg(F.min("low").alias("low"))
        low = held.select("line_id", "first", "near_new").join(low, "line_id", "left").withColumn("low", F.when(F.col("first").isNull(), F.least("low", "near_new")))
        seen = Observation()
        low = low.where("first is not null or low is not null").observe(seen, F.count_if(F.col("first").isNull()).alias("open"))
        scratch.save(low.select("line_id", "first", "low"), f"low{turn}")
        low = self._read(scratch.at(f"low{turn}"), "line_id long, first long, low long").distinct()
        to = f"{self.path}/links/call={self.calls}/turn={turn}"
        done = low.where("first is not null").select(F.col("first").alias("first_id"), F.col("line_id").alias("dup_id"))
        if not observed(seen).get("open"):
            done.write.mode("overwrite").parquet(to)
            return 0
        # A line whose first counterpart is accepted for good is rejected; the others wait. So do the texts of a block
        # from its first leader on that is not accepted for good, as those that follow it may still become leaders.
        open_ = low.where("first is null").select("line_id", "low")
        unsure = open_.select("line_id")
        sure = open_
        if followers:
            shaky = pairs.where("not old").select("block", F.col("low").alias("line_id")).distinct().join(unsure, "line_id", "left_semi")
            since = shaky.groupBy("block").agg(F.min("line_id").alias("since"))
            late = fresh.select("line_id", "block").join(since, "block").where("line_id > since").select("line_id").distinct()
            unsure, sure = unsure.union(late), sure.join(late, "line_id", "left_anti")
        unsure = unsure.distinct()
        sure = sure.join(unsure.select(F.col("line_id").alias("low")), "low", "left_anti")
        wait = unsure.join(sure, "line_id", "left_anti").select(F.lit(None).cast("long").alias("first_id"), F.col("line_id").alias("dup_id"))
        result = done.unionByName(sure.select(F.col("low").alias("first_id"), F.col("line_id").alias("dup_id"))).unionByName(wait)
        left = Observation()
        result = result.observe(left, F.count_if(F.col("first_id").isNull()).alias("waiting"))
        result.write.mode("overwrite").parquet(to)
        return observed(left).get("waiting", 0)

    def _accepted(self, lines: DataFrame, links: DataFrame, split: DataFrame | None) -> DataFrame:
        """gkey, entry: the keys of the lines that are accepted now."""
        taken = lines.join(links.select(F.col("dup_id").alias("line_id")).distinct(), "line_id", "left_anti")
        entry = lambda text: F.struct(F.col("line_id").alias("line"), text.alias("text"))
        none = F.lit(None).cast("string")
        text = F.when(F.size(F.split("text", " ")) >= MIN_WORDS, F.col("text"))
        whole = F.when(text.isNotNull(), F.col("block"))
        if split is not None:
            marked = taken.join(split.withColumn("apart", F.lit(True)), "block", "left").where("apart is null or block is null")
            apart = by_parts(taken.join(split, "block", "left_semi").where(text.isNotNull()).select("line_id", "block", "text"))
            parts = apart.select("gkey", entry(F.col("text")).alias("entry"))
            keys = taken.select(F.explode(F.array_compact(F.array("u", "t"))).alias("gkey"), entry(none).alias("entry"))
            blocks = marked.where(text.isNotNull()).select(F.col("block").alias("gkey"), entry(F.col("text")).alias("entry"))
            return keys.unionByName(blocks).unionByName(parts)
        rows = F.array(F.struct(F.col("u").alias("gkey"), entry(none).alias("entry")), F.struct(F.col("t").alias("gkey"), entry(none).alias("entry")), F.struct(whole.alias("gkey"), entry(text).alias("entry")))
        return taken.select(F.explode(F.filter(rows, lambda x: x["gkey"].isNotNull())).alias("x")).select("x.*")


def calls_of(raw_line: DataFrame) -> list[tuple[list, int]]:
    """(batches, lines) of each call, in order: a call a batch. Batches whose
    line_ids overlap are linked in one, as lines are decided in their order."""
    sizes = raw_line.groupBy("batch_no").agg(F.min("line_id").alias("low"), F.max("line_id").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("low").collect()
    calls: list[tuple[list, int]] = []
    high = None
    for r in sizes:  # one row a batch
        if high is None or r["low"] is None or r["low"] <= high:
            own, n = calls.pop() if calls else ([], 0)
            calls.append(([*own, r["batch_no"]], n + r["n"]))
        else:
            calls.append(([r["batch_no"]], r["n"]))
        high = r["high"] if high is None else max(high, r["high"] or high)
    return calls


def link_batches(raw_line: DataFrame, source_file: DataFrame, more: dict[str, Column] | None = None) -> tuple[LinkIndex, DataFrame]:
    """All batches of raw_line in order, a call each, against what was accepted
    before: the index and the lines as prepared.

    A line is rejected if an accepted line before it has the same identifier
    (128 bits, however written), or the same session and type, neither meta,
    and the same tool block ids or, where neither has tool blocks, a text of at
    least 8 words that is equal but for case, punctuation, white space and at
    most two words. first_id is the smallest such line. Lines without a
    session or a type can only repeat by identifier; a null batch is a batch of
    its own, a line without a line_id is left out, repeated rows are one line.
    No lines give no links. Extra columns are ignored.
    """
    spark = raw_line.sparkSession
    raw_line = raw_line.where("line_id is not null")
    scratch = Scratch(spark, "linkage")
    calls = calls_of(raw_line)
    # As many partitions of the state as the session shuffles into, but none of fewer than STATE_ROWS lines.
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = LinkIndex(spark, scratch.at("index"), max(1, min(most, sum(n for _, n in calls) // STATE_ROWS)))
    number = F.coalesce(*[F.when(F.col("batch_no").eqNullSafe(F.lit(b)), F.lit(k)) for k, (own, _) in enumerate(calls, 1) for b in own], F.lit(1)) if calls else F.lit(1)
    lines = prepare(raw_line, source_file, more).withColumn("call", number).drop("batch_no")
    if not calls:
        scratch.save(lines, "index/in", ["call"])
        index.stop()
        return index, lines
    # One shuffle lays the lines out by call, in files of the advised size.
    lines.hint("rebalance", "call").write.partitionBy("call").mode("overwrite").parquet(f"{index.path}/stage")
    staged = spark.read.schema(f"{KEYS}, call int").parquet(f"{index.path}/stage")
    there = set()
    if any(not index._is_small(n, rows) for n, (_, rows) in enumerate(calls, 1)):
        busy = staged.where("block is not null").groupBy("call", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
        busy = scratch.save(busy.select("call", "block"), "busy")
        there = {r["call"] for r in busy.select("call").distinct().collect()}
    for n, (_, rows) in enumerate(calls, 1):
        index.add_staged(busy.where(F.col("call") == n).select("block") if n in there else None, rows)
    index.stop()
    return index, spark.read.schema(lines.drop("call").schema).parquet(f"{index.path}/in").where("line_id is not null")


def rejected_lines(raw_line: DataFrame, source_file: DataFrame) -> DataFrame:
    """first_id, dup_id. The index is dropped once the links are there; a
    LinkIndex of one's own goes on with the batches to come."""
    index, _ = link_batches(raw_line, source_file)
    index.drop()
    return index.links()
