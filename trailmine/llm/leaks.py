"""Problem 8: evaluation texts in the documents.

Method: an FM-index for each shard of the documents. The items' own phrases
are searched backward through wavelet ranks, their places found by sampled
suffix positions; each document with a hit is then checked exactly, and the
places found are merged into removal spans.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fmindex import FMIndex

#: Words of a searched phrase, of the shortest agreement that counts in the
#: exact check, and of one that is longer than a quotation.
PHRASE = 4
RUN = 3
LONG = 8
#: Own words in order that make a case.
LEAST_WORDS = 12
#: Wording that more items share is not an item's own.
SHARED = 5
#: Words of documents in one shard's index; a longer document is a shard of its own.
SHARD_WORDS = 1 << 20
#: Items searched at once. Their phrases go to every task, so a block bounds what is sent.
BLOCK_ITEMS = 20_000

TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
INVISIBLE = re.compile("[­​-‏⁠﻿]")
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words without letter case, punctuation and markup."""
    if not text:
        return []
    text = TAG.sub(" ", text)
    if "&" in text:
        text = TAG.sub(" ", html.unescape(text))
    return WORD.findall(INVISIBLE.sub("", text).casefold())


@dataclass
class Items:
    """A block of items with their own phrases."""

    words: dict[int, list[str]]
    shared: int = SHARED
    own: dict[int, dict[int, np.ndarray]] = field(default_factory=dict)  # by RUN and LONG: is what begins at a place the item's own?
    phrases: dict[tuple[str, ...], list[int]] = field(default_factory=dict)

    @staticmethod
    def grams(words: list[str], n: int) -> list[tuple[str, ...]]:
        return [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]

    @classmethod
    def of(cls, words: dict[int, list[str]], counts: dict[int, Counter], shared: int = SHARED) -> Items:
        """counts: in how many of all items (not of the block) a phrase of n words is."""
        self = cls(words, shared)
        phrases = defaultdict(list)
        for item, ws in words.items():
            self.own[item] = {n: np.array([counts[n][g] <= shared for g in cls.grams(ws, n)], bool) for n in (RUN, LONG)}
            for g in set(cls.grams(ws, PHRASE)):
                if counts[PHRASE][g] <= shared:
                    phrases[g].append(item)
        self.phrases = dict(phrases)
        return self


def matched(doc: list[str], item: list[str], own: dict[int, np.ndarray]) -> tuple[int, list[tuple[int, int]]]:
    """Most own words of the item that the document has in their order, and
    the places in the document.

    Runs of at least RUN equal words count with those words that lie in a
    stretch of RUN words that is the item's own, or of LONG words, in which
    wording may be its own whose short parts many items share. Words of a
    stretch of LONG words that many items share never count.
    """
    shared = np.zeros(len(item), bool)
    for k in np.flatnonzero(~own[LONG]):
        shared[k : k + LONG] = True
    places = defaultdict(list)
    grams = Items.grams(item, RUN)
    wanted = set(grams)
    for j, g in enumerate(zip(*(doc[k:] for k in range(RUN)))):
        if g in wanted:
            places[g].append(j)
    ends: dict[tuple[int, int], list[int]] = {}  # places of the last gram of a run -> run
    found: list[list[int]] = []
    for i, g in enumerate(grams):
        for j in places.get(g, ()):
            run = ends.pop((i - 1, j - 1), None)
            if run is None:
                run = [i, j, RUN]
                found.append(run)
            else:
                run[2] += 1
            ends[i, j] = run
    runs = []
    for i, j, n in found:
        mask = np.zeros(n, np.int64)
        for size, is_own in own.items():
            for k in np.flatnonzero(is_own[i : i + n - size + 1]) if n >= size else ():
                mask[k : k + size] = 1
        mask[shared[i : i + n]] = 0
        if mask.any():
            runs.append((i, j, n, [*mask[::-1].cumsum()[::-1].tolist(), 0]))  # own words from each place on
    runs.sort(key=lambda r: (r[1] + r[2], r[0]))
    best: list[tuple[int, int]] = []  # (own words, run before)
    for b, (i, j, n, rest) in enumerate(runs):
        top = (rest[0], -1)
        for a in range(b):
            x, y, m, _ = runs[a]
            cut = max(0, x + m - i, y + m - j)
            if x < i and y < j and cut < n and best[a][0] + rest[cut] > top[0]:
                top = (best[a][0] + rest[cut], a)
        best.append(top)
    if not runs:
        return 0, []
    b = max(range(len(runs)), key=lambda k: best[k][0])
    most, spans = best[b][0], []
    while b >= 0:
        spans.append((runs[b][1], runs[b][1] + runs[b][2]))
        b = best[b][1]
    return most, spans[::-1]


def search_shard(docs: list[list[str]], items: Items, least: int = LEAST_WORDS) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """(document, item, own words, spans) of the shard's documents."""
    numbers: dict[str, int] = {}
    total = sum(map(len, docs)) + len(docs)
    text, starts, at = np.zeros(total, np.int64), np.zeros(len(docs), np.int64), 0
    for d, ws in enumerate(docs):
        starts[d] = at
        text[at : at + len(ws)] = [numbers.setdefault(w, len(numbers) + 1) for w in ws]
        at += len(ws) + 1
    phrases = [p for p in items.phrases if all(w in numbers for w in p)]
    if not phrases or not total:
        return []
    index = FMIndex(text)
    low, high = index.search(np.array([[numbers[w] for w in p] for p in phrases], np.int64))
    count = high - low
    which = np.repeat(np.arange(len(phrases)), count)
    rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)
    doc = np.searchsorted(starts, index.locate(rows), side="right") - 1
    pairs = {(int(d), item) for d, p in zip(doc, which) for item in items.phrases[phrases[p]]}
    out = []
    for d, item in sorted(pairs):
        n, spans = matched(docs[d], items.words[item], items.own[item])
        if n >= least:
            out.append((d, item, n, spans))
    return out


FOUND = "doc_id long, item_id long, words int, spans array<struct<from:int,to:int>>"


def _search(items: Items, shard_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("words", pa.int32()), ("spans", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        docs: list[list[str]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = search_shard(docs, items)
            return pa.RecordBatch.from_pylist([{"doc_id": ids[d], "item_id": i, "words": n, "spans": [{"from": a, "to": b} for a, b in spans]} for d, i, n, spans in found], schema=schema)

        for batch in batches:
            for k, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ws = words_of(text)
                if len(ws) < PHRASE:
                    continue
                if size and size + len(ws) > shard_words:
                    yield flush()
                    ids, docs, size = [], [], 0
                ids.append(k)
                docs.append(ws)
                size += len(ws)
        if docs:
            yield flush()

    return run


def leaked(documents: DataFrame, eval_item: DataFrame, shard_words: int = SHARD_WORDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, words, spans: documents that reproduce at least
    LEAST_WORDS words of an item's own wording in their order, and where (word
    places from, to).

    Items with null, empty or very short texts have no own wording and match
    nothing, as do such documents; items of equal wording share it, up to
    SHARED of them count. Documents are read whole, each in one shard, without
    a shuffle; items go to the tasks in blocks of block_items. Repeated rows of
    a document repeat its rows; extra columns are ignored.
    """
    spark = documents.sparkSession
    texts = eval_item.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = {n: Counter() for n in (RUN, PHRASE, LONG)}
    number = texts.count()
    blocks = -(-number // block_items)
    parts = [texts] if blocks == 1 else [texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) for b in range(blocks)]
    for part in parts:
        for r in part.toLocalIterator():
            ws = words_of(r["text"])
            for n, c in counts.items():
                c.update(set(Items.grams(ws, n)))
    out = spark.createDataFrame([], FOUND)
    for part in parts:
        words = {r["item_id"]: words_of(r["text"]) for r in part.toLocalIterator()}
        out = out.unionByName(rows.mapInArrow(_search(Items.of(words, counts), shard_words), FOUND))
    return out


def removal_spans(found: DataFrame) -> DataFrame:
    """doc_id, from, to, items: the places of all items in a document, merged
    where they overlap or touch."""
    spans = found.select("doc_id", "item_id", F.explode("spans").alias("x")).select("doc_id", "item_id", F.col("x.from").alias("from"), F.col("x.to").alias("to"))
    by = Window.partitionBy("doc_id").orderBy("from", "to", "item_id")
    before = F.max("to").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("from") <= before, 0).otherwise(1))
    marked = marked.withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "span").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.array_sort(F.collect_set("item_id")).alias("items")).drop("span")
