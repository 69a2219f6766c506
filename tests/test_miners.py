"""Properties of the miners on small corpora, and against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trailmine.operators import findings, follows, ngrams, rank, seqs, streams, surprise
from trailmine.schema import conform


def corpus(spark, lists, costs=None):
    rows = [(f"s{n:03d}", k, "tool", t, (costs or {}).get(t, 1)) for n, tokens in enumerate(lists) for k, t in enumerate(tokens)]
    df = spark.createDataFrame(rows, "s string, i long, k string, act string, b long") if rows else spark.createDataFrame([], "s string, i long, k string, act string, b long")
    df = df.withColumn("f", F.substr("s", F.lit(2)).cast("long"))
    marked = df.withColumn("st", F.when(df.act.endswith("!"), "fail").otherwise("ok")).withColumn("act", F.regexp_replace("act", r"!\z", ""))
    return conform(marked.withColumn("p", F.lit("p")))


def plain(spark, lists, **more):
    return streams.tokens(corpus(spark, lists, more.pop("costs", None)), collapse=more.pop("collapse", False), **more)


def listed(df, key="gram"):
    return {" ".join(r[key]): r for r in df.collect()}


def test_collapse_and_numbering_over_small_parts(spark):
    rng = random.Random(3)
    lists = [[rng.choice("abc") for _ in range(rng.randrange(1, 60))] for _ in range(6)]
    got = streams.tokens(corpus(spark, lists, {"a": 2}), bucket=4).collect()
    for n, tokens in enumerate(lists):
        want, k = [], 0
        while k < len(tokens):
            e = k
            while e < len(tokens) and tokens[e] == tokens[k]:
                e += 1
            want.append((len(want), tokens[k] + "+" * (e - k > 1), k, (e - k) * (2 if tokens[k] == "a" else 1)))
            k = e
        assert sorted((r["pos"], r["tok"], r["seq"], r["bytes"]) for r in got if r["stream"] == f"p/s{n:03d}@") == want


def test_neighbours_across_chunks(spark):
    rows = plain(spark, [list("abcdefghij")])
    got = {r["pos"]: (r["prev"], r["next"]) for r in streams.around(rows, {"prev": ("tok", 2)}, {"next": ("tok", 3)}, chunk=4).collect()}
    assert got == {k: (list("abcdefghij"[max(0, k - 2) : k]), list("abcdefghij"[k + 1 : k + 4])) for k in range(10)}
    with pytest.raises(ValueError):
        streams.around(rows, after={"next": ("tok", 4)}, chunk=4)


def test_longer_grams_close_shorter_ones(spark):
    counts = ngrams.count_grams(plain(spark, [list("xetdy")] * 4), 2, 3)
    got = listed(ngrams.frequent_grams(counts, 2, 2))
    assert got["e t d"]["n"] == 4 and got["e t d"]["streams"] == 4 and "e t" not in got
    lone = ngrams.count_grams(plain(spark, [list("xetdy")] * 3 + [list("zeto")]), 2, 3)
    assert set(listed(ngrams.frequent_grams(lone, 2, 4))) == {"e t"}


def test_edges_and_bounces(spark):
    rows = plain(spark, [list("abaca"), list("ab"), []])
    assert [(r["src"], r["dst"], r["n"]) for r in follows.edges(rows).collect()] == [("a", "b", 2), ("a", "c", 1), ("b", "a", 1), ("c", "a", 1)]
    assert [tuple(r) for r in follows.bounces(rows).collect()] == [("a", "b", 1), ("a", "c", 1)]


def test_scrambled_stream_is_the_most_surprising(spark):
    rows = plain(spark, [list("abcdabcdabcd")] * 5 + [list("dbacbdcadacb")])
    got = surprise.surprise(rows, 3, 5).collect()
    assert got[-1]["stream"] == "p/s005@" and len(got) == 6
    assert surprise.surprise(rows, 3, 50).count() == 0
    routine, odd = surprise.extremes(surprise.surprise(rows, 3, 5), 2)
    assert routine.count() == odd.count() == 1


def brute(lists, least, gap, longest):
    support = Counter()
    for tokens in lists:
        seen = set()

        def grow(path, at, tokens=tokens, seen=seen):
            seen.add(path)
            if len(path) < longest:
                for k in range(at + 1, min(at + gap + 1, len(tokens))):
                    grow((*path, tokens[k]), k)

        for k, t in enumerate(tokens):
            grow((t,), k)
        support.update(seen)
    return {p: n for p, n in support.items() if n >= least}


def test_gapped_sequences_against_brute_force(spark):
    rng = random.Random(5)
    lists = [[rng.choice("abcd") for _ in range(rng.randrange(1, 14))] for _ in range(12)]
    levels = seqs.pattern_levels(plain(spark, lists), 4, 2, 3)
    want = brute(lists, 4, 2, 3)
    assert {tuple(r["pattern"]): r["support"] for r in levels.collect()} == want
    mined = seqs.closed_patterns(levels, 10_000)
    best = Counter()
    for p, n in want.items():
        best[p[:-1]] = max(best[p[:-1]], n)
    closed = {p: n for p, n in want.items() if len(p) > 1 and len(set(p)) > 1 and 10 * best[p] < 8 * n}
    assert {tuple(r["pattern"]): r["support"] for r in mined.patterns.collect()} == closed and not mined.truncated
    capped = seqs.closed_patterns(levels, 1)
    assert capped.patterns.count() == 1 and capped.truncated


def test_support_counts_streams_and_gaps_have_an_end(spark):
    got = {tuple(r["pattern"]): r["support"] for r in seqs.mine(plain(spark, [list("ababab"), list("ab"), list("axyb")]), 2, 2, 2).patterns.collect()}
    assert got[("a", "b")] == 2


def test_folding_buckets_and_families(spark):
    rows = plain(spark, [list("abc")] * 5 + [list("abxy")] * 3)
    patterns = spark.createDataFrame([(list("abc"), 5), (list("ac"), 5), (list("ab"), 8), (list("bc"), 6)], "pattern array<string>, support long")
    kept = listed(rank.fold(patterns, 0.8), "pattern")
    assert set(kept) == {"a b c", "a b"} and kept["a b c"]["folded"] == 2
    assert rank.fold(patterns.limit(0)).count() == 0
    buckets = spark.createDataFrame([(["a!", "b", "b"],), (["a", "b", "a", "c!"],), (["a", "b"],), (["a", "c"],)], "pattern array<string>").withColumn("bits", F.when(F.col("pattern")[1] == "b", 0.5).otherwise(2.5))
    got = [r[0] for r in buckets.select(rank.bucket_of(F.col("pattern"), F.col("bits"), 1.0)).collect()]
    assert got == ["friction", "loop", "script", "watch"]
    ranked = rank.rank_patterns(rows, seqs.mine(rows, 3, 3, 3).patterns, rank.RankOptions(noise_bits=9))
    cards = ranked.cards.collect()
    assert cards and all(c["score"] >= 0 for c in cards)
    swapped = spark.createDataFrame([("watch", ["e!", "r"], 5, 1.0, 2.0, 0), ("watch", ["r", "e!"], 4, 1.0, 3.0, 2), ("watch", ["x", "y"], 4, 1.0, 3.0, 0)], "bucket string, pattern array<string>, support long, bits double, score double, folded long")
    merged = {tuple(r["pattern"]): (r["variants"], r["folded"]) for r in rank.merge_families(swapped).collect()}
    assert merged == {("r", "e!"): (1, 2), ("x", "y"): (0, 0)}


def test_findings_are_greedy(spark):
    pattern = spark.createDataFrame([(["a", "b"], "script", 2, 1.0)], "pattern array<string>, bucket string, support long, score double").withColumn("exemplar", F.struct(F.lit("s").alias("stream"), F.lit(0).alias("pos"), F.lit(0).alias("seq")))
    rows = plain(spark, [list("abab"), list("axb")], costs={"a": 10, "b": 20, "x": 5})
    got = findings.findings(rows, pattern).first()
    assert (got["kind"], got["action"], got["n"], got["streams"], got["burn"], got["fail_rate"]) == ("routine", "script", 3, 2, 90 // 4, 0.0)
    assert findings.findings(plain(spark, [list("ba")]), pattern).count() == 0
    assert findings.of_kind(findings.findings(rows, pattern), "noise").count() == 0


def test_random_measures(spark):
    rng = random.Random(8)
    lists = [[rng.choice("abc") for _ in range(rng.randrange(1, 30))] for _ in range(8)]
    motifs = [("a", "b"), ("a", "a"), ("a", "b", "c"), ("c", "b", "a")]
    got = {tuple(r["pattern"]): (r["n"], r["streams"]) for r in findings.measure(plain(spark, lists), spark.createDataFrame([(list(m),) for m in motifs], "pattern array<string>"), 2).collect()}
    for m in motifs:
        n = inside = 0
        for tokens in lists:
            k = hits = 0
            while k < len(tokens):
                at = k if tokens[k] == m[0] else None
                for t in m[1:]:
                    at = next((x for x in range(at + 1, min(at + 3, len(tokens))) if tokens[x] == t), None) if at is not None else None
                if at is None:
                    k += 1
                else:
                    hits, k = hits + 1, at + 1
            n, inside = n + hits, inside + (hits > 0)
        assert got.get(m, (0, 0)) == (n, inside)


def test_empty_tables(spark):
    rows = plain(spark, [])
    assert rows.count() == 0 and streams.vocabulary(rows).count() == 0 and follows.edges(rows).count() == 0
    assert ngrams.count_grams(rows).count() == 0 and surprise.surprise(rows).count() == 0
    assert seqs.mine(rows, 2).patterns.count() == 0
