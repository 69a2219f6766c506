"""The registered queries at the lengths of the commands, against brute force."""

import json
import math
import random
from collections import Counter

import pytest
from test_miners import brute

from trailmine.queries import queries


@pytest.fixture(scope="module")
def habits(spark, tmp_path_factory):
    """(folder, token lists by stream) of five users with habits of five tokens and more."""
    rng, rows = random.Random(11), []
    steps = [("click", 3), ("click", 4), ("view", 3), ("view", 5), ("purchase", 3), ("purchase", 4)]
    for user in range(5):
        line = [s for _ in range(3) for s in (*steps, rng.choice(steps))] + [rng.choice(steps) for _ in range(6)]
        rows += [(len(rows) + n, user, kind, float(n), json.dumps({"k": k})) for n, (kind, k) in enumerate(line)]
    folder = str(tmp_path_factory.mktemp("habits"))
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    df.selectExpr("*", "timestamp_seconds(event_id) AS ts").write.parquet(f"{folder}/events.parquet")
    lists: dict[str, list] = {}
    for r in queries()["collapse"](spark, folder).orderBy("stream", "pos").collect():
        lists.setdefault(r["stream"], []).append(r["tok"])
    return folder, lists


def rows_of(spark, folder, name):
    return queries()[name](spark, folder).collect()


def grams(lists, shortest, longest):
    return Counter(tuple(t[k : k + n]) for t in lists.values() for n in range(shortest, longest + 1) for k in range(len(t) - n + 1))


def test_grams(spark, habits):
    folder, lists = habits
    want = grams(lists, 2, 5)
    assert {tuple(r["gram"].split(" > ")): r["n"] for r in rows_of(spark, folder, "ngram_counts_full")} == want
    assert {tuple(r["gram"].split(" > ")): r["n"] for r in rows_of(spark, folder, "gram_model_full")} == grams(lists, 1, 4)
    streams = {g: sum(any(tuple(t[k : k + len(g)]) == g for k in range(len(t))) for t in lists.values()) for g in want}
    kept = {g: n for g, n in want.items() if n >= 5 and streams[g] >= 3}
    closed = {g for g, n in kept.items() if len(set(g)) > 1 and not any(10 * m >= 8 * n for h, m in kept.items() if len(h) == len(g) + 1 and g in (h[1:], h[:-1]))}
    assert {tuple(r["gram"].split(" > ")) for r in rows_of(spark, folder, "ngrams_closed_full")} == closed and max(map(len, closed)) == 5


def test_surprise(spark, habits):
    folder, lists = habits
    n, total = grams(lists, 1, 4), sum(map(len, lists.values()))
    bits = {}
    for stream, t in lists.items():
        if len(t) >= 20:
            each = [-math.log2(n[tuple(t[max(0, k - 3) : k + 1])] / (n[tuple(t[max(0, k - 3) : k])] if k else total)) for k in range(len(t))]
            bits[stream] = round(sum(each) / len(each), 5)
    assert {r["stream"]: round(r["bits"], 5) for r in rows_of(spark, folder, "surprise_scores_full")} == pytest.approx(bits, abs=2e-5) and bits
    assert {r["stream"] for r in rows_of(spark, folder, "surprise_extremes_full")} == set(bits)


def test_sequences_cards_and_findings(spark, habits):
    folder, lists = habits
    levels = brute(list(lists.values()), 2, 3, 5)
    assert {tuple(r["pattern"].split(" > ")): r["support"] for r in rows_of(spark, folder, "seqs_support")} == levels
    best = Counter()
    for p, n in levels.items():
        best[p[:-1]] = max(best[p[:-1]], n)
    closed = {p: n for p, n in levels.items() if len(p) > 1 and len(set(p)) > 1 and 10 * best[p] < 8 * n}
    assert {tuple(r["pattern"].split(" > ")): r["support"] for r in rows_of(spark, folder, "seqs_closed")} == closed
    inside = lambda p, q: (lambda it: all(t in it for t in p))(iter(q))
    kept, folded = [], Counter()
    for p in sorted(closed, key=lambda p: (-len(p), -closed[p], p)):
        holder = next((q for q in kept if len(q) > len(p) and closed[q] >= 0.8 * closed[p] and inside(p, q)), None)
        if holder is None:
            kept.append(p)
        else:
            folded[holder] += 1
    assert {tuple(r["pattern"].split(" > ")): r["folded"] for r in rows_of(spark, folder, "fold")} == {p: folded[p] for p in kept}
    cards = {tuple(r["pattern"].split(" > ")): r for r in rows_of(spark, folder, "rank_cards")}
    assert set(cards) <= set(kept) and max(map(len, cards)) == 5 and all(r["support"] == closed[p] for p, r in cards.items())
    families = {r["bucket"]: (r["families"], r["variants"], r["folded"]) for r in rows_of(spark, folder, "family_merge")}
    assert families == {b: (sum(r["bucket"] == b for r in cards.values()), sum(r["variants"] for r in cards.values() if r["bucket"] == b), sum(r["folded"] for r in cards.values() if r["bucket"] == b)) for b in {r["bucket"] for r in cards.values()}}
    assert {tuple(r["pattern"].split(" > ")) for r in rows_of(spark, folder, "rank_topk")} <= set(cards)
    found = {tuple(r["pattern"].split(" > ")): r["n"] for r in rows_of(spark, folder, "report")}
    assert found == {p: n for p in cards if (n := walked(lists, p)[0])} and max(map(len, found)) == 5


def test_all_mined_patterns_are_measured(spark, habits):
    folder, lists = habits
    got = {tuple(r["pattern"].split(" > ")): (r["n"], r["streams"]) for r in rows_of(spark, folder, "findings_measure_full")}
    want = {p: x for p in brute(list(lists.values()), 2, 3, 5) if (x := walked(lists, p))[0]}
    assert got == want and {len(p) for p in got} == {1, 2, 3, 4, 5}


def walked(lists, motif, gap=3):
    """(occurrences, streams) of a motif, taken from left to right."""
    n = inside = 0
    for tokens in lists.values():
        k = hits = 0
        while k < len(tokens):
            at = k if tokens[k] == motif[0] else None
            for t in motif[1:]:
                at = next((x for x in range(at + 1, min(at + gap + 1, len(tokens))) if tokens[x] == t), None) if at is not None else None
            hits, k = (hits, k + 1) if at is None else (hits + 1, at + 1)
        n, inside = n + hits, inside + (hits > 0)
    return n, inside


def test_all_tokens_of_the_largest_session(spark, tmp_path):
    rows = [(n, 0 if n < 500 else 1, "click", 1.0, json.dumps({"k": 3 + n % 2})) for n in range(520)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    df.selectExpr("*", "timestamp_seconds(event_id) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = [(r["stream"], r["pos"], r["seq"]) for r in rows_of(spark, str(tmp_path), "tokens_session_full")]
    assert got == [("p0/user-0@", n, n) for n in range(500)]
