"""Problems 8, 9 and 10."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from trailmine.llm.fmindex import FMIndex, suffix_array
from trailmine.llm.leaks import LONG, PHRASE, RUN, Items, leaked, matched, removal_spans, search_shard, words_of
from trailmine.llm.mixing import TOKENIZER, mix_sources
from trailmine.llm.residue import clean, judge, residue

# ---- 8 ---------------------------------------------------------------------------------


def test_fm_index_against_scanning():
    rng = np.random.default_rng(1)
    for _ in range(80):
        text = rng.integers(0, rng.integers(2, 7), rng.integers(1, 60))
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda k: text[k:].tolist())
        index = FMIndex(text, int(rng.integers(1, 6)))
        phrases = rng.integers(1, 8, (6, 3))
        for p, low, high in zip(phrases, *index.search(phrases)):
            assert sorted(index.locate(np.arange(low, high)).tolist()) == [k for k in range(len(text) - 2) if (text[k : k + 3] == p).all()]


def test_words():
    assert words_of("<p>A <b>b</b>&#59; c&nbsp;d</p> e-f_g Ünï​x ＜") == ["a", "b", "c", "d", "e", "f", "g", "ünïx"]
    assert words_of(None) == words_of("") == words_of("<p></p> …") == []


OWN = [f"{a}{n}" for n in range(7) for a in ("alpha", "beta", "gamma")]
SHARED = "answer the following question in one short sentence please and stop".split()
ITEMS = {k: SHARED + [f"{w}x{k}" for w in OWN] for k in range(8)}


def items():
    counts = {n: Counter(g for w in ITEMS.values() for g in set(Items.grams(w, n))) for n in (RUN, PHRASE, LONG)}
    return Items.of(ITEMS, counts)


def test_matching_counts_own_words_in_order():
    i = items()
    own = ITEMS[3][len(SHARED) :]
    n = lambda doc: matched(doc, i.words[3], i.own[3])[0]
    assert n(["z", *own[:12], "z"]) == 12 and n(own) == 21 and n([]) == 0
    assert n(own[:6] + ["changed"] + own[7:13]) == 12
    assert n(own[:6] + ["added"] + own[6:12]) == 12
    assert n(own[6:12] + own[:6]) == 6 and n(SHARED * 3) == 0 and n(own[::-1]) == 0 and n(own[:7]) == 7
    assert n(own[:6] + ["far"] * 500 + own[8:14]) == 12


def test_shards_find_what_scanning_finds():
    rng = random.Random(7)
    i, docs = items(), []
    for _ in range(60):
        own = ITEMS[rng.randrange(8)]
        a = rng.randrange(len(own) - 8)
        docs.append([rng.choice("abc") for _ in range(rng.randrange(30))] + own[a : a + rng.randrange(5, 25)] + [rng.choice("abc") for _ in range(5)])
    got = {(d, k): n for d, k, n, _ in search_shard(docs, i)}
    want = {(d, k): n for d, doc in enumerate(docs) for k in ITEMS if (n := matched(doc, i.words[k], i.own[k])[0]) >= 12}
    assert got == want and got


def test_leaks_of_tables(spark):
    item_rows = [(k, "form", " ".join(w), "clash") for k, w in ITEMS.items()] + [(90, "x", None, ""), (91, "x", "", ""), (92, "x", "too short", ""), (None, "x", "y", "")]
    own = " ".join(ITEMS[2][len(SHARED) :])
    docs = [(1, f"Before. <b>{own.upper()}</b> after", "a"), (2, " ".join(SHARED), "a"), (3, None, "a"), (4, "", "a"), (5, own, "a"), (5, own, "a"), (6, "word " * 50_000 + own, "a")]
    docs_df, item_df = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(item_rows, "item_id long, form string, text string, doc_id string")
    for more in ({}, {"shard_words": 30, "block_items": 5}):
        got = leaked(docs_df, item_df, **more)
        assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, 2), (5, 2), (5, 2), (6, 2)]
    spans = {r["doc_id"]: (r["from"], r["to"], r["items"]) for r in removal_spans(got).collect()}
    assert spans[1] == (1, 22, [2]) and spans[6] == (50_000, 50_021, [2])
    assert leaked(docs_df.limit(0), item_df).collect() == [] and leaked(docs_df, item_df.limit(0)).collect() == []


# ---- 9 ---------------------------------------------------------------------------------

DOCS = "doc_id long, text string, source string, tokens string, key string, range string"
TARGETS = "source string, weight double, max_repeat int, docs string"


def mix(spark, docs, targets, **more):
    if not os.path.exists(TOKENIZER):
        pytest.skip("no tokenizer files here")
    return mix_sources(spark.createDataFrame([(*d, "x", "y", "z") for d in docs], DOCS) if docs else spark.createDataFrame([], DOCS), spark.createDataFrame([(*t, "x") for t in targets], TARGETS), **more)


def test_shares_and_repeats(spark):
    rng = random.Random(9)
    docs = [(k, " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(rng.randrange(5, 60))), rng.choice(["A b", "a-B ", "a_b"])) for k in range(300)]
    docs += [(1000 + k, "small source here " * 5, "c") for k in range(20)] + [(2000, "none", None), (2001, "untargeted", "d"), (2002, None, "c"), (2003, "", "c")]
    targets = [("a_b", 0.5, 2), ("C", 0.3, 3), ("empty", 0.2, 5), (None, 0.1, 1), ("d", None, None)]
    found = mix(spark, docs, targets)
    shares = {r["source"]: r for r in found.shares.collect()}
    assert shares["c"]["most_copies"] == 3 and shares["empty"]["used_tokens"] == 0 and shares["d"]["used_tokens"] == 0
    assert abs(shares["a_b"]["actual_share"] - 0.625) < 0.01 and abs(shares["c"]["actual_share"] - 0.375) < 0.01
    chosen = found.selection.collect()
    assert len({r["doc_id"] for r in chosen}) == len(chosen) and all(1 <= r["copies"] <= 3 for r in chosen)
    again = mix(spark, docs[::-1], targets, ranges=7)
    assert sorted(map(tuple, again.selection.collect())) == sorted(map(tuple, chosen))
    big = {r["source"]: r for r in mix(spark, docs, targets, total_tokens=10**9).shares.collect()}
    assert big["a_b"]["used_tokens"] == 2 * big["a_b"]["tokens"] and big["a_b"]["most_copies"] == 2


def test_mix_of_nothing(spark):
    found = mix(spark, [], [("a", 1.0, 1)])
    assert found.selection.collect() == [] and [r["used_tokens"] for r in found.shares.collect()] == [0]


# ---- 10 --------------------------------------------------------------------------------

REAL = "The parser was slow because it read every file twice. We changed that on Monday."


@pytest.mark.parametrize(
    "text",
    [
        f"Dear {{{{ first_name | default }}}}, {REAL}", f"{REAL} It was moved by [INSERT NAME] at noon.", f"{REAL} Owner: ${{OWNER}}.", f"{REAL} Send it to <your name here> soon.", f"{REAL} (TBD: due date)", f"{REAL} Ask __TEAM__ about it.",
        f"{REAL} Due %DUE_DATE% at last.", f"{REAL} See @@TICKET@@.", f"{REAL} <%= team %> did it.", f"{REAL} Tracking: XXXX.", "Lorem ipsum dolam sit.", f"{REAL.split('. ')[0]}.\n\nasdf asdf asdf asdf asdf asdf asdf asdf asdf asdf asdf asdf",
        "404 Not Found", "Please enable JavaScript and cookies to continue.", "<html><body><h1>Page not found</h1><p>The link may be old.</p></body></html>", "One real sentence stands here.\n\n502 Bad gateway\nPlease come back later.", "Seite nicht gefunden", "Sample text goes here.",
    ],
)
def test_residue(text):
    assert judge(text)


@pytest.mark.parametrize(
    "text",
    [
        REAL, "", "   ", None, f"{REAL} The template holds `{{{{ title }}}}` and fills it.", f"{REAL}\n```\nexport A=${{HOME}}\n```\n{REAL}", f"{REAL} The gateway showed error 502 for an hour.", f'{REAL} It said "Page not found" and we fixed it.',
        f"{REAL} We removed the lorem ipsum from the handbook.", f"{REAL}\n> Page not found\n> The link may be old.\n\n{REAL}", f"{REAL} A search for TODO found 44 hits.", f"{REAL} Use the format string `%s`.", "[12:01] " + REAL, REAL * 20_000,
    ],
)
def test_real_text(text):
    assert judge(text) is None


def test_residue_of_tables(spark):
    docs = spark.createDataFrame([(1, "404 Not Found", "x"), (2, REAL, "x"), (3, None, None), (1, "404 Not Found", "x")], "doc_id long, text string, residue string")
    assert sorted(map(tuple, residue(docs).collect())) == [(1, "notice"), (1, "notice")]
    assert sorted(r["doc_id"] for r in clean(docs).collect()) == [2, 3] and clean(docs).columns == docs.columns
    assert residue(docs.limit(0)).collect() == []


LATIN = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Ut enim ad minim veniam, quis nostrud exercitation. Duis aute irure dolor in reprehenderit.\nExcepteur sint occaecat cupidatat non proident."


def test_filler_of_several_sentences():
    assert judge(f"One real sentence stands here. {LATIN}") == judge(f"One real sentence stands here.\n\n{LATIN}\n\nSed do eiusmod tempor. Nulla facilisi.") == "filler"
    assert judge(f"{REAL} {REAL} {LATIN}") is None
    assert judge("We looked at the page. Lorem ipsum was still on it. We took it out and told the team. It is in order now.") is None


@pytest.mark.parametrize("text", [
    "Sorry, this content is not available right now. Please try again in a few minutes.", "Error 418\n\nThe server refused this request.", "Your account does not have permission to view this document. Contact your administrator.",
    "The connection timed out while loading this page.", "<h1>503</h1><p>The service is temporarily overloaded. Retry later.</p>", "You need to enable JavaScript to use this application.", "Please verify that you are human before continuing.",
    "Die Seite ist nicht verfügbar. Bitte versuchen Sie es später erneut.", "Página no disponible. Intente más tarde.", "Erreur 404. Cette page est introuvable.", "页面找不到，请稍后重试。", "One real sentence about parsers and their tables.\n\nAccess denied. Please log in again.",
])
def test_notices_in_other_words(text):
    """Wordings made up for this test: what counts are a page's words, not its phrases."""
    assert judge(text) == "notice"


@pytest.mark.parametrize("text", [
    "The login page failed twice during the rollout, so we reverted the cookie change.", "Retry storms exhausted our quota on Tuesday; the dashboard shows which tenants were affected.", "We moved the error page templates into their own module and added snapshot tests.",
    "Our browser matrix covers Firefox, Safari and Chrome; scripts run nightly.", "The cache is cold. It fills within an hour. Nobody has complained so far about slow starts.", "服务器在周二重启了三次，原因是内存泄漏，我们已经在新版本里修复。",
])
def test_texts_about_errors_are_real(text):
    assert judge(text) is None
