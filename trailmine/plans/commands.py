"""The commands: each a plan over the event table, with its defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings as _findings
from ..operators import follows, ngrams, rank, seqs, streams, summary, surprise
from .render import parse_range

#: Rows shown where no limit is given, fixed values. A limit of 0 stands for these.
LIMITS = {"summary": 20, "ngrams": 30, "seqs": 30, "report": 30, "surprise": 20, "graph": 40, "tokens": 200}


@dataclass(frozen=True)
class View:
    """How events become tokens."""

    lens: str = "tool"
    mark_fail: bool = True
    collapse: bool = True
    no_sidechain: bool = False

    def of(self, events: DataFrame) -> DataFrame:
        return streams.tokens(events, self.lens, self.mark_fail, self.collapse, self.no_sidechain)


def summary_plan(events: DataFrame, by: str = "corpus") -> tuple[DataFrame, DataFrame]:
    """(buckets, top actions); the actions are those of the corpus at any grain."""
    return summary.summarize(events, by), summary.top_actions(events)


def ngrams_plan(events: DataFrame, view: View = View(), n: str = "2-5", min_count: int = 5, min_streams: int = 3) -> DataFrame:
    low, high = parse_range(n)
    return ngrams.frequent_grams(ngrams.count_grams(view.of(events), low, high), min_count, min_streams)


def seqs_plan(events: DataFrame, view: View = View(), min_support: int = 20, max_gap: int = 3, max_len: int = 5) -> seqs.Mined:
    return seqs.mine(view.of(events), min_support, max_gap, max_len)


def rank_plan(events: DataFrame, view: View = View(), min_support: int = 20, max_gap: int = 3, max_len: int = 5, options: rank.RankOptions = rank.RankOptions(), top: int = 10) -> tuple[DataFrame, rank.Ranked, bool]:
    """(first `top` cards of each bucket, all ranked, was mining cut short?)."""
    tokens = view.of(events)
    mined = seqs.mine(tokens, min_support, max_gap, max_len)
    ranked = rank.rank_patterns(tokens, mined.patterns, options)
    return rank.top_per_bucket(ranked.cards, top), ranked, mined.truncated


def report_plan(events: DataFrame, view: View = View(), kind: str = "", min_support: int = 20, max_gap: int = 3, max_len: int = 5, options: rank.RankOptions = rank.RankOptions(), top: int = 10) -> DataFrame:
    """Findings of the first `top` cards of each bucket: capped before they are
    ordered by cost."""
    cards, _, _ = rank_plan(events, view, min_support, max_gap, max_len, options, top)
    return _findings.of_kind(_findings.findings(view.of(events), cards.drop("place", "left_out"), max_gap), kind)


def surprise_plan(events: DataFrame, view: View = View(), order: int = 3, min_tokens: int = 20) -> DataFrame:
    return surprise.surprise(view.of(events), order, min_tokens)


def graph_plan(events: DataFrame, view: View = View(), min_count: int = 20) -> tuple[DataFrame, DataFrame]:
    """(edges from min_count on, all bounces)."""
    tokens = view.of(events)
    return follows.edges(tokens).where(F.col("n") >= min_count), follows.bounces(tokens)


def tokens_plan(events: DataFrame, session: str, view: View = View(), limit: int = 0) -> DataFrame:
    return streams.session_tokens(view.of(events), session, limit or LIMITS["tokens"])
