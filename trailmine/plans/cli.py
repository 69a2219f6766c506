"""python -m trailmine.plans.cli COMMAND ...: the commands at a terminal."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from ..operators.rank import RankOptions
from ..operators.surprise import extremes
from ..session import Scratch, local_session
from ..sources import artifact
from . import commands as c
from .render import Sink, check_format, document, exemplar, graph, page

#: Rows that any output can have.
EVERY = (1 << 31) - 2
LEGEND = "! failed  ? in a failed compound  + run of equal tokens  seqs may have gaps"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trailmine")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, lens: bool = True, **options) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--data", default="trailmine-data")
        p.add_argument("--root", default="transcripts")
        p.add_argument("--format", default="text")
        p.add_argument("--limit", type=int, default=0)
        p.add_argument("--max-bytes", type=int, default=0)
        if lens:
            p.add_argument("--lens", default="tool")
            p.add_argument("--no-mark-fail", action="store_true")
            p.add_argument("--no-collapse", action="store_true")
            p.add_argument("--no-sidechain", action="store_true")
        for key, value in options.items():
            p.add_argument("--" + key.replace("_", "-"), type=type(value), default=value)
        return p

    ingest = add("ingest", False, project="")
    ingest.add_argument("--dry-run", action="store_true")
    add("summary", False, by="corpus")
    add("ngrams", n="2-5", min_count=5, min_sessions=3)
    mining = {"min_support": 20, "max_gap": 3, "max_len": 5}
    add("seqs", **mining)
    ranking = {"order": 3, "script_bits": 1.0, "noise_bits": 3.0, "delta": 0.8, "top": 10}
    add("rank", **mining, **ranking)
    add("report", **mining, **ranking, kind="")
    add("surprise", order=3, min_toks=20)
    add("graph", min_count=20).add_argument("--loops", action="store_true")
    add("tokens", session="")
    return top


def run(args: list[str], write=sys.stdout.write) -> int:
    a = parser().parse_args(args)
    check_format(a.format, ("text", "json", "mermaid", "dot") if a.command == "graph" else ("text", "json"), a.max_bytes)
    spark = local_session()
    if a.command == "ingest":
        health = artifact.build(spark, a.root, a.data, a.project, a.dry_run)
        for key, value in health.items():
            write(f"{key}: {value}\n")
        return 0
    artifact.ensure(spark, a.data, a.root)
    events = artifact.load(spark, a.data)
    view = c.View(a.lens, not a.no_mark_fail, not a.no_collapse, a.no_sidechain) if hasattr(a, "lens") else c.View()
    # rank shows its first cards of each bucket, without a limit on the rows.
    limit = a.limit or c.LIMITS.get(a.command, EVERY if a.command == "rank" else 1_000)
    more: dict = {}
    options = RankOptions(a.order, a.script_bits, a.noise_bits, a.delta) if a.command in ("rank", "report") else None
    if a.command == "summary":
        df, actions = c.summary_plan(events, a.by)
        more = {"actions": [r.asDict() for r in actions.collect()]} if a.format == "json" else {}
    elif a.command == "ngrams":
        df = c.ngrams_plan(events, view, a.n, a.min_count, a.min_sessions)
    elif a.command == "seqs":
        mined = c.seqs_plan(events, view, a.min_support, a.max_gap, a.max_len)
        df, more = mined.patterns, {"mining_truncated": mined.truncated}
    elif a.command == "rank":
        df, ranked, cut = c.rank_plan(events, view, a.min_support, a.max_gap, a.max_len, options, a.top)
        more = {"noise": ranked.noise, "mining_truncated": cut}
    elif a.command == "report":
        df = c.report_plan(events, view, a.kind, a.min_support, a.max_gap, a.max_len, options, a.top)
    elif a.command == "surprise":
        scored = Scratch(spark, "surprise").save(c.surprise_plan(events, view, a.order, a.min_toks), "scored")
        # Half of the rows are the most predictable streams, half the most surprising ones.
        low, high = extremes(scored, limit)
        df = low.unionByName(high).distinct().orderBy("bits", "stream")
        mean = scored.agg(F.avg("bits").alias("mean"), F.count(F.lit(1)).alias("n")).first()
        more = {"mean_bits": mean["mean"], "streams": mean["n"]}
    elif a.command == "graph":
        df, loops = c.graph_plan(events, view, a.min_count)
        if a.loops:
            df = loops
    else:
        df = c.tokens_plan(events, a.session, view, limit)
    rows, total, truncated = page(df, limit)
    if a.format == "json":
        write(document(rows, total, truncated, **more) + "\n")
    elif a.format in ("mermaid", "dot"):
        write(graph(rows, a.format))
    else:
        sink = Sink(write, limit, a.max_bytes)
        sink.head(LEGEND)
        for key, value in more.items() if a.command == "surprise" else ():
            sink.head(f"{key}: {_cell(key, value)}")
        for r in rows:
            sink.row("  ".join(_cell(k, v) for k, v in r.items()))
        sink.close(total)
    return 0


def _cell(name: str, value) -> str:
    if name == "exemplar":
        return exemplar(value["stream"], value["seq"])
    if isinstance(value, list):
        return " > ".join(map(str, value))
    return f"{value:.3f}" if isinstance(value, float) else str(value)


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
