"""Results as text or JSON within budgets."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame


class Sink:
    """Lines within a number of rows and bytes; the last line tells how many
    rows were left out."""

    def __init__(self, write: Callable[[str], None], limit: int = 0, max_bytes: int = 0):
        self.write, self.limit, self.max_bytes = write, limit, max_bytes
        self.rows = self.size = self.left_out = 0

    def head(self, line: str) -> None:
        self._put(line)

    def row(self, line: str) -> bool:
        """False if the row didn't fit; it is counted."""
        if self.left_out or (self.limit and self.rows >= self.limit) or (self.max_bytes and self.size + len(line.encode()) + 1 > self.max_bytes):
            self.left_out += 1
            return False
        self.rows += 1
        self._put(line)
        return True

    def _put(self, line: str) -> None:
        self.size += len(line.encode()) + 1
        self.write(line + "\n")

    def close(self, total: int | None = None) -> None:
        more = self.left_out if total is None else total - self.rows
        if more > 0:
            self.write(f"... +{more} more\n")


def check_format(given: str, allowed: Iterable[str] = ("text", "json"), max_bytes: int = 0) -> None:
    if given not in allowed:
        raise ValueError(f"unknown format {given!r}; there are {', '.join(allowed)}")
    if max_bytes and given == "json":
        raise ValueError("max-bytes goes with text only: a cut JSON document is none")


def page(df: DataFrame, limit: int) -> tuple[list[dict], int, bool]:
    """(rows up to the limit in the order of df, number of all rows, were there more?)."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit).collect()]
    total = len(rows) if len(rows) < limit else df.count()
    return rows, total, total > len(rows)


def document(rows: list[dict], total: int, truncated: bool, **more) -> str:
    return json.dumps({**more, "total": total, "truncated": truncated, "rows": rows}, indent=2, default=str)


def exemplar(stream: str, seq: int) -> str:
    """The begin of the session and the line: abcdefgh@12. A short session is
    kept whole with its @."""
    session = stream.rpartition("/")[2]
    short = session[:8] if "@" not in session[:8] else session[: session.index("@")]
    return f"{short}@{seq}"


_ESCAPES = {'"': "#quot;", "[": "#91;", "]": "#93;", "{": "#123;", "}": "#125;"}


def mermaid_label(text: str) -> str:
    return "".join(_ESCAPES.get(c, c) for c in text)


def graph(edges: list[dict], form: str = "mermaid") -> str:
    """A graph of edges (src, dst, n) for mermaid or dot."""
    names = {x: f"n{k}" for k, x in enumerate(dict.fromkeys(v for e in edges for v in (e["src"], e["dst"])))}
    if form == "dot":
        quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return "\n".join(["digraph follows {", *[f"  {quote(e['src'])} -> {quote(e['dst'])} [label={e['n']}];" for e in edges], "}"]) + "\n"
    nodes = [f'  {n}["{mermaid_label(x)}"]' for x, n in names.items()]
    return "\n".join(["graph LR", *nodes, *[f"  {names[e['src']]} -->|{e['n']}| {names[e['dst']]}" for e in edges]]) + "\n"


def parse_range(text: str) -> tuple[int, int]:
    """N or A-B with A at least 2 and B at least A."""
    low, dash, high = text.partition("-")
    try:
        a, b = int(low), int(high) if dash else int(low)
    except ValueError:
        raise ValueError(f"no range: {text!r}") from None
    if a < 2 or b < a:
        raise ValueError(f"no range: {text!r}")
    return a, b
