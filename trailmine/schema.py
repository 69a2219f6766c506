"""The canonical event and its order.

An event table has the columns of EVENT. A stream is (p, s, a) in the order
(f, i, seg): file, line in the file, place in the line. t is advisory and
orders nothing. Absent strings are '' and absent flags false, so that nulls
never reach the miners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = (
    "f long, i long, seg int, t timestamp, p string, s string, a string, sc boolean, k string, act string, tgt string, d string, st string, "
    "ms long, rt boolean, cp boolean, b long, skill string, plug string, mcp string, v string"
)
#: Kinds and statuses, fixed values.
TOOL, SHELL, PROMPT = "tool", "shell", "prompt"
OK, FAIL, COMPOUND_FAIL, NONE = "ok", "fail", "cfail", "none"
STREAM = ("p", "s", "a")
ORDER = ("f", "i", "seg")


def conform(events: DataFrame) -> DataFrame:
    """Any table with some of the event columns as an event table; other
    columns are dropped, missing ones filled with what stands for absent."""
    fills = {"string": F.lit(""), "boolean": F.lit(False), "long": F.lit(0).cast("long"), "int": F.lit(0), "timestamp": F.lit(None).cast("timestamp")}
    out = []
    for column in EVENT.split(", "):
        name, kind = column.split()
        empty = F.lit(None).cast(kind) if name in ("t", "ms") else fills[kind]
        out.append((F.coalesce(F.col(name).cast(kind), empty) if name in events.columns else empty).alias(name))
    return events.select(*out)
