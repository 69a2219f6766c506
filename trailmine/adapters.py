"""Tables of other shapes as canonical events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import conform

#: Actions by event type and the number k in props, fixed values.
ACTIONS = {
    "click": ("shell", ["go_test", "git_add", "rg", "cat", "make", "kubectl_get"]),
    "view": ("tool", ["Read", "Grep", "mcp__tracker__find", "WebFetch"]),
    "purchase": ("tool", ["Edit", "Write"]),
    "error": ("tool", ["Task", "TodoWrite", "mcp__solo"]),
}
SUFFIXES = [".py", ".go", "", ".toolongsuffix"]


def from_stream_table(events: DataFrame) -> DataFrame:
    """The events table: a user is a session, event_id the line."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    kind, act = F.lit("prompt"), F.lit("prompt")
    for name, (what, acts) in ACTIONS.items():
        is_it = F.col("event_type") == name
        kind = F.when(is_it, what).otherwise(kind)
        act = F.when(is_it, F.element_at(F.array(*map(F.lit, acts)), F.col("k_") % len(acts) + 1)).otherwise(act)
    target = F.concat(F.lit("src/f"), F.col("k_") % 17, F.element_at(F.array(*map(F.lit, SUFFIXES)), F.col("k_") % 4 + 1))
    status = F.when(F.col("k_") % 7 == 0, "fail").when(F.col("k_") % 7 == 1, "cfail").when(F.col("k_") % 7 == 2, "none").otherwise("ok")
    rows = events.withColumn("k_", k).withColumn("k", kind)
    rows = rows.select(
        F.lit(0).alias("f"), F.col("event_id").alias("i"), F.lit(0).alias("seg"), F.col("ts").alias("t"),
        F.concat(F.lit("p"), F.col("user_id") % 3).alias("p"), F.concat(F.lit("user-"), F.col("user_id")).alias("s"), F.lit("").alias("a"),
        (F.col("event_id") % 11 == 0).alias("sc"), "k", act.alias("act"),
        F.when(F.col("k") == "tool", target).otherwise("").alias("tgt"), F.when(F.col("k") == "shell", F.concat(F.lit("run "), F.col("k_") % 9)).otherwise("").alias("d"),
        F.when(F.col("k") == "prompt", "").otherwise(status).alias("st"), (F.col("k_") * 10).alias("ms"), F.lit(False).alias("rt"), (F.col("k_") % 5 == 0).alias("cp"),
        F.floor(F.coalesce("value", F.lit(0.0)) * 100).alias("b"),
    )
    return conform(rows)


#: The same as SQL over the table events.
EVENTS_SQL = """ev AS (
  SELECT 0 AS f, event_id AS i, 0 AS seg, ts AS t, 'p' || (user_id % 3) AS p, 'user-' || user_id AS s, '' AS a, event_id % 11 = 0 AS sc, kind AS k,
    CASE event_type WHEN 'click' THEN ['go_test','git_add','rg','cat','make','kubectl_get'][n % 6 + 1] WHEN 'view' THEN ['Read','Grep','mcp__tracker__find','WebFetch'][n % 4 + 1]
      WHEN 'purchase' THEN ['Edit','Write'][n % 2 + 1] WHEN 'error' THEN ['Task','TodoWrite','mcp__solo'][n % 3 + 1] ELSE 'prompt' END AS act,
    CASE WHEN kind = 'tool' THEN 'src/f' || (n % 17) || ['.py','.go','','.toolongsuffix'][n % 4 + 1] ELSE '' END AS tgt,
    CASE WHEN kind = 'shell' THEN 'run ' || (n % 9) ELSE '' END AS d,
    CASE WHEN kind = 'prompt' THEN '' WHEN n % 7 = 0 THEN 'fail' WHEN n % 7 = 1 THEN 'cfail' WHEN n % 7 = 2 THEN 'none' ELSE 'ok' END AS st,
    false AS rt, n % 5 = 0 AS cp, CAST(floor(coalesce(value, 0.0) * 100) AS BIGINT) AS b
  FROM (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS n,
      CASE event_type WHEN 'click' THEN 'shell' WHEN 'view' THEN 'tool' WHEN 'purchase' THEN 'tool' WHEN 'error' THEN 'tool' ELSE 'prompt' END AS kind FROM events))"""


def from_session_table(events: DataFrame) -> DataFrame:
    """The session_event table, which is canonical but for the file."""
    return conform(events.where("act is not null"))
