"""SQL that says the same as a query, for another engine."""

from __future__ import annotations

_B = r"' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(133) || chr(160) || chr(8195) || chr(12288) || chr(65279)"
_ACT = f"lower(trim(act, {_B}))"
#: Each event once: ev has p, s, a, i, seg, act, tgt, b.
_EVENTS = f"""raw AS (SELECT *, {_ACT} AS form, trim(tgt, {_B}) AS plain FROM session_event WHERE act IS NOT NULL),
  shaped AS (SELECT *, nullif(CASE WHEN regexp_matches(plain, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN plain ELSE regexp_replace(regexp_replace(replace(plain, '\\', '/'), '/{{2,}}', '/', 'g'), '^(\\./)+(.)', '\\2') END, '') AS target FROM raw),
  ev AS (SELECT p, s, a, i, seg, min(form) AS act, min(target) AS tgt, min(b) AS b FROM shaped WHERE form <> '' GROUP BY p, s, a, i, seg)"""

_STEPS = """e AS (SELECT dense_rank() OVER (ORDER BY p, s, a) AS st, act, row_number() OVER (PARTITION BY p, s, a ORDER BY i, seg) AS pos FROM ev),
  size AS (SELECT count(DISTINCT st) AS n FROM e), floor_ AS (SELECT greatest(5, CAST(ceil(n * 0.04) AS BIGINT)) AS m FROM size),
  common AS (SELECT act FROM e GROUP BY act HAVING count(DISTINCT st) >= (SELECT m FROM floor_)), f AS (SELECT e.* FROM e JOIN common USING (act)),
  s2 AS (SELECT DISTINCT x.st, x.act AS a1, y.act AS a2, y.pos FROM f x JOIN f y ON y.st = x.st AND y.pos BETWEEN x.pos + 1 AND x.pos + 3 AND y.act <> x.act),
  k2 AS (SELECT a1, a2 FROM s2 GROUP BY ALL HAVING count(DISTINCT st) >= (SELECT m FROM floor_)), p2 AS (SELECT s2.* FROM s2 JOIN k2 USING (a1, a2)),
  s3 AS (SELECT DISTINCT x.st, a1, a2, y.act AS a3, y.pos FROM p2 x JOIN f y ON y.st = x.st AND y.pos BETWEEN x.pos + 1 AND x.pos + 3 AND y.act NOT IN (a1, a2)),
  k3 AS (SELECT a1, a2, a3, count(DISTINCT st) AS n FROM s3 GROUP BY ALL HAVING count(DISTINCT st) >= (SELECT m FROM floor_)), p3 AS (SELECT s3.* FROM s3 JOIN k3 USING (a1, a2, a3)),
  s4 AS (SELECT DISTINCT x.st, a1, a2, a3, y.act AS a4, y.pos FROM p3 x JOIN f y ON y.st = x.st AND y.pos BETWEEN x.pos + 1 AND x.pos + 3 AND y.act NOT IN (a1, a2, a3)),
  k4 AS (SELECT a1, a2, a3, a4, count(DISTINCT st) AS n FROM s4 GROUP BY ALL HAVING count(DISTINCT st) >= (SELECT m FROM floor_)), p4 AS (SELECT s4.* FROM s4 JOIN k4 USING (a1, a2, a3, a4)),
  k5 AS (SELECT a1, a2, a3, a4, y.act AS a5, count(DISTINCT x.st) AS n FROM p4 x JOIN f y ON y.st = x.st AND y.pos BETWEEN x.pos + 1 AND x.pos + 3 AND y.act NOT IN (a1, a2, a3, a4) GROUP BY ALL HAVING count(DISTINCT x.st) >= (SELECT m FROM floor_)),
  found AS (SELECT a1 || ' > ' || a2 || ' > ' || a3 AS pattern, n AS streams FROM k3 UNION ALL SELECT a1 || ' > ' || a2 || ' > ' || a3 || ' > ' || a4, n FROM k4 UNION ALL SELECT a1 || ' > ' || a2 || ' > ' || a3 || ' > ' || a4 || ' > ' || a5, n FROM k5)"""

_RUNS = """turns AS (SELECT *, CASE WHEN lag(act) OVER w = act AND i - lag(i) OVER w <= 10 AND 10 * abs(b - lag(b) OVER w) <= greatest(b, lag(b) OVER w) THEN 0 ELSE 1 END AS turn FROM ev WINDOW w AS (PARTITION BY p, s, a ORDER BY i, seg)),
  numbered AS (SELECT *, sum(turn) OVER (PARTITION BY p, s, a ORDER BY i, seg) AS run FROM turns),
  runs AS (SELECT p, s, a, min(act) AS act, arg_min(i, (i, seg)) AS first_i, arg_min(seg, (i, seg)) AS first_seg, arg_max(i, (i, seg)) AS last_i, arg_max(seg, (i, seg)) AS last_seg, count(*) AS events FROM numbered GROUP BY p, s, a, run)"""

_TOP = """counts AS (SELECT 'act' AS field, act AS item, count(*) AS n FROM ev GROUP BY act UNION ALL SELECT 'tgt', tgt, count(*) FROM ev WHERE tgt IS NOT NULL GROUP BY tgt),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, item) AS r FROM counts),
  top AS (SELECT field, item, n FROM ranked WHERE r <= CASE field WHEN 'act' THEN 20 ELSE 40 END)"""

_KEY = f"regexp_replace(regexp_replace(regexp_replace(lower(trim(uuid, {_B})), '^(urn:)?(uuid:|guid:)', ''), '^[{{(\\[\"'']+|[}})\\]\"'']+$', '', 'g'), '^0x', '')"
_KEYED = f"""k AS (SELECT line_id, replace({_KEY}, '-', '') AS key FROM raw_line),
  ids AS (SELECT line_id, CASE WHEN regexp_matches(key, '^[0-9a-f]{{32}}$') AND key <> repeat('0', 32) THEN key END AS key FROM k),
  seen AS (SELECT line_id, key IS NOT NULL AND line_id > min(line_id) OVER (PARTITION BY key) AS seen FROM ids)"""

ORACLES = {
    "p1_found": f"WITH {_EVENTS}, {_STEPS} SELECT pattern FROM found",
    "p1_patterns": f"WITH {_EVENTS}, {_STEPS} SELECT pattern, streams FROM found",
    "p5_found": f"WITH {_KEYED} SELECT line_id FROM seen WHERE seen",
    "p5_seen": f"WITH {_KEYED} SELECT line_id, seen FROM seen",
    "p5_rate": f"WITH {_KEYED} SELECT count(*) AS lines, count(*) FILTER (WHERE seen) AS seen, CAST(0 AS BIGINT) AS wrong_seen, CAST(0 AS BIGINT) AS wrong_new, CAST(0 AS DOUBLE) AS wrong_rate FROM seen",
    "p6_found": f"WITH {_EVENTS}, {_RUNS} SELECT s, a, first_i, first_seg, last_i, last_seg FROM runs WHERE events > 1",
    "p6_runs": f"WITH {_EVENTS}, {_RUNS} SELECT * FROM runs",
    "p7_found": f"WITH {_EVENTS}, {_TOP} SELECT field, item FROM top",
    "p7_counts": f"WITH {_EVENTS}, {_TOP} SELECT * FROM top",
}
