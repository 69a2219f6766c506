"""Queries of the core operators and their SQL.

The SQL is written for another engine over the same tables; arrays are joined
with ' > ', floats rounded to six places on both sides.

Queries named *_full have the lengths that the commands have by default; those
of the same name without it keep to the shorter ones that their SQL spells out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import EVENTS_SQL, from_session_table, from_stream_table
from .functions.lens import lens
from .operators import findings, follows, ngrams, rank, seqs, streams, summary, surprise
from .session import table

Query = Callable[[SparkSession, str], DataFrame]

#: Thresholds of the queries: fixed shares of the streams, so that results exist at any scale.
SUPPORT_PERCENT = 40


def _events(spark: SparkSession, data: str) -> DataFrame:
    return from_stream_table(table(spark, data, "events"))


def _sessions(spark: SparkSession, data: str) -> DataFrame:
    return from_session_table(table(spark, data, "session_event"))


def _support(tokens: DataFrame) -> int:
    n = tokens.select("stream").distinct().count()
    return max(2, -(-n * SUPPORT_PERCENT // 100))


def joined(column: str) -> Column:
    return F.array_join(column, " > ").alias(column)


# ---- sources -------------------------------------------------------------------------


def p2_found(spark: SparkSession, data: str) -> DataFrame:
    from .operators.drift import schema_changes

    return schema_changes(table(spark, data, "log_line"), table(spark, data, "log_file"))


def p2_table(spark: SparkSession, data: str) -> DataFrame:
    from .operators.drift import consistent_table

    return consistent_table(table(spark, data, "log_line"), table(spark, data, "log_file"))


def ingest_events(spark: SparkSession, data: str) -> DataFrame:
    """raw_line as canonical events: decoding, dedup, pairing, retries."""
    from .sources.transcripts import from_table

    return from_table(table(spark, data, "raw_line"), table(spark, data, "source_file"))


def pairing(spark: SparkSession, data: str) -> DataFrame:
    """Statuses of the ingested calls."""
    return ingest_events(spark, data).where("k <> 'prompt'").groupBy("st").agg(F.count(F.lit(1)).alias("calls"), F.count("ms").alias("timed"))


def retry(spark: SparkSession, data: str) -> DataFrame:
    return ingest_events(spark, data).where("rt").select("f", "i", "seg", "act", "tgt", "st")


def dedup(spark: SparkSession, data: str) -> DataFrame:
    """The line that stands for each identifier, as written."""
    rows = table(spark, data, "raw_line").where("uuid is not null and uuid <> '' and type in ('user', 'assistant')")
    first = rows.groupBy("uuid").agg(F.min(F.struct("file_id", "line_no", "line_id")).alias("x"))
    return first.select("uuid", "x.file_id", "x.line_no", "x.line_id")


DEDUP_SQL = """SELECT uuid, file_id, line_no, line_id FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY file_id, line_no, line_id) AS r FROM raw_line
  WHERE uuid IS NOT NULL AND uuid <> '' AND type IN ('user', 'assistant')) WHERE r = 1"""

PAIRING_SQL = """WITH kept AS (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(uuid, ''), CAST(line_id AS VARCHAR)) ORDER BY file_id, line_no, line_id) AS r FROM raw_line WHERE type IN ('user', 'assistant')),
  lines AS (SELECT file_id AS f, line_no AS i, type, try_cast("timestamp" AS TIMESTAMPTZ) AS t, message.content AS c FROM kept WHERE r = 1 AND message.content LIKE '[%'),
  blocks AS (SELECT f, i, type, t, unnest(from_json(c, '["json"]')) AS b, generate_subscripts(from_json(c, '["json"]'), 1) AS n FROM lines),
  steps AS (SELECT f, i, n, t, json_extract_string(b, '$.type') = 'tool_use' AS call, coalesce(json_extract_string(b, '$.id'), json_extract_string(b, '$.tool_use_id'), '') AS id,
      coalesce(json_extract_string(b, '$.is_error'), 'false') = 'true' AS bad, json_extract_string(b, '$.name') AS name FROM blocks
    WHERE (type = 'assistant' AND json_extract_string(b, '$.type') = 'tool_use') OR (type = 'user' AND json_extract_string(b, '$.type') = 'tool_result')),
  paired AS (SELECT *, lead(call) OVER w AS next_call, lead(bad) OVER w AS next_bad, lead(t) OVER w AS next_t FROM steps WINDOW w AS (PARTITION BY f, id ORDER BY i, n))
  SELECT CASE WHEN id <> '' AND next_call = false THEN CASE WHEN next_bad THEN 'fail' ELSE 'ok' END ELSE 'none' END AS st, count(*) AS calls,
    count(*) FILTER (WHERE id <> '' AND next_call = false AND t IS NOT NULL AND next_t IS NOT NULL) AS timed FROM paired WHERE call AND name <> 'Bash' GROUP BY 1"""


def pairing_tools(spark: SparkSession, data: str) -> DataFrame:
    """Statuses of the ingested calls that are no shell commands."""
    return ingest_events(spark, data).where("k = 'tool'").groupBy("st").agg(F.count(F.lit(1)).alias("calls"), F.count("ms").alias("timed"))


# ---- lenses and streams ----------------------------------------------------------------

_MCP = "CASE WHEN instr(substr(act, 6), '__') > 0 THEN 'mcp:' || substr(act, 6, instr(substr(act, 6), '__') - 1) || '.' || substr(substr(act, 6), instr(substr(act, 6), '__') + 2) ELSE 'mcp:' || substr(act, 6) END"
_TOOL = f"CASE WHEN k = 'prompt' THEN 'prompt' WHEN k = 'shell' THEN 'sh:' || act WHEN act LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN {_MCP} ELSE act END"
_EXT = "regexp_extract(tgt, '(\\.[^./]*)$', 1)"
LENS_SQL = {
    "coarse": "CASE WHEN k = 'prompt' THEN 'prompt' WHEN k = 'tool' THEN CASE WHEN act LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN 'mcp' WHEN act = 'Read' THEN 'read' WHEN act = 'Grep' THEN 'search' WHEN act IN ('Edit', 'Write') THEN 'edit' "
    "WHEN act = 'Task' THEN 'agent' WHEN act = 'WebFetch' THEN 'fetch' WHEN act = 'TodoWrite' THEN 'plan' ELSE 'tool' END "
    "ELSE CASE act WHEN 'go_test' THEN 'test' WHEN 'git_add' THEN 'vcs' WHEN 'rg' THEN 'search' WHEN 'cat' THEN 'read' WHEN 'make' THEN 'build' ELSE 'sh' END END",
    "tool": _TOOL,
    "target": f"CASE WHEN k = 'tool' AND {_EXT} <> '' AND strlen({_EXT}) <= 8 THEN {_TOOL} || ':' || {_EXT} ELSE {_TOOL} END",
    "exact": f"CASE WHEN k IN ('tool', 'shell') AND tgt <> '' THEN {_TOOL} || ':' || tgt WHEN k = 'shell' AND d <> '' THEN {_TOOL} || ':' || d ELSE {_TOOL} END",
}


def _lens_query(name: str) -> Query:
    return lambda spark, data: _events(spark, data).groupBy(lens(name).alias("tok")).agg(F.count(F.lit(1)).alias("n"))


def _lens_sql(name: str) -> str:
    return f"WITH {EVENTS_SQL} SELECT {LENS_SQL[name]} AS tok, count(*) AS n FROM ev GROUP BY 1"


_MARKED = f"({_TOOL}) || CASE st WHEN 'fail' THEN '!' WHEN 'cfail' THEN '?' ELSE '' END"
#: Token streams as SQL: tk has stream, pos (from 0), tok, seq, bytes, after runs are collapsed.
TOKENS_SQL = f"""{EVENTS_SQL},
  raw AS (SELECT p || '/' || s || '@' || a AS stream, i AS seq, b AS bytes, {_MARKED} AS tok FROM ev),
  turns AS (SELECT *, CASE WHEN lag(tok) OVER w = tok THEN 0 ELSE 1 END AS turn FROM raw WINDOW w AS (PARTITION BY stream ORDER BY seq)),
  runs AS (SELECT *, sum(turn) OVER (PARTITION BY stream ORDER BY seq) AS run FROM turns),
  tk AS (SELECT stream, CAST(run - 1 AS BIGINT) AS pos, CASE WHEN count(*) > 1 THEN min(tok) || '+' ELSE min(tok) END AS tok, min(seq) AS seq, CAST(sum(bytes) AS BIGINT) AS bytes FROM runs GROUP BY stream, run)"""


def _tokens(spark: SparkSession, data: str, **more) -> DataFrame:
    return streams.tokens(_events(spark, data), **more)


def mark_fail(spark: SparkSession, data: str) -> DataFrame:
    return streams.visible(_events(spark, data)).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


def collapse(spark: SparkSession, data: str) -> DataFrame:
    return _tokens(spark, data).select("stream", "pos", "tok", "seq", "bytes")


def no_sidechain(spark: SparkSession, data: str) -> DataFrame:
    return _tokens(spark, data, collapse=False, mark_fail=False, no_sidechain=True).select("stream", "pos", "tok", "seq")


NO_SIDECHAIN_SQL = f"WITH {EVENTS_SQL} SELECT p || '/' || s || '@' || a AS stream, row_number() OVER (PARTITION BY p, s, a ORDER BY i) - 1 AS pos, {_TOOL} AS tok, i AS seq FROM ev WHERE NOT sc"


def tokens_session(spark: SparkSession, data: str) -> DataFrame:
    return streams.session_tokens(_tokens(spark, data), "user-7@", 200).select("stream", "pos", "tok", "seq", "bytes")


def tokens_session_full(spark: SparkSession, data: str) -> DataFrame:
    """All tokens of the session that has most; tokens_session has 200 of one session, as its SQL."""
    tokens = _tokens(spark, data).withColumn("session", F.regexp_replace("stream", "@[^@]*$", ""))
    largest = tokens.groupBy("session").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "session").limit(1)
    return tokens.join(largest.select("session"), "session", "left_semi").orderBy("stream", "pos").select("stream", "pos", "tok", "seq", "bytes")


def vocab(spark: SparkSession, data: str) -> DataFrame:
    return streams.vocabulary(_tokens(spark, data))


VOCAB_SQL = f"WITH {TOKENS_SQL}, v AS (SELECT tok, count(*) AS n, min(seq) AS seq, tok LIKE '%+' AS late, arg_min(pos, seq) AS pos FROM tk GROUP BY tok) SELECT tok, n, row_number() OVER (ORDER BY late, seq, pos) - 1 AS id FROM v"


# ---- counts ------------------------------------------------------------------------------


def _summary(by: str) -> Query:
    def query(spark: SparkSession, data: str) -> DataFrame:
        rows = summary.summarize(_events(spark, data), by)
        kinds = F.array_join(F.transform(F.array_sort(F.map_entries("by_kind")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
        return rows.select("key", "events", kinds.alias("by_kind"), "sessions", "fails", "cfails", "unpaired", "retries", F.round("fail_pct", 6).alias("fail_pct"))

    return query


def _summary_sql(key: str) -> str:
    return f"""WITH {EVENTS_SQL}, kinds AS (SELECT {key} AS key, string_agg(k || '=' || n, ',' ORDER BY k) AS by_kind FROM (SELECT p, s, k, n FROM (SELECT min(p) AS p, min(s) AS s, {key} AS g, k, count(*) AS n FROM ev GROUP BY {key}, k)) GROUP BY {key}),
      sums AS (SELECT {key} AS key, count(*) AS events, count(DISTINCT s) AS sessions, count(*) FILTER (WHERE st = 'fail') AS fails, count(*) FILTER (WHERE st = 'cfail') AS cfails,
        count(*) FILTER (WHERE st = 'none' AND k <> 'prompt') AS unpaired, count(*) FILTER (WHERE rt) AS retries FROM ev GROUP BY {key})
      SELECT key, events, by_kind, sessions, fails, cfails, unpaired, retries, round(100.0 * fails / events, 6) AS fail_pct FROM sums JOIN kinds USING (key)"""


def top_actions(spark: SparkSession, data: str) -> DataFrame:
    return summary.top_actions(_events(spark, data))


TOP_SQL = f"WITH {EVENTS_SQL} SELECT CASE WHEN k = 'shell' THEN 'sh:' || act ELSE act END AS action, count(*) AS n, count(*) FILTER (WHERE st = 'fail') AS fails FROM ev WHERE k <> 'prompt' GROUP BY 1"


def summary_hot_sessions(spark: SparkSession, data: str) -> DataFrame:
    """Sessions of session_event, which has a hot one."""
    return summary.summarize(_sessions(spark, data), "session").drop("by_kind", "fail_pct", "retry_pct")


HOT_SQL = """SELECT coalesce(p, '') || '/' || coalesce(s, '') AS key, count(*) AS events, count(DISTINCT coalesce(s, '')) AS sessions, count(*) FILTER (WHERE st = 'fail') AS fails, count(*) FILTER (WHERE st = 'cfail') AS cfails,
  count(*) FILTER (WHERE st = 'none' AND k <> 'prompt') AS unpaired, count(*) FILTER (WHERE rt) AS retries FROM session_event WHERE act IS NOT NULL GROUP BY 1"""


# ---- grams, edges, surprise ---------------------------------------------------------------


def ngram_counts(spark: SparkSession, data: str) -> DataFrame:
    return ngrams.count_grams(_tokens(spark, data), 2, 3).select(joined("gram"), "n", "streams", F.col("exemplar.seq").alias("first_seq"))


_GRAMS = """g AS (SELECT *, lead(tok, 1) OVER w AS t1, lead(tok, 2) OVER w AS t2, min(seq) OVER (PARTITION BY stream) AS first_of FROM tk WINDOW w AS (PARTITION BY stream ORDER BY pos)),
  grams AS (SELECT [tok, t1] AS gram, * FROM g WHERE t1 IS NOT NULL UNION ALL SELECT [tok, t1, t2] AS gram, * FROM g WHERE t2 IS NOT NULL),
  counted AS (SELECT gram, count(*) AS n, count(DISTINCT stream) AS streams, arg_min(seq, (first_of, pos)) AS first_seq FROM grams GROUP BY gram)"""
NGRAMS_SQL = f"WITH {TOKENS_SQL}, {_GRAMS} SELECT array_to_string(gram, ' > ') AS gram, n, streams, first_seq FROM counted"


def ngrams_closed(spark: SparkSession, data: str) -> DataFrame:
    return ngrams.frequent_grams(ngrams.count_grams(_tokens(spark, data), 2, 3), 5, 3).select(joined("gram"), "n", "streams")


CLOSED_SQL = f"""WITH {TOKENS_SQL}, {_GRAMS}, kept AS (SELECT * FROM counted WHERE n >= 5 AND streams >= 3),
  closers AS (SELECT gram[1:2] AS gram, n FROM kept WHERE len(gram) = 3 UNION ALL SELECT gram[2:3], n FROM kept WHERE len(gram) = 3)
  SELECT array_to_string(gram, ' > ') AS gram, n, streams FROM kept WHERE len(list_distinct(gram)) > 1 AND NOT EXISTS (SELECT 1 FROM closers c WHERE c.gram = kept.gram AND 10 * c.n >= 8 * kept.n)"""


def ngram_counts_full(spark: SparkSession, data: str) -> DataFrame:
    """All grams of 2 to 5 tokens."""
    return ngrams.count_grams(_tokens(spark, data)).select(joined("gram"), "n", "streams", F.col("exemplar.seq").alias("first_seq"))


def ngrams_closed_full(spark: SparkSession, data: str) -> DataFrame:
    return ngrams.frequent_grams(ngrams.count_grams(_tokens(spark, data))).select(joined("gram"), "n", "streams")


def follows_edges(spark: SparkSession, data: str) -> DataFrame:
    return follows.edges(_tokens(spark, data))


EDGES_SQL = f"WITH {TOKENS_SQL} SELECT src, dst, count(*) AS n FROM (SELECT tok AS src, lead(tok) OVER (PARTITION BY stream ORDER BY pos) AS dst FROM tk) WHERE dst IS NOT NULL GROUP BY 1, 2"


def bounce_cycles(spark: SparkSession, data: str) -> DataFrame:
    return follows.bounces(_tokens(spark, data))


BOUNCE_SQL = f"""WITH {TOKENS_SQL} SELECT least(tok, x) AS a, greatest(tok, x) AS b, count(*) AS n FROM (SELECT tok, lead(tok) OVER w AS x, lead(tok, 2) OVER w AS y FROM tk WINDOW w AS (PARTITION BY stream ORDER BY pos))
  WHERE y = tok AND x <> tok GROUP BY 1, 2"""


def edges_sessions(spark: SparkSession, data: str) -> DataFrame:
    """Edges of session_event under the coarse lens, most events in one stream."""
    return follows.edges(streams.tokens(_sessions(spark, data), "coarse", mark_fail=False, collapse=False))


def gram_model(spark: SparkSession, data: str) -> DataFrame:
    return ngrams.gram_model(_tokens(spark, data), 2).select(joined("gram"), "n")


MODEL_SQL = f"""WITH {TOKENS_SQL}, {_GRAMS} SELECT array_to_string(gram, ' > ') AS gram, n FROM counted UNION ALL SELECT tok AS gram, count(*) AS n FROM tk GROUP BY tok"""


def gram_model_full(spark: SparkSession, data: str) -> DataFrame:
    """Order 3: all grams of 1 to 4 tokens."""
    return ngrams.gram_model(_tokens(spark, data)).select(joined("gram"), "n")


def surprise_scores(spark: SparkSession, data: str) -> DataFrame:
    return surprise.surprise(_tokens(spark, data), 2, 20).select("stream", "tokens", F.round("bits", 6).alias("bits"))


_SURPRISE = f"""{TOKENS_SQL}, total AS (SELECT count(*) AS all_ FROM tk),
  c AS (SELECT stream, pos, tok, lag(tok, 1) OVER w AS p1, lag(tok, 2) OVER w AS p2, lead(tok, 1) OVER w AS n1, lead(tok, 2) OVER w AS n2 FROM tk WINDOW w AS (PARTITION BY stream ORDER BY pos)),
  one AS (SELECT tok AS a, count(*) AS n FROM tk GROUP BY 1), two AS (SELECT tok AS a, n1 AS b, count(*) AS n FROM c WHERE n1 IS NOT NULL GROUP BY 1, 2), three AS (SELECT tok AS a, n1 AS b, n2 AS d, count(*) AS n FROM c WHERE n2 IS NOT NULL GROUP BY 1, 2, 3),
  bits AS (SELECT c.stream, CASE WHEN c.p1 IS NULL THEN -log2(o.n / t.all_) WHEN c.p2 IS NULL THEN -log2(CAST(b.n AS DOUBLE) / o1.n) ELSE -log2(CAST(x.n AS DOUBLE) / b2.n) END AS bits FROM c CROSS JOIN total t
    JOIN one o ON o.a = c.tok LEFT JOIN one o1 ON o1.a = c.p1 LEFT JOIN two b ON b.a = c.p1 AND b.b = c.tok LEFT JOIN two b2 ON b2.a = c.p2 AND b2.b = c.p1 LEFT JOIN three x ON x.a = c.p2 AND x.b = c.p1 AND x.d = c.tok),
  scored AS (SELECT stream, count(*) AS tokens, avg(bits) AS bits FROM bits GROUP BY stream HAVING count(*) >= 20)"""
SURPRISE_SQL = f"WITH {_SURPRISE} SELECT stream, tokens, round(bits, 6) AS bits FROM scored"


def surprise_scores_full(spark: SparkSession, data: str) -> DataFrame:
    return surprise.surprise(_tokens(spark, data)).select("stream", "tokens", F.round("bits", 6).alias("bits"))


def _extremes(scored: DataFrame) -> DataFrame:
    routine, odd = surprise.extremes(scored, 20)
    rows = routine.withColumn("end", F.lit("routine")).unionByName(odd.withColumn("end", F.lit("surprising")))
    return rows.select("end", "stream", "tokens", F.round("bits", 6).alias("bits"))


def surprise_extremes(spark: SparkSession, data: str) -> DataFrame:
    return _extremes(surprise.surprise(_tokens(spark, data), 2, 20))


def surprise_extremes_full(spark: SparkSession, data: str) -> DataFrame:
    return _extremes(surprise.surprise(_tokens(spark, data)))


EXTREMES_SQL = f"""WITH {_SURPRISE} SELECT * FROM (SELECT 'routine' AS "end", stream, tokens, round(bits, 6) AS bits FROM scored ORDER BY scored.bits, stream LIMIT 10) UNION ALL
  SELECT * FROM (SELECT 'surprising' AS "end", stream, tokens, round(bits, 6) AS bits FROM scored ORDER BY scored.bits DESC, stream DESC LIMIT 10)"""


# ---- sequences, cards, findings --------------------------------------------------------------


def _levels(spark: SparkSession, data: str) -> tuple[DataFrame, DataFrame]:
    """Patterns of up to 5 tokens. The SQL beside these queries ends at 3, so
    that it says the same only where no pattern of 4 is frequent."""
    tokens = _tokens(spark, data)
    return tokens, seqs.pattern_levels(tokens, _support(tokens))


def seqs_support(spark: SparkSession, data: str) -> DataFrame:
    return _levels(spark, data)[1].select(joined("pattern"), "support")


_SEQS = f"""{TOKENS_SQL}, least_ AS (SELECT greatest(2, CAST(ceil(count(DISTINCT stream) * {SUPPORT_PERCENT} / 100.0) AS BIGINT)) AS m FROM tk),
  l1 AS (SELECT [tok] AS pattern, count(DISTINCT stream) AS support FROM tk GROUP BY tok HAVING count(DISTINCT stream) >= (SELECT m FROM least_)),
  s2 AS (SELECT DISTINCT x.stream, x.tok AS a, y.tok AS b, y.pos AS upto FROM tk x JOIN tk y ON y.stream = x.stream AND y.pos BETWEEN x.pos + 1 AND x.pos + 3),
  l2 AS (SELECT [a, b] AS pattern, count(DISTINCT stream) AS support FROM s2 GROUP BY a, b HAVING count(DISTINCT stream) >= (SELECT m FROM least_)),
  s3 AS (SELECT DISTINCT s2.stream, a, b, z.tok AS c FROM s2 JOIN tk z ON z.stream = s2.stream AND z.pos BETWEEN upto + 1 AND upto + 3),
  l3 AS (SELECT [a, b, c] AS pattern, count(DISTINCT stream) AS support FROM s3 GROUP BY a, b, c HAVING count(DISTINCT stream) >= (SELECT m FROM least_)),
  levels AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"""
SEQS_SQL = f"WITH {_SEQS} SELECT array_to_string(pattern, ' > ') AS pattern, support FROM levels"


def seqs_closed(spark: SparkSession, data: str) -> DataFrame:
    return seqs.closed_patterns(_levels(spark, data)[1]).patterns.select(joined("pattern"), "support")


_CLOSED_SEQS = f"""{_SEQS}, best AS (SELECT pattern[1:len(pattern) - 1] AS pattern, max(support) AS child FROM levels WHERE len(pattern) > 1 GROUP BY 1),
  closed AS (SELECT l.* FROM levels l LEFT JOIN best b ON b.pattern = l.pattern WHERE len(l.pattern) > 1 AND len(list_distinct(l.pattern)) > 1 AND (child IS NULL OR 10 * child < 8 * support))"""
SEQS_CLOSED_SQL = f"WITH {_CLOSED_SEQS} SELECT array_to_string(pattern, ' > ') AS pattern, support FROM closed"


def fold(spark: SparkSession, data: str) -> DataFrame:
    patterns = seqs.closed_patterns(_levels(spark, data)[1]).patterns
    return rank.fold(patterns.select("pattern", "support"), 0.8).select(joined("pattern"), "support", "folded")


FOLD_SQL = f"""WITH {_CLOSED_SEQS}, long3 AS (SELECT * FROM closed WHERE len(pattern) = 3), short2 AS (SELECT * FROM closed WHERE len(pattern) = 2),
  into_ AS (SELECT s.pattern, (SELECT l.pattern FROM long3 l WHERE CAST(l.support AS DOUBLE) >= 0.8 * s.support AND ((l.pattern[1] = s.pattern[1] AND (l.pattern[2] = s.pattern[2] OR l.pattern[3] = s.pattern[2])) OR (l.pattern[2] = s.pattern[1] AND l.pattern[3] = s.pattern[2])) ORDER BY l.support DESC, l.pattern LIMIT 1) AS holder FROM short2 s),
  kept AS (SELECT pattern, support FROM long3 UNION ALL SELECT s.pattern, s.support FROM short2 s JOIN into_ i ON i.pattern = s.pattern WHERE i.holder IS NULL)
  SELECT array_to_string(k.pattern, ' > ') AS pattern, k.support, (SELECT count(*) FROM into_ i WHERE i.holder = k.pattern) AS folded FROM kept k"""


def _cards(spark: SparkSession, data: str) -> tuple[DataFrame, rank.Ranked]:
    tokens, levels = _levels(spark, data)
    return tokens, rank.rank_patterns(tokens, seqs.closed_patterns(levels).patterns)


def _card() -> list:
    return [joined("pattern"), "support", F.round("bits", 6).alias("bits"), F.round("score", 6).alias("score")]


def rank_cards(spark: SparkSession, data: str) -> DataFrame:
    return _cards(spark, data)[1].cards.select("bucket", *_card(), "variants", "folded")


def rank_topk(spark: SparkSession, data: str) -> DataFrame:
    return rank.top_per_bucket(_cards(spark, data)[1].cards, 3).select("bucket", *_card(), "place", "left_out")


def family_merge(spark: SparkSession, data: str) -> DataFrame:
    """How many cards each family takes in."""
    return _cards(spark, data)[1].cards.groupBy("bucket").agg(F.count(F.lit(1)).alias("families"), F.sum("variants").alias("variants"), F.sum("folded").alias("folded"))


def findings_measure(spark: SparkSession, data: str) -> DataFrame:
    tokens, levels = _levels(spark, data)
    return findings.measure(tokens, levels.where(F.size("pattern") == 2), 3).select(joined("pattern"), "n", "streams", "bytes")


MEASURE_SQL = f"""WITH RECURSIVE {_SEQS}, starts AS (SELECT x.stream, l.pattern, x.pos AS st, min(y.pos) AS en, x.bytes AS b1 FROM l2 l JOIN tk x ON x.tok = l.pattern[1] JOIN tk y ON y.stream = x.stream AND y.tok = l.pattern[2] AND y.pos BETWEEN x.pos + 1 AND x.pos + 3 GROUP BY ALL),
  found AS (SELECT s.*, s.b1 + y.bytes AS bytes FROM starts s JOIN tk y ON y.stream = s.stream AND y.pos = s.en),
  walk AS (SELECT stream, pattern, min(st) AS st FROM found GROUP BY stream, pattern
    UNION ALL SELECT w.stream, w.pattern, (SELECT min(n.st) FROM found n WHERE n.stream = w.stream AND n.pattern = w.pattern AND n.st > f.en) AS st FROM walk w JOIN found f ON f.stream = w.stream AND f.pattern = w.pattern AND f.st = w.st WHERE w.st IS NOT NULL)
  SELECT array_to_string(w.pattern, ' > ') AS pattern, count(*) AS n, count(DISTINCT w.stream) AS streams, CAST(sum(f.bytes) AS BIGINT) AS bytes FROM walk w JOIN found f ON f.stream = w.stream AND f.pattern = w.pattern AND f.st = w.st GROUP BY 1"""


def findings_measure_full(spark: SparkSession, data: str) -> DataFrame:
    """Costs of all mined patterns; findings_measure has those of two tokens, as its SQL."""
    tokens, levels = _levels(spark, data)
    return findings.measure(tokens, levels).select(joined("pattern"), "n", "streams", "bytes")


def report(spark: SparkSession, data: str) -> DataFrame:
    tokens, ranked = _cards(spark, data)
    rows = findings.findings(tokens, ranked.cards)
    return rows.select("kind", "action", joined("pattern"), "n", "streams", F.round("fail_rate", 6).alias("fail_rate"), "burn")


def shell_split(spark: SparkSession, data: str) -> DataFrame:
    """Segments of command lines: those in the shell events' details."""
    from .functions.shell import split

    commands = F.udf(lambda text: [c for c, _ in split(text)[0]], "array<string>", useArrow=True)
    rows = table(spark, data, "session_event").where("k = 'shell' and d is not null").groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.explode(commands("d")).alias("cmd"), "n").groupBy("cmd").agg(F.sum("n").alias("n"))


_PLAIN = [
    p2_found, p2_table, ingest_events, pairing, pairing_tools, retry, dedup, mark_fail, collapse, no_sidechain, tokens_session, tokens_session_full, vocab, top_actions, summary_hot_sessions, ngram_counts, ngrams_closed, follows_edges,
    bounce_cycles, edges_sessions, gram_model, surprise_scores, surprise_extremes, ngram_counts_full, ngrams_closed_full, gram_model_full, surprise_scores_full, surprise_extremes_full, seqs_support, seqs_closed, fold, rank_cards, rank_topk, family_merge, findings_measure, findings_measure_full, report, shell_split,
]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f.__name__: f for f in _PLAIN}
    out |= {f"lens_{name}": _lens_query(name) for name in LENS_SQL}
    return out | {f"summary_{by}": _summary(by) for by in ("corpus", "project", "session")}


def oracle_sql() -> dict[str, str]:
    tokens_of = f"WITH {TOKENS_SQL} SELECT stream, pos, tok, seq, bytes FROM tk"
    return {
        "pairing_tools": PAIRING_SQL, "dedup": DEDUP_SQL, "mark_fail": f"WITH {EVENTS_SQL} SELECT {_MARKED} AS tok, count(*) AS n FROM ev GROUP BY 1", "collapse": tokens_of, "no_sidechain": NO_SIDECHAIN_SQL,
        "tokens_session": tokens_of + " WHERE stream LIKE '%/user-7@%' ORDER BY stream, pos LIMIT 200", "vocab": VOCAB_SQL, "top_actions": TOP_SQL, "summary_hot_sessions": HOT_SQL,
        "ngram_counts": NGRAMS_SQL, "ngrams_closed": CLOSED_SQL, "follows_edges": EDGES_SQL, "bounce_cycles": BOUNCE_SQL, "gram_model": MODEL_SQL, "surprise_scores": SURPRISE_SQL, "surprise_extremes": EXTREMES_SQL,
        "seqs_support": SEQS_SQL, "seqs_closed": SEQS_CLOSED_SQL, "fold": FOLD_SQL, "findings_measure": MEASURE_SQL,
        **{f"lens_{name}": _lens_sql(name) for name in LENS_SQL},
        "summary_corpus": _summary_sql("'corpus'"), "summary_project": _summary_sql("p"), "summary_session": _summary_sql("p || '/' || s"),
    }
