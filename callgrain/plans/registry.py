"""Catalog of registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = with_views(sql, *views) if views else sql
            return fn

        return add


def with_views(sql: str, *names: str) -> str:
    """Prefixes the SQL with the CTEs it needs, dependencies first."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for dep in DEPENDS.get(name, ()):
            need(dep)
        if name not in wanted:
            wanted.append(name)

    for n in names:
        need(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# SQL forms of callgrain.sources.views, in the dialect of the checking engine.
DEPENDS = {
    "truth_v": ("words_v",), "frames_v": ("words_v",), "acted_v": ("words_v",),
    "turns_v": ("words_v",), "acted_turns_v": ("acted_v",), "boundaries_v": ("acted_turns_v",),
}

_TURNS = """
SELECT call_id, turn_id, min(speaker) AS speaker, min(start_ms) AS start_ms, arg_max(end_ms, (turn, pos)) AS end_ms, min(turn) AS first_turn,
  count(*) AS words, string_agg(word, ' ' ORDER BY turn, pos) AS text, floor(avg(confidence) * 100 + 0.5) / 100 AS confidence
FROM (SELECT *, sum(CASE WHEN prev IS DISTINCT FROM speaker THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY turn, pos) AS turn_id
  FROM (SELECT *, lag(speaker) OVER (PARTITION BY call_id ORDER BY turn, pos) AS prev FROM {source}) a) b
GROUP BY call_id, turn_id
"""

_ACK = "'yeah','yes','yep','yup','okay','ok','right','sure','mm','mhm','hmm','uh-huh','uh','huh','oh','alright','i','see','got','it','thanks','thank','you','sorry','go','ahead','please'"
_DANGLING = "'the','a','an','and','but','or','to','of','for','with','my','your','i','it''s','it','that','is','are','was','on','in','at','so','because','if','i''m','we','you','this'"
_BOUNDARIES = f"""
SELECT *, CASE WHEN overlap >= 0.15 THEN 'simultaneous' WHEN ack AND resumed AND pw >= 3 THEN 'backchannel' WHEN pw >= 3 AND NOT fin AND gap < 0.5 THEN 'interruption' ELSE 'transition' END AS kind
FROM (SELECT *, (start_ms - pe) / 1000.0 AS gap, greatest(0.0, (pe - start_ms) / 1000.0) AS overlap,
   len(string_split_regex(trim(text), '\\s+')) <= 3 AND len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: regexp_replace(lower(w), '[^a-z''-]', '', 'g') NOT IN ({_ACK}))) = 0 AS ack,
   nxt IS NOT NULL AND nxt = ps AS resumed, string_split_regex(trim(pt), '\\s+')[-1] AS lw,
   regexp_matches(string_split_regex(trim(pt), '\\s+')[-1], '[.?!]["'')]*$') AS fin,
   regexp_replace(lower(string_split_regex(trim(pt), '\\s+')[-1]), '[^a-z''-]', '', 'g') IN ({_DANGLING}) AS dangling
  FROM (SELECT *, lag(speaker) OVER w AS ps, lag(end_ms) OVER w AS pe, lag(text) OVER w AS pt, lag(words) OVER w AS pw, lag(confidence) OVER w AS pc, lead(speaker) OVER w AS nxt
    FROM acted_turns_v WINDOW w AS (PARTITION BY call_id ORDER BY turn_id)) a WHERE ps IS NOT NULL) b
"""

VIEWS = {
    "calls_v": """
SELECT id, owner_id, started_at,
  CASE WHEN status <> 'in_progress' THEN started_at + to_microseconds(CAST(round(value * 100000) AS BIGINT)) END AS ended_at,
  value / 10 AS latency_s, status, input_source, stt_provider_used, id % 9 = 4 AS stt_failover_occurred, injected_fault,
  CASE WHEN injected_fault IS NULL AND id % 2 = 0 THEN 'control' END AS label_source,
  CASE WHEN status = 'in_progress' THEN NULL WHEN status = 'completed' THEN 'ok'
       WHEN id % 5 = 0 THEN 'timeout' ELSE COALESCE(injected_fault, 'bad_stt') END AS predicted_category,
  total_cost_usd, ab_run_id, ab_side
FROM (SELECT event_id AS id, user_id AS owner_id, ts AS started_at, value,
  CASE WHEN event_type = 'error' THEN 'failed'
       WHEN event_type = 'view' AND event_id % 10 = 0 THEN 'in_progress' ELSE 'completed' END AS status,
  CASE event_id % 3 WHEN 0 THEN 'sample' WHEN 1 THEN 'upload' ELSE 'recording' END AS input_source,
  CASE WHEN event_id % 4 = 0 THEN 'whisper' ELSE 'deepgram' END AS stt_provider_used,
  CASE WHEN (event_type = 'error' AND event_id % 6 <> 0) OR event_id % 11 = 0 THEN
       CASE event_id % 7 WHEN 0 THEN 'bad_stt' WHEN 1 THEN 'hallucination' WHEN 2 THEN 'tts_glitch'
         WHEN 3 THEN 'timeout' WHEN 4 THEN 'user_hangup' WHEN 5 THEN 'network_drop' ELSE 'exception' END
  END AS injected_fault,
  value / 10000 AS total_cost_usd, event_id % 40 AS ab_run_id,
  CASE WHEN event_id % 80 < 40 THEN 'A' ELSE 'B' END AS ab_side
FROM events) e
""",
    "stages_v": """
SELECT l_orderkey AS call_id,
  CASE l_linenumber WHEN 1 THEN 'stt' WHEN 2 THEN 'llm' WHEN 3 THEN 'tts' ELSE 'analysis' END AS stage,
  CASE WHEN l_linenumber = 1 AND l_suppkey % 4 = 0 THEN 'whisper' WHEN l_linenumber = 1 THEN 'deepgram' ELSE 'openai' END AS provider,
  CAST(l_quantity * 200 AS INT) AS duration_ms,
  CASE WHEN l_returnflag = 'R' AND l_partkey % 10 = 0 THEN 'timeout'
       WHEN l_returnflag = 'A' AND l_partkey % 10 = 0 THEN 'error' ELSE 'ok' END AS status,
  l_extendedprice / 10000000 AS cost_usd, l_shipdate AS started_at, l_partkey AS part_key, l_linenumber AS line_number
FROM lineitem
""",
    "words_v": """
SELECT call_id, turn, speaker, pos, word, start_ms, start_ms + dur_ms AS end_ms,
  0.5 + ((length(word) * 7 + pos * 13 + turn * 5) % 32) / 64.0 AS confidence
FROM (SELECT call_id, turn, speaker, pos, word, dur_ms,
    CAST(SUM(dur_ms + gap_ms) OVER (PARTITION BY call_id ORDER BY turn, pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - dur_ms AS BIGINT) AS start_ms
  FROM (SELECT call_id, turn, speaker, pos, word, 60 * length(word) AS dur_ms,
          CASE WHEN pos % 53 = 52 THEN 1700 WHEN pos % 17 = 16 THEN 800 WHEN pos = 0 THEN 300 ELSE 40 END AS gap_ms
        FROM (SELECT conv_id AS call_id, turn, role AS speaker, unnest(range(len(string_split(text, ' ')))) AS pos,
                unnest(string_split(text, ' ')) AS word FROM conversations) x) y) z
""",
    "acted_v": """
SELECT * REPLACE (CASE WHEN pos = 0 AND turn % 3 = 1 THEN start_ms - 550 ELSE start_ms END AS start_ms,
  CASE WHEN turn % 5 = 2 AND pos = 0 THEN 'Yeah,' WHEN turn % 5 = 2 AND pos = 1 THEN 'okay.' WHEN turn % 4 = 0 THEN regexp_replace(word, '[.?!]+$', '') ELSE word END AS word,
  CASE WHEN turn % 5 = 2 AND pos >= 2 THEN CASE WHEN speaker = 'user' THEN 'assistant' ELSE 'user' END ELSE speaker END AS speaker)
FROM words_v
""",
    "truth_v": """
SELECT call_id, turn, speaker AS who, min(start_ms) + 200 AS start_ms, max(end_ms) - 200 AS end_ms
FROM words_v WHERE turn % 4 <> 3 GROUP BY call_id, turn, speaker
""",
    "pairs_v": """
SELECT conv_id * 100 + turn AS pair_id, text AS ref, replace(replace(text, ' de ', ' '), ' la ', ' le ') AS hyp FROM conversations
""",
    "frames_v": """
SELECT call_id, frame_idx,
  (CASE WHEN turn % 7 = 5 AND turn > 0 THEN 330.0 WHEN speaker = 'user' THEN 110.0 ELSE 210.0 END + CAST((frame_idx * 7 + pos * 3) % 11 AS DOUBLE))::DOUBLE AS f0,
  (CASE WHEN turn % 7 = 5 AND turn > 0 THEN -44.0 ELSE -20.0 END + CAST((frame_idx * 5) % 7 AS DOUBLE))::DOUBLE AS db
FROM (SELECT call_id, turn, pos, speaker,
  unnest(range(CAST(floor(start_ms / 50) AS BIGINT), CAST(floor((end_ms - 1) / 50) AS BIGINT) + 1)) AS frame_idx FROM words_v) f
""",
    "turns_v": _TURNS.format(source="words_v"),
    "acted_turns_v": _TURNS.format(source="acted_v"),
    "boundaries_v": _BOUNDARIES,
}
