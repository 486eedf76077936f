"""Listing, detail, cost, quota and maintenance queries over the call ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.functions import predicates as P
from callgrain.functions import pricing
from callgrain.functions.columns import micros, nearest_rank
from callgrain.operators import ledger as L
from callgrain.operators import quantiles
from callgrain.plans.registry import Catalog
from callgrain.sources import sinks
from callgrain.sources.ledger import load_calls
from callgrain.sources.views import calls_view, stages_view, table
from callgrain.streaming.source import work_dir

catalog = Catalog()
q = catalog.query


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    cast = {c: F.round(c, digits) for c, t in df.dtypes if t == "double"}
    return df.withColumns(cast) if cast else df


def newest(calls: DataFrame) -> Column:
    """Clock of the data: newest call, a one-row scalar subquery."""
    return calls.agg(F.max("started_at")).scalar()


def shared_calls(spark, d):
    """Every 13th call belongs to nobody (readable by all)."""
    return calls_view(spark, d).withColumn("owner_id", F.when(F.col("id") % 13 != 0, F.col("owner_id")))


@q("s01_ledger_scan", """
SELECT status, input_source, count(*) AS n, round(sum(total_cost_usd), 6) AS cost FROM calls_v GROUP BY status, input_source
""", ("calls_v",))
def ledger_scan(spark, d):
    return calls_view(spark, d).groupBy("status", "input_source").agg(
        F.count("*").alias("n"), F.round(F.sum("total_cost_usd"), 6).alias("cost"))


@q("s01_s13_appended_ledger", """
SELECT CAST(id AS VARCHAR) AS id, epoch_us(started_at) AS started_us, status, CAST(owner_id AS VARCHAR) AS owner_id, round(total_cost_usd, 9) AS total_cost_usd FROM calls_v
WHERE CAST(started_at AS DATE) = (SELECT CAST(max(started_at) AS DATE) - 1 FROM calls_v)
""", ("calls_v",))
def appended_ledger(spark, d):
    """Two appends to a ledger cut by call date, then one day of it: the scan reads that day's folder alone."""
    calls = calls_view(spark, d).select(F.col("id").cast("string").alias("id"), "started_at", "status", F.col("owner_id").cast("string").alias("owner_id"), F.round("total_cost_usd", 9).cast("decimal(18,9)").alias("total_cost_usd"))
    folder = work_dir(spark, "ledger")
    for part in (F.col("status") == "failed", F.col("status") != "failed"):
        sinks.append_calls(calls.where(part), f"{folder}/calls")
    day = calls.agg(F.date_sub(F.to_date(F.max("started_at")), 1)).first()[0]
    return load_calls(spark, folder).where(F.col("call_date") == F.lit(day)).select("id", micros("started_at").alias("started_us"), "status", "owner_id", F.round("total_cost_usd", 9).alias("total_cost_usd"))


@q("s13_appended_spend", """
SELECT CAST(o_custkey AS VARCHAR) AS owner_id, round(sum(o_totalprice / 1000000), 6) AS cost_usd, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY 1
""")
def appended_spend(spark, d):
    """A side ledger of order prices above a floor; entries that are not positive are not recorded."""
    orders = table(spark, d, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_custkey").cast("string").alias("owner_id"), F.lit("order").alias("kind"),
        F.when(F.col("o_totalprice") > 150000, F.col("o_totalprice") / 1000000).otherwise(F.lit(0.0)).alias("cost_usd"))
    folder = work_dir(spark, "spend")
    sinks.append_spend(orders, folder)
    return spark.read.parquet(folder).groupBy("owner_id").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count("*").alias("n"))


@q("s02_tenant_scope", """
SELECT id, owner_id, status FROM (SELECT * REPLACE (CASE WHEN id % 13 <> 0 THEN owner_id END AS owner_id) FROM calls_v) c
WHERE owner_id IS NULL OR owner_id = 7
""", ("calls_v",))
def tenant_scope(spark, d):
    return L.scope(shared_calls(spark, d), 7, include_shared=True).select("id", "owner_id", "status")


@q("s12_dead_letters", """
SELECT event_id, CASE WHEN k IS NULL THEN 'rejected' ELSE 'accepted' END AS route, k
FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM
  (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '{"k": "?' ELSE props END AS props FROM events
   WHERE event_id % 17 <> 0) good
  UNION ALL SELECT event_id, NULL AS k FROM events WHERE event_id % 17 = 0) r
""")
def dead_letters(spark, d):
    raw = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 17 == 0, F.lit('{"k": "?')).otherwise(F.col("props")).alias("props"))
    good, bad = sinks.split_malformed(raw, "props", "k BIGINT")
    accepted = good.select("event_id", F.lit("accepted").alias("route"), F.col("parsed.k").alias("k"))
    return accepted.unionByName(bad.select("event_id", F.lit("rejected").alias("route"), F.lit(None).cast("bigint").alias("k")))


@q("f01_list_calls", """
SELECT id, epoch_us(started_at) AS started_us, status, predicted_category FROM calls_v
WHERE owner_id = 7 AND stt_provider_used = 'deepgram' ORDER BY started_at DESC NULLS LAST, id LIMIT 20
""", ("calls_v",))
def list_calls(spark, d):
    return L.list_calls(calls_view(spark, d), 7, provider="deepgram", limit=20).select(
        "id", micros("started_at").alias("started_us"), "status", "predicted_category")


def with_document(spark, d):
    doc = F.expr("""to_json(named_struct(
        'understanding', named_struct('primary_intent', named_struct('label', concat('intent_', cast(id % 5 AS string)))),
        'difficulty', named_struct('label', CASE WHEN id % 3 = 0 THEN 'Hard' ELSE 'Easy' END),
        'script_match', named_struct('wer', cast(id % 20 AS double) / 100)))""")
    return calls_view(spark, d).withColumn("analysis", F.when(F.col("id") % 8 != 0, doc))


@q("f02_document_labels", """
SELECT CASE WHEN id % 8 <> 0 THEN 'intent_' || (id % 5) END AS intent,
  CASE WHEN id % 8 <> 0 THEN CASE WHEN id % 3 = 0 THEN 'Hard' ELSE 'Easy' END END AS difficulty, count(*) AS n
FROM calls_v GROUP BY 1, 2
""", ("calls_v",))
def document_labels(spark, d):
    return L.with_labels_from_document(with_document(spark, d)).groupBy("intent", "difficulty").agg(F.count("*").alias("n"))


@q("x06_json_rebuild", """
SELECT k, count(*) AS n, sum(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS even_n
FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e GROUP BY k
""")
def json_rebuild(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    again = F.get_json_object(F.to_json(F.struct(k.alias("k"), (k % 2 == 0).alias("even"))), "$.even") == "true"
    return table(spark, d, "events").select(k.alias("k"), again.alias("even")).groupBy("k").agg(
        F.count("*").alias("n"), F.count_if("even").alias("even_n"))


def reports(spark, d):
    """Several report versions per call, from the order table."""
    return table(spark, d, "orders").selectExpr(
        "o_orderkey % 5000 AS call_id", "o_orderkey AS report_id", "o_orderdate AS generated_at",
        "concat('report ', o_orderpriority) AS report_text")


@q("f03_call_detail", """
WITH latest AS (SELECT call_id, arg_max(report_text, (generated_at, report_id)) AS report_text FROM
  (SELECT o_orderkey % 5000 AS call_id, o_orderkey AS report_id, o_orderdate AS generated_at, 'report ' || o_orderpriority AS report_text FROM orders) r
  GROUP BY call_id)
SELECT c.id, c.status, s.stage, s.duration_ms, epoch_us(s.started_at) AS stage_us, l.report_text
FROM calls_v c LEFT JOIN latest l ON l.call_id = c.id LEFT JOIN stages_v s ON s.call_id = c.id
""", ("calls_v", "stages_v"))
def call_detail(spark, d):
    return L.call_detail(calls_view(spark, d), stages_view(spark, d), reports(spark, d)).select(
        "id", "status", "stage", "duration_ms", micros("stage_started_at").alias("stage_us"), "report_text")


@q("w07_latest_report", """
SELECT call_id, arg_max(report_id, (generated_at, report_id)) AS report_id, max(epoch_us(generated_at)) AS generated_us FROM
 (SELECT o_orderkey % 5000 AS call_id, o_orderkey AS report_id, o_orderdate AS generated_at FROM orders) r GROUP BY call_id
""")
def latest_report(spark, d):
    return L.latest_per_key(reports(spark, d), ["call_id"], "generated_at", "report_id", ["report_id", "generated_at"]).select(
        "call_id", "report_id", micros("generated_at").alias("generated_us"))


@q("f04_display_rows", """
WITH spent AS (SELECT call_id, sum(COALESCE(cost_usd, 0)) AS stage_cost FROM stages_v GROUP BY call_id)
SELECT id, status, CASE WHEN status = 'failed' THEN COALESCE(CASE WHEN predicted_category <> 'ok' THEN predicted_category END, 'unknown') END AS cause,
  round((epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0, 6) AS duration_s,
  round(COALESCE(CASE WHEN id % 3 <> 0 THEN total_cost_usd END, stage_cost, 0), 9) AS cost_usd, status IN ('completed', 'failed', 'aborted') AS is_finished
FROM calls_v LEFT JOIN spent ON call_id = id
""", ("calls_v", "stages_v"))
def display_rows(spark, d):
    calls = calls_view(spark, d).withColumn("total_cost_usd", F.when(F.col("id") % 3 != 0, F.col("total_cost_usd")))
    return L.display_rows(calls, stages_view(spark, d)).withColumns(
        {"duration_s": F.round("duration_s", 6), "cost_usd": F.round("cost_usd", 9)})


@q("f05_failing_stage", """
WITH bad AS (SELECT call_id, arg_min(stage, CASE stage WHEN 'stt' THEN 0 WHEN 'llm' THEN 1 ELSE 2 END) AS broken
  FROM stages_v WHERE stage IN ('stt', 'llm', 'tts') AND status <> 'ok' GROUP BY call_id)
SELECT id, predicted_category AS cause, COALESCE(broken, CASE predicted_category WHEN 'bad_stt' THEN 'stt' WHEN 'hallucination' THEN 'llm'
  WHEN 'tts_glitch' THEN 'tts' END) AS failing_stage FROM calls_v LEFT JOIN bad ON call_id = id WHERE status = 'failed'
""", ("calls_v", "stages_v"))
def failing_stage(spark, d):
    return L.failing_stage(calls_view(spark, d), stages_view(spark, d))


@q("f06_ground_truth", """
SELECT COALESCE(injected_fault, 'ok') AS truth, count(*) AS n FROM calls_v
WHERE status IN ('completed', 'failed') AND predicted_category IS NOT NULL AND (injected_fault IS NOT NULL OR label_source = 'control') GROUP BY 1
""", ("calls_v",))
def ground_truth(spark, d):
    return calls_view(spark, d).where(P.has_ground_truth()).groupBy(P.truth_label().alias("truth")).agg(F.count("*").alias("n"))


@q("f07_health_rows", """
SELECT s.stage, s.status, count(*) AS n FROM stages_v s JOIN calls_v c ON c.id = s.call_id
WHERE c.status IN ('completed', 'failed') AND c.injected_fault IS NULL AND s.stage IN ('stt', 'llm', 'tts') AND s.duration_ms IS NOT NULL GROUP BY 1, 2
""", ("calls_v", "stages_v"))
def health_rows(spark, d):
    healthy = calls_view(spark, d).where(P.healthy_call()).select(F.col("id").alias("call_id"))
    return stages_view(spark, d).where(P.measured_stage()).join(healthy, "call_id", "left_semi").groupBy("stage", "status").agg(F.count("*").alias("n"))


@q("f11_reply_length_mismatch", """
SELECT CASE WHEN size_bytes IS NULL OR size_bytes < 1000 THEN true WHEN chars = 0 THEN false
  ELSE seconds / (chars / 15.0) < 0.5 OR seconds / (chars / 15.0) > 2.5 END AS mismatch, count(*) AS n
FROM (SELECT CASE WHEN l_partkey % 50 <> 0 THEN CAST(l_extendedprice / 10 AS INT) END AS size_bytes, l_quantity / 2 AS seconds, l_partkey % 300 AS chars FROM lineitem) x GROUP BY 1
""")
def reply_length_mismatch(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "CASE WHEN l_partkey % 50 <> 0 THEN CAST(round(l_extendedprice / 10) AS INT) END AS size_bytes", "l_quantity / 2 AS seconds", "l_partkey % 300 AS chars")
    return rows.groupBy(P.speech_length_mismatch("size_bytes", "seconds", "chars").alias("mismatch")).agg(F.count("*").alias("n"))


@q("f14_upsert", """
SELECT id, CASE WHEN status = 'in_progress' THEN 'aborted' ELSE status END AS status FROM calls_v UNION ALL SELECT -1 - id, 'failed' FROM calls_v WHERE status = 'failed'
""", ("calls_v",))
def upsert(spark, d):
    calls = calls_view(spark, d).select("id", "status")
    # two versions of each replaced row, the later one first, and two of each new row
    stuck, failed = calls.where("status = 'in_progress'"), calls.where("status = 'failed'").withColumn("id", -1 - F.col("id"))
    versions = F.explode(F.array(F.struct(F.lit(2).alias("version"), F.lit(True).alias("last")), F.struct(F.lit(1).alias("version"), F.lit(False).alias("last")))).alias("v")
    delta = stuck.select("id", F.lit("aborted").alias("final"), versions).unionByName(failed.select("id", F.lit("failed").alias("final"), versions))
    return L.upsert(calls, delta.select("id", F.when(F.col("v.last"), F.col("final")).otherwise(F.lit("queued")).alias("status"), F.col("v.version").alias("version")), ["id"], ["version"])


@q("f15_abort_in_flight", """
SELECT id, CASE WHEN status IN ('queued', 'in_progress') THEN 'aborted' ELSE status END AS status,
  epoch_us(CASE WHEN status IN ('queued', 'in_progress') THEN (SELECT max(started_at) FROM calls_v) ELSE ended_at END) AS ended_us FROM calls_v
""", ("calls_v",))
def abort_in_flight(spark, d):
    calls = calls_view(spark, d)
    return L.abort_in_flight(calls, newest(calls)).select("id", "status", micros("ended_at").alias("ended_us"))


@q("f16_add_costs", """
WITH extra AS (SELECT call_id, sum(cost_usd) AS extra FROM stages_v WHERE stage = 'analysis' GROUP BY call_id)
SELECT id, round(CASE WHEN extra IS NULL THEN t ELSE COALESCE(t, 0) + extra END, 9) AS total_cost_usd
FROM (SELECT id, CASE WHEN id % 7 <> 0 THEN total_cost_usd END AS t FROM calls_v) c LEFT JOIN extra ON call_id = id
""", ("calls_v", "stages_v"))
def add_costs(spark, d):
    calls = calls_view(spark, d).select("id", F.when(F.col("id") % 7 != 0, F.col("total_cost_usd")).alias("total_cost_usd"))
    return rounded(L.add_costs(calls, stages_view(spark, d).where("stage = 'analysis'")))


@q("f17_purge_counts", """
WITH doomed AS (SELECT id FROM calls_v WHERE id % 13 = 0 AND id % 3 <> 0 AND id % 5 = 1)
SELECT 'calls' AS table_name, (SELECT count(*) FROM doomed) AS n_deleted, (SELECT count(*) FROM calls_v) - (SELECT count(*) FROM doomed) AS n_kept
UNION ALL SELECT 'call_stages', (SELECT count(*) FROM stages_v WHERE call_id IN (SELECT id FROM doomed)), (SELECT count(*) FROM stages_v WHERE call_id NOT IN (SELECT id FROM doomed))
""", ("calls_v", "stages_v"))
def purge_counts(spark, d):
    calls = shared_calls(spark, d).withColumns({
        "ab_run_id": F.when(F.col("id") % 3 == 0, F.col("ab_run_id")),
        "redacted_transcript": F.concat(F.lit("seeded line "), (F.col("id") % 5).cast("string"))})
    children = {"call_stages": stages_view(spark, d).select("call_id")}
    texts = ["seeded line 1"]
    kept = L.purge(calls, children, texts)
    left = None
    for name, df in kept.items():
        part = df.agg(F.count("*").alias("n_kept")).select(F.lit("calls" if name == "calls" else name).alias("table_name"), "n_kept")
        left = part if left is None else left.unionByName(part)
    return L.purge_counts(calls, children, texts).join(left, "table_name")


TENANT_KEY_SQL = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"""


@q("f20_tenant_key", f"""
SELECT event_id, CASE WHEN regexp_full_match(k, '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-8][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}') THEN lower(k) END AS tenant
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(u) ELSE u END AS k FROM (SELECT event_id, {TENANT_KEY_SQL} AS u FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events) a) b) c
""")
def tenant_key(spark, d):
    keys = table(spark, d, "events").select("event_id", F.md5(F.col("event_id").cast("string")).alias("h")).selectExpr("event_id", f"{TENANT_KEY_SQL} AS u")
    raw = keys.select("event_id", F.when(F.col("event_id") % 2 == 0, F.upper("u")).otherwise(F.col("u")).alias("k"))
    return raw.select("event_id", P.tenant_key("k").alias("tenant"))


@q("f21_audio_kind", """
SELECT CASE WHEN ext IN ('mpeg', 'mpga') THEN 'mp3' WHEN ext IN ('wav', 'mp3', 'm4a', 'mp4', 'ogg', 'oga', 'webm', 'flac', 'aac') THEN ext
  ELSE CASE mime WHEN 'audio/x-wav' THEN 'wav' WHEN 'audio/mp4' THEN 'm4a' WHEN 'video/webm' THEN 'webm' END END AS kind, count(*) AS n
FROM (SELECT CASE event_id % 7 WHEN 0 THEN 'wav' WHEN 1 THEN 'mpeg' WHEN 2 THEN 'txt' WHEN 3 THEN 'flac' WHEN 4 THEN '' WHEN 5 THEN 'ogg' ELSE 'mp4' END AS ext,
  CASE event_id % 5 WHEN 0 THEN 'audio/x-wav' WHEN 1 THEN 'audio/mp4' WHEN 2 THEN 'video/webm' WHEN 3 THEN 'text/plain' END AS mime FROM events) x GROUP BY 1
""")
def audio_kind(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "concat('rec.', event_id, CASE event_id % 7 WHEN 0 THEN '.WAV' WHEN 1 THEN '.mpeg' WHEN 2 THEN '.txt' WHEN 3 THEN '.flac' WHEN 4 THEN '' WHEN 5 THEN '.Ogg' ELSE '.mp4' END) AS name",
        "CASE event_id % 5 WHEN 0 THEN 'audio/x-wav' WHEN 1 THEN 'Audio/MP4; rate=8000' WHEN 2 THEN 'video/webm' WHEN 3 THEN 'text/plain' END AS mime")
    return rows.groupBy(P.audio_kind("name", "mime").alias("kind")).agg(F.count("*").alias("n"))


@q("j01_stage_call_join", """
SELECT c.input_source, s.stage, count(*) AS n, sum(s.duration_ms)::BIGINT AS total_ms FROM stages_v s JOIN calls_v c ON c.id = s.call_id WHERE c.status = 'failed' GROUP BY 1, 2
""", ("calls_v", "stages_v"))
def stage_call_join(spark, d):
    failed = calls_view(spark, d).where("status = 'failed'").select(F.col("id").alias("call_id"), "input_source")
    return stages_view(spark, d).join(failed, "call_id").groupBy("input_source", "stage").agg(
        F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"))


PRICED_SQL = """round(CASE stage WHEN 'stt' THEN seconds / 60.0 * CASE provider WHEN 'whisper' THEN 0.006 ELSE 0.0043 END
 WHEN 'llm' THEN pt / 1000.0 * CASE model WHEN 'gpt-4o' THEN 0.0025 ELSE 0.00015 END + ct / 1000.0 * CASE model WHEN 'gpt-4o' THEN 0.01 ELSE 0.0006 END
 WHEN 'tts' THEN chars / 1000.0 * 0.015 ELSE 0.0 END, 9)"""


@q("j04_t16_stage_cost", f"""
SELECT stage, provider, model, count(*) AS n, round(sum(c), 6) AS cost FROM (SELECT *, {PRICED_SQL} AS c FROM
 (SELECT stage, provider, CASE part_key % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE 'other' END AS model,
   duration_ms / 1000.0 AS seconds, part_key % 900 AS pt, part_key % 300 AS ct, part_key % 2000 AS chars FROM stages_v) a) b GROUP BY 1, 2, 3
""", ("stages_v",))
def stage_cost(spark, d):
    rows = stages_view(spark, d).selectExpr(
        "stage", "provider", "CASE part_key % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE 'other' END AS model",
        "duration_ms / 1000.0D AS seconds", "part_key % 900 AS pt", "part_key % 300 AS ct", "part_key % 2000 AS chars")
    cost = F.round(pricing.stage_cost("stage", "provider", "seconds", "model", "pt", "ct", "chars"), 9)
    return rows.groupBy("stage", "provider", "model").agg(F.count("*").alias("n"), F.round(F.sum(cost), 6).alias("cost"))


@q("j05_fresh_suggestion_anti_join", """
WITH t AS (SELECT max(started_at) AS as_of FROM calls_v),
rec AS (SELECT owner_id, predicted_category AS fault_type, count(*) AS n FROM calls_v, t WHERE status = 'failed' AND predicted_category IS NOT NULL AND started_at > as_of - INTERVAL 24 HOUR GROUP BY 1, 2),
fresh AS (SELECT DISTINCT owner_id, injected_fault AS fault_type FROM calls_v, t WHERE id % 4 = 0 AND started_at > as_of - INTERVAL 2 HOUR)
SELECT owner_id, fault_type, n FROM rec WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.owner_id = rec.owner_id AND f.fault_type IS NOT DISTINCT FROM rec.fault_type)
""", ("calls_v",))
def fresh_suggestion_anti_join(spark, d):
    calls = calls_view(spark, d)
    as_of = newest(calls)
    made = calls.where("id % 4 = 0").select("owner_id", F.col("injected_fault").alias("fault_type"), F.col("started_at").alias("generated_at"))
    return L.without_fresh_suggestion(L.recurring_failures(calls, as_of), made, as_of).select("owner_id", "fault_type", "n")


@q("j06_visible_semi_join", """
SELECT s.stage, count(*) AS n FROM stages_v s WHERE s.call_id IN (SELECT id FROM calls_v WHERE id % 13 = 0 OR owner_id = 7) GROUP BY 1
""", ("calls_v", "stages_v"))
def visible_semi_join(spark, d):
    visible = L.scope(shared_calls(spark, d), 7, include_shared=True).select(F.col("id").alias("call_id"))
    return stages_view(spark, d).join(visible, "call_id", "left_semi").groupBy("stage").agg(F.count("*").alias("n"))


@q("j13_first_report_per_call", """
SELECT c.id, c.status, f.first_report FROM calls_v c LEFT JOIN
 (SELECT call_id, arg_min(report_text, (generated_at, report_id)) FILTER (WHERE report_text <> 'report 5-LOW') AS first_report FROM
  (SELECT o_orderkey % 5000 AS call_id, o_orderkey AS report_id, o_orderdate AS generated_at, 'report ' || o_orderpriority AS report_text FROM orders) r GROUP BY call_id) f ON f.call_id = c.id
""", ("calls_v",))
def first_report_per_call(spark, d):
    wanted = F.when(F.col("report_text") != "report 5-LOW", F.struct("generated_at", "report_id"))
    first = reports(spark, d).groupBy(F.col("call_id").alias("id")).agg(F.min_by("report_text", wanted).alias("first_report"))
    return calls_view(spark, d).select("id", "status").join(first, "id", "left")


@q("j14_library_merge", """
SELECT s_suppkey AS item, 'server' AS origin, s_name AS label FROM supplier
UNION ALL SELECT p_partkey, 'bundled', p_brand FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)
""")
def library_merge(spark, d):
    server = table(spark, d, "supplier").select(F.col("s_suppkey").alias("item"), F.lit("server").alias("origin"), F.col("s_name").alias("label"))
    bundled = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.lit("bundled").alias("origin"), F.col("p_brand").alias("label"))
    return L.merge_libraries(server, bundled, "item", [0, 6, 2]).select("item", "origin", "label")


@q("j17_join_on_extracted_key", """
SELECT c.c_mktsegment, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM
 (SELECT 'call-' || o_custkey || '-script' AS long_id, o_totalprice FROM orders) o JOIN (SELECT 'call-' || c_custkey || '.wav' AS file, c_mktsegment FROM customer) c
 ON regexp_extract(o.long_id, '^(call-\\d+)', 1) = regexp_extract(c.file, '^(call-\\d+)', 1) GROUP BY 1
""")
def join_on_extracted_key(spark, d):
    key = lambda c: F.regexp_extract(c, r"^(call-\d+|stress-\d+)", 1).alias("short_id")
    orders = table(spark, d, "orders").select(key(F.format_string("call-%d-script", "o_custkey")), "o_totalprice")
    files = table(spark, d, "customer").select(key(F.format_string("call-%d.wav", "c_custkey")), "c_mktsegment")
    return orders.join(files, "short_id").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@q("a01_tenant_summary", """
SELECT owner_id, count(*) AS total, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status IN ('queued', 'in_progress')) AS in_flight,
  round(COALESCE(avg((epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0), 0), 12) AS avg_latency_s, round(COALESCE(sum(total_cost_usd), 0), 6) AS total_cost_usd,
  count(*) FILTER (WHERE started_at > (SELECT max(started_at) FROM calls_v) - INTERVAL 24 HOUR) AS used_24h,
  round(COALESCE(100.0 * count(*) FILTER (WHERE status = 'failed') / nullif(count(*) - count(*) FILTER (WHERE status IN ('queued', 'in_progress')), 0), 0), 9) AS failure_rate
FROM calls_v GROUP BY owner_id
""", ("calls_v",))
def tenant_summary(spark, d):
    calls = calls_view(spark, d)
    out = L.tenant_summary(calls, newest(calls))
    return out.withColumns({"avg_latency_s": F.round("avg_latency_s", 12), "total_cost_usd": F.round("total_cost_usd", 6), "failure_rate": F.round("failure_rate", 9)})


@q("a02_a03_failure_impact", """
WITH t AS (SELECT owner_id, count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE injected_fault IS NOT NULL) AS injected,
  avg(total_cost_usd) FILTER (WHERE status = 'completed' AND injected_fault IS NULL) AS ok, avg(total_cost_usd) FILTER (WHERE status = 'failed') AS bad
  FROM calls_v WHERE status IN ('completed', 'failed') GROUP BY owner_id),
p AS (SELECT *, COALESCE(ok, 0.00408) AS c, COALESCE(bad, ok, 0.00408) AS f FROM t)
SELECT owner_id, n, failed, injected, CASE WHEN ok IS NULL THEN 'reference' ELSE 'your_calls' END AS basis, round(c, 12) AS avg_call_usd, round(f, 12) AS avg_failed_call_usd,
  30000.0 AS monthly_calls, 3000.0 AS monthly_failures, round(30000 * c, 9) AS monthly_spend_usd, round(3000 * f, 9) AS wasted_usd, round(3000 * c, 9) AS retry_usd, round(3000 * f + 3000 * c, 9) AS monthly_impact_usd FROM p
""", ("calls_v",))
def failure_impact(spark, d):
    p = L.impact_projection(L.impact_totals(calls_view(spark, d)), F.lit(1000), F.lit(10.0))
    money = {c: F.round(c, 9) for c in ("monthly_spend_usd", "wasted_usd", "retry_usd", "monthly_impact_usd")}
    return p.withColumns({**money, "avg_call_usd": F.round("avg_call_usd", 12), "avg_failed_call_usd": F.round("avg_failed_call_usd", 12)}).drop("avg_ok", "avg_failed")


@q("a04_cost_by_failure", """
SELECT predicted_category AS fault_type, count(*) AS n, round(avg(total_cost_usd), 9) AS avg_cost_usd, round(min(total_cost_usd), 9) AS min_cost_usd, round(max(total_cost_usd), 9) AS max_cost_usd
FROM calls_v WHERE status = 'failed' AND total_cost_usd IS NOT NULL AND predicted_category IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1
""", ("calls_v",))
def cost_by_failure(spark, d):
    return rounded(L.cost_by_failure(calls_view(spark, d)))


@q("a05_cost_by_stage", """
WITH m AS (SELECT s.stage, s.provider, count(*) AS n, avg(s.cost_usd) AS a FROM stages_v s JOIN calls_v c ON c.id = s.call_id
  WHERE c.injected_fault IS NULL AND c.status IN ('completed', 'failed') AND s.cost_usd IS NOT NULL AND s.provider IS NOT NULL GROUP BY 1, 2)
SELECT stage, provider, n, round(a, 9) AS avg_cost, round(a / sum(a) OVER (), 9) AS share, round(a * 30000, 5) AS monthly_usd FROM m
""", ("calls_v", "stages_v"))
def cost_by_stage(spark, d):
    out = L.cost_by_stage(calls_view(spark, d), stages_view(spark, d), 30000.0)
    return rounded(out.withColumn("monthly_usd", F.round("monthly_usd", 5)))


@q("a06_stage_latency", """
WITH lim AS (SELECT * FROM (VALUES ('stt', 5000), ('llm', 8000), ('tts', 5000)) v(stage, limit_ms)),
m AS (SELECT s.stage, count(*) AS n, quantile_cont(s.duration_ms, 0.5) AS p50, quantile_cont(s.duration_ms, 0.95) AS p95, max(s.duration_ms) AS mx,
  count(*) FILTER (WHERE s.status = 'timeout') AS timeouts, count(*) FILTER (WHERE s.status = 'error') AS errors
  FROM stages_v s JOIN calls_v c ON c.id = s.call_id WHERE c.status IN ('completed', 'failed') AND c.injected_fault IS NULL AND s.stage IN ('stt', 'llm', 'tts') AND s.duration_ms IS NOT NULL GROUP BY 1)
SELECT stage, limit_ms, COALESCE(n, 0) AS n, round(p50, 6) AS p50_ms, round(p95, 6) AS p95_ms, mx AS max_ms, COALESCE(timeouts, 0) AS timeouts, COALESCE(errors, 0) AS errors,
  round(COALESCE(least(1.0, p95 / limit_ms), 0), 6) AS utilisation, COALESCE(least(1.0, p95 / limit_ms), 0) > 0.8 AS alert FROM lim LEFT JOIN m USING (stage)
""", ("calls_v", "stages_v"))
def stage_latency(spark, d):
    return rounded(L.stage_limits_report(L.stage_latency(calls_view(spark, d), stages_view(spark, d))), 6)


@q("a06_stage_latency_by_tenant", """
SELECT c.owner_id, s.stage, count(*) AS n, round(quantile_cont(s.duration_ms, 0.5), 6) AS p50_ms, round(quantile_cont(s.duration_ms, 0.95), 6) AS p95_ms, max(s.duration_ms) AS max_ms,
  count(*) FILTER (WHERE s.status = 'timeout') AS timeouts, count(*) FILTER (WHERE s.status = 'error') AS errors
FROM stages_v s JOIN calls_v c ON c.id = s.call_id WHERE c.status IN ('completed', 'failed') AND c.injected_fault IS NULL AND s.stage IN ('stt', 'llm', 'tts') AND s.duration_ms IS NOT NULL GROUP BY 1, 2
""", ("calls_v", "stages_v"))
def stage_latency_by_tenant(spark, d):
    return rounded(L.stage_latency(calls_view(spark, d), stages_view(spark, d), ["owner_id"]), 6)


@q("a07_stage_seconds", """
SELECT call_id, round(sum(duration_ms) / 1000.0, 6) AS pipeline_s FROM stages_v WHERE stage IN ('stt', 'llm', 'tts') GROUP BY 1
""", ("stages_v",))
def pipeline_seconds(spark, d):
    return rounded(L.pipeline_seconds(stages_view(spark, d)), 6)


@q("a08_stage_shares", """
WITH p AS (SELECT call_id, stage, sum(cost_usd) AS c, sum(duration_ms) AS t, CASE stage WHEN 'stt' THEN 0 WHEN 'llm' THEN 1 WHEN 'tts' THEN 2 ELSE 3 END AS r FROM stages_v GROUP BY 1, 2)
SELECT call_id, stage, round(c / sum(c) OVER w, 6) AS cost_share, round(t / sum(t) OVER w, 6) AS time_share,
  round((sum(c) OVER o - c) / sum(c) OVER w, 6) AS arc_start, round(sum(c) OVER o / sum(c) OVER w, 6) AS arc_end
FROM p WINDOW w AS (PARTITION BY call_id), o AS (PARTITION BY call_id ORDER BY r ROWS UNBOUNDED PRECEDING)
""", ("stages_v",))
def stage_shares(spark, d):
    out = rounded(L.stage_shares(stages_view(spark, d)), 6)
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in ("arc_start", "arc_end")})


@q("a15_recurring_failures", """
SELECT owner_id, predicted_category AS fault_type, count(*) AS n, count(*) >= 3 AS recurring FROM calls_v
WHERE status = 'failed' AND predicted_category IS NOT NULL AND started_at > (SELECT max(started_at) FROM calls_v) - INTERVAL 24 HOUR GROUP BY 1, 2
""", ("calls_v",))
def recurring_failures(spark, d):
    calls = calls_view(spark, d)
    return L.recurring_failures(calls, newest(calls))


@q("a16_u01_spend_today", """
WITH t AS (SELECT date_trunc('day', max(started_at)) AS day0 FROM calls_v),
u AS (SELECT started_at AS spent_at, total_cost_usd AS cost FROM calls_v UNION ALL SELECT o_orderdate + INTERVAL 9000 DAY, o_totalprice / 1000000 FROM orders)
SELECT round(COALESCE(sum(cost), 0), 6) AS spent_usd, COALESCE(sum(cost), 0) >= 5 AS over_cap FROM u, t WHERE spent_at >= day0
""", ("calls_v",))
def spend_today(spark, d):
    calls = calls_view(spark, d)
    side = table(spark, d, "orders").select(
        F.expr("o_orderdate + INTERVAL 9000 DAYS").alias("at"), (F.col("o_totalprice") / 1000000).alias("cost_usd"))
    return rounded(L.spend_today(calls, side, newest(calls)), 6)


@q("a16_session_spend", """
SELECT round(sum(greatest(0, c)), 6) AS spent_usd, sum(greatest(0, c)) >= 1 AS over_cap FROM (SELECT CASE WHEN id % 4 = 0 THEN -total_cost_usd ELSE total_cost_usd END AS c FROM calls_v) x
""", ("calls_v",))
def session_spend(spark, d):
    costs = calls_view(spark, d).selectExpr("CASE WHEN id % 4 = 0 THEN -total_cost_usd ELSE total_cost_usd END AS cost_usd")
    return rounded(L.session_spend(costs), 6)


@q("a17_quota", """
SELECT owner_id, count(*) FILTER (WHERE started_at > (SELECT max(started_at) FROM calls_v) - INTERVAL 24 HOUR) AS used,
  greatest(0, 25 - count(*) FILTER (WHERE started_at > (SELECT max(started_at) FROM calls_v) - INTERVAL 24 HOUR)) AS remaining FROM calls_v GROUP BY 1
""", ("calls_v",))
def quota(spark, d):
    calls = calls_view(spark, d)
    return L.quota(calls, newest(calls))


@q("a17_quota_of_a_ledger", """
WITH t AS (SELECT CAST(max(started_at) AS DATE) AS today FROM calls_v), w AS (SELECT owner_id, count(*) AS n FROM calls_v, t WHERE started_at > CAST(today AS TIMESTAMP) - INTERVAL 24 HOUR AND started_at < today GROUP BY 1)
SELECT CAST(o.owner_id AS VARCHAR) AS owner_id, coalesce(n, 0) AS used, greatest(0, 25 - coalesce(n, 0)) AS remaining FROM (SELECT DISTINCT owner_id FROM calls_v) o LEFT JOIN w USING (owner_id)
""", ("calls_v",))
def quota_of_a_ledger(spark, d):
    """At the last midnight, from a ledger cut by call date: the scan reads the folders of one day of it, tenants come from their own table."""
    calls = calls_view(spark, d)
    past = calls.where(F.col("started_at") < F.date_trunc("day", newest(calls)))
    rows = past.select(F.col("id").cast("string").alias("id"), "started_at", "status", F.col("owner_id").cast("string").alias("owner_id"), F.col("total_cost_usd").cast("decimal(18,9)").alias("total_cost_usd"))
    folder = work_dir(spark, "quota")
    sinks.append_calls(rows.repartition(F.to_date("started_at")), f"{folder}/calls")
    as_of = F.date_trunc("day", newest(calls))
    return L.quota(load_calls(spark, folder), as_of, tenants=calls.select(F.col("owner_id").cast("string").alias("owner_id")))


@q("a23_status_counts", "SELECT status, count(*) AS n FROM calls_v GROUP BY 1", ("calls_v",))
def status_counts(spark, d):
    return L.counts_by(calls_view(spark, d), "status")


@q("a33_facet_groups", """
SELECT position, facet, label, n FROM (VALUES (0, 'core', 'Core scenarios'), (1, 'stress', 'Stress tests'), (2, 'quick', 'Quick clips')) v(position, facet, label) JOIN
 (SELECT CASE input_source WHEN 'sample' THEN 'core' WHEN 'upload' THEN 'quick' ELSE 'quick' END AS facet, count(*) AS n FROM calls_v GROUP BY 1) g USING (facet)
""", ("calls_v",))
def facet_groups(spark, d):
    rows = calls_view(spark, d).selectExpr("CASE input_source WHEN 'sample' THEN 'core' WHEN 'upload' THEN 'quick' END AS grp")
    return L.facet_groups(rows, "grp", [("core", "Core scenarios"), ("stress", "Stress tests"), ("quick", "Quick clips")], "quick")


@q("k02_recent_examples", """
WITH rec AS (SELECT owner_id, predicted_category FROM calls_v WHERE status = 'failed' AND predicted_category IS NOT NULL
  AND started_at > (SELECT max(started_at) FROM calls_v) - INTERVAL 240 HOUR GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT owner_id, predicted_category, id, rank FROM (SELECT c.owner_id, c.predicted_category, c.id, row_number() OVER (PARTITION BY c.owner_id, c.predicted_category ORDER BY c.started_at DESC, c.id) AS rank
  FROM calls_v c JOIN rec USING (owner_id, predicted_category)) x WHERE rank <= 10
""", ("calls_v",))
def recent_examples(spark, d):
    calls = calls_view(spark, d)
    wide = calls.where((F.col("status") == "failed") & F.col("predicted_category").isNotNull() & (F.col("started_at") > newest(calls) - L.hours(240)))
    rec = wide.groupBy("owner_id", F.col("predicted_category").alias("fault_type")).agg((F.count("*") >= 3).alias("recurring"))
    return L.recent_examples(calls, rec).select("owner_id", "predicted_category", "id", "rank")


@q("k03_stage_provider_order", "SELECT stage, provider, count(*) AS n, row_number() OVER (ORDER BY CASE stage WHEN 'stt' THEN 0 WHEN 'llm' THEN 1 WHEN 'tts' THEN 2 ELSE 3 END, provider) AS position FROM stages_v GROUP BY 1, 2", ("stages_v",))
def stage_provider_order(spark, d):
    from pyspark.sql import Window as W

    from callgrain.functions.columns import rank_in
    from callgrain.vocab import STAGES

    counted = L.counts_by(stages_view(spark, d), "stage", "provider")  # a handful of rows
    return counted.withColumn("position", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(rank_in(STAGES, "stage"), "provider")))


@q("k01_newest_failures", "SELECT id, epoch_us(started_at) AS us, predicted_category FROM calls_v WHERE status = 'failed' ORDER BY started_at DESC NULLS LAST, id LIMIT 50", ("calls_v",))
def newest_failures(spark, d):
    return calls_view(spark, d).where("status = 'failed'").orderBy(*L.newest_first()).limit(50).select("id", micros("started_at").alias("us"), "predicted_category")


@q("x05_nearest_rank", """
SELECT l_shipmode, p10, p50, p90 FROM (SELECT CASE l_linenumber WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'more' END AS l_shipmode, list(l_extendedprice ORDER BY l_extendedprice) AS v FROM lineitem GROUP BY 1) a,
 LATERAL (SELECT v[CAST(least(len(v) - 1, floor(len(v) * 0.1)) AS BIGINT) + 1] AS p10, v[CAST(least(len(v) - 1, floor(len(v) * 0.5)) AS BIGINT) + 1] AS p50, v[CAST(least(len(v) - 1, floor(len(v) * 0.9)) AS BIGINT) + 1] AS p90) b
""")
def nearest_rank_large(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("CASE l_linenumber WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'more' END AS l_shipmode", "l_extendedprice")
    return quantiles.nearest_rank_by(rows, ["l_shipmode"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, width=500.0)


@q("x05_upper_median_per_call", """
SELECT call_id, v[CAST(floor(len(v) / 2) AS BIGINT) + 1] AS median_ms FROM (SELECT call_id, list(duration_ms ORDER BY duration_ms) AS v FROM stages_v GROUP BY 1) a
""", ("stages_v",))
def upper_median_per_call(spark, d):
    return stages_view(spark, d).groupBy("call_id").agg(nearest_rank("duration_ms", 0.5).alias("median_ms"))


@q("t22_postmortem", """
WITH st AS (SELECT call_id, string_agg(stage || ' (' || status || ', ' || duration_ms || 'ms)', ' > ' ORDER BY started_at, line_number, duration_ms, stage, status, part_key) AS chain FROM stages_v GROUP BY call_id)
SELECT id, 'Classified as ' || predicted_category || '.' AS cause, COALESCE(chain, '') AS chain,
 'STT served by ' || stt_provider_used || CASE WHEN stt_failover_occurred THEN ' after failover from primary' ELSE '' END || '.' AS factors,
 'Investigate the ' || predicted_category || ' failures as a group before single calls.' AS recommendation FROM calls_v LEFT JOIN st ON call_id = id WHERE status = 'failed'
""", ("calls_v", "stages_v"))
def postmortem(spark, d):
    from callgrain.operators import reports as R

    failed = calls_view(spark, d).where("status = 'failed'")
    texts = R.postmortems(failed, stages_view(spark, d), ["started_at", "line_number", "duration_ms", "stage", "status", "part_key"])
    return R.sections(texts).select("id", "cause", F.regexp_replace(F.regexp_replace("chain", r"(?m)^\d+\. ", ""), "\n", " > ").alias("chain"), "factors", "recommendation")
