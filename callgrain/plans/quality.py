"""Calibration, comparison and suite-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgrain.functions.columns import micros
from callgrain.operators import calibration as C
from callgrain.operators import compare as A
from callgrain.plans.ledger import newest, rounded
from callgrain.plans.registry import Catalog
from callgrain.sources.views import calls_view, stages_view, table

catalog = Catalog()
q = catalog.query

LABELLED = """SELECT *, COALESCE(injected_fault, 'ok') AS truth, predicted_category AS predicted FROM calls_v
 WHERE status IN ('completed', 'failed') AND predicted_category IS NOT NULL AND (injected_fault IS NOT NULL OR label_source = 'control')"""
SCORES = """SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(actual)::BIGINT AS actual,
 round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 9) AS precision, round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 9) AS recall
 FROM (SELECT truth AS label, CASE WHEN truth = predicted THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN truth = predicted THEN 0 ELSE n END AS fn, n AS actual FROM cells
  UNION ALL SELECT predicted, 0, CASE WHEN truth = predicted THEN 0 ELSE n END, 0, 0 FROM cells) m GROUP BY label"""


def labelled(spark, d):
    return C.labelled_calls(calls_view(spark, d))


def doc_labels(spark, d):
    """Label 'toxic' against a rule on the text length: the same operators on another table."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") % 3 == 0, "toxic").otherwise("clean").alias("predicted"))
    truth = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("truth"))
    return docs.join(truth, "doc_id")


@q("a09_confusion", f"SELECT truth, predicted, count(*) AS n FROM ({LABELLED}) l GROUP BY 1, 2", ("calls_v",))
def confusion(spark, d):
    return C.confusion(labelled(spark, d))


@q("a09_confusion_wide", f"""
SELECT truth, {", ".join(f"count(*) FILTER (WHERE predicted = '{c}') AS {c}" for c in ("bad_stt", "hallucination", "tts_glitch", "timeout", "user_hangup", "network_drop", "exception", "ok", "unknown"))}
FROM ({LABELLED}) l GROUP BY 1
""", ("calls_v",))
def confusion_wide(spark, d):
    return C.confusion_wide(labelled(spark, d))


@q("a10_u02_label_scores", f"WITH cells AS (SELECT truth, predicted, count(*) AS n FROM ({LABELLED}) l GROUP BY 1, 2) {SCORES}", ("calls_v",))
def label_scores(spark, d):
    return rounded(C.label_scores(C.confusion(labelled(spark, d))))


@q("a10_j12_document_label_scores", f"""
WITH cells AS (SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS truth, CASE WHEN n_chars % 3 = 0 THEN 'toxic' ELSE 'clean' END AS predicted, count(*) AS n
 FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) {SCORES}
""")
def document_label_scores(spark, d):
    return rounded(C.label_scores(C.confusion(doc_labels(spark, d))))


@q("a10_a12_accuracy", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE truth <> 'ok') AS fault_runs, count(*) FILTER (WHERE truth = 'ok') AS clean_runs, count(*) FILTER (WHERE truth = predicted) AS correct,
 round(count(*) FILTER (WHERE truth = predicted) / count(*), 9) AS accuracy, count(*) > 0 AND count(*) FILTER (WHERE truth <> 'ok') < 14 AS small_sample FROM ({LABELLED}) l
""", ("calls_v",))
def accuracy(spark, d):
    return rounded(C.small_sample(C.overall(C.confusion(labelled(spark, d)))))


@q("a10_accuracy_by_tenant", f"""
SELECT owner_id, count(*) AS total, count(*) FILTER (WHERE truth <> 'ok') AS fault_runs, count(*) FILTER (WHERE truth = 'ok') AS clean_runs,
 count(*) FILTER (WHERE truth = predicted) AS correct, round(count(*) FILTER (WHERE truth = predicted) / count(*), 9) AS accuracy FROM ({LABELLED}) l GROUP BY 1
""", ("calls_v",))
def accuracy_by_tenant(spark, d):
    return rounded(C.overall(C.confusion(labelled(spark, d), ["owner_id"]), ["owner_id"]))


@q("a11_hourly_trend", f"""
SELECT epoch_us(date_trunc('hour', started_at)) AS bucket_us, count(*) AS total, count(*) FILTER (WHERE truth = predicted) AS correct
FROM ({LABELLED}) l WHERE started_at > (SELECT max(started_at) FROM calls_v) - INTERVAL 24 HOUR GROUP BY 1
""", ("calls_v",))
def hourly_trend(spark, d):
    calls = calls_view(spark, d)
    return C.hourly_trend(C.labelled_calls(calls), newest(calls)).select(micros("bucket").alias("bucket_us"), "total", "correct")


@q("a12_right_of_row", f"SELECT truth, count(*) FILTER (WHERE truth = predicted) AS right_n, count(*) AS row_n FROM ({LABELLED}) l WHERE truth <> 'ok' GROUP BY 1", ("calls_v",))
def right_of_row(spark, d):
    return C.right_of_row(C.confusion(labelled(spark, d)))


@q("a13_reference_distribution", """
SELECT input_source, sum(c)::BIGINT AS n, COALESCE(sum(c) FILTER (WHERE p = 'ok'), 0)::BIGINT AS ok, COALESCE(string_agg(p || ':' || c, ',' ORDER BY p) FILTER (WHERE p <> 'ok'), '') AS other,
 round(sum(s) / sum(c), 10) AS avg_usd, round(min(lo), 10) AS min_usd, round(max(hi), 10) AS max_usd
FROM (SELECT input_source, predicted_category AS p, count(*) AS c, sum(total_cost_usd) AS s, min(total_cost_usd) AS lo, max(total_cost_usd) AS hi FROM calls_v WHERE predicted_category IS NOT NULL GROUP BY 1, 2) g GROUP BY 1
""", ("calls_v",))
def reference_distribution(spark, d):
    return rounded(C.reference_distribution(calls_view(spark, d), ["input_source"]), 10)


@q("k01_mistakes", f"SELECT id, epoch_us(started_at) AS us, truth, predicted, stt_provider_used FROM ({LABELLED}) l WHERE truth <> predicted ORDER BY started_at DESC, id LIMIT 25", ("calls_v",))
def mistakes(spark, d):
    return C.mistakes(labelled(spark, d)).select("id", micros("started_at").alias("us"), "truth", "predicted", "stt_provider_used")


@q("e09_fault_diagnosis", f"""
SELECT truth AS fault, truth <> 'hallucination' AS deterministic, count(*) FILTER (WHERE truth = predicted) AS right_n, count(*) AS row_n,
 count(*) FILTER (WHERE truth = predicted) || '/' || count(*) || ' (' || CAST(floor(100.0 * count(*) FILTER (WHERE truth = predicted) / count(*) + 0.5) AS BIGINT) || '%)' AS score
FROM ({LABELLED}) l WHERE truth <> 'ok' GROUP BY 1
""", ("calls_v",))
def fault_diagnosis(spark, d):
    return C.fault_diagnosis(C.confusion(labelled(spark, d)))


# ------------------------------------------------------------- comparing two sides

AB_CALLS = """SELECT id // 8 AS ab_run_id, CASE WHEN id % 8 < 4 THEN 'A' ELSE 'B' END AS ab_side, id, status, total_cost_usd * (CASE WHEN id % 8 < 4 THEN 1 ELSE 1 + (id // 8) % 5 END) AS total_cost_usd, started_at,
 stt_failover_occurred, CASE WHEN id % 3 = 0 THEN ((id * 7) % 20 + CASE WHEN id % 8 < 4 THEN 0 ELSE 10 * ((id // 8) % 3) END) / 100.0 END AS wer, 0.5 + (id % 40) / 100.0 AS avg_confidence,
 CASE WHEN id % 4 <> 0 THEN 'text ' || id END AS redacted_transcript, 'intent_' || (id % 5) AS intent FROM calls_v"""
AB_SIDES = f"""SELECT ab_run_id, ab_side, count(*) FILTER (WHERE fin) AS n, count(*) FILTER (WHERE status = 'failed') AS failed,
 COALESCE(count(*) FILTER (WHERE status = 'failed') / nullif(count(*) FILTER (WHERE fin), 0), 0) AS failure_rate,
 avg(total_cost_usd) FILTER (WHERE ok) AS cost_mean, sum(total_cost_usd) FILTER (WHERE ok) AS cost_sum, min(total_cost_usd) FILTER (WHERE ok) AS cost_lo, max(total_cost_usd) FILTER (WHERE ok) AS cost_hi,
 avg(ms / 1000.0) FILTER (WHERE ok) AS time_mean, min(ms / 1000.0) FILTER (WHERE ok) AS time_lo, max(ms / 1000.0) FILTER (WHERE ok) AS time_hi,
 avg(wer) FILTER (WHERE fin) AS wer_mean, min(wer) FILTER (WHERE fin) AS wer_lo, max(wer) FILTER (WHERE fin) AS wer_hi, avg(avg_confidence) FILTER (WHERE fin) AS conf,
 count(*) FILTER (WHERE fin AND stt_failover_occurred) AS failovers,
 arg_min(redacted_transcript, (started_at, id)) FILTER (WHERE fin AND redacted_transcript IS NOT NULL) AS sample_transcript, arg_min(intent, (started_at, id)) FILTER (WHERE fin AND redacted_transcript IS NOT NULL) AS primary_intent
 FROM (SELECT a.*, p.ms, status IN ('completed', 'failed') AS fin, status = 'completed' AS ok FROM ({AB_CALLS}) a
   LEFT JOIN (SELECT call_id, sum(duration_ms) AS ms FROM stages_v WHERE stage IN ('stt', 'llm', 'tts') GROUP BY 1) p ON p.call_id = a.id) x GROUP BY 1, 2"""


def ab_rows(spark, d):
    side_b = F.col("id") % 8 >= 4
    run = F.expr("id div 8")
    calls = calls_view(spark, d).withColumns({
        "ab_run_id": run, "ab_side": F.when(side_b, "B").otherwise("A"),
        "total_cost_usd": F.col("total_cost_usd") * F.when(side_b, 1 + run % 5).otherwise(1),
        "wer": F.when(F.col("id") % 3 == 0, ((F.col("id") * 7) % 20 + F.when(side_b, 10 * (run % 3)).otherwise(0)) / 100.0),
        "avg_confidence": F.lit(0.5) + (F.col("id") % 40) / 100.0,
        "redacted_transcript": F.when(F.col("id") % 4 != 0, F.concat(F.lit("text "), F.col("id").cast("string"))),
        "intent": F.concat(F.lit("intent_"), (F.col("id") % 5).cast("string")),
    })
    return A.ab_rows(calls, stages_view(spark, d))


@q("a20_side_summary", f"""
SELECT ab_run_id, ab_side, n, failed, round(failure_rate, 9) AS failure_rate, round(COALESCE(cost_mean, 0), 12) AS avg_cost_usd, round(COALESCE(cost_sum, 0), 9) AS total_cost_usd,
 round(time_mean, 9) AS avg_latency_s, round(wer_mean, 9) AS avg_wer, round(conf, 9) AS avg_confidence, failovers, sample_transcript, primary_intent FROM ({AB_SIDES}) s
""", ("calls_v", "stages_v"))
def side_summary(spark, d):
    s = A.side_summary(ab_rows(spark, d))
    nine = {c: F.round(c, 9) for c in ("failure_rate", "total_cost_usd", "avg_latency_s", "avg_wer", "avg_confidence")}
    return s.withColumns({**nine, "avg_cost_usd": F.round("avg_cost_usd", 12)}).select(
        "ab_run_id", "ab_side", "n", "failed", "failure_rate", "avg_cost_usd", "total_cost_usd", "avg_latency_s", "avg_wer", "avg_confidence", "failovers", "sample_transcript", "primary_intent")


@q("a21_r11_run_progress", """
SELECT ab_run_id, finished, expected, stale, CASE WHEN finished >= expected OR stale THEN 'done' ELSE 'running' END AS status FROM
 (SELECT id // 8 AS ab_run_id, count(*) FILTER (WHERE status IN ('completed', 'failed')) AS finished, 8 AS expected, min(started_at) < (SELECT max(started_at) FROM calls_v) - INTERVAL 5 MINUTE AS stale FROM calls_v GROUP BY 1) x
""", ("calls_v",))
def run_progress(spark, d):
    calls = calls_view(spark, d).withColumns({"ab_run_id": F.expr("id div 8")})
    runs = calls.groupBy("ab_run_id").agg(F.min("started_at").alias("created_at")).withColumn("iterations", F.lit(4))
    return A.run_progress(calls, runs, newest(calls))


LOWER = """CASE WHEN a.{m}_mean IS NULL OR b.{m}_mean IS NULL OR abs(a.{m}_mean - b.{m}_mean) < {need} THEN 'none'
 WHEN a.{m}_mean < b.{m}_mean AND a.{m}_hi < b.{m}_lo THEN 'A' WHEN a.{m}_mean > b.{m}_mean AND b.{m}_hi < a.{m}_lo THEN 'B' ELSE 'none' END"""


@q("a22_verdict", f"""
WITH s AS ({AB_SIDES}),
m AS (SELECT COALESCE(a.ab_run_id, b.ab_run_id) AS ab_run_id, COALESCE(a.n, 0) >= 2 AND COALESCE(b.n, 0) >= 2 AS enough,
 CASE WHEN abs(a.failure_rate - b.failure_rate) >= 0.5 THEN CASE WHEN a.failure_rate < b.failure_rate THEN 'A' ELSE 'B' END ELSE 'none' END AS fail,
 {LOWER.format(m="wer", need="0.03")} AS wer, {LOWER.format(m="time", need="greatest(0.4, (a.time_mean + b.time_mean) * 0.5 * 0.1)")} AS tim, {LOWER.format(m="cost", need="greatest(0.0002, (a.cost_mean + b.cost_mean) * 0.5 * 0.1)")} AS cos,
 COALESCE(a.failovers, 0) + COALESCE(b.failovers, 0) > 0 AS fell, a.wer_mean IS NOT NULL OR b.wer_mean IS NOT NULL AS has_ref
 FROM (SELECT * FROM s WHERE ab_side = 'A') a FULL JOIN (SELECT * FROM s WHERE ab_side = 'B') b ON a.ab_run_id = b.ab_run_id),
w AS (SELECT *, CASE WHEN NOT enough THEN 'insufficient' WHEN fail = 'none' AND wer = 'none' AND tim = 'none' AND cos = 'none' THEN 'tie'
 WHEN (fail = 'A' OR wer = 'A') AND (fail = 'B' OR wer = 'B') THEN 'tradeoff' WHEN fail = 'A' OR wer = 'A' THEN 'A' WHEN fail = 'B' OR wer = 'B' THEN 'B'
 WHEN (tim = 'A' OR cos = 'A') AND (tim = 'B' OR cos = 'B') THEN 'tradeoff' WHEN tim = 'A' OR cos = 'A' THEN 'A' ELSE 'B' END AS winner FROM m)
SELECT ab_run_id, winner, CASE WHEN enough THEN fail || ',' || CASE WHEN has_ref THEN wer || ',' ELSE '' END || tim || ',' || cos ELSE '' END AS better,
 CASE WHEN NOT enough THEN 0 ELSE CAST(fell AS INT) + CAST(NOT has_ref AS INT) + CASE WHEN winner = 'A' AND 'B' IN (fail, wer, tim, cos) THEN 1 WHEN winner = 'B' AND 'A' IN (fail, wer, tim, cos) THEN 1 ELSE 0 END END AS n_caveats,
 CASE winner WHEN 'insufficient' THEN 'Too few finished calls to decide; the least for each side is 2.' WHEN 'tie' THEN 'The sides are equal as far as the measurements can tell.'
  WHEN 'tradeoff' THEN CASE WHEN fail <> 'none' OR wer <> 'none' THEN 'The sides win on different quality measures.' ELSE 'Time speaks for one side and cost for the other.' END
  ELSE 'Config ' || winner || CASE WHEN fail <> 'none' OR wer <> 'none' THEN ' wins on quality.' ELSE ' is ' || CASE WHEN tim <> 'none' AND cos <> 'none' THEN 'faster and cheaper' WHEN tim <> 'none' THEN 'faster' ELSE 'cheaper' END || ' at equal quality.' END END AS headline FROM w
""", ("calls_v", "stages_v"))
def verdict(spark, d):
    v = A.ab_verdict(A.ab_metrics(A.side_summary(ab_rows(spark, d))))
    return v.select("ab_run_id", "winner", F.array_join(F.transform("metrics", lambda m: m["better"]), ",").alias("better"),
                    F.size("caveats").alias("n_caveats"), "headline")


# ----------------------------------------------------------------- suite history


def suite_runs(spark, d):
    """One run per (owner, 7 calls): each call is one prompt check."""
    rows = calls_view(spark, d).select(
        "owner_id", F.expr("id div 7").alias("run_id"), "started_at",
        F.struct(
            F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("id"), F.lit("q").alias("prompt"), F.lit("e").alias("expected"), F.lit("r").alias("response"),
            (F.col("id") % 5 == 1).alias("hallucinated"), F.lit("").alias("reasoning"), F.when(F.col("status") == "failed", F.lit(True)).alias("error")).alias("r"))
    return rows.groupBy("run_id", (F.col("run_id") % 40).alias("owner_id")).agg(F.min("started_at").alias("run_at"), F.collect_list("r").alias("results"))


SUITE = """SELECT id // 7 AS run_id, (id // 7) % 40 AS owner_id, id % 7 AS p, id % 5 = 1 AS hallucinated, status = 'failed' AS error, started_at FROM calls_v"""


@q("a19_suite_run_summary", f"""
SELECT run_id, owner_id, epoch_us(min(started_at)) AS run_us, count(*) FILTER (WHERE NOT error) AS total, count(*) FILTER (WHERE NOT error AND hallucinated) AS hallucinated, count(*) FILTER (WHERE error) AS errors,
 round(count(*) FILTER (WHERE NOT error AND hallucinated) / count(*) FILTER (WHERE NOT error), 9) AS rate FROM ({SUITE}) s GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT error) > 0
""", ("calls_v",))
def suite_run_summary(spark, d):
    return rounded(A.suite_run_summary(suite_runs(spark, d))).withColumn("run_us", micros("run_at")).drop("run_at")


@q("a19_suite_overview", f"""
SELECT owner_id, count(*) AS runs, round(avg(rate), 9) AS avg_rate, round(arg_max(rate, (run_at, run_id)), 9) AS latest_rate FROM (SELECT run_id, owner_id, min(started_at) AS run_at,
 count(*) FILTER (WHERE NOT error AND hallucinated) / count(*) FILTER (WHERE NOT error) AS rate FROM ({SUITE}) s GROUP BY 1, 2 HAVING count(*) FILTER (WHERE NOT error) > 0) x GROUP BY 1
""", ("calls_v",))
def suite_overview(spark, d):
    return rounded(A.suite_overview(A.suite_run_summary(suite_runs(spark, d))))


@q("a18_suite_per_prompt", f"""
WITH r AS (SELECT run_id, owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY min(started_at) DESC, run_id DESC) AS k FROM ({SUITE}) s GROUP BY 1, 2)
SELECT s.owner_id, 'p' || p AS prompt_id, count(*) AS runs, count(*) FILTER (WHERE hallucinated) AS hallucinated, round(count(*) FILTER (WHERE hallucinated) / count(*), 9) AS rate
FROM ({SUITE}) s JOIN r ON r.run_id = s.run_id AND r.k <= 10 WHERE NOT error GROUP BY 1, 2
""", ("calls_v",))
def suite_per_prompt(spark, d):
    return rounded(A.suite_per_prompt(suite_runs(spark, d)))
