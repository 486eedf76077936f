"""Call-shaped views over the driver's tables (see FIXTURES.md).

Every view is a lazy projection of one Parquet table, so column pruning and
filter push-down reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.operators.intervals import frames_per_slot, slot_of
from callgrain.operators.sequence import running_sum

TURNS_PER_CHUNK = 64
ARROW_BATCH = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # rows go to Python in batches of at most so many bytes: words and recordings take up to ten times that there, in each task
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def calls_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_from_events(table(spark, sf_dir, "events"))


def calls_from_events(events: DataFrame) -> DataFrame:
    """Call rows from event rows, as a table or a stream."""
    base = events.selectExpr(
        "event_id AS id",
        "user_id AS owner_id",
        "ts AS started_at",
        "value",
        "CASE WHEN event_type = 'error' THEN 'failed'"
        " WHEN event_type = 'view' AND event_id % 10 = 0 THEN 'in_progress' ELSE 'completed' END AS status",
        "CASE event_id % 3 WHEN 0 THEN 'sample' WHEN 1 THEN 'upload' ELSE 'recording' END AS input_source",
        "CASE WHEN event_id % 4 = 0 THEN 'whisper' ELSE 'deepgram' END AS stt_provider_used",
        "CASE WHEN (event_type = 'error' AND event_id % 6 <> 0) OR event_id % 11 = 0 THEN"
        " CASE event_id % 7 WHEN 0 THEN 'bad_stt' WHEN 1 THEN 'hallucination' WHEN 2 THEN 'tts_glitch'"
        " WHEN 3 THEN 'timeout' WHEN 4 THEN 'user_hangup' WHEN 5 THEN 'network_drop' ELSE 'exception' END"
        " END AS injected_fault",
        "value / 10000 AS total_cost_usd",
        "event_id % 40 AS ab_run_id",
        "CASE WHEN event_id % 80 < 40 THEN 'A' ELSE 'B' END AS ab_side",
    )
    return base.selectExpr(
        "id",
        "owner_id",
        "started_at",
        "CASE WHEN status <> 'in_progress' THEN"
        " timestampadd(MICROSECOND, CAST(round(value * 100000) AS BIGINT), started_at) END AS ended_at",
        "value / 10 AS latency_s",
        "status",
        "input_source",
        "stt_provider_used",
        "id % 9 = 4 AS stt_failover_occurred",
        "injected_fault",
        "CASE WHEN injected_fault IS NULL AND id % 2 = 0 THEN 'control' END AS label_source",
        "CASE WHEN status = 'in_progress' THEN NULL WHEN status = 'completed' THEN 'ok'"
        " WHEN id % 5 = 0 THEN 'timeout' ELSE COALESCE(injected_fault, 'bad_stt') END AS predicted_category",
        "total_cost_usd",
        "ab_run_id",
        "ab_side",
    )


def stages_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS call_id",
        "CASE l_linenumber WHEN 1 THEN 'stt' WHEN 2 THEN 'llm' WHEN 3 THEN 'tts' ELSE 'analysis' END AS stage",
        "CASE WHEN l_linenumber = 1 AND l_suppkey % 4 = 0 THEN 'whisper' WHEN l_linenumber = 1 THEN 'deepgram'"
        " ELSE 'openai' END AS provider",
        "CAST(l_quantity * 200 AS INT) AS duration_ms",
        "CASE WHEN l_returnflag = 'R' AND l_partkey % 10 = 0 THEN 'timeout'"
        " WHEN l_returnflag = 'A' AND l_partkey % 10 = 0 THEN 'error' ELSE 'ok' END AS status",
        "l_extendedprice / 10000000 AS cost_usd",
        "l_shipdate AS started_at",
        "l_partkey AS part_key",
        "l_linenumber AS line_number",
    )


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Deals rows that are about to be exploded. As many parts as any shuffle has: by their bytes they would be put into too few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def words_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per spoken word: (call_id, chunk, turn, pos, word, speaker, start_ms, end_ms, confidence).

    ``chunk`` cuts a call into runs of turns; it is the unit every ordered
    operator partitions by, so one long call does not become one task. Turns are
    dealt by (call_id, chunk) before they are cut into words.
    """
    said = conversations(spark, sf_dir).select(
        F.col("conv_id").alias("call_id"), F.expr(f"turn div {TURNS_PER_CHUNK}").alias("chunk"), "turn", F.col("role").alias("speaker"), "text"
    )
    words = (
        dealt(said, "call_id", "chunk")
        .select("call_id", "chunk", "turn", "speaker", F.posexplode(F.split("text", " ")).alias("p", "word"))
        .select("call_id", "chunk", "turn", "speaker", F.col("p").cast("bigint").alias("pos"), "word")
        .withColumn("dur_ms", (F.length("word") * 60).cast("bigint"))
        .withColumn(
            "gap_ms",
            F.expr(
                "CAST(CASE WHEN pos % 53 = 52 THEN 1700 WHEN pos % 17 = 16 THEN 800"
                " WHEN pos = 0 THEN 300 ELSE 40 END AS BIGINT)"
            ),
        )
    )
    timed = running_sum(
        words, key=["call_id"], chunk="chunk", order=["turn", "pos"], sums={"clock_ms": F.col("dur_ms") + F.col("gap_ms")}
    )
    # multiples of 1/64, so sums are exact in any order
    confidence = (F.lit(0.5) + ((F.length("word") * 7 + F.col("pos") * 13 + F.col("turn") * 5) % 32) / 64.0).alias("confidence")
    return timed.select(
        "call_id", "chunk", "turn", "pos", "word", "speaker",
        (F.col("clock_ms") - F.col("dur_ms")).alias("start_ms"), F.col("clock_ms").alias("end_ms"), confidence,
    )


def acted_words_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words, with scripted events: early starts, cut sentences, and short acknowledgements after which the other speaker goes on."""
    early = (F.col("pos") == 0) & (F.col("turn") % 3 == 1)
    nod = F.col("turn") % 5 == 2
    said = (
        F.when(nod & (F.col("pos") == 0), "Yeah,")
        .when(nod & (F.col("pos") == 1), "okay.")
        .when(F.col("turn") % 4 == 0, F.regexp_replace("word", "[.?!]+$", ""))
        .otherwise(F.col("word"))
    )
    return words_view(spark, sf_dir).withColumns({
        "start_ms": F.when(early, F.col("start_ms") - 550).otherwise(F.col("start_ms")), "word": said,
        "speaker": F.when(nod & (F.col("pos") >= 2), F.when(F.col("speaker") == "user", "assistant").otherwise("user")).otherwise(F.col("speaker")),
    })


def truth_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        words_view(spark, sf_dir)
        .where("turn % 4 <> 3")
        .groupBy("call_id", "turn", F.col("speaker").alias("who"))
        .agg((F.min("start_ms") + 200).alias("start_ms"), (F.max("end_ms") - 200).alias("end_ms"))
    )


def pairs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).selectExpr(
        "conv_id * 100 + turn AS pair_id",
        "text AS ref",
        "replace(replace(text, ' de ', ' '), ' la ', ' le ') AS hyp",
    )


def frames_view(spark: SparkSession, sf_dir: str, hop_ms: int = 50) -> DataFrame:
    """Pitch and level frames under every word: the two roles have different registers.

    Columns (call_id, frame_idx, f0, db, floor_db, frame_slot). Frames outside words do not exist, as
    an unvoiced frame carries no measurement. Words are cut at the slots and dealt by
    (call_id, frame_slot) before they become frames, so that a join on these does not deal the frames.
    """
    width = frames_per_slot(hop_ms)
    words = words_view(spark, sf_dir).select(
        "call_id", "turn", "pos", "speaker", F.floor(F.col("start_ms") / hop_ms).alias("lo"), F.floor((F.col("end_ms") - 1) / hop_ms).alias("hi"))
    # a word may end before it starts: its frames then run backwards, as a sequence does
    first, last = F.least("lo", "hi"), F.greatest("lo", "hi")
    pieces = dealt(
        words.select("*", F.explode(F.sequence(slot_of(first, width), slot_of(last, width))).alias("frame_slot")), "call_id", "frame_slot")
    span = F.sequence(F.greatest(first, F.col("frame_slot") * width), F.least(last, F.col("frame_slot") * width + width - 1))
    aside = (F.col("turn") % 7 == 5) & (F.col("turn") > 0)  # a quiet third voice
    base = F.when(aside, 330.0).when(F.col("speaker") == "user", 110.0).otherwise(210.0)
    wobble = ((F.col("frame_idx") * 7 + F.col("pos") * 3) % 11).cast("double")
    level = F.when(aside, -44.0).otherwise(-20.0)
    return (
        pieces.select("call_id", "turn", "pos", "speaker", F.explode(span).alias("frame_idx"), "frame_slot")
        .select(
            "call_id",
            F.col("frame_idx").cast("bigint").alias("frame_idx"),
            (base + wobble).alias("f0"),
            (level + ((F.col("frame_idx") * 5) % 7).cast("double")).alias("db"),
            F.lit(-70.0).alias("floor_db"),
            "frame_slot",
        )
    )
