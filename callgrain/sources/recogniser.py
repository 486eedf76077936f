"""Recogniser output documents to word tables, and scripted timelines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgrain.functions.columns import clamp, half_up
from callgrain.operators.intervals import points_in_intervals

WORDS_PER_CHUNK = 4096

FLAT = """id STRING, provider STRING, transcript STRING, duration DOUBLE,
 words ARRAY<STRUCT<word STRING, punctuated_word STRING, confidence DOUBLE, start DOUBLE, end DOUBLE, speaker INT>>"""
SEGMENTED = """id STRING, task STRING, language STRING, duration DOUBLE, text STRING,
 segments ARRAY<STRUCT<id INT, seek INT, start DOUBLE, end DOUBLE, text STRING, tokens ARRAY<INT>, temperature DOUBLE, avg_logprob DOUBLE, compression_ratio DOUBLE, no_speech_prob DOUBLE>>,
 words ARRAY<STRUCT<word STRING, start DOUBLE, end DOUBLE>>"""
TIMELINE = "id STRING, segments ARRAY<STRUCT<who STRING, text STRING, start DOUBLE, end DOUBLE>>"


def _ms(seconds: str | Column) -> Column:
    return half_up(F.col(seconds) * 1000 if isinstance(seconds, str) else seconds * 1000).cast("bigint")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def words_of(docs: DataFrame) -> DataFrame:
    """Word rows of flat documents; absent times and speakers stay null, the written form wins over the raw one."""
    rows = docs.select(F.col("id").alias("call_id"), F.posexplode("words").alias("pos", "w"))
    return rows.select(
        "call_id", F.expr(f"pos div {WORDS_PER_CHUNK}").alias("chunk"), F.lit(0).cast("bigint").alias("turn"), F.col("pos").cast("bigint").alias("pos"),
        F.coalesce(F.when(F.col("w.punctuated_word") != "", F.col("w.punctuated_word")), F.col("w.word")).alias("word"),
        F.coalesce("w.confidence", F.lit(0.0)).alias("confidence"), _ms("w.start").alias("start_ms"), _ms("w.end").alias("end_ms"),
        F.col("w.speaker").alias("speaker"),
    )


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return words_of(read_documents(spark, path, FLAT))


def log_confidence(avg_logprob: Column) -> Column:
    return clamp(F.exp(avg_logprob), 0.0, 1.0)


def segment_averages(segments: DataFrame) -> DataFrame:
    """(call_id, avg_logprob, confidence, no_speech_prob) over the segments of each call."""
    mean = F.avg(F.coalesce("avg_logprob", F.lit(0.0)))
    return segments.groupBy("call_id").agg(
        mean.alias("mean_logprob"), log_confidence(mean).alias("mean_confidence"), F.avg(F.coalesce("no_speech_prob", F.lit(0.0))).alias("no_speech_prob")
    )


def confidence_from_segments(words: DataFrame, segments: DataFrame, slot_ms: int = 30_000) -> DataFrame:
    """Gives each word the confidence of the first segment around its midpoint, else the mean of the call.

    ``segments``: (call_id, segment_id, start_ms, end_ms, avg_logprob, no_speech_prob).
    """
    spans = segments.select("call_id", "segment_id", (F.col("start_ms") * 2).alias("lo2"), (F.col("end_ms") * 2).alias("hi2"), "avg_logprob")
    middle = F.coalesce("start_ms", F.lit(0)) + F.coalesce("end_ms", F.lit(0))
    word = ["call_id", "turn", "pos"]
    inside = points_in_intervals(words.select(*word, "start_ms", "end_ms"), spans, key=["call_id"], point=middle, lo="lo2", hi="hi2", slot=2 * slot_ms)
    first = inside.groupBy(*word).agg(F.min_by(F.struct("avg_logprob"), "segment_id").alias("__s"))
    joined = words.join(first, word, "left").join(segment_averages(segments), "call_id", "left")
    own = log_confidence(F.coalesce("__s.avg_logprob", "mean_logprob"))
    conf = F.when(F.col("__s").isNotNull(), own).otherwise(F.coalesce("mean_confidence", F.lit(1.0)))
    return joined.withColumn("confidence", conf).drop("__s", "mean_logprob", "mean_confidence", "no_speech_prob")


@F.pandas_udf(T.ArrayType(T.StringType()))
def reattach_punctuation(words: pd.Series, texts: pd.Series) -> pd.Series:
    """Words with the punctuation that follows them in the text; a word found more than 12 characters ahead is left alone."""
    # fixed values: punctuation that may follow a word
    marks = frozenset(".,!?;:\"')…-")

    def one(items, text: str):
        low, at, out = text.lower(), 0, []
        for w in items:
            found = low.find(w.lower(), at)
            if found < 0 or found - at > 12:
                out.append(w)
                continue
            stop = end = found + len(w)
            while end < len(text) and text[end] in marks:
                end += 1
            out.append(w + text[stop:end])
            at = end
        return out

    return pd.Series([None if w is None else one(w, t or "") for w, t in zip(words, texts)])


def segmented_words(docs: DataFrame) -> DataFrame:
    """Word rows of segmented documents: punctuation re-attached, confidence from the segments, no speakers."""
    kept = F.filter(F.transform("words", lambda w: F.struct(F.trim(w["word"]).alias("word"), w["start"].alias("start"), w["end"].alias("end"))), lambda w: w["word"] != "")
    bare = docs.select("id", "text", kept.alias("w"))
    named = bare.select("id", "w", reattach_punctuation(F.transform("w", lambda x: x["word"]), F.coalesce("text", F.lit(""))).alias("p"))
    rows = named.select(F.col("id").alias("call_id"), F.posexplode(F.arrays_zip("w", "p")).alias("pos", "x"))
    words = rows.select(
        "call_id", F.expr(f"pos div {WORDS_PER_CHUNK}").alias("chunk"), F.lit(0).cast("bigint").alias("turn"), F.col("pos").cast("bigint").alias("pos"),
        F.col("x.p").alias("word"), _ms("x.w.start").alias("start_ms"), _ms("x.w.end").alias("end_ms"), F.lit(None).cast("int").alias("speaker"),
    )
    segments = docs.select(F.col("id").alias("call_id"), F.posexplode("segments").alias("segment_id", "s")).select(
        "call_id", "segment_id", _ms("s.start").alias("start_ms"), _ms("s.end").alias("end_ms"), "s.avg_logprob", "s.no_speech_prob")
    return confidence_from_segments(words, segments)


def read_segmented_words(spark: SparkSession, path: str) -> DataFrame:
    return segmented_words(read_documents(spark, path, SEGMENTED))


def parsed(docs: DataFrame, column: str, schema: str) -> DataFrame:
    """Documents held as JSON text in a column, in the declared schema."""
    return docs.select(F.from_json(column, schema).alias("__doc")).select("__doc.*")


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    return timeline_of(read_documents(spark, path, TIMELINE))


def timeline_of(docs: DataFrame) -> DataFrame:
    """Scripted lines: (call_id, turn, chunk, who, text, start_ms, end_ms)."""
    rows = docs.select(F.col("id").alias("call_id"), F.posexplode("segments").alias("turn", "s"))
    return rows.select(
        "call_id", F.col("turn").cast("bigint").alias("turn"), F.expr(f"turn div {WORDS_PER_CHUNK}").alias("chunk"),
        "s.who", "s.text", _ms("s.start").alias("start_ms"), _ms("s.end").alias("end_ms"),
    )
