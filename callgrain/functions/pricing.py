"""Stage cost from the fixed price list (unknown models fall back to the default model)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callgrain import vocab as V
from callgrain.functions.columns import col, lookup


def stt_cost(provider: str | Column, seconds: str | Column) -> Column:
    per_minute = lookup(V.STT_PER_MINUTE, provider, V.STT_PER_MINUTE["deepgram"])
    return F.coalesce(col(seconds), F.lit(0)) / 60.0 * per_minute


def llm_cost(model: str | Column, prompt_tokens: str | Column, completion_tokens: str | Column) -> Column:
    default_in, default_out = V.LLM_PER_1K_TOKENS[V.DEFAULT_LLM]
    rate_in = lookup({m: r[0] for m, r in V.LLM_PER_1K_TOKENS.items()}, model, default_in)
    rate_out = lookup({m: r[1] for m, r in V.LLM_PER_1K_TOKENS.items()}, model, default_out)
    tokens_in = F.coalesce(col(prompt_tokens), F.lit(0)) / 1000.0
    tokens_out = F.coalesce(col(completion_tokens), F.lit(0)) / 1000.0
    return tokens_in * rate_in + tokens_out * rate_out


def tts_cost(model: str | Column, chars: str | Column) -> Column:
    rate = lookup(V.TTS_PER_1K_CHARS, model, V.TTS_PER_1K_CHARS[V.DEFAULT_TTS])
    return F.coalesce(col(chars), F.lit(0)) / 1000.0 * rate


def stage_cost(
    stage: str | Column, provider: str | Column, seconds: str | Column, model: str | Column,
    prompt_tokens: str | Column, completion_tokens: str | Column, chars: str | Column,
) -> Column:
    return (
        F.when(col(stage) == "stt", stt_cost(provider, seconds))
        .when(col(stage) == "llm", llm_cost(model, prompt_tokens, completion_tokens))
        .when(col(stage) == "tts", tts_cost(model, chars))
        .otherwise(F.lit(0.0))
    )
