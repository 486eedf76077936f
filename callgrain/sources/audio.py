"""Audio files: catalog, 10 ms voice frames and signal quality.

Files arrive as ``binaryFile`` rows (path, content). A file is decoded inside
the task that reads it; only frame rows leave that task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callgrain import vocab as V
from callgrain.functions.columns import clamp, half_up, nearest_rank  # noqa: F401
from callgrain.functions.predicates import audio_kind

# fixed values: frame analysis
HOP_S, PITCH_WINDOW_S, PITCH_RATE = 0.01, 0.04, 8000
F0_MIN_HZ, F0_MAX_HZ = 60, 400
MIN_VOICING, PEAK_SHARE, MIN_ENERGY = 0.45, 0.9, 1e-7
MEL_BANDS, MEL_LOW_HZ, MEL_HIGH_HZ, CEPSTRA = 22, 100.0, 3800.0, 12
SIGNAL_FRAME_S, LOUD_WITHIN_DB, LOUD_FRAMES, FFT_SIZE = 0.02, 6.0, 300, 1024


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _u32(content: Column, offset: int) -> Column:
    """Little-endian unsigned 32-bit number at a byte offset."""
    byte = lambda i: F.conv(F.hex(F.substring(content, offset + 1 + i, 1)), 16, 10).try_cast("bigint")
    return byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216


def catalog(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(id, kind, bytes, duration_s[, manifest columns]): duration from the WAV header, null for other formats.

    Zero-byte files never reach this point: Spark's binary source does not list them.
    """
    name = F.element_at(F.split("path", "/"), -1)
    size = F.length("content").cast("bigint")
    wav = (F.substring("content", 1, 4) == F.lit(b"RIFF")) & (F.substring("content", 9, 4) == F.lit(b"WAVE"))
    rate = _u32(F.col("content"), 28)
    seconds = F.when(F.lower(name).endswith(".wav") & wav & (size >= 44) & (rate > 0), half_up((size - 44) / rate, 1))
    out = files.select(name.alias("id"), audio_kind(name, F.lit(None).cast("string")).alias("kind"), size.alias("bytes"), seconds.alias("duration_s"))
    if manifest is None:
        return out
    base = F.replace(F.regexp_replace("id", r"\.[^.]+$", ""), F.lit("-"), F.lit(" "))
    merged = out.join(manifest, "id", "left").withColumn("label", F.coalesce("label", F.concat(F.upper(F.substring(base, 1, 1)), F.expr("substring(replace(regexp_replace(id, '\\\\.[^.]+$', ''), '-', ' '), 2)"))))
    return merged.orderBy(F.coalesce("position", F.lit(1000)), "id")


# ------------------------------------------------------------------- decoding


def decode_pcm16(content: bytes) -> tuple[np.ndarray, int] | None:
    """Mono samples in -1..1 and the rate of a 16-bit PCM WAV, None for anything else."""
    if content is None or len(content) < 44 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    le = lambda at, n: int.from_bytes(content[at:at + n], "little")
    pos, fmt = 12, None
    while pos + 8 <= len(content):
        tag, size, body = content[pos:pos + 4], le(pos + 4, 4), pos + 8
        if tag == b"fmt ":
            if body + 16 > len(content):
                return None
            fmt = (le(body, 2), le(body + 2, 2), le(body + 4, 4), le(body + 14, 2))
        elif tag == b"data":
            if fmt is None or fmt[0] != 1 or fmt[3] != 16 or not 1 <= fmt[1] <= 8 or fmt[2] < 1000:
                return None
            channels = fmt[1]
            n = (min(len(content), body + size) - body) // (2 * channels)
            raw = np.frombuffer(content, dtype="<i2", count=n * channels, offset=body).reshape(n, channels)
            return raw.mean(axis=1) / 32768.0, fmt[2]
        pos = body + size + size % 2
    return None


# --------------------------------------------------------------- voice frames


@lru_cache(maxsize=8)
def _spectral_tables(rate: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(fft size, window, mel filters, cosine table) for a sample rate."""
    n = 1 << max(0, int(np.ceil(np.log2(rate * 0.032))))
    mel = lambda hz: 2595.0 * np.log10(1.0 + hz / 700.0)
    top = min(MEL_HIGH_HZ, rate / 2 - 100)
    edges = 700.0 * (10.0 ** (np.linspace(mel(MEL_LOW_HZ), mel(top), MEL_BANDS + 2) / 2595.0) - 1.0) * n / rate
    k = np.arange(n // 2)[None, :]
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.where((k > lo) & (k <= mid), (k - lo) / (mid - lo), np.where((k > mid) & (k < hi), (hi - k) / (hi - mid), 0.0))
    bank[:, 0] = 0.0
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    cosines = np.cos(np.pi * np.arange(1, CEPSTRA + 1)[:, None] * (np.arange(MEL_BANDS)[None, :] + 0.5) / MEL_BANDS)
    return n, window, bank, cosines


def _sliced(x: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Windows of ``width`` samples at ``starts``, zero-padded at the end."""
    padded = np.concatenate([x, np.zeros(width)])
    return padded[starts[:, None] + np.arange(width)[None, :]]


def voice_frames(samples: np.ndarray, rate: int, block: int = 2048) -> dict[str, np.ndarray]:
    """Level, pitch, voicing and spectral envelope per 10 ms, vectorised over blocks of frames."""
    half_up_int = lambda v: int(np.floor(v + 0.5))
    hop = half_up_int(rate * HOP_S)
    count = max(0, (len(samples) - half_up_int(rate * PITCH_WINDOW_S)) // hop)
    dec = max(1, half_up_int(rate / PITCH_RATE))
    low = samples[: len(samples) // dec * dec].reshape(-1, dec).mean(axis=1)
    low_rate = rate / dec
    win, low_hop = half_up_int(low_rate * PITCH_WINDOW_S), half_up_int(low_rate * HOP_S)
    lag_lo, lag_hi = int(np.floor(low_rate / F0_MAX_HZ)), int(np.ceil(low_rate / F0_MIN_HZ))
    n_fft, hann, bank, cosines = _spectral_tables(rate)
    db, f0, voicing = np.zeros(count, np.float32), np.zeros(count, np.float32), np.zeros(count, np.float32)
    cep = np.zeros((count, CEPSTRA), np.float32)
    for at in range(0, count, block):
        idx = np.arange(at, min(count, at + block))
        level = _sliced(samples, idx * hop, hop * 2)
        db[idx] = 10 * np.log10((level**2).sum(axis=1) / (hop * 2) + 1e-12)
        spectrum = np.abs(np.fft.rfft(_sliced(samples, idx * hop, n_fft) * hann, axis=1)[:, : n_fft // 2]) ** 2
        cep[idx] = np.log(spectrum @ bank.T + 1e-10) @ cosines.T / MEL_BANDS
        usable = idx[idx * low_hop + win + lag_hi <= len(low)]
        if len(usable) == 0:
            continue
        seg = low[usable[:, None] * low_hop + np.arange(win + lag_hi)[None, :]]
        seg = seg - seg.mean(axis=1, keepdims=True)
        head = seg[:, :win]
        e0 = (head**2).sum(axis=1)
        lags = np.arange(lag_lo, lag_hi + 1)
        shifted = np.lib.stride_tricks.sliding_window_view(seg, win, axis=1)[:, lag_lo:lag_hi + 1]
        corr = np.einsum("fw,flw->fl", head, shifted)
        energy = (shifted**2).sum(axis=2)
        ncc = corr / np.sqrt(e0[:, None] * energy + 1e-12)
        best = np.maximum(ncc.max(axis=1), 0.0)
        inner = ncc[:, 1:-1]
        peak = (inner >= PEAK_SHARE * best[:, None]) & (inner >= ncc[:, :-2]) & (inner >= ncc[:, 2:])
        ok = (e0 >= MIN_ENERGY) & (best >= MIN_VOICING) & peak.any(axis=1)
        pick = lags[1:-1][peak.argmax(axis=1)]
        f0[usable[ok]] = low_rate / pick[ok]
        voicing[usable[ok]] = best[ok]
    floor = float(np.sort(db)[int(np.floor(count * 0.1))]) if count else -100.0
    return {"f0": f0, "voicing": voicing, "db": db, "cep": cep, "floor_db": floor, "hop_s": hop / rate}


FRAME_SCHEMA = "path string, frame_idx bigint, hop_s double, f0 float, voicing float, db float, floor_db double, cep array<float>"


def audio_frames(files: DataFrame) -> DataFrame:
    """Voice frames of every readable file: (path, frame_idx, hop_s, f0, voicing, db, floor_db, cep)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                pcm = decode_pcm16(bytes(content) if content is not None else None)
                if pcm is None:
                    continue
                fr = voice_frames(*pcm)
                n = len(fr["db"])
                if n == 0:
                    continue
                yield pd.DataFrame({
                    "path": path, "frame_idx": np.arange(n), "hop_s": fr["hop_s"], "f0": fr["f0"], "voicing": fr["voicing"], "db": fr["db"],
                    "floor_db": fr["floor_db"], "cep": list(fr["cep"]),
                })

    return files.select("path", "content").mapInPandas(run, FRAME_SCHEMA)


# -------------------------------------------------------------- signal quality

SIGNAL_SCHEMA = "path string, frame_idx bigint, rate int, samples bigint, clipped bigint, db double, lo double, hi double"


def signal_frames(files: DataFrame) -> DataFrame:
    """20 ms frames: level, and the energy of the speech band and of 5-7 kHz where a full FFT window fits.

    Recordings shorter than half a second are left out. ``samples`` and
    ``clipped`` are per frame (the tail counts with the last frame).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                pcm = decode_pcm16(bytes(content) if content is not None else None)
                if pcm is None or len(pcm[0]) < pcm[1] * 0.5:
                    continue
                x, rate = pcm
                width = int(np.floor(rate * SIGNAL_FRAME_S + 0.5))
                n = len(x) // width
                body = x[: n * width].reshape(n, width)
                hits = np.abs(x) >= 0.999
                clipped = hits[: n * width].reshape(n, width).sum(axis=1)
                sizes = np.full(n, width)
                sizes[-1] += len(x) - n * width
                clipped[-1] += int(hits[n * width:].sum())
                lo, hi = np.full(n, np.nan), np.full(n, np.nan)
                if rate >= 16000:
                    starts = np.arange(n) * width
                    fits = starts + FFT_SIZE <= len(x)
                    hz = np.arange(FFT_SIZE // 2) * rate / FFT_SIZE
                    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FFT_SIZE) / (FFT_SIZE - 1))
                    power = np.abs(np.fft.rfft(_sliced(x, starts[fits], FFT_SIZE) * window, axis=1)[:, : FFT_SIZE // 2]) ** 2
                    lo[fits] = power[:, (hz >= 500) & (hz <= 2500)].sum(axis=1)
                    hi[fits] = power[:, (hz >= 5000) & (hz <= 7000)].sum(axis=1)
                out = pd.DataFrame({
                    "path": path, "frame_idx": np.arange(n), "rate": rate, "samples": sizes, "clipped": clipped,
                    "db": 10 * np.log10((body**2).mean(axis=1) + 1e-12), "lo": lo, "hi": hi,
                })
                yield out.astype({"lo": object, "hi": object}).where(out.notna(), None)

    return files.select("path", "content").mapInPandas(run, SIGNAL_SCHEMA)


def signal_quality(frames: DataFrame) -> DataFrame:
    """Noise floor, speech level, signal-to-noise, clipping, bandwidth and dynamics per file.

    The frames of a file are bounded by its length, so its percentiles are
    taken over its own sorted levels.
    """
    base = frames.groupBy("path").agg(
        F.max("rate").alias("sample_rate"), F.sum("samples").alias("n_samples"), F.sum("clipped").alias("n_clipped"),
        nearest_rank("db", 0.2).alias("floor"), nearest_rank("db", 0.9).alias("speech"),
    )
    rows = frames.join(base.select("path", "floor", "speech"), "path")
    active = F.when(F.col("db") > F.col("floor") + 10, F.col("db"))
    spread = rows.groupBy("path").agg(F.count(active).alias("n_active"), F.stddev_pop(active).alias("sd"))
    loud = rows.where((F.col("db") >= F.col("speech") - LOUD_WITHIN_DB) & F.col("lo").isNotNull())
    first = loud.withColumn("k", F.row_number().over(W.partitionBy("path").orderBy("frame_idx"))).where(F.col("k") <= LOUD_FRAMES)
    bands = first.groupBy("path").agg(F.count("*").alias("n_loud"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    joined = base.join(spread, "path").join(bands, "path", "left")
    hf = F.when(F.col("n_loud") >= 5, half_up(F.lit(10.0) * F.log10((F.col("hi") + 1e-12) / (F.col("lo") + 1e-12)), 1))
    sd = F.when(F.col("n_active") >= 10, F.col("sd")).otherwise(F.lit(0.0))
    out = joined.select(
        "path", half_up(F.col("n_samples") / F.col("sample_rate"), 1).alias("duration_s"), "sample_rate",
        half_up("floor", 1).alias("noise_floor_db"), half_up("speech", 1).alias("speech_level_db"),
        half_up(F.least(F.lit(60.0), F.col("speech") - F.col("floor")), 1).alias("snr_db"), (F.col("n_clipped") / F.col("n_samples")).alias("clipping_ratio"),
        hf.alias("hf_ratio_db"), sd.alias("__sd"), (F.col("n_active") >= 10).alias("__enough"),
    )
    limited = F.when(F.col("hf_ratio_db").isNotNull(), F.col("hf_ratio_db") <= V.BAND_LIMITED_HF_DB).otherwise(F.col("sample_rate") <= 8000)
    squashed = F.col("__enough") & (F.col("__sd") <= V.COMPRESSED_LEVEL_SD_DB) & (F.col("snr_db") >= V.COMPRESSED_MIN_SNR_DB)
    return out.withColumns({"band_limited": limited, "level_sd_db": half_up("__sd", 1), "dynamics_compressed": squashed}).drop("__sd", "__enough").withColumn(
        "condition", condition()
    )


def condition() -> Column:
    """Flags of a recording and the label they add up to."""
    noise = F.when(F.col("snr_db") < V.VERY_NOISY_DB, "very_noisy").when(F.col("snr_db") < V.NOISY_DB, "noisy")
    flags = F.array_compact(F.array(
        noise, F.when(F.col("band_limited"), "band_limited"), F.when(F.col("clipping_ratio") > V.CLIPPING_RATIO, "clipped"), F.when(F.col("dynamics_compressed"), "compressed")))
    one = F.when(flags[0] == "very_noisy", F.lit("noisy")).otherwise(F.get(flags, F.lit(0)))
    label = F.when(F.size(flags) == 0, F.when(F.col("snr_db") >= V.CLEAN_DB, "clean_wideband").otherwise("acceptable")).when(F.size(flags) == 1, one).otherwise("degraded")
    return F.struct(label.alias("label"), flags.alias("flags"))


def envelope(df: DataFrame, *, key: str, position: str, value: str, buckets: int, floor: float = 0.06, samples_per_bucket: int = 40) -> DataFrame:
    """Peak outline of a series: max of sampled absolute values per bucket over the tallest bucket, never below ``floor``."""
    sized = df.groupBy(key).agg(F.count("*").alias("__n")).withColumn("__size", F.greatest(F.lit(1), F.floor(F.col("__n") / buckets)))
    rows = df.join(sized, key).withColumn("bucket", F.floor(F.col(position) / F.col("__size")))
    step = F.greatest(F.lit(1), F.floor(F.col("__size") / samples_per_bucket))
    sampled = rows.where((F.col("bucket") < buckets) & ((F.col(position) - F.col("bucket") * F.col("__size")) % step == 0))
    peaks = sampled.groupBy(key, "bucket").agg(F.max(F.abs(value)).alias("peak"))
    top = F.max("peak").over(W.partitionBy(key))  # at most ``buckets`` rows per key
    scaled = F.col("peak") / F.when(top == 0, F.lit(1.0)).otherwise(top)
    return peaks.select(key, "bucket", F.greatest(F.lit(floor), scaled).alias("height"))
