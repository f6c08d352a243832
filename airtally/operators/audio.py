"""Fingerprints of audio windows, and spectral peaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airtally.functions.hashes import sign_fingerprint
from airtally.operators.segments import keep_first
from airtally.sources.audio import TARGET_RATE

# Bands and frames of the fingerprint.
EDGES = 257
FFT_SIZE = 4096
HOP = FFT_SIZE // 2
LOW_HZ, HIGH_HZ = 200.0, 4000.0
FLOOR = 1e-9
MAX_PEAKS = 64


def band_edges(fft_size: int = FFT_SIZE, rate: int = TARGET_RATE) -> np.ndarray:
    """Spectrum bins at which the bands begin, evenly spaced on a log scale."""
    top = min(HIGH_HZ, rate / 2 - 1)
    hertz = np.exp(np.linspace(np.log(LOW_HZ), np.log(top), EDGES))
    return np.clip((hertz * fft_size / rate).astype(int), 1, fft_size // 2 - 1)


def band_levels(pcm: bytes) -> list[float]:
    """Mean log energy per band; empty for audio shorter than one frame.

    The last of the 257 values has no band of its own and stays 0. A band without
    bins has the energy floor.
    """
    samples = np.frombuffer(pcm, dtype="<i2").astype(np.float32) / np.float32(32768)
    if len(samples) < FFT_SIZE:
        return []
    frames = np.lib.stride_tricks.sliding_window_view(samples, FFT_SIZE)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FFT_SIZE), axis=1)) ** 2
    edges = band_edges()
    running = np.concatenate([np.zeros((len(power), 1)), np.cumsum(power, axis=1)], axis=1)
    energy = running[:, edges[1:]] - running[:, edges[:-1]]
    # Differences of running sums may fall a hair below zero.
    levels = np.log(np.maximum(energy, 0) + FLOOR).mean(axis=0)
    return [*levels.tolist(), 0.0]


def _levels(pcm: pd.Series) -> pd.Series:
    return pcm.map(lambda b: None if b is None else band_levels(b))


def fingerprint_windows(windows: DataFrame) -> DataFrame:
    """(path, start_ms, fingerprint_hash) of audio windows. The transform runs in
    Python on Arrow batches, the signs and hex digits are columns again. Audio
    shorter than a frame has the hash of all zeros."""
    measured = windows.filter(F.col("pcm").isNotNull()).withColumn(
        "levels", F.pandas_udf(_levels, "array<double>")("pcm")
    )
    empty = F.lit("0" * 64)
    value = F.when(F.size("levels") == 0, empty).otherwise(sign_fingerprint("levels"))
    return measured.select("path", "start_ms", value.alias("fingerprint_hash"))


def clip_starts(total: Column | str, window: int = 3000, hop: int = 1500) -> Column:
    """Start positions of the windows that fit into a clip, in milliseconds."""
    length = F.col(total) if isinstance(total, str) else total
    fits = length >= window
    return F.when(fits, F.sequence(F.lit(0), length - window, F.lit(hop))).otherwise(
        F.array().cast("array<int>")
    )


def spectral_peaks(cells: DataFrame, clip: str = "clip_id", limit: int = MAX_PEAKS) -> DataFrame:
    """The strongest local maxima of each clip's spectrogram (clip, t, f, amplitude).

    Every cell is sent to its four neighbours and met there by one aggregate, so
    no task needs a whole clip. Border cells lack a neighbour and never count.
    """
    here = F.array(F.struct(F.col("t").alias("t"), F.col("f").alias("f"), F.lit(True).alias("own")))
    steps = [(0, -1), (0, 1), (-1, 0), (1, 0)]
    around = F.array(
        *[
            F.struct((F.col("t") + dt).alias("t"), (F.col("f") + df).alias("f"), F.lit(False).alias("own"))
            for dt, df in steps
        ]
    )
    sent = cells.select(clip, "amplitude", F.inline(F.concat(here, around)))
    met = sent.groupBy(clip, "t", "f").agg(
        F.max(F.when(F.col("own"), F.col("amplitude"))).alias("amplitude"),
        F.max(F.when(~F.col("own"), F.col("amplitude"))).alias("highest"),
        F.count_if(~F.col("own")).alias("neighbours"),
    )
    peaks = met.filter((F.col("neighbours") == 4) & (F.col("amplitude") > F.col("highest")))
    order = [F.col("amplitude").desc(), F.col("t"), F.col("f")]
    return keep_first(peaks.select(clip, "t", "f", "amplitude"), [clip], order, limit)
