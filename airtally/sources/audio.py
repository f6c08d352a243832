"""Audio clips: WAV files to windows of samples."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TARGET_RATE = 16_000
WINDOW_SCHEMA = "path string, start_ms bigint, pcm binary, problem string"


def parse_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples and sample rate of a 16-bit PCM file; a cut-off end is accepted."""
    if len(data) < 44 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    layout, at = None, 12
    while at + 8 <= len(data):
        name, size = data[at:at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = at + 8
        if name == b"fmt ":
            if body + 16 > len(data):
                raise ValueError("truncated fmt chunk")
            layout = struct.unpack_from("<HHIIHH", data, body)
        elif name == b"data":
            break
        at = body + size + size % 2
    else:
        raise ValueError("no data chunk")
    if layout is None or layout[0] != 1:
        raise ValueError("only PCM is supported")
    if layout[5] != 16:
        raise ValueError("only 16-bit samples are supported")
    channels, rate = layout[1], layout[2]
    size = min(size, len(data) - body)
    frames = size // (2 * channels)
    samples = np.frombuffer(data, dtype="<i2", count=frames * channels, offset=body)
    total = samples.reshape(frames, channels).astype(np.int64).sum(axis=1)
    # The mean of the channels, rounded toward zero.
    mono = np.sign(total) * (np.abs(total) // channels)
    return np.clip(mono, -32768, 32767).astype(np.int16), rate


def resample(samples: np.ndarray, rate: int, target: int = TARGET_RATE) -> np.ndarray:
    """Linear interpolation, truncated to whole samples."""
    if rate == target or len(samples) == 0:
        return samples
    position = np.arange(int(len(samples) / (rate / target))) * (rate / target)
    low = np.minimum(position.astype(np.int64), len(samples) - 1)
    high = np.minimum(low + 1, len(samples) - 1)
    a, b = samples[low].astype(np.float64), samples[high].astype(np.float64)
    return np.trunc(a + (b - a) * (position - np.floor(position))).astype(np.int16)


def _windows(batches: Iterator[pd.DataFrame], window_ms: int, hop_ms: int):
    size, hop = window_ms * TARGET_RATE // 1000, hop_ms * TARGET_RATE // 1000
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                samples = resample(*parse_wav(bytes(content)))
                problem = None if len(samples) >= size else "audio shorter than window"
            except ValueError as error:
                samples, problem = np.zeros(0, np.int16), str(error)
            if problem:
                yield pd.DataFrame(
                    {"path": [path], "start_ms": [None], "pcm": [None], "problem": [problem]}
                )
                continue
            # One small frame at a time: a long clip is never held as all its windows.
            starts = range(0, len(samples) - size + 1, hop)
            for first in range(0, len(starts), 64):
                part = starts[first:first + 64]
                yield pd.DataFrame(
                    {
                        "path": path,
                        "start_ms": [s * 1000 // TARGET_RATE for s in part],
                        "pcm": [samples[s:s + size].astype("<i2").tobytes() for s in part],
                        "problem": None,
                    }
                )


def read_windows(spark: SparkSession, path: str, window_ms: int = 3000,
                 hop_ms: int = 1500) -> DataFrame:
    """Overlapping windows of all WAV files of a folder at 16 kHz mono.

    A file that cannot be read gives one row with its problem and no samples.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(
        lambda batches: _windows(batches, window_ms, hop_ms), WINDOW_SCHEMA
    )
