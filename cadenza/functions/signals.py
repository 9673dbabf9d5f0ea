"""Features of sampled signals in array columns, a window at a time, computed in Arrow batches.

Signals of one length are stacked and transformed together.  All levels are in decibels of full scale
(samples lie in -1 to 1); what is silent has the floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

FLOOR_DB, TINY = -140.0, 1e-20
#: A sample of this size or more is clipped, and so many in a row are a clip.
CLIPPED, RUN = 0.999, 3
#: Percentile of a frequency's power over time that is taken for its noise.
NOISE = 5
FEATURES = ("rms_db", "peak_db", "crest_db", "clipped_share", "n_clips", "dc_offset", "zero_crossings", "flatness", "centroid", "rolloff_95", "tilt_db_oct", "snr_db")


def decibels(power: np.ndarray) -> np.ndarray:
    return np.maximum(10 * np.log10(np.maximum(power, TINY)), FLOOR_DB)


def runs(mask: np.ndarray, least: int) -> np.ndarray:
    """How many runs of at least ``least`` true values each row has."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, start), (_, end) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    return np.bincount(row[end - start >= least], minlength=len(mask))


def power_frames(x: np.ndarray, frame: int) -> np.ndarray:
    """Power spectra (rows, frames, bins) of Hann windows that overlap by half; a signal that ends early is filled with silence."""
    step = frame // 2
    count = max(1, -(-(x.shape[1] - frame) // step) + 1) if x.shape[1] > frame else 1
    padded = np.pad(x, ((0, 0), (0, max(0, (count - 1) * step + frame - x.shape[1]))))
    frames = np.lib.stride_tricks.sliding_window_view(padded, frame, axis=1)[:, ::step][:, :count]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    return np.abs(np.fft.rfft(frames * hann, axis=2)) ** 2


def features(x: np.ndarray, rate: float, frame: int) -> dict[str, np.ndarray]:
    """All features of the rows of x (signals of one length, one sample at least)."""
    size = np.abs(x)
    rms, peak = decibels((x * x).mean(1)), decibels(size.max(1) ** 2)
    power = power_frames(x - x.mean(1, keepdims=True), frame)
    mean, hz = power.mean(1), np.fft.rfftfreq(frame, 1 / rate)
    noise = np.percentile(power, NOISE, axis=1)
    music = np.maximum(mean - noise, TINY)
    total = mean.sum(1)
    sounding = total > TINY
    cumulative = np.cumsum(music, axis=1)
    rolloff = hz[np.minimum((cumulative < 0.95 * cumulative[:, -1:]).sum(1), len(hz) - 1)]
    level = decibels(mean[:, 1:])
    octave = np.log2(hz[1:]) - np.log2(hz[1:]).mean()
    tilt = (level * octave).sum(1) / max((octave * octave).sum(), TINY)
    signs = np.signbit(x)
    out = {
        "rms_db": rms,
        "peak_db": peak,
        "crest_db": peak - rms,
        "clipped_share": (size >= CLIPPED).mean(1),
        "n_clips": runs(size >= CLIPPED, RUN),
        "dc_offset": x.mean(1),
        "zero_crossings": (signs[:, 1:] != signs[:, :-1]).sum(1),
        "flatness": np.exp(np.log(np.maximum(mean[:, 1:], TINY)).mean(1)) / np.maximum(mean[:, 1:].mean(1), TINY),
        "centroid": (mean * hz).sum(1) / np.maximum(total, TINY),
        "rolloff_95": rolloff,
        "tilt_db_oct": tilt,
        "snr_db": decibels(total) - decibels(noise.sum(1)),
    }
    return out | {c: np.where(sounding, out[c], 0.0) for c in ("flatness", "centroid", "rolloff_95", "tilt_db_oct", "snr_db")}


def signal_features(signals: DataFrame, key: str, samples: str, rate: float = 1.0, frame: int = 16) -> DataFrame:
    """key, n (samples) and FEATURES: one row per row; null and empty signals have null features, a null or non-finite sample is silence."""
    key_type = signals.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            flat = pc.fill_null(column.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            flat = np.where(np.isfinite(flat), flat, 0.0)
            start = np.cumsum(lengths) - lengths
            out = {f: np.full(len(lengths), np.nan) for f in FEATURES}
            for n in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == n)
                for f, values in features(flat[start[rows][:, None] + np.arange(n)], rate, frame).items():
                    out[f][rows] = values
            fields = [pa.array(out[f], mask=lengths == 0) for f in FEATURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths.astype(np.int64)), *fields], names=[key, "n", *FEATURES])

    schema = f"`{key}` {key_type}, n long, " + ", ".join(f"{f} double" for f in FEATURES)
    return signals.select(key, samples).mapInArrow(run, schema)


def envelope(x: np.ndarray, points: int) -> tuple[list[int], list[int]]:
    """Least and greatest of each of ``points`` blocks, in hundredths of the greatest size; fewer samples give a block each, what is left over is not shown."""
    per = max(1, len(x) // points)
    blocks = x[: min(points, len(x)) * per].reshape(-1, per)
    low, high = blocks.min(1), blocks.max(1)
    norm = max(np.abs(low).max(), np.abs(high).max(), 1e-6)
    return np.rint(low / norm * 100).astype(int).tolist(), np.rint(high / norm * 100).astype(int).tolist()
