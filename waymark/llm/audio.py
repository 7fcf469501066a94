"""Media columns: 8-bit audio kept losslessly, and log-mel features with time spans.

A payload of bytes is stored as an 8-bit mono WAV and read back from it. Features: a rational polyphase resampler
(each output phase is one short filter, so no sample is computed that is not kept), overlapping Hann frames, log-mel
filterbanks, and segments by energy with hysteresis (a segment opens above the high and closes below the low
threshold). Log-mels are cut into windows of a fixed number of frames, held as fixed-shape Arrow tensors with the
time span of each; the query's feature is told from these tensors. Frames are resampled and worked off in chunks of a fixed number, counted from the text's own start, so equal
texts have equal values to the last bit whatever batch they are in.
"""

from __future__ import annotations

import hashlib
import io
import math
import wave
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches

RATE, TARGET, FRAME, HOP, MELS, WINDOW = 16_000, 8_000, 256, 128, 32, 64
CHUNK = 2048  # frames worked off at a time


def pad(data: bytes, multiple: int = 64) -> bytes:
    """data with bytes 0 up to a positive multiple."""
    return data + bytes(max(1, -(-len(data) // multiple)) * multiple - len(data))


def store(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV of one channel whose 8-bit samples are the payload's bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


@lru_cache(maxsize=8)
def phases(up: int, down: int, half: int = 8) -> tuple[np.ndarray, ...]:
    """A windowed-sinc low pass, split in up phases."""
    n = 2 * half * max(up, down) + 1
    t = np.arange(n) - n // 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * cut * np.hanning(n + 2)[1:-1]
    h *= up / h.sum()
    return tuple(h[k::up] for k in range(up))


def resampled(x: np.ndarray, lo: int, hi: int, rate: int = RATE, target: int = TARGET) -> np.ndarray:
    """Samples lo to hi of 8-bit samples x at another rate, of which there are ceil(len * target / rate). Only the part
    of x that they need is looked at; beyond its ends is silence."""
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    value = lambda part: (part.astype(np.float64) - 128) / 128
    if up == down:
        return value(x[lo:hi])
    bank = phases(up, down)
    centre, taps = (sum(map(len, bank)) - 1) // 2, max(map(len, bank))
    out = np.empty(max(0, hi - lo))
    # Output m is sum_k h[k] * x[(m * down + centre - k) / up]; outputs m = first + i * up share the phase of h.
    for first in range(lo, min(lo + up, hi)):
        h = bank[(first * down + centre) % up]
        newest, count = (first * down + centre) // up, -(-(hi - first) // up)
        begin, end = newest - taps, newest + (count - 1) * down + 1
        held = np.zeros(end - begin)
        held[max(0, -begin) : max(0, min(end, len(x)) - begin)] = value(x[max(0, begin) : max(0, min(end, len(x)))])
        total = np.zeros(count)
        for r in range(min(down, len(h))):  # the taps h[r::down] see every down-th sample only
            part = h[r::down]
            at = newest - r - (len(part) - 1) * down - begin
            total += np.convolve(held[at :: down][: count + len(part) - 1], part, "valid")
        out[first - lo :: up] = total
    return out


def resample(x: np.ndarray, rate: int = RATE, target: int = TARGET) -> np.ndarray:
    """All of x at another rate."""
    return resampled(x, 0, -(-len(x) * target // rate), rate, target)


@lru_cache(maxsize=2)
def hann(frame: int = FRAME) -> np.ndarray:
    return np.hanning(frame).astype(np.float32)


@lru_cache(maxsize=4)
def mel_bank(rate: int = TARGET, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, [bins, mels]."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1)[:, None] * rate / frame
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel values [frames, MELS] and energies in dB by frame of 8-bit samples; the last frame is filled up with
    zeros. CHUNK frames are resampled and worked off at a time, so little more than these values is held."""
    samples = -(-len(x) * TARGET // RATE)
    n = max(1, -(-max(0, samples - FRAME) // HOP) + 1)
    window, bank = hann(), mel_bank()
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for a in range(0, n, CHUNK):
        frames = min(CHUNK, n - a)
        held = np.zeros((frames - 1) * HOP + FRAME, np.float32)
        y = resampled(x, a * HOP, min(samples, a * HOP + len(held)))
        held[: len(y)] = y
        part = np.lib.stride_tricks.sliding_window_view(held, FRAME)[::HOP] * window
        spectrum = np.fft.rfft(part, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mel[a : a + frames] = np.log10(np.maximum(power @ bank, 1e-10))
        energy[a : a + frames] = 10 * np.log10(np.maximum((part * part).mean(axis=1), 1e-10))
    return mel, energy


def segments(energy: np.ndarray, high: float = -3.0, low: float = -6.0) -> list[tuple[int, int]]:
    """[first, end) frames of segments: runs above the low threshold that somewhere are above the high one; both
    are in dB against the recording's mean energy."""
    mean = 10 * np.log10(np.mean(10 ** (energy.astype(np.float64) / 10)))
    over = np.concatenate([[False], energy >= mean + low, [False]])
    edge = np.flatnonzero(over[1:] != over[:-1])
    peak = np.concatenate([[0], np.cumsum(energy >= mean + high)])
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if peak[b] > peak[a]]


def features(payload: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    mel, energy = log_mel(np.frombuffer(payload, np.uint8))
    return mel, energy, segments(energy)


def tensors(mel: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Windows of WINDOW frames as a fixed-shape tensor array (the last filled up with the floor), and their spans
    in seconds [windows, 2]."""
    n = -(-len(mel) // WINDOW)
    held = np.full((n * WINDOW, MELS), -10, np.float32)
    held[: len(mel)] = mel
    at = np.arange(n) * WINDOW
    spans = np.stack([at * HOP, (np.minimum(at + WINDOW, len(mel)) - 1) * HOP + FRAME], axis=1) / TARGET
    return pa.FixedShapeTensorArray.from_numpy_ndarray(held.reshape(n, WINDOW, MELS)), spans


def stored(payload: bytes) -> tuple[pa.Array, np.ndarray, list[tuple[int, int]]]:
    """The features as they are kept: windows as fixed-shape tensors, the time span of each, and the segments."""
    mel, _, parts = features(payload)
    return *tensors(mel), parts


def summary(payload: bytes) -> str:
    """The stored tensors in short: their shape and number, the time spans of the first and the last, the segments with
    the first and last of their spans, and the mean log-mels of the frames within the spans."""
    held, spans, parts = stored(payload)
    frames = np.rint(((spans[:, 1] - spans[:, 0]) * TARGET - FRAME) / HOP).astype(int) + 1
    windows = held.to_numpy_ndarray()
    total = sum((w[:n].sum(axis=0, dtype=np.float64) for w, n in zip(windows, frames)), np.zeros(MELS))
    span = lambda p: f"{p[0] * HOP / TARGET:.3f}-{((p[1] - 1) * HOP + FRAME) / TARGET:.3f}"
    ends = ",".join(span(p) for p in dict.fromkeys([*parts[:1], *parts[-1:]]))
    times = ",".join(f"{a:.3f}-{b:.3f}" for a, b in dict.fromkeys([tuple(spans[0]), tuple(spans[-1])]))
    means = ",".join(f"{v:.2f}" for v in total / frames.sum())
    return f"tensors={len(held)}x{'x'.join(map(str, windows.shape[1:]))};frames={frames.sum()};times={times};segments={len(parts)};active={sum(b - a for a, b in parts)};spans={ends};logmel={means}"


def media(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of docs: id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (the last 64 bytes; these
    two of what is read back), media_bytes, media_sha256 (of the WAV), feature.

    Null and empty texts are 64 bytes 0. Every text is taken whole; equal texts have equal values; only the two
    columns are read; an empty table gives an empty result."""
    text_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]

    def one(data: bytes | None) -> tuple:
        data = data or b""
        form = store(pad(data))
        back = load(form)
        return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(form), hashlib.sha256(form).hexdigest(), summary(back)

    def run(batches):
        for b in batches:
            rows = [one(t.as_py()) for t in b.column(1).cast(pa.large_binary())]
            columns = [pa.array([r[k] for r in rows], pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", *[f.name for f in fields]])

    return narrow.mapInArrow(run, T.StructType([narrow.schema["id"], *fields])).withColumnRenamed("id", id_col)


def spectrogram_windows(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The features in full: id, window, start_s, end_s, log_mel (WINDOW x MELS floats, row by row: the storage of a
    fixed-shape tensor, to which as_tensors() turns it back), shape and active (frames of the window in segments); a
    row for each window of each text, null and empty texts included."""
    text_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            for i, t in enumerate(b.column(1).cast(pa.large_binary())):
                held, spans, parts = stored(load(store(pad(t.as_py() or b""))))
                n = len(held)
                busy = np.zeros(n * WINDOW, bool)
                for p, q in parts:
                    busy[p:q] = True
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * n)), pa.array(np.arange(n), pa.int64()), pa.array(spans[:, 0]), pa.array(spans[:, 1]), held.storage.cast(pa.list_(pa.float32())), pa.array([[WINDOW, MELS]] * n, pa.list_(pa.int32())), pa.array(busy.reshape(n, WINDOW).sum(axis=1), pa.int32())], names=["id", "window", "start_s", "end_s", "log_mel", "shape", "active"])

    schema = T.StructType([narrow.schema["id"], *T._parse_datatype_string("window long, start_s double, end_s double, log_mel array<float>, shape array<int>, active int").fields])
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def as_tensors(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A column log_mel, as Arrow or Parquet gives it, as fixed-shape tensors."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = pa.fixed_shape_tensor(pa.float32(), [WINDOW, MELS])
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat.flatten(), WINDOW * MELS))
