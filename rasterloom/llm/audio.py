"""Media columns: byte payloads as 8-bit audio, and features read back from the stored waveform.

Polyphase resampling, overlapped log-mel filterbanks and hysteresis energy segmentation. Features are kept as Arrow
fixed-shape tensors (one patch of frames x bands a row, with its time span) in an IPC stream per row.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bound_batches, byte_texts

UNIT, FILL = 576, 255
RATE, UP, DOWN, TAPS = 16_000, 5, 8, 12
FRAME, HOP, BANDS, PATCH = 512, 256, 32, 16
TENSOR = pa.fixed_shape_tensor(pa.float32(), (PATCH, BANDS))
TENSOR_SCHEMA = pa.schema([("patch", TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64())])


def payload_of(data: bytes) -> bytes:
    """The bytes filled up with 255 to a positive multiple of 576."""
    return data + bytes([FILL]) * ((-len(data)) % UNIT if data else UNIT)


def write_wave(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of unsigned 8-bit mono samples. An odd payload gets the format's pad byte after its chunk."""
    pad = len(payload) % 2
    head = b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad


def read_wave(data: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of a RIFF file of 8-bit mono samples; chunks may stand in any order."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF wave")
    at, rate, found = 12, 0, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono samples")
        elif name == b"data":
            found = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if found is None:
        raise ValueError("no data chunk")
    return rate, found


def phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """up x taps: a Hann-windowed sinc low-pass, dealt into its phases."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = np.sinc(t * cut) * cut * up * np.hanning(n + 2)[1:-1]
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, filters: np.ndarray, down: int = DOWN) -> np.ndarray:
    """The signal at up/down of its rate, by one short filter per phase; ceil(n * up / down) samples."""
    up, taps = filters.shape
    n = -(-len(x) * up // down)
    half = taps // 2
    wide = np.concatenate((np.zeros(half, np.float32), x.astype(np.float32), np.zeros(taps + down, np.float32)))
    out = np.zeros(n, np.float32)
    for r in range(min(up, n)):  # outputs r, r + up, ... use the same phase, and start `down` samples apart
        first, phase = divmod(r * down, up)
        count = -(-(n - r) // up)
        part = out[r::up]
        for k in range(taps):
            part += filters[phase, k] * wide[first + k : first + k + (count - 1) * down + 1 : down]
    return out


def mel_filters(rate: int = RATE * UP // DOWN, frame: int = FRAME, bands: int = BANDS) -> np.ndarray:
    """Triangular filters, (frame / 2 + 1) x bands, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """frames x bands of log10 energy; frames overlap by half, the last is filled with silence; one frame at least."""
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    wide = np.zeros((frames - 1) * HOP + FRAME, np.float64)
    wide[: len(x)] = x
    view = np.lib.stride_tricks.sliding_window_view(wide, FRAME)[::HOP]
    power = np.empty((frames, BANDS))
    window = np.hanning(FRAME)
    for at in range(0, frames, 256):
        spectrum = np.fft.rfft(view[at : at + 256] * window, axis=1)
        power[at : at + 256] = (spectrum.real**2 + spectrum.imag**2) @ filters
    return np.log10(power + 1e-10)


def segments(energy: np.ndarray, rise: float = 0.15, fall: float = 0.05) -> list[tuple[int, int]]:
    """Runs of frames that stay above the median + fall and reach the median + rise: (first, last + 1)."""
    base = float(np.median(energy))
    on = np.concatenate(([False], energy >= base + fall, [False]))
    begin, end = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(~on[1:] & on[:-1])
    return [(int(a), int(b)) for a, b in zip(begin, end, strict=True) if energy[a:b].max() >= base + rise]


def tensors(mel: np.ndarray, seconds: float) -> bytes:
    """An Arrow IPC stream: one fixed-shape tensor of PATCH frames a row (silence fills the last) with its time span."""
    count = -(-len(mel) // PATCH)
    wide = np.full((count * PATCH, BANDS), -10.0, np.float32)
    wide[: len(mel)] = mel
    first = np.arange(count) * PATCH
    storage = pa.FixedSizeListArray.from_arrays(pa.array(wide.ravel()), PATCH * BANDS)
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(TENSOR, storage), pa.array(first * seconds), pa.array(np.minimum(first + PATCH, len(mel)) * seconds)], schema=TENSOR_SCHEMA)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSOR_SCHEMA) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def encode_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): whole texts stored as 8-bit waveforms. Null text: the empty text, a payload of 576 bytes 255."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Batches) -> Batches:
        for b in parts:
            texts = byte_texts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_wave(payload_of(t)) for t in texts], pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def audio_features(media: DataFrame) -> DataFrame:
    """The rows of encode_audio with what is read back from the stored waveform.

    Adds samples (the payload), frames, mel_mean (a mean a band), spans (start_s, end_s of energetic segments) and
    features (an IPC stream of fixed-shape tensors). Every row has one frame at least; equal media give equal values.
    """
    kind = media.schema["id"].dataType.simpleString()
    filters, bands = phases(), mel_filters()

    def run(parts: Batches) -> Batches:
        for b in parts:
            samples, frames, means, spans, kept = [], [], [], [], []
            for data in b.column(2).to_pylist():
                rate, raw = read_wave(data)
                x = resample(np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1, filters)
                rate = rate * UP // DOWN
                mel = log_mel(x, bands)
                step = HOP / rate
                samples.append(raw)
                frames.append(len(mel))
                means.append(mel.mean(axis=0).tolist())
                spans.append([{"start_s": a * step, "end_s": (z - 1) * step + FRAME / rate} for a, z in segments(mel.mean(axis=1))])
                kept.append(tensors(mel, step))
            yield pa.RecordBatch.from_arrays([
                *b.columns[:3], pa.array(samples, pa.binary()), pa.array(frames, pa.int64()), pa.array(means, pa.list_(pa.float64())),
                pa.array(spans, pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), pa.array(kept, pa.binary()),
            ], names=["id", "n_bytes", "media", "samples", "frames", "mel_mean", "spans", "features"])

    return media.select("id", "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, media binary, samples binary, frames long, mel_mean array<double>, spans array<struct<start_s: double, end_s: double>>, features binary")


def read_tensors(features: bytes) -> pa.Table:
    """The patches of one row, as an Arrow table with a fixed-shape tensor column."""
    return pa.ipc.open_stream(features).read_all()
