"""Operator 2, media columns: audio features of samples stored in a media column.

``store_media`` keeps each payload as a media file (RIFF/WAVE, one channel of
8-bit samples) in a table of the shared folder; ``audio_features`` reads the
stored bytes back and computes

* polyphase resampling by a ratio up/down: a windowed-sinc low-pass filter split
  into one short filter for each of the ``up`` output phases;
* log-mel filterbanks of overlapped, Hann-windowed frames;
* energy segmentation with hysteresis: a segment begins where a frame's energy
  reaches the upper level and lasts until it falls below the lower one.

Features are kept as an Arrow stream of fixed-shape tensors (a patch of frames by
mel bands each) with their time spans.  All is done a bounded run of samples at a
time; a text's result depends on its own bytes only.

Payloads: UTF-8 bytes, null as empty, then zero bytes up to a positive multiple of
64.  Null and repeated ids keep a row each; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise
from .vectext import slices

_WAVE = struct.Struct("<4sI4s4sIHHIIHH4sI")


@dataclass(frozen=True)
class AudioSettings:
    rate: int = 8000
    up: int = 3
    down: int = 4
    taps: int = 12  # on each side of a phase's filter
    frame: int = 256
    hop: int = 128
    mels: int = 24
    patch: int = 32  # frames in a tensor
    upper: float = 1.5  # of the mean energy: a segment begins
    lower: float = 0.75  # and ends


def to_wave(payload: bytes, rate: int) -> bytes:
    pad = b"\0" * (len(payload) & 1)
    head = _WAVE.pack(b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def from_wave(media: bytes) -> tuple[int, memoryview]:
    """(rate, samples) of a file that ``to_wave`` made."""
    riff, _, wave, _, _, kind, channels, rate, _, _, bits, _, size = _WAVE.unpack_from(media, 0)
    if (riff, wave, kind, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8):
        raise ValueError("not one channel of 8-bit samples")
    return rate, memoryview(media)[_WAVE.size : _WAVE.size + size]


@lru_cache(maxsize=8)
def polyphase_filters(up: int, down: int, taps: int) -> np.ndarray:
    """(up, 2 taps) filters: row p gives outputs of phase p from 2 * taps neighbouring inputs."""
    cut = min(1.0, up / down)
    at = np.arange(-taps + 1, taps + 1)[None, :] - (np.arange(up) / up)[:, None]
    window = np.cos(np.pi * at / (2 * taps + 1)) ** 2
    rows = cut * np.sinc(cut * at) * window
    return (rows / rows.sum(1, keepdims=True)).astype(np.float32)


def resample(samples: np.ndarray, up: int, down: int, taps: int, run: int = 1 << 16) -> np.ndarray:
    """Samples at up/down times the rate; output k is at input time k * down / up, the edges are padded with zeros."""
    filters = polyphase_filters(up, down, taps)
    n = -(-len(samples) * up // down)
    padded = np.concatenate((np.zeros(taps - 1, np.float32), samples, np.zeros(taps + down, np.float32)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * taps)
    out = np.empty(n, np.float32)
    for phase in range(up):  # outputs k = phase, phase + up, ... advance by whole samples
        place = phase * down
        count = len(range(phase, n, up))
        mine, theirs = out[phase::up], windows[place // up :: down]
        for lo in range(0, count, run):
            mine[lo : lo + run] = theirs[lo : min(count, lo + run)] @ filters[place % up]
    return out


@lru_cache(maxsize=8)
def mel_filters(rate: float, frame: int, mels: int) -> np.ndarray:
    """(frame // 2 + 1, mels) triangles of equal width on the mel scale."""
    mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(0.0, mel(rate / 2), mels + 2) / 2595.0) - 1.0)
    f = np.linspace(0.0, rate / 2, frame // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0.0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


def log_mel(samples: np.ndarray, rate: float, s: AudioSettings, run: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel of each frame, energy of each frame); the last frame is padded with zeros."""
    frames = max(1, -(-(len(samples) - s.frame) // s.hop) + 1)
    padded = np.zeros((frames - 1) * s.hop + s.frame, np.float32)
    padded[: len(samples)] = samples[: len(padded)]
    windows = np.lib.stride_tricks.sliding_window_view(padded, s.frame)[:: s.hop]
    hann, bank = np.hanning(s.frame).astype(np.float32), mel_filters(rate, s.frame, s.mels)
    out, energy = np.empty((frames, s.mels), np.float32), np.empty(frames, np.float32)
    for lo in range(0, frames, run):
        part = windows[lo : lo + run] * hann
        energy[lo : lo + run] = np.einsum("ij,ij->i", part, part) / s.frame
        spectrum = np.fft.rfft(part, axis=1)
        out[lo : lo + run] = np.log10((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank + 1e-6)
    return out, energy


def segments(energy: np.ndarray, upper: float, lower: float) -> list[tuple[int, int]]:
    """(first frame, end) of runs that reach ``upper`` and then stay at ``lower`` or above."""
    active = np.flatnonzero(energy >= lower)
    if not len(active):
        return []
    cut = np.flatnonzero(np.diff(active) > 1)
    firsts, lasts = np.append(active[0], active[cut + 1]), np.append(active[cut], active[-1])
    out = []
    for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
        loud = np.flatnonzero(energy[a : b + 1] >= upper)
        if len(loud):
            out.append((a + int(loud[0]), b + 1))
    return out


def features(samples: memoryview, rate: int, s: AudioSettings) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], np.ndarray]:
    """(patches: n x patch x mels, time span of each in ms, segments, mean log-mel of the frames: what fills the last patch doesn't count)."""
    signal = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128.0) / 128.0
    new_rate = rate * s.up / s.down
    mel, energy = log_mel(resample(signal, s.up, s.down, s.taps), new_rate, s)
    mean = float(energy.mean())
    found = segments(energy, s.upper * mean, s.lower * mean) if mean > 0 else []
    number = -(-len(mel) // s.patch)
    patches = np.zeros((number * s.patch, s.mels), np.float32)
    patches[: len(mel)] = mel
    ms = 1000.0 * s.hop / new_rate
    first = np.arange(number) * s.patch
    last = np.minimum(first + s.patch, len(mel))
    spans = np.stack((first * ms, last * ms), 1)
    return patches.reshape(number, s.patch, s.mels), spans, found, mel.mean(0, dtype=np.float64)


def tensor_stream(patches: np.ndarray, spans: np.ndarray) -> bytes:
    """An Arrow stream with a fixed-shape tensor and its time span in each row."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(patches.ravel()), patches.shape[1] * patches.shape[2])
    kind = pa.fixed_shape_tensor(pa.float32(), patches.shape[1:])
    table = pa.table({"patch": pa.ExtensionArray.from_storage(kind, flat), "start_ms": spans[:, 0], "end_ms": spans[:, 1]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    table = pa.ipc.open_stream(stream).read_all()
    patches = table["patch"].combine_chunks().to_numpy_ndarray()
    return patches, np.stack([table["start_ms"].to_numpy(), table["end_ms"].to_numpy()], 1)


def store_media(docs: DataFrame, settings: AudioSettings = AudioSettings(), id_column: str = "doc_id", text_column: str = "text", unit: int = 64) -> DataFrame:
    """A table (id, n_bytes, media) in the shared folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [b or b"" for b in part.column("text").to_pylist()]
                media = [to_wave(b + b"\0" * (-len(b) % unit if b else unit), settings.rate) for b in raw]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    return materialise(slim.mapInArrow(encode, f"id {kind}, n_bytes long, media binary"), "media")


def audio_features(media: DataFrame, settings: AudioSettings = AudioSettings(), with_tensors: bool = True) -> DataFrame:
    """(id, n_bytes, payload and media digests, feature, segments, seconds[, tensors]) of a table of ``store_media``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for media in part.column("media").to_pylist():
                    rate, samples = from_wave(media)
                    patches, spans, found, level = features(samples, rate, settings)
                    ms = 1000.0 * settings.hop * settings.down / (rate * settings.up)
                    text = ",".join(f"{x:.3f}" for x in np.round(level, 3).tolist()) + f";{len(patches)};{len(found)}"
                    rows.append(
                        {
                            "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
                            "feature": text, "seconds": len(samples) / rate, "segments": [{"start_ms": a * ms, "end_ms": b * ms} for a, b in found],
                        } | ({"tensors": tensor_stream(patches, spans)} if with_tensors else {})
                    )
                found = pa.RecordBatch.from_pylist(rows, schema=arrow)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), *found.columns], ["id", "n_bytes", *arrow.names])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    columns = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, segments array<struct<start_ms: double, end_ms: double>>" + ", tensors binary" * with_tensors
    arrow = to_arrow_schema(_parse_datatype_string(columns))
    kind = media.schema["id"].dataType.simpleString()
    return media.mapInArrow(compute, f"id {kind}, n_bytes long, {columns}")
