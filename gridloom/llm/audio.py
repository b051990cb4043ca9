"""Audio features of sample payloads: polyphase resampling, log-mel filterbanks, energy segments.

A payload (any bytes, padded) is stored losslessly as an 8-bit mono WAVE file; the features are computed from
the samples read back from that file. Per payload:

* the samples are resampled by ``up``/``down`` with a windowed-sinc filter split into its polyphase branches;
* overlapped Hann frames give power spectra, a triangular mel filterbank and log energies;
* frames whose energy rises above ``on_db`` over the payload's median open a segment, which lasts until the energy
  falls under ``off_db``: the hysteresis keeps a segment from flickering;
* the log-mel frames are stored as an Arrow stream with one column of fixed-shape tensors
  (``frames_per_block`` x ``n_mels``; the last block is padded with zeros) and the time span of each block and segment.

Everything is a function of the payload alone and computed in one pass without an exchange; long payloads are framed
in blocks, and memory follows the longest payload (about 20 bytes for each of its samples, in one task); a very long text is a batch of its own. Nulls: a null text is an empty one, a null doc_id is passed on. Repeated rows
give repeated results, an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm.common import chunks, utf8

RATE, UP, DOWN = 8000, 1, 2
FRAME, HOP, N_MELS, FRAMES_PER_BLOCK = 128, 64, 16, 32
PAD_TO, PAD_BYTE, TAIL = 576, 255, 32

SPANS = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))  # seconds
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("n_frames", T.LongType()),
    T.StructField("n_segments", T.LongType()),
    T.StructField("segments", T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))),
    T.StructField("media", T.BinaryType()),
    T.StructField("tensors", T.BinaryType()),
])


def padded(data: bytes) -> bytes:
    return data + bytes([PAD_BYTE]) * (PAD_TO - len(data) % PAD_TO if len(data) % PAD_TO or not data else 0)


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAVE file whose 8-bit samples are the payload's bytes."""
    odd = len(payload) % 2
    header = b"RIFF" + struct.pack("<I", 36 + len(payload) + odd) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return header + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * odd


def from_wave(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache
def polyphase(up: int, down: int, taps: int = 8) -> np.ndarray:
    """Branches of a windowed-sinc low-pass: row p has the taps that make the outputs of phase p."""
    half = taps * max(up, down)
    t = np.arange(-half, half + 1)
    h = np.sinc(t / max(up, down)) * np.hanning(len(t) + 2)[1:-1]
    h *= up / h.sum()
    h = np.append(h, np.zeros(-len(h) % up))
    return h.reshape(-1, up).T.astype(np.float32).copy()


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """``x`` at up/down of its rate; output m is made at the input position m*down/up, by the branch m*down mod up."""
    branches = polyphase(up, down)
    n_out = -(-len(x) * up // down)
    half = (8 * max(up, down)) // up
    width = branches.shape[1]
    padded_x = np.concatenate([np.zeros(width, np.float32), x, np.zeros(width + half, np.float32)])
    out = np.empty(n_out, np.float32)
    for first in range(min(up, n_out)):  # outputs first, first+up, ... share a branch and step by ``down`` inputs
        phase, start = first * down % up, first * down // up
        count = len(range(first, n_out, up))
        h, total = branches[phase], np.zeros(count, np.float32)
        for k in range(width):
            at = start - k + half + width
            total += h[k] * padded_x[at : at + (count - 1) * down + 1 : down]
        out[first::up] = total
    return out


@lru_cache
def mel_filters(rate: float, frame: int, n_mels: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), n_mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).T.astype(np.float32)


def log_mel(x: np.ndarray, rate: float, frame: int = FRAME, hop: int = HOP, n_mels: int = N_MELS, block: int = 4096) -> np.ndarray:
    """Log energies in mel bands of overlapped Hann frames; the tail is padded to a whole frame."""
    n = max(1, -(-max(0, len(x) - frame) // hop) + 1)
    x = np.append(x, np.zeros((n - 1) * hop + frame - len(x), np.float32))
    frames = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    window, filters = np.hanning(frame + 1)[:-1].astype(np.float32), mel_filters(rate, frame, n_mels)
    out = np.empty((n, n_mels), np.float32)
    for i in range(0, n, block):
        spectrum = np.fft.rfft(frames[i : i + block] * window)
        out[i : i + block] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ filters
    return np.log10(out + 1e-6)


def segments(energy: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Runs of frames (end exclusive) that begin above ``on`` and last while the energy stays at or above ``off``."""
    starts, stops = np.flatnonzero(energy > on), np.flatnonzero(energy < off)
    out, at = [], 0
    while (i := np.searchsorted(starts, at)) < len(starts):
        start = int(starts[i])
        j = np.searchsorted(stops, start)
        at = int(stops[j]) if j < len(stops) else len(energy)
        out.append((start, at))
    return out


def tensors(mel: np.ndarray, spans: list[tuple[int, int]], seconds_a_frame: float) -> bytes:
    """An Arrow stream: fixed-shape tensors of frames with their time spans; the segments are in the schema's metadata."""
    blocks = -(-len(mel) // FRAMES_PER_BLOCK)
    whole = np.zeros((blocks, FRAMES_PER_BLOCK, mel.shape[1]), np.float32)
    whole.reshape(-1, mel.shape[1])[: len(mel)] = mel
    starts = np.arange(blocks) * FRAMES_PER_BLOCK * seconds_a_frame
    ends = np.minimum(starts + FRAMES_PER_BLOCK * seconds_a_frame, len(mel) * seconds_a_frame)
    batch = pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(whole), pa.array(starts), pa.array(ends)], names=["log_mel", "start_s", "end_s"])
    batch = batch.replace_schema_metadata({"segments": ",".join(f"{a * seconds_a_frame:.4f}-{b * seconds_a_frame:.4f}" for a, b in spans)})
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as to:
        to.write_batch(batch)
    return sink.getvalue()


def analyse(media: bytes, on_db: float = 3.0, off_db: float = 1.0) -> tuple[np.ndarray, list[tuple[int, int]], float]:
    """Log-mel frames, energy segments and seconds a frame of a stored file."""
    samples, rate = from_wave(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    new_rate = rate * UP / DOWN
    y = resample(x, UP, DOWN)
    mel = log_mel(y, new_rate)
    energy = 10 * np.log10(np.mean(np.float32(10.0) ** mel, axis=1) + 1e-9)
    middle = float(np.median(energy))
    return mel, segments(energy, middle + on_db, middle + off_db), HOP / new_rate


def features(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """One row per row of ``docs``; ``media`` and ``tensors`` are null unless ``keep_media``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 8 << 20):
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                media = to_wave(padded(data))
                payload, _ = from_wave(media)
                mel, spans, step = analyse(media)
                stored = tensors(mel, spans, step)
                told = f"mels={N_MELS};frames={len(mel)};segments={len(spans)};mean={float(mel.mean()):.3f};tensors={zlib.crc32(stored):08x}"
                rows.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), told, len(mel), len(spans), [{"start": a * step, "end": b * step} for a, b in spans], media if keep_media else None, stored if keep_media else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), SPANS, pa.binary(), pa.binary()), strict=True)], names=SCHEMA.names)

    return docs.select("doc_id", "text").mapInArrow(task, SCHEMA)
