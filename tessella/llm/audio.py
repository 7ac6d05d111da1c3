"""Audio columns: a lossless 8-bit store, resampling, log-mel features, energy segments.

A payload of bytes is kept as mono 8-bit PCM in a WAV container.  Features are
read from the stored form: a polyphase FIR resampler changes the rate, frames
overlap, a mel filterbank gives log energies, and a two-threshold (hysteresis)
rule cuts the frame energies into active segments with time spans.  Feature
blocks have a fixed shape and are kept as Arrow fixed-shape tensors.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows, small_batches

BLOCK = 576
RATE_IN, RATE_OUT = 16_000, 8_000
FRAME, HOP, FFT, MELS = 200, 80, 256, 24
TENSOR_FRAMES = 32
#: dB above the document's floor (its quietest tenth) that opens and closes a segment.
OPEN_DB, CLOSE_DB, MIN_FRAMES = 3.0, 1.0, 3
CHUNK_FRAMES = 4096


# ----------------------------------------------------------------- store
def payload_of(text: str | None, block: int = BLOCK) -> tuple[bytes, int]:
    """UTF-8 bytes and then bytes 255 up to a positive multiple of ``block``; the unpadded length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    want = max(1, -(-len(raw) // block)) * block
    return raw + b"\xff" * (want - len(raw)), len(raw)


def wav_bytes(samples: bytes, rate: int = RATE_IN) -> bytes:
    """Mono unsigned 8-bit PCM."""
    pad = b"\0" * (len(samples) % 2)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def wav_samples(stored: bytes) -> tuple[bytes, int]:
    """The samples and the rate of a mono 8-bit PCM file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        kind, size = struct.unpack_from("<4sI", stored, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif kind == b"data":
            return stored[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


# ----------------------------------------------------------------- features
@lru_cache(8)
def _taps(up: int, down: int, half: int = 8) -> np.ndarray:
    """Windowed-sinc low-pass as (phase, tap)."""
    top = max(up, down)
    n = np.arange(-half * top, half * top + 1)
    h = np.sinc(n / top) * np.hamming(len(n)) * up / top
    h = np.append(h, np.zeros(-len(h) % up))
    return h.reshape(-1, up).T.copy()


def resample(x: np.ndarray, up: int, down: int, half: int = 8) -> np.ndarray:
    """Polyphase resampling by up/down; output k is the input's time k*down/up.  Works in chunks."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return x.astype(np.float64)
    phases = _taps(up, down, half)
    taps = phases.shape[1]
    delay = half * max(up, down)
    n_out = -(-len(x) * up // down)
    out = np.empty(n_out)
    padded = np.concatenate([np.zeros(taps), x, np.zeros(taps + delay // up + 1)])
    for phase in range(min(up, n_out)):
        k = np.arange(phase, n_out, up)  # these outputs all use one phase
        t = k * down + delay
        newest = t // up + taps
        h = phases[t[0] % up]
        acc = np.zeros(len(k))
        lo, step = newest[0], down
        for j in range(taps):
            if h[j]:
                acc += h[j] * padded[lo - j : lo - j + step * (len(k) - 1) + 1 : step]
        out[k] = acc
    return out


@lru_cache(8)
def _mel(rate: int, fft: int, mels: int) -> np.ndarray:
    def to_mel(f):
        return 2595.0 * np.log10(1.0 + f / 700.0)

    edges = 700.0 * (10.0 ** (np.linspace(0, to_mel(rate / 2), mels + 2) / 2595.0) - 1.0)
    bins = np.arange(fft // 2 + 1) * rate / fft
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0.0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))).T.copy()


def log_mel(x: np.ndarray, rate: int = RATE_OUT) -> np.ndarray:
    """(frames, mels) float32 in dB; at least one frame (zero padded)."""
    if len(x) < FRAME:
        x = np.append(x, np.zeros(FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, bank = np.hanning(FRAME + 1)[:-1], _mel(rate, FFT, MELS)
    out = np.empty((len(frames), MELS), np.float32)
    for at in range(0, len(frames), CHUNK_FRAMES):
        spectrum = np.fft.rfft(frames[at : at + CHUNK_FRAMES] * window, FFT)
        power = spectrum.real**2 + spectrum.imag**2
        out[at : at + CHUNK_FRAMES] = 10.0 * np.log10(power @ bank + 1e-10)
    return out


def segments(energy: np.ndarray, open_db: float = OPEN_DB, close_db: float = CLOSE_DB, least: int = MIN_FRAMES) -> list[tuple[int, int]]:
    """Active frame spans [start, end): opened at ``open_db`` above the floor, closed below ``close_db``."""
    floor = np.sort(energy)[len(energy) // 10]
    above, keep = energy >= floor + open_db, energy >= floor + close_db
    edge = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    count = np.concatenate([[0], np.cumsum(above)])
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= least and count[b] > count[a]]


def tensors(mel: np.ndarray, frames: int = TENSOR_FRAMES) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Blocks of a fixed shape (block, frames, mels), the last padded with its floor, and their spans in seconds."""
    n = -(-len(mel) // frames)
    out = np.full((n * frames, mel.shape[1]), mel.min(), np.float32)
    out[: len(mel)] = mel
    spans = [(k * frames * HOP / RATE_OUT, (min((k + 1) * frames, len(mel)) - 1) * HOP / RATE_OUT + FRAME / RATE_OUT) for k in range(n)]
    return out.reshape(n, frames, mel.shape[1]), spans


def arrow_table(mel: np.ndarray, active: list[tuple[int, int]]) -> pa.Table:
    """Feature blocks as a fixed-shape tensor column with start_s, end_s and the active share."""
    blocks, spans = tensors(mel)
    mask = np.zeros(len(blocks) * TENSOR_FRAMES, np.float32)
    for a, b in active:
        mask[a:b] = 1
    return pa.table({
        "log_mel": pa.FixedShapeTensorArray.from_numpy_ndarray(blocks),
        "start_s": pa.array([s for s, _ in spans], pa.float64()),
        "end_s": pa.array([e for _, e in spans], pa.float64()),
        "active": pa.array(mask.reshape(-1, TENSOR_FRAMES).mean(axis=1), pa.float32()),
    })


def ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def read_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def features(stored: bytes) -> tuple[bytes, np.ndarray, list[tuple[int, int]]]:
    """Samples read back, log-mel frames and active spans of a stored file; depends on its bytes alone."""
    samples, rate = wav_samples(stored)
    x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128.0) / 128.0
    mel = log_mel(resample(x, RATE_OUT, rate))
    return samples, mel, segments(mel.mean(axis=1))


def summary(mel: np.ndarray, active: list[tuple[int, int]], stream: bytes) -> str:
    """Frames, all active time spans in milliseconds, whole-decibel band means and a digest of the tensor stream."""
    ms = 1000 * HOP // RATE_OUT
    spans = ",".join(f"{a * ms}-{b * ms}" for a, b in active)
    mean = ",".join(str(int(v)) for v in np.floor(mel.mean(axis=0, dtype=np.float64) + 0.5))
    digest = hashlib.sha256(stream).hexdigest()
    return f"frames={len(mel)};segments={len(active)}:{spans};active={sum(b - a for a, b in active)};mel={mean};tensors={digest}"


def read_features(stream: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel frames and active frame spans of a stored tensor stream."""
    table = read_ipc(stream)
    blocks = table["log_mel"].combine_chunks()
    blocks = blocks.chunk(0) if isinstance(blocks, pa.ChunkedArray) else blocks
    last = table["end_s"][-1].as_py() * RATE_OUT - FRAME
    mel = blocks.to_numpy_ndarray().reshape(-1, MELS)[: round(last / HOP) + 1]
    return mel, segments(mel.mean(axis=1))


# ----------------------------------------------------------------- operators
def audio_features(docs: DataFrame) -> DataFrame:
    """doc_id, bytes before padding, the stored WAV file and an Arrow stream of its fixed-shape feature tensors with time spans.

    A null text counts as empty: one block of padding.  Every row gets one
    result, repeated rows equal ones; other columns are ignored; an empty table
    gives none.
    """
    small_batches(docs.sparkSession, 200)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def make():
        def step(cols):
            out = {"doc_id": cols["doc_id"], "n_bytes": [], "media": [], "features": []}
            for text in cols["text"]:
                payload, n = payload_of(text)
                media = wav_bytes(payload)
                _, mel, active = features(media)
                out["n_bytes"].append(n)
                out["media"].append(media)
                out["features"].append(ipc(arrow_table(mel, active)))
            return out

        return step

    return map_rows(rows, make, "doc_id long, n_bytes long, media binary, features binary")


def op10(docs: DataFrame) -> DataFrame:
    """Digests of what ``audio_features`` stores, from its files and tensor streams read back."""
    rows = audio_features(docs)

    def make():
        def step(cols):
            out: dict[str, list] = {"doc_id": cols["doc_id"]}
            got = []
            for n, media, stream in zip(cols["n_bytes"], cols["media"], cols["features"]):
                back = wav_samples(media)[0]
                got.append((
                    n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media),
                    hashlib.sha256(media).hexdigest(), summary(*read_features(stream), stream),
                ))
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            return out | {name: list(c) for name, c in zip(names, zip(*got))}

        return step

    return map_rows(
        rows, make,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string",
    )
