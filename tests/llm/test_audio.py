import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa

from tessella.llm import audio as A
from tests.llm.conftest import prose


def test_store_is_a_wav_file_and_lossless():
    payload, n = A.payload_of("héllo " * 300)
    assert n == 2100 and len(payload) % 576 == 0
    stored = A.wav_bytes(payload)
    with wave.open(io.BytesIO(stored)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, A.RATE_IN)
        assert w.readframes(w.getnframes()) == payload
    assert A.wav_samples(stored) == (payload, A.RATE_IN)


def test_resampling_matches_direct_filtering():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    for up, down in ((1, 2), (3, 2), (2, 3), (160, 441)):
        h = A._taps(up, down).T.reshape(-1)
        dense = np.zeros(len(x) * up)
        dense[::up] = x
        full = np.convolve(dense, h)
        delay = 8 * max(up, down)
        n = -(-len(x) * up // down)
        want = np.append(full, np.zeros(down * n))[delay : delay + down * n : down][:n]
        assert np.allclose(A.resample(x, up, down), want)
    t = np.arange(4000) / 16000
    y = A.resample(np.sin(2 * np.pi * 440 * t), 1, 2)
    assert np.abs(y - np.sin(2 * np.pi * 440 * np.arange(len(y)) / 8000))[40:-40].max() < 0.02


def test_log_mel_matches_a_plain_loop():
    x = np.random.default_rng(1).normal(size=1000)
    got, bank = A.log_mel(x), A._mel(A.RATE_OUT, A.FFT, A.MELS)
    for f in range(len(got)):
        s = np.fft.rfft(x[f * A.HOP : f * A.HOP + A.FRAME] * np.hanning(A.FRAME + 1)[:-1], A.FFT)
        assert np.allclose(got[f], 10 * np.log10((np.abs(s) ** 2) @ bank + 1e-10), atol=1e-3)


def brute_segments(e, open_db, close_db, least):
    floor = sorted(e)[len(e) // 10]
    out, start, loud = [], None, False
    for k, v in enumerate([*e, -np.inf]):
        if v >= floor + close_db:
            start = k if start is None else start
            loud |= v >= floor + open_db
        elif start is not None:
            if loud and k - start >= least:
                out.append((start, k))
            start, loud = None, False
    return out


def test_hysteresis_segments():
    rng = np.random.default_rng(2)
    for _ in range(50):
        e = rng.normal(scale=3, size=rng.integers(1, 80)).cumsum()
        assert A.segments(e) == brute_segments(e, A.OPEN_DB, A.CLOSE_DB, A.MIN_FRAMES)


def test_tensors_are_fixed_shape_with_spans():
    mel = A.features(A.wav_bytes(A.payload_of(prose(1, 2000))[0]))[1]
    table = A.read_ipc(A.ipc(A.arrow_table(mel, [(0, 5)])))
    kind = table.schema.field("log_mel").type
    assert isinstance(kind, pa.FixedShapeTensorType) and list(kind.shape) == [A.TENSOR_FRAMES, A.MELS]
    back = table["log_mel"].chunk(0).to_numpy_ndarray().reshape(-1, A.MELS)
    assert np.array_equal(back[: len(mel)], mel)
    assert table["end_s"].to_pylist()[-1] * A.RATE_OUT == (len(mel) - 1) * A.HOP + A.FRAME


def test_query_digests(odd_docs, empty_docs, make_docs):
    texts = [r["text"] for r in odd_docs.collect()]
    got = {}
    for r, t in zip(A.op10(odd_docs.coalesce(1)).collect(), texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_bytes"] == len(payload) + 44
        got.setdefault(t, set()).add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in got.values())
    assert A.op10(empty_docs).collect() == []
    long = make_docs([prose(5, 30000)])
    size = A.op10(long).first()["payload_bytes"]
    assert size > 100000
    row = A.audio_features(long).first()
    frames = (size // 2 - A.FRAME) // A.HOP + 1  # at half the rate
    assert A.read_ipc(row["features"]).num_rows == -(-frames // A.TENSOR_FRAMES)
    assert A.wav_samples(row["media"])[1] == A.RATE_IN


def test_query_covers_all_spans_and_the_stored_tensors(make_docs):
    table = make_docs(["".join(" " * 4000 + prose(k, 400) for k in range(7)), prose(6, 20), None])
    stored = {r["doc_id"]: r for r in A.audio_features(table).collect()}
    most = 0
    for r in A.op10(table).collect():
        _, mel, active = A.features(stored[r["doc_id"]]["media"])
        back, spans = A.read_features(stored[r["doc_id"]]["features"])
        assert np.array_equal(back, mel) and spans == active
        parts = dict(p.split("=", 1) for p in r["feature"].split(";"))
        n, _, listed = parts["segments"].partition(":")
        assert [tuple(int(x) // 10 for x in s.split("-")) for s in listed.split(",") if s] == active and int(n) == len(active)
        assert parts["tensors"] == hashlib.sha256(stored[r["doc_id"]]["features"]).hexdigest()
        most = max(most, len(active))
    assert most > 3
