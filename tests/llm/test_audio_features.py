import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlattice.llm import audio_features as A

from .docs import awkward, frame


def test_resampling_is_filtering_of_the_upsampled_signal():
    x = np.random.default_rng(0).normal(size=3000).astype(np.float32)
    for up, down in ((3, 4), (4, 3), (1, 2), (160, 147)):
        h = A._phases(up, down).T.ravel()
        z = np.zeros(len(x) * up)
        z[::up] = x
        want = np.convolve(z, h)[8 * max(up, down) :: down]
        n = min(len(want), len(x) * up // down)
        assert np.abs(A.resampled(x, up, down, 0, n) - want[:n]).max() < 1e-5
        assert np.abs(A.resampled(x, up, down, 100, 417) - want[100:417]).max() < 1e-5


def test_a_tone_is_in_its_band():
    t = np.arange(16000) / 16000
    for hz in (300, 1000, 3000):
        mel, energy = A.log_mel((np.sin(2 * np.pi * hz * t) * 100 + 128).astype(np.uint8).tobytes(), 16000)
        filters = A._mel(A.TARGET_RATE, A.FFT, A.BANDS)
        assert abs(int(mel[50].argmax()) - int(filters[round(hz * A.FFT / A.TARGET_RATE)].argmax())) <= 1
    assert len(mel) == len(energy) == A.frames_of(16000, 16000)


def test_pieces_make_no_difference():
    s = np.random.default_rng(1).integers(0, 255, 90_000).astype(np.uint8).tobytes()
    a, ea = A.log_mel(s, 16000, 400)
    for k in (1, 3):
        b, eb = A.log_mel(s, 16000, k)
        assert np.abs(a - b).max() < 1e-4 and np.abs(ea - eb).max() < 1e-3


def test_two_thresholds():
    e = np.array([0, 0, 10, 5.2, 4.9, 0, 0, 10, 10, 5.1, 5.1, 0], float)
    e = e - e.mean() + 3
    want, on = [], False
    for k, x in enumerate(e):
        if x >= e.mean() + 1:
            on = True
        elif x < e.mean() - 1:
            on = False
        want.append(on)
    got = np.zeros(len(e), bool)
    for a, b in A.segments(e, 1.0):
        got[a:b] = True
    assert got.tolist() == want
    assert len(A.segments(np.zeros(0))) == 0


def test_files():
    for data in (b"", b"a", bytes(range(256)) * 3):
        w = A.wav(data)
        assert A.unwav(w) == (A.RATE, data) and len(w) % 2 == 0 and int.from_bytes(w[4:8], "little") == len(w) - 8
    assert A.unwav(None) == A.unwav(b"junk") == (0, b"")


def test_tensors():
    media = [A.wav(b"q" * 40_000), None, A.wav(b""), A.wav(b"hello" * 20)]
    f = A.features_of(media).to_pylist()
    t = [A.read_tensors(x["tensors"]) for x in f]
    assert [x.num_rows for x in t] == [3, 0, 0, 1] and f[1]["frames"] == 0
    assert t[0].schema.field("tensor").type == A.tensor_type()
    assert t[0].column("start_ms").to_pylist() == [0, 960, 1920] and t[0].column("end_ms")[-1].as_py() >= 2500
    mel, energy = A.log_mel(b"q" * 40_000, A.RATE)
    got = t[0].column("tensor").to_numpy_ndarray()
    assert got.shape == (3, *A.SHAPE) and np.array_equal(got.reshape(-1, A.BANDS)[: len(mel)], mel) and (got.reshape(-1, A.BANDS)[len(mel) :] == A.FLOOR).all()
    assert np.allclose(t[0].column("level").to_numpy(), [energy[k : k + 96].mean() for k in (0, 96, 192)], atol=1e-3)


def by_hand(payload):
    """The feature string, frame by frame: resampling by full filtering, a direct transform, bands, states."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    h = A._phases(3, 4).T.ravel().astype(float)
    z = np.zeros(len(x) * 3)
    z[::3] = x
    y = np.convolve(z, h)[32::4]
    n = A.frames_of(len(payload), A.RATE)
    y = np.concatenate((y, np.zeros(n * A.HOP + A.FRAME)))
    y[-(-len(x) * 3 // 4) + 40 :] = 0
    y = y - 0.97 * np.concatenate(([0], y[:-1]))
    turn = np.exp(-2j * np.pi * np.outer(np.arange(A.FRAME), np.arange(A.FFT // 2 + 1)) / A.FFT)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(A.FRAME) / A.FRAME)
    mel, energy = [], []
    for k in range(n):
        power = abs((y[k * A.HOP : k * A.HOP + A.FRAME] * window) @ turn) ** 2 / A.FFT
        mel.append(np.log10(np.maximum(power @ A._mel(A.TARGET_RATE, A.FFT, A.BANDS), 1e-10)))
        energy.append(10 * np.log10(max(power.mean(), 1e-10)))
    on, segments, ms = False, 0, 0
    for e in energy:
        now = True if e >= np.mean(energy) + 0.5 else False if e < np.mean(energy) - 0.5 else on
        segments += now and not on
        ms, on = ms + 10 * now, now
    levels = [np.mean(energy[k : k + 96]) for k in range(0, n, 96)]
    return n, segments, ms, levels, np.mean(mel, axis=0)


def test_feature_by_hand(spark):
    """Of a text of over 16 tensors, whose last part is unlike the first."""
    text = "calm and even words here " * 12_000 + "!?" * 20_000
    r = A.op9(frame(spark, [(1, text, "en", "a", 1)])).first()
    raw = text.encode()
    n, segments, ms, levels, bands = by_hand(raw + bytes(-len(raw) % 64))
    said = dict(x.split("=") for x in r["feature"].split("|"))
    assert (int(said["frames"]), said["tensors"]) == (n, f"{len(levels)}x96x40") and len(levels) > 16
    assert int(said["segments"]) == segments and int(said["active_ms"]) == ms
    assert np.abs(np.array(said["db"].split(","), int) - levels).max() < 0.51
    assert np.abs(np.array(said["mel"].split(","), int) / 10 - bands).max() < 0.06
    other = A.op9(frame(spark, [(1, text[:-1] + " " * 3000, "en", "a", 1)])).first()
    assert other["feature"] != r["feature"]


def test_clashing_columns(spark):
    df = frame(spark).withColumn("media", F.lit(1)).withColumn("Frames", F.lit(2))
    out = A.media_table(df)
    assert out.columns == [*df.columns, "_media", "_frames", "segments", "tensors"] and out.count() == df.count()


def test_query(spark):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in A.op9(frame(spark)).collect()}
    for d, text, *_ in awkward():
        raw = (text or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        r, w = got[d, hashlib.sha256(p).hexdigest()], A.wav(p)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (len(raw), len(p), zlib.crc32(p[-64:]), len(w), hashlib.sha256(w).hexdigest())
    rows = {r["doc_id"]: r["feature"] for r in A.op9(frame(spark)).collect()}
    assert rows[6] == rows[7] and rows[1] == rows[2] and all(rows.values()) and rows[6] != rows[9]
    assert A.op9(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [64, 128, 6400])
def test_payload_lengths(spark, n):
    r = A.op9(frame(spark, [(1, "é" * (n // 2), "en", "a", 1)])).first()
    assert r["n_bytes"] == r["payload_bytes"] == n
