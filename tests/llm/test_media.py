import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromalyne.llm import media
from helpers import awkward, none, prose


def direct(x, up, down):
    """Zeros between samples, convolution, every down-th sample."""
    taps = media.lowpass(up, down).astype(float)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    full = np.convolve(wide, taps)[len(taps) // 2 :]
    return full[: len(wide)][::down]


@pytest.mark.parametrize("up,down", [(1, 2), (2, 1), (3, 2), (2, 3), (1, 3), (441, 160)])
def test_polyphase_equals_direct_resampling(up, down):
    x = np.random.default_rng(0).normal(0, 1, 503).astype(np.float32)
    got, want = media.resample(x, up, down), direct(x, up, down)
    assert len(got) == -(-len(x) * up // down)
    assert got == pytest.approx(want[: len(got)], abs=1e-4)


def test_tones_keep_their_place():
    t = np.arange(16000) / 16000
    x = media.resample(np.sin(2 * np.pi * 1000 * t).astype(np.float32), 1, 2)
    spectrum = np.abs(np.fft.rfft(x[1000:7000]))
    assert spectrum.argmax() * 8000 / 6000 == pytest.approx(1000, abs=2)
    mel = media.log_mel(x)
    assert mel.shape == ((8000 - media.FRAME) // media.HOP + 1, media.MELS) and 8 <= mel.mean(0).argmax() <= 13
    assert np.abs(media.resample(np.sin(2 * np.pi * 7000 * t).astype(np.float32), 1, 2)[200:-200]).max() < 0.02


def test_log_mel_equals_a_plain_computation():
    """A sum over every sample and frequency for each frame, and triangles drawn one by one."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.3, media.FRAME + 3 * media.HOP).astype(np.float32)
    got = media.log_mel(x)
    n = np.arange(media.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / (media.FRAME - 1))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, mel(media.TO_RATE / 2), media.MELS + 2)]
    for k in range(4):
        part = x[k * media.HOP :][: media.FRAME] * window
        power = [abs(np.sum(part * np.exp(-2j * np.pi * f * n / media.FFT))) ** 2 for f in range(media.FFT // 2 + 1)]
        for b in range(media.MELS):
            low, mid, high = points[b : b + 3]
            total = 0.0
            for f, p in enumerate(power):
                hz = f * media.TO_RATE / media.FFT
                total += p * max(0.0, min((hz - low) / (mid - low), (high - hz) / (high - mid)))
            assert got[k, b] == pytest.approx(10 * np.log10(total + 1e-8), abs=0.02)


def test_hysteresis_holds_between_thresholds():
    assert media.segments(np.array([0.0, 1, 0.5, 0.5, 0.3, 0.5, 0.7, 0.0])).tolist() == [[1, 4], [6, 7]]
    assert media.segments(np.full(9, 3.0)).tolist() == []
    assert media.segments(np.array([1.0, 0.0])).tolist() == [[0, 1]]


def test_wav_round_trip():
    for body in (b"x" * 192, bytes(range(256)) * 3):
        assert media.from_wav(media.to_wav(body)) == (body, media.RATE)


def test_rows(spark):
    table = awkward(spark)
    found = media.audio_features(table)
    rows = found.withColumn("feature", media.feature_digest()).collect()
    texts = {r["doc_id"]: r["text"] for r in table.where("doc_id is not null").collect()}
    assert len(rows) == table.count()
    for r in rows:
        if r["doc_id"] is None:
            continue
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert media.from_wav(bytes(r["media"]))[0] == payload
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        block, spans = media.read_tensors(bytes(r["tensors"]))
        assert block.shape == (len(r["tensor_spans"]), media.TENSOR_FRAMES, media.MELS) and block.dtype == np.float32
        assert spans == [(s["start_s"], s["end_s"]) for s in r["tensor_spans"]] and len(block) == -(-r["n_frames"] // media.TENSOR_FRAMES)
        assert all(s["start_s"] < s["end_s"] for s in r["segments"])
    same = {r["feature"] for r in rows if r["doc_id"] in (0, 1)}
    assert len(same) == 1 and len({r["feature"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert media.audio_features(none(spark)).count() == 0


def test_batches_make_no_difference(spark):
    df = spark.createDataFrame([(i, prose(i % 7, 50 + i % 7)) for i in range(60)], "doc_id long, text string")
    one, many = (media.audio_features(df.repartition(k)).select("doc_id", media.feature_digest().alias("f"), F.md5("tensors").alias("t")) for k in (1, 9))
    assert one.exceptAll(many).count() == 0
