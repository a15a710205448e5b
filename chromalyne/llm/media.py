"""Audio columns: lossless 8-bit storage, polyphase resampling, log-mel frames, hysteresis segments, fixed-shape tensors."""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromalyne.llm.common import map_arrow, slices

RATE, TO_RATE = 16_000, 8_000
FRAME, HOP, FFT, MELS = 200, 80, 256, 24
TENSOR_FRAMES = 64
#: Hysteresis: a segment opens at OPEN and closes below CLOSE, both as shares of the span from the quietest to the loudest frame (dB).
OPEN, CLOSE = 0.6, 0.4
BLOCK = 1 << 14

MEDIA = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, n_frames long, tensors binary, tensor_spans array<struct<start_s: double, end_s: double>>, segments array<struct<start_s: double, end_s: double>>, mean_db array<float>"


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM WAV file whose samples are the payload's bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and rate of such a file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit PCM is expected")
        return w.readframes(w.getnframes()), w.getframerate()


@functools.lru_cache(8)
def lowpass(up: int, down: int, half: int = 8) -> np.ndarray:
    """A Hann-windowed sinc for resampling by up / down, with gain `up`; 2 * half * max(up, down) + 1 taps."""
    most = max(up, down)
    n = np.arange(-half * most, half * most + 1)
    taps = np.sinc(n / most) * np.hanning(len(n) + 2)[1:-1]
    return (taps * up / taps.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """x at up / down times its rate: each output phase uses its own share of the taps, zeros are never multiplied."""
    g = gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return x.astype(np.float32)
    taps = lowpass(up, down)
    mid = len(taps) // 2
    n = -(-len(x) * up // down)
    out = np.empty(n, np.float32)
    for phase in range(min(up, n)):
        # output m = phase + up * i lies at m * down on the finer grid: input (m * down + mid - t) / up meets tap t
        own = taps[(phase * down + mid) % up :: up][::-1]
        last = (phase * down + mid) // up  # newest input that meets output `phase`
        pad = len(own)
        wide = np.concatenate([np.zeros(pad, np.float32), x, np.zeros(pad + mid // up + down, np.float32)])
        windows = np.lib.stride_tricks.sliding_window_view(wide, len(own))[last + 1 :: down]
        count = -(-(n - phase) // up)
        for a in range(0, count, BLOCK):
            out[phase + up * a : phase + up * min(a + BLOCK, count) : up] = np.ascontiguousarray(windows[a : min(a + BLOCK, count)]) @ own
    return out


@functools.lru_cache(2)
def mel_bank(rate: int = TO_RATE, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters, equally spaced and half overlapped on the mel scale: (fft // 2 + 1) x mels."""
    mel = lambda hz: 2595.0 * np.log10(1.0 + hz / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(mel(0.0), mel(rate / 2), mels + 2) / 2595.0) - 1.0)
    hz = np.arange(fft // 2 + 1) * rate / fft
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    rise, fall = (hz[:, None] - low) / (mid - low), (high - hz[:, None]) / (high - mid)
    return np.maximum(0.0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames x MELS in dB, from overlapped Hann windows; a signal shorter than one frame is padded with silence."""
    x = np.concatenate([x, np.zeros(max(0, FRAME - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(frames), MELS), np.float32)
    window = np.hanning(FRAME).astype(np.float32)
    for a in range(0, len(frames), 2048):
        spectrum = np.fft.rfft(frames[a : a + 2048] * window, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[a : a + 2048] = 10.0 * np.log10(power @ mel_bank() + np.float32(1e-8))
    return out


def segments(energy: np.ndarray) -> np.ndarray:
    """First and last + 1 frames of the stretches that open at the upper and close below the lower threshold."""
    low, high = float(energy.min()), float(energy.max())
    if high - low < 1e-3:
        return np.zeros((0, 2), np.int64)
    turn = np.where(energy >= low + OPEN * (high - low), 1, np.where(energy < low + CLOSE * (high - low), -1, 0))
    last = np.maximum.accumulate(np.where(turn != 0, np.arange(len(turn)), -1))
    on = np.concatenate([[False], (last >= 0) & (turn[np.maximum(last, 0)] > 0), [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return edges.reshape(-1, 2)


def tensors(mel: np.ndarray) -> tuple[bytes, list[dict]]:
    """The frames as an Arrow IPC stream of fixed-shape (TENSOR_FRAMES, MELS) float32 tensors, the last filled with its own floor, and each one's span."""
    count = -(-len(mel) // TENSOR_FRAMES)
    wide = np.full((count * TENSOR_FRAMES, MELS), mel.min(), np.float32)
    wide[: len(mel)] = mel
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(wide.reshape(count, TENSOR_FRAMES, MELS))
    spans = [(a * HOP / TO_RATE, ((min(a + TENSOR_FRAMES, len(mel)) - 1) * HOP + FRAME) / TO_RATE) for a in range(0, len(mel), TENSOR_FRAMES)]
    batch = pa.RecordBatch.from_arrays([column, pa.array([s for s, _ in spans]), pa.array([e for _, e in spans])], ["log_mel", "start_s", "end_s"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes(), [{"start_s": s, "end_s": e} for s, e in spans]


def read_tensors(stored: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    found = pa.ipc.open_stream(stored).read_all().combine_chunks()
    return found["log_mel"].chunk(0).to_numpy_ndarray(), list(zip(found["start_s"].to_pylist(), found["end_s"].to_pylist()))


def _of(text: bytes, align: int) -> tuple:
    payload = text + b" " * (-len(text) % align if text else align)
    media = to_wav(payload)
    back, rate = from_wav(media)
    x = (np.frombuffer(back, np.uint8).astype(np.float32) - 128.0) / 128.0
    mel = log_mel(resample(x, TO_RATE, rate))
    blob, spans = tensors(mel)
    cut = [{"start_s": a * HOP / TO_RATE, "end_s": ((b - 1) * HOP + FRAME) / TO_RATE} for a, b in segments(mel.mean(1)).tolist()]
    return len(text), media, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(mel), blob, spans, cut, mel.mean(0, dtype=np.float64).astype(np.float32).tolist()


def audio_features(docs: DataFrame, key: str = "doc_id", text: str = "text", align: int = 192) -> DataFrame:
    """Store each text's UTF-8 bytes as an 8-bit WAV, read the stored bytes back and compute audio features of them.

    The payload is the text's bytes filled with spaces to a positive multiple of `align`. Returns per row: doc_id,
    n_bytes, media (the WAV), payload_bytes, payload_sha256 and tail_crc32 (of the samples read back), n_frames,
    tensors (an Arrow IPC stream of fixed-shape log-mel tensors), tensor_spans, segments (both in seconds) and mean_db.
    Null and empty texts are `align` spaces, whose constant energy has no segment. Values depend on the text alone, so
    repeated rows agree; texts equal within one batch are computed once. Very long texts are framed and resampled in
    blocks. The key is a whole number (cast to long) and may be null. Only the key and text are read, so names of other
    columns can't clash. An empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("n_frames", pa.int64()), ("tensors", pa.binary()), ("tensor_spans", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), ("segments", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), ("mean_db", pa.list_(pa.float32()))])

    def featured(batch: pa.RecordBatch):
        for part in slices(batch, "text", 4 << 20):
            known: dict[bytes, tuple] = {}
            rows = []
            for doc, body in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                raw = (body or "").encode()
                if raw not in known:
                    known[raw] = _of(raw, align)
                rows.append((doc, *known[raw]))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), featured, MEDIA)


def feature_digest() -> Column:
    """The operator's features as one string: frames, tensors, segments, total segment time, mean dB a band (one decimal)."""
    total = F.aggregate("segments", F.lit(0.0), lambda s, x: s + x["end_s"] - x["start_s"])
    bands = F.concat_ws(",", F.transform("mean_db", lambda x: F.format_number(x, 1)))
    return F.concat_ws("|", F.col("n_frames").cast("string"), F.size("tensor_spans").cast("string"), F.size("segments").cast("string"), F.format_number(total, 3), bands)
