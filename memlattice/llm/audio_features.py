"""Media columns: audio features of 8-bit PCM.

Media are WAV files with one channel of unsigned 8-bit samples. They are resampled by a polyphase windowed sinc, framed
with overlap into log-mel filterbanks, and segmented by frame energy with two thresholds: a segment begins where the
energy reaches the file's mean plus a margin and ends where it falls under the mean less that margin. The features of a
file are fixed-shape tensors (frames x bands, float32, the last one padded with the floor), each with its time span and
level. They are stored as an Arrow record batch of a fixed-shape tensor column, one binary value for each file; what is said
about a file is read back from all tensors of it.

A null payload is an empty one; an empty payload has no frames, segments or tensors; an unreadable file has none either.
Equal media give equal features (ties); repeated rows are repeated work and nothing else. Files are worked through a few
tensors at a time, so a long one needs no more memory than its samples and its features. The media table's columns take
free names where the input has columns of theirs. Of an empty table the result is empty.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, small_batches

RATE = 16_000
TARGET_RATE = 12_000
FRAME, HOP, FFT, BANDS = 300, 120, 512, 40
#: Shape of a tensor: frames x bands.
TENSOR_FRAMES = 96
FLOOR = -10.0
MARGIN_DB = 0.5
SHAPE = (TENSOR_FRAMES, BANDS)
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of unsigned 8-bit samples, one channel."""
    pad = len(samples) & 1
    return HEADER.pack(b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + b"\0" * pad


def unwav(media: bytes | None) -> tuple[int, bytes]:
    """Rate and samples; (0, empty) for what isn't such a file. Chunks other than fmt and data are passed over."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return 0, b""
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                return 0, b""
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return 0, b""


@lru_cache(8)
def _phases(up: int, down: int, half: int = 8) -> np.ndarray:
    """Taps by phase, [up, taps]: a Hann-windowed sinc that passes what both rates can carry."""
    wide = max(up, down)
    n = 2 * half * wide + 1
    t = (np.arange(n) - half * wide) / wide
    h = np.sinc(t) * (0.5 + 0.5 * np.cos(np.pi * t / half)) * up / wide
    taps = -(-n // up)
    return np.pad(h, (0, taps * up - n)).reshape(taps, up).T.astype(np.float32)


def resampled(x: np.ndarray, up: int, down: int, begin: int, end: int, half: int = 8) -> np.ndarray:
    """Samples begin to end of x at up/down times its rate; beyond x's ends it is zero."""
    if up == down:
        return np.pad(x[begin:end], (0, max(0, end - max(begin, len(x)))))
    taps, delay = _phases(up, down, half), half * max(up, down)
    out = np.zeros(end - begin, np.float32)
    for p in range(up):
        m = np.arange(begin + (p - begin) % up, end, up, dtype=np.int64)
        if not len(m):
            continue
        at = m * down + delay  # position in the upsampled signal, of which x fills every up-th place
        phase = int(at[0] % up)
        last = at // up
        lo, hi = int(last[0]) - taps.shape[1] + 1, int(last[-1]) + 1
        part = np.pad(x[max(0, lo) : max(0, min(hi, len(x)))], (max(0, -lo), max(0, hi - max(len(x), lo))))
        out[m - begin] = np.lib.stride_tricks.sliding_window_view(part, taps.shape[1])[::down] @ np.ascontiguousarray(taps[phase][::-1])
    return out


@lru_cache(4)
def _mel(rate: int, fft: int, bands: int) -> np.ndarray:
    """Triangular filters [fft bins, bands], evenly spaced in mel."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def frames_of(n_samples: int, rate: int) -> int:
    n = -(-n_samples * TARGET_RATE // rate) if rate else 0
    return 0 if not n else 1 + max(0, -(-(n - FRAME) // HOP))


def log_mel(samples: bytes, rate: int, tensors_at_once: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel bands [frames, bands] and the energy in dB of each frame."""
    n = frames_of(len(samples), rate)
    mel, energy = np.full((n, BANDS), FLOOR, np.float32), np.full(n, 10 * FLOOR, np.float32)
    raw = np.frombuffer(samples, np.uint8)
    g = gcd(TARGET_RATE, rate or 1)
    up, down = TARGET_RATE // g, (rate or 1) // g
    filters = _mel(TARGET_RATE, FFT, BANDS)
    step = TENSOR_FRAMES * tensors_at_once
    for a in range(0, n, step):
        b = min(n, a + step)
        first, last = a * HOP - 1, (b - 1) * HOP + FRAME  # one sample more for the pre-emphasis
        lo = max(0, (max(0, first) * down) // up - 64 * max(1, down // up))
        hi = min(len(raw), last * down // up + 64 * max(1, down // up))
        lo -= lo % down  # so that the cut keeps the phases
        x = (raw[lo:hi].astype(np.float32) - 128) / 128
        off = lo * up // down
        y = resampled(x, up, down, max(0, first) - off, last - off)
        y = np.append(np.zeros(int(first < 0), np.float32), y)
        y = y[1:] - np.float32(0.97) * y[:-1]
        view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * _WINDOW
        z = np.fft.rfft(view, FFT, axis=1)
        power = (z.real * z.real + z.imag * z.imag).astype(np.float32, copy=False) / np.float32(FFT)
        mel[a:b] = np.log10(np.maximum(power @ filters, 10.0**FLOOR))
        energy[a:b] = 10 * np.log10(np.maximum(power.mean(axis=1), 10.0**FLOOR))
    return mel, energy


def segments(energy: np.ndarray, margin: float = MARGIN_DB) -> np.ndarray:
    """[k, 2]: frames where segments begin and end (exclusive), by two thresholds around the mean."""
    if not len(energy):
        return np.zeros((0, 2), np.int64)
    mean = float(energy.mean(dtype=np.float64))
    mark = np.where(energy >= mean + margin, 1, np.where(energy < mean - margin, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[at] == 1, False)
    edge = np.diff(np.concatenate(([0], on.view(np.int8), [0])))
    return np.stack([np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]], axis=1)


def frame_ms(frame: np.ndarray | int):
    return frame * HOP * 1000 // TARGET_RATE


SPAN = T.StructType([T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType())])
FEATURES = T.StructType([T.StructField("frames", T.LongType()), T.StructField("segments", T.ArrayType(SPAN)), T.StructField("tensors", T.BinaryType())])


def tensor_type() -> pa.DataType:
    """The Arrow type of the tensor column."""
    return pa.fixed_shape_tensor(pa.float32(), SHAPE, dim_names=["frame", "band"])


def tensor_schema() -> pa.Schema:
    return pa.schema([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("level", pa.float64()), ("tensor", tensor_type())])


def stored_tensors(mel: np.ndarray, energy: np.ndarray) -> bytes:
    """The bands of a file's frames as fixed-shape tensors with their time spans and mean energies: an Arrow record batch."""
    n, k = len(mel), -(-len(mel) // TENSOR_FRAMES)
    padded = np.full((k * TENSOR_FRAMES, BANDS), FLOOR, np.float32)
    padded[:n] = mel
    first = np.arange(k) * TENSOR_FRAMES
    last = np.minimum(first + TENSOR_FRAMES, n)
    levels = np.add.reduceat(energy.astype(np.float64), first) / (last - first) if k else np.zeros(0)
    tensors = pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), SHAPE[0] * SHAPE[1]))
    spans = pa.array(frame_ms(first)), pa.array(frame_ms(last - 1) + FRAME * 1000 // TARGET_RATE)
    return pa.record_batch([*spans, pa.array(levels), tensors], tensor_schema()).serialize().to_pybytes()


def read_tensors(stored: bytes) -> pa.RecordBatch:
    """start_ms, end_ms, level and tensor, as stored_tensors() has written them."""
    return pa.ipc.read_record_batch(pa.py_buffer(stored), tensor_schema())


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))


def features_of(media: list[bytes | None]) -> pa.StructArray:
    """The features of some files, in one Arrow array."""
    frames, segs, tensors = [], [], []
    for m in media:
        rate, samples = unwav(m)
        mel, energy = log_mel(samples, rate)
        frames.append(len(mel))
        segs.append(segments(energy))
        tensors.append(stored_tensors(mel, energy))
    seg = np.concatenate([*segs, np.zeros((0, 2), np.int64)])
    lists = pa.ListArray.from_arrays(_offsets([len(x) for x in segs]), pa.StructArray.from_arrays([pa.array(frame_ms(seg[:, 0])), pa.array(frame_ms(seg[:, 1]))], ["start_ms", "end_ms"]))
    return pa.StructArray.from_arrays([pa.array(frames, pa.int64()), lists, pa.array(tensors, pa.binary())], ["frames", "segments", "tensors"])


def _by_size(values: pa.Array, most: int = 4 << 20) -> Iterator[list]:
    """The values in lists of some megabytes."""
    out, held = [], 0
    for x in values:
        v = x.as_py()
        out.append(v)
        held += len(v or b"")
        if held >= most:
            yield out
            out, held = [], 0
    yield out


@F.arrow_udf(T.BinaryType())
def store(payload: pa.Array) -> pa.Array:
    """Payload bytes -> a WAV file that holds them as samples."""
    return pa.array([wav(x.as_py() or b"") for x in payload], pa.binary())


@F.arrow_udf(T.BinaryType())
def load(media: pa.Array) -> pa.Array:
    """The samples that a WAV file holds."""
    return pa.array([unwav(x.as_py())[1] for x in media], pa.binary())


@F.arrow_udf(FEATURES)
def features(media: pa.Array) -> pa.Array:
    """frames, segments and tensors of a WAV file."""
    return pa.concat_arrays([features_of(some) for some in _by_size(media)])


@F.arrow_udf(T.StringType())
def described(frames: pa.Array, tensors: pa.Array) -> pa.Array:
    """What the stored tensors of a file hold: how many, the level of each in dB, and each band's mean over all frames, in tenths."""
    out = []
    for n, stored in zip(frames.to_pylist(), tensors):
        x = read_tensors(stored.as_py())
        levels = ",".join(str(round(v)) for v in x.column("level").to_pylist())
        bands = x.column("tensor").to_numpy_ndarray().reshape(-1, BANDS)[:n].mean(axis=0, dtype=np.float64) if n else np.zeros(0)
        out.append(f"tensors={x.num_rows}x{SHAPE[0]}x{SHAPE[1]}|db={levels}|mel=" + ",".join(str(round(10 * float(v))) for v in bands))
    return pa.array(out, pa.string())


def payload(text: Column, multiple: int = 64) -> Column:
    """The text's UTF-8 bytes, filled up with zeros to a positive multiple."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    short = F.when(n == 0, multiple).otherwise(F.pmod(-n, F.lit(multiple)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), short)))


def media_table(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a media file that holds its text, and the file's frames, segments and tensors (read_tensors() reads them)."""
    small_batches(df.sparkSession, 200)
    media, f, *names = free(df, "media", "a_features", "frames", "segments", "tensors")
    x = df.withColumn(media, store(payload(F.col(text))))
    x = x.withColumn(f, features(media))
    return x.select(*df.columns, media, *(F.col(f)[c].alias(n) for c, n in zip(("frames", "segments", "tensors"), names)))


def op9(df: DataFrame) -> DataFrame:
    """The digest of the contract, from the stored files and their stored features."""
    x = media_table(df.select("doc_id", "text"))
    x = x.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "media", "frames", "segments", "tensors")
    x = x.select("*", load("media").alias("back"), described("frames", "tensors").alias("said"))
    ms = F.aggregate("segments", F.lit(0).cast("long"), lambda a, s: a + s["end_ms"] - s["start_ms"])
    said = F.concat_ws("|", F.concat(F.lit("frames="), F.col("frames")), F.concat(F.lit("segments="), F.size("segments")), F.concat(F.lit("active_ms="), ms), F.col("said"))
    return x.select(
        "doc_id",
        "n_bytes",
        F.octet_length("back").cast("long").alias("payload_bytes"),
        F.sha2("back", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(back, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        said.alias("feature"),
    )
