"""Sound columns: WAV bytes in, spectral-peak pair fingerprints out.

A WAV value is read with the ``wave`` module (PCM of 8, 16, 24 or 32 bits, any number of channels, averaged).  Short-time
Fourier transforms of a whole batch run in one call; a peak is a local maximum in time and frequency that
stands out of its frame (the clip's mean is taken off first); each peak is paired with the peaks that follow it, and a pair is the code
(frequency, frequency, frames between) at the time of its first peak.  No shuffle: rows never meet.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


FRAME = 256
HOP = 128
BANDS = FRAME // 2 + 1
NEAR_BANDS = 3
NEAR_FRAMES = 2
STANDS_OUT = 2.0
FAN = 5
REACH = 63
RATE = 8000
SAMPLES_AT_ONCE = 1 << 20


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(samples)
    return out.getvalue()


def read_wav(blob: bytes | None) -> tuple[np.ndarray, int, int, str | None]:
    """(samples within -1..1, rate, channels, what is wrong with it)."""
    none = np.zeros(0, np.float32)
    if blob is None:
        return none, 0, 0, "null"
    try:
        with wave.open(io.BytesIO(blob), "rb") as f:
            rate, channels, width = f.getframerate(), f.getnchannels(), f.getsampwidth()
            raw = f.readframes(f.getnframes())
    except (wave.Error, EOFError, ValueError) as e:
        return none, 0, 0, f"unreadable: {str(e) or type(e).__name__}"
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / (1 << 15)
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ (1 << 23)) - (1 << 23)).astype(np.float32) / (1 << 23)
    elif width == 4:
        x = (np.frombuffer(raw, "<i4") / (1 << 31)).astype(np.float32)
    else:
        return none, rate, channels, f"unreadable: {width} bytes a sample"
    return (x.reshape(-1, channels).mean(axis=1) if channels > 1 else x), rate, channels, None


_HANN = np.hanning(FRAME).astype(np.float32)


def frame_count(n: int) -> int:
    """Frames that cover all ``n`` samples, the last padded with silence."""
    return 0 if n == 0 else 1 + -(-max(0, n - FRAME) // HOP)


def peaks(clips: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(clip, frame within the clip, band) of all peaks, in that order."""
    frames = np.array([frame_count(len(c)) for c in clips], dtype=np.int64)
    if not frames.sum():
        return (np.zeros(0, np.int64),) * 3
    padded = []
    for c, n in zip(clips, frames):
        if n:
            padded.append(c - c.mean())
            padded.append(np.zeros((n - 1) * HOP + FRAME - len(c), np.float32))
    sound = np.concatenate(padded)
    size = np.where(frames > 0, (frames - 1) * HOP + FRAME, 0)
    base = np.concatenate([[0], np.cumsum(size)])[:-1]
    owner = np.repeat(np.arange(len(clips)), frames)
    within = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(frames)])[:-1], frames)
    held = []
    step = max(1, 4 * SAMPLES_AT_ONCE // FRAME)
    windows = np.lib.stride_tricks.sliding_window_view(sound, FRAME)
    for at in range(0, len(owner), step):
        low, high = max(0, at - NEAR_FRAMES), min(len(owner), at + step + NEAR_FRAMES)
        o = owner[low:high]
        level = np.abs(np.fft.rfft(windows[base[o] + within[low:high] * HOP] * _HANN, axis=1)).astype(np.float32)
        level = np.round(level, 4)
        high_band = level.copy()
        for k in range(1, NEAR_BANDS + 1):
            np.maximum(high_band[:, k:], level[:, :-k], out=high_band[:, k:])
            np.maximum(high_band[:, :-k], level[:, k:], out=high_band[:, :-k])
        top = high_band.copy()
        for k in range(1, NEAR_FRAMES + 1):
            same = (o[k:] == o[:-k])[:, None]
            np.maximum(top[k:], np.where(same, high_band[:-k], 0), out=top[k:])
            np.maximum(top[:-k], np.where(same, high_band[k:], 0), out=top[:-k])
        good = (level >= top) & (level > STANDS_OUT * level.mean(axis=1, keepdims=True)) & (level > 1e-3)
        row, band = np.nonzero(good)
        mine = (row + low >= at) & (row + low < at + step)
        held.append((row[mine] + low, band[mine]))
    row, band = (np.concatenate([h[k] for h in held]) for k in range(2))
    return owner[row], within[row], band


def fingerprints(clips: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(clip, time in frames, code) of all peak pairs, by clip, time and code.

    A peak is paired with the ``FAN`` next peaks of later frames, by frame and band, that are within ``REACH`` frames.
    """
    clip, frame, band = peaks(clips)
    if not len(clip):
        return (np.zeros(0, np.int64),) * 3
    when = clip * (int(frame.max()) + 1) + frame  # sorted
    later, held = np.searchsorted(when, when, side="right"), []
    for k in range(FAN):
        own = np.flatnonzero(later + k < len(clip))
        other = later[own] + k
        gap = frame[other] - frame[own]
        use = (clip[other] == clip[own]) & (gap <= REACH)
        own, other, gap = own[use], other[use], gap[use]
        held.append((clip[own], frame[own], band[own] << 14 | band[other] << 6 | gap))
    clip, frame, code = (np.concatenate([h[k] for h in held]) for k in range(3))
    order = np.lexsort((code, frame, clip))
    return clip[order], frame[order], code[order]


_OUT = "struct<rate: int, channels: int, samples: int, times: array<int>, codes: array<int>, error: string>"


def fingerprint_column(wav: Column) -> Column:
    @F.arrow_udf(_OUT)
    def of(blobs: pa.Array) -> pa.Array:
        read, clips, sizes, held, waiting = [], [], [], [], 0

        def flush() -> None:
            nonlocal clips, waiting
            clip, frame, code = fingerprints(clips)
            sizes.append(np.bincount(clip, minlength=len(clips)))
            held.append((frame.astype(np.int32), code.astype(np.int32)))
            clips, waiting = [], 0

        for blob in blobs:
            x, rate, channels, error = read_wav(blob.as_py())
            read.append((rate, channels, len(x), error))
            clips.append(x)
            waiting += len(x)
            if waiting >= SAMPLES_AT_ONCE:
                flush()
        if clips:
            flush()
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        frame = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.int32)
        code = np.concatenate([h[1] for h in held]) if held else np.zeros(0, np.int32)
        columns = list(zip(*read)) if read else [(), (), (), ()]
        return pa.StructArray.from_arrays(
            [*(pa.array(c, pa.int32()) for c in columns[:3]), pa.ListArray.from_arrays(offsets, pa.array(frame)), pa.ListArray.from_arrays(offsets, pa.array(code)), pa.array(columns[3], pa.string())],
            names=["rate", "channels", "samples", "times", "codes", "error"],
        )

    return of(wav)


def render_text(text: Column) -> Column:
    """A WAV value whose 8-bit samples are the UTF-8 bytes of the text; null for a null text."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else write_wav(t.encode("utf-8", "surrogatepass")) for t in texts.to_pylist()], pa.binary())

    return of(text.cast("string"))


def fingerprint_media(media: DataFrame, key: str = "doc_id", wav: str = "wav") -> DataFrame:
    """``<key>, rate, channels, samples, times, codes, error`` of every row.

    ``times[i]`` is the frame of pair i and ``codes[i]`` its code; both are sorted by time, then code.  The whole clip counts.

    * null WAV: empty arrays and error ``null``.  Bytes that are no WAV: empty arrays and what is wrong.  No samples, or silence: empty arrays, no error.
    * null key: reported with a null.  Repeated rows: each is reported; equal sounds have equal arrays.
    * ties: equally loud neighbours are all peaks.  An empty table gives no rows.
    * further columns, whatever their names, are ignored.
    """
    found = media.select(F.col(key), fingerprint_column(F.col(wav)).alias("f"))
    return found.select(key, *(F.col(f"f.{c}").alias(c) for c in ("rate", "channels", "samples", "times", "codes", "error")))


def sound_of(docs: DataFrame) -> DataFrame:
    """A table of sounds to work on: each document as a WAV value."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), render_text(F.col("text")).alias("wav"))


