import io
import wave

import numpy as np
import pytest

from tidewheel.llm import media as M


def wav(samples, rate=8000, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels), f.setsampwidth(width), f.setframerate(rate)
        f.writeframes(samples)
    return out.getvalue()


def slow_peaks(x):
    """Peaks by looking at every neighbour, a frame at a time."""
    n = M.frame_count(len(x))
    x = np.concatenate([x - x.mean(), np.zeros((n - 1) * M.HOP + M.FRAME - len(x), np.float32)]).astype(np.float32)
    level = np.array([np.abs(np.fft.rfft(x[k * M.HOP : k * M.HOP + M.FRAME] * M._HANN)) for k in range(n)]).astype(np.float32).round(4)
    out = []
    for t in range(n):
        for b in range(M.BANDS):
            near = level[max(0, t - M.NEAR_FRAMES) : t + M.NEAR_FRAMES + 1, max(0, b - M.NEAR_BANDS) : b + M.NEAR_BANDS + 1]
            if level[t, b] >= near.max() and level[t, b] > M.STANDS_OUT * level[t].mean() and level[t, b] > 1e-3:
                out.append((t, b))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_peaks_and_pairs_by_hand(seed):
    rng = np.random.default_rng(seed)
    clips = [rng.normal(size=int(n)).astype(np.float32) for n in (900, 0, 100, 3000, 257)]
    clip, frame, band = M.peaks(clips)
    want = [(k, t, b) for k, c in enumerate(clips) if len(c) for t, b in slow_peaks(c)]
    assert list(zip(clip, frame, band)) == want
    pairs = []
    for k in range(len(clips)):
        own = [(t, b) for c, t, b in want if c == k]
        for i, (t, b) in enumerate(own):
            later = [p for p in own[i + 1 :] if p[0] > t][: M.FAN]
            pairs += [(k, t, b << 14 | b2 << 6 | t2 - t) for t2, b2 in later if t2 - t <= M.REACH]
    assert list(zip(*M.fingerprints(clips))) == sorted(pairs)


def test_portions_give_the_same(monkeypatch):
    clip = [np.random.default_rng(0).normal(size=20000).astype(np.float32)]
    whole = [a.tolist() for a in M.fingerprints(clip)]
    monkeypatch.setattr(M, "SAMPLES_AT_ONCE", 600)
    assert [a.tolist() for a in M.fingerprints(clip)] == whole


def test_a_tone_peaks_at_its_band():
    t = np.arange(4000) / 8000
    _, _, band = M.peaks([np.sin(2 * np.pi * 1000 * t).astype(np.float32)])
    assert set(band[2:-2]) == {round(1000 * M.FRAME / 8000)}


@pytest.mark.parametrize("width, kind", [(1, np.uint8), (2, "<i2"), (4, "<i4")])
def test_formats(width, kind):
    x = np.array([0, 0.5, -0.5, 0.25])
    raw = ((x * 128 + 128) if width == 1 else x * (1 << (8 * width - 1))).astype(kind)
    got, rate, channels, error = M.read_wav(wav(raw.tobytes(), 11025, 1, width))
    assert np.allclose(got, x, atol=0.01) and (rate, channels, error) == (11025, 1, None)
    stereo, _, two, _ = M.read_wav(wav(np.repeat(raw, 2).tobytes(), 8000, 2, width))
    assert two == 2 and np.allclose(stereo, x, atol=0.01)


def test_24_bits():
    x = [0, 1 << 22, -(1 << 22)]
    got, *_ = M.read_wav(wav(b"".join((v & 0xFFFFFF).to_bytes(3, "little") for v in x), width=3))
    assert np.allclose(got, [0, 0.5, -0.5])


def test_rows(spark):
    tone = wav((np.sin(np.arange(5000) / 3) * 9000).astype("<i2").tobytes())
    rows = [(1, tone), (2, None), (3, b""), (4, b"RIFFxxxx"), (5, wav(b"")), (5, wav(b"")), (None, tone), (6, tone[:-31]), (7, wav(bytes(4000)))]
    df = spark.createDataFrame(rows, "doc_id long, wav binary").selectExpr("*", "1 AS f", "2 AS times", "3 AS codes")
    got = M.fingerprint_media(df).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows] and got[0].codes and got[0].codes == got[6].codes and got[0].times == sorted(got[0].times)
    assert got[1].error == "null" and got[2].error and got[3].error and got[4].error is None and got[4].codes == [] and got[8].codes == []
    assert M.fingerprint_media(df.where("false")).count() == 0


def test_sound_of_documents(odd_docs, make_docs):
    got = M.fingerprint_media(M.sound_of(odd_docs)).collect()
    for r, d in zip(got, odd_docs.collect()):
        assert r.samples == len((d.text or "").encode()) and (r.error == "null") == (d.text is None)
    text = "Some words that make a sound when read as samples. " * 30
    a, b = M.fingerprint_media(M.sound_of(make_docs([(1, text), (2, text)]))).collect()
    assert a.codes == b.codes and len(a.codes) > 0
