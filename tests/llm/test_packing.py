import numpy as np
import pytest
import tiktoken

from tidewheel.llm import bpe as B
from tidewheel.llm import packing as P

ENCODER = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=B.read_vocabulary(), special_tokens={})


def unpacked(docs, window):
    out = []
    for doc_id, text in docs:
        n = len(ENCODER.encode_ordinary(text or ""))
        out += [(doc_id, s, min(window, n - s)) for s in range(0, n, window)]
    return sorted(out, key=str)


def check(rows, docs, window):
    assert sorted(((r.doc_id, r.start, r.length) for r in rows), key=str) == unpacked(docs, window)
    packs = {}
    for r in rows:
        packs.setdefault(r.pack_id, []).append((r.offset, r.length, r.slot))
    for places in packs.values():
        places.sort()
        assert all(a + n <= b for (a, n, _), (b, _, _) in zip(places, places[1:]))
        assert places[-1][0] + places[-1][1] <= window
        assert [s for _, _, s in places] == list(range(len(places)))
    assert sorted(packs) == list(range(len(packs)))
    return packs


def first_fit(lengths, window):
    bins = []
    for n in sorted(lengths, reverse=True):
        for k, free in enumerate(bins):
            if free >= n:
                bins[k] -= n
                break
        else:
            bins.append(window - n)
    return len(bins)


def test_places_and_density(make_docs):
    rng = np.random.default_rng(1)
    docs = [(k, " ".join(["w"] * int(n))) for k, n in enumerate(rng.integers(1, 600, 400))]
    packs = check(P.pack_documents(make_docs(docs, clash=True), 256).collect(), docs, 256)
    rounded = [2 * -(-n // 2) for _, _, n in unpacked(docs, 256)]
    assert len(packs) <= 1.03 * first_fit(rounded, 256) + 2


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_the_histogram_exactly(seed):
    rng = np.random.default_rng(seed)
    h = np.zeros(33, dtype=np.int64)
    h[1:] = rng.integers(0, 40, 32) * (rng.random(32) < (0.2, 0.9)[seed % 2])
    used = np.zeros_like(h)
    for shape, times in P.plan_packs(h):
        assert sum(shape) <= 32 and times > 0
        for k in shape:
            used[k] += times
    assert (used == h).all()


def test_nnls_is_a_minimum():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.normal(size=(8, 12)), rng.normal(size=8)
        x = P.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g <= 1e-6).all() and abs(g @ x) < 1e-6


def test_combinations():
    assert set(P.combinations([4, 3, 2, 1], 4, 3)) == {(4,), (3, 1), (2, 2), (2, 1, 1)}


def test_odd_rows(odd_docs, no_docs):
    rows = P.pack_documents(odd_docs, 2048).collect()
    check(rows, [(r.doc_id, r.text) for r in odd_docs.collect()], 2048)
    assert P.pack_documents(no_docs).count() == 0


def test_many_slots(make_docs, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_SLOT", 7)
    docs = [(k % 40, "w " * (1 + k % 5)) for k in range(200)]
    check(P.pack_documents(make_docs(docs), 128).collect(), docs, 128)


def test_windows_hold_every_token_once(make_docs):
    rng = np.random.default_rng(5)
    words = ["tide", "wheel", "über", "漢字", "running", "42", "..."]
    docs = [(k, " ".join(rng.choice(words, int(n)))) for k, n in enumerate(rng.integers(0, 500, 60))]
    docs += [docs[3], (3, "another text under that id"), (None, "no id " * 90), (None, None), (70, ""), (71, docs[4][1])]
    rows = P.pack_windows(make_docs(docs, clash=True), 256).collect()
    assert sorted(r.pack_id for r in rows) == list(range(len(rows)))
    got = []
    for r in rows:
        assert len(r.tokens) == sum(r.lengths) <= 256
        at = 0
        for d, s, n in zip(r.doc_ids, r.starts, r.lengths):
            got.append((d, s, tuple(r.tokens[at : at + n])))
            at += n
    want = []
    for d, t in docs:
        ids = ENCODER.encode_ordinary(t or "")
        want += [(d, s, tuple(ids[s : s + 256])) for s in range(0, len(ids), 256)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_as_few_windows_as_greedy_packing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = P.pack_documents(docs).collect()
    lengths = [16 * -(-n // 16) for _, _, n in unpacked([(r.doc_id, r.text) for r in docs.collect()], 2048)]
    assert len({r.pack_id for r in rows}) <= 1.03 * first_fit(lengths, 2048) + 2
