import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import kernel as K

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
TEXTS = st.lists(st.one_of(st.none(), st.text("ab é-\n1漢", max_size=40)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    words = K.tokenize(pa.array(texts, pa.string()))
    expected = [WORD.findall((t or "").lower()) for t in texts]
    assert np.diff(words.offsets).tolist() == [len(e) for e in expected]
    found = [bytes(words.data[a:z]).decode() for a, z in zip(words.starts, words.ends)]
    assert found == [w for e in expected for w in e]
    same = {}
    for w, h in zip(found, words.hashes.tolist()):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_ngram_sets(texts, n):
    words = K.tokenize(pa.array(texts, pa.string()))
    doc, grams = K.unique_sets(*K.ngram_sets(words, n))
    for k, t in enumerate(texts):
        w = WORD.findall((t or "").lower())
        kinds = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        assert (doc == k).sum() == len(kinds)
    assert (np.diff(doc) >= 0).all()


def test_long_text_in_pieces(monkeypatch):
    text = pa.array(["abc defgh " * 500])
    whole = K.tokenize(text).hashes
    monkeypatch.setattr(K, "_PIECE", 37)
    assert (K.tokenize(text).hashes == whole).all()


def test_chunks_cover_all():
    texts = pa.array(["x" * k for k in range(50)] + [None, "y" * 500])
    spans = list(K.chunks(texts, 100))
    assert spans[0][0] == 0 and spans[-1][1] == 52 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
