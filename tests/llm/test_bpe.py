import os

import numpy as np
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import bpe as B

RANKS = B.read_vocabulary()
CODEC = B.Codec(RANKS)
REFERENCE = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXT = st.lists(st.sampled_from([*"ab'stredlvm 12½é漢!?.\n\t  ", "😀", "don't", " the", "'re"]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_like_the_public_encoder(texts):
    ids, sizes = CODEC.encode(texts)
    at = 0
    for t, n in zip(texts, sizes):
        assert ids[at : at + n].tolist() == REFERENCE.encode_ordinary(t)
        at += n
    assert CODEC.decode(ids).tobytes() == "".join(texts).encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=4))
def test_parts_of_any_text(texts):
    whole, starts, _, per = CODEC.split(texts)
    ends = [*starts[1:], len(whole)]
    assert [whole[a:z] for a, z in zip(starts, ends)] == [m for t in texts for m in regex.findall(B.PATTERN, t)]
    assert per.tolist() == [len(regex.findall(B.PATTERN, t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=24))
def test_merges_one_by_one(word):
    parts = [word[i : i + 1] for i in range(len(word))]
    if word not in RANKS:
        while True:
            ranked = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    else:
        parts = [word]
    assert CODEC.merge(word) == [RANKS[p] for p in parts]


def test_small_cache_gives_the_same():
    text = ["some words here, some words there 123 " * 20]
    assert B.Codec(RANKS, keep=3).encode(text)[0].tolist() == CODEC.encode(text)[0].tolist()


def test_another_pattern():
    codec = B.Codec(RANKS, pattern=r"\S+|\s+")
    ids, _ = codec.encode(["ab cd", "e"])
    assert codec.decode(ids).tobytes() == b"ab cde"


def test_rows(odd_docs, no_docs):
    rows = B.encode(odd_docs).collect()
    for r, d in zip(rows, odd_docs.collect()):
        if d.text is None:
            assert r.tokens is None and r.n_tokens == 0 and r.decoded is None
        else:
            assert r.decoded and r.tokens == REFERENCE.encode_ordinary(d.text) and r.n_tokens == len(r.tokens)
    back = B.decode(B.encode(odd_docs)).collect()
    assert [r.text for r in back] == [d.text for d in odd_docs.collect()]
    assert B.encode(no_docs).count() == 0 and B.decode(B.encode(no_docs)).count() == 0


def test_bad_tokens(spark):
    rows = spark.createDataFrame([(1, [1, 10**6]), (2, [None]), (3, []), (4, None), (5, [-1])], "doc_id long, tokens array<int>")
    assert [r.text for r in B.decode(rows).collect()] == [None, None, "", None, None]
    assert os.path.exists(B.VOCABULARY)


def test_equal_hashes_do_no_harm(spark, monkeypatch):
    """Texts whose parts all have one hash come out right all the same."""
    from tidewheel.llm import kernel as K

    def everything(texts):
        codec = B.Codec(RANKS)
        monkeypatch.setattr(K, "hash_spans", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
        try:
            return [codec.encode_one(t).tolist() for t in texts], codec.encode(texts)
        finally:
            monkeypatch.undo()

    texts = ["some text", "", "another, text 42"]
    one, (ids, size) = everything(texts)
    assert one == [REFERENCE.encode_ordinary(t) for t in texts] and ids.tolist() != [x for o in one for x in o]


def test_counts(make_docs):
    rows = [(1, "a text of words"), (2, ""), (3, None), (None, "漢字 and so on 12.5")]
    got = sorted(((r.doc_id, r.n_tokens) for r in B.count_tokens(make_docs(rows)).collect()), key=str)
    assert got == sorted(((d, len(REFERENCE.encode_ordinary(t or ""))) for d, t in rows), key=str)
