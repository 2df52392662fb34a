import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewheel.llm import kernel as K
from tidewheel.llm import suffix_dedup as S

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
L = S.LENGTH


@pytest.mark.parametrize("seed", range(25))
def test_suffix_order_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    n, letters = int(rng.integers(1, 60)), int(rng.integers(1, 4))
    length = rng.integers(1, 45, n)
    words = rng.integers(0, letters, int(length.sum()) + 3).astype(np.uint32)
    start, group = np.cumsum([0, *length])[:-1], rng.integers(0, 3, n)
    order, lcp = S.sort_suffixes(words, start, length, group)
    seq = [(int(g), words[s : s + m].tolist()) for g, s, m in zip(group, start, length)]
    got = [seq[i] for i in order]
    assert got == sorted(seq)
    for k, (a, b) in enumerate(zip(got[1:], got), 1):
        same = next((i for i, (x, y) in enumerate(zip(a[1], b[1])) if x != y), min(len(a[1]), len(b[1])))
        assert lcp[k] == (same if a[0] == b[0] else -1)


def brute(rows):
    """Passages and what dropping leaves, by counting every window."""
    none = 1 << 62
    tokens = [(none if d is None else d, WORD.findall((t or "").lower())) for d, t in rows]
    docs = defaultdict(set)
    for d, w in tokens:
        for i in range(len(w) - L + 1):
            docs[tuple(w[i : i + L])].add(d)
    spans, left = set(), []
    for d, w in tokens:
        marks, owner, gone = [False] * len(w), {}, [False] * len(w)
        for i in range(len(w) - L + 1):
            o = docs[tuple(w[i : i + L])]
            if len(o) > 1:
                owner[i] = min(o)
                for j in range(i, i + L):
                    marks[j] = True
                    gone[j] |= min(o) < d
        i = 0
        starts = sorted(owner)
        while starts:
            b = e = starts[0]
            first = owner[b]
            e = b + L
            starts.pop(0)
            while starts and starts[0] <= e:
                first = min(first, owner[starts[0]])
                e = starts.pop(0) + L
            spans.add((None if d == none else d, b, e - b, None if first == none else first))
        left.append([x for x, g in zip(w, gone) if not g])
    return spans, left


def same(make_docs, rows):
    docs = make_docs(rows, clash=True)
    spans, left = brute(rows)
    got = {(r.doc_id, r.start_word, r.n_words, r.first_doc_id) for r in S.repeated_passages(docs).collect()}
    assert got == spans
    kept = S.drop_repeats(docs)
    assert kept.columns == docs.columns
    want = sorted(str((d, x)) for (d, t), x in zip(rows, left) if x or not WORD.search(t or ""))
    out = kept.collect()
    assert sorted(str((r.doc_id, WORD.findall((r.text or "").lower()))) for r in out) == want
    assert all(r.n_chars == len(r.text) for r in out if r.text is not None)
    return out


def test_against_all_windows(make_docs):
    random.seed(4)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = random.choices(vocabulary, k=90)
    other = random.choices(vocabulary, k=51)
    rows = []
    for k in range(40):
        w = random.choices(vocabulary, k=random.randint(0, 150))
        for p in random.sample([passage, other, passage[20:75], passage[:50], passage[:49]], k=random.randint(0, 2)):
            at = random.randint(0, len(w))
            w[at:at] = p
        if k % 5 == 0 and rows:
            w = rows[-1][1].split()
            if w:
                w[random.randrange(len(w))] = "edited"
        rows.append((random.choice([k, k, k, 3, None]), " ".join(w)))
    rows += [rows[2], rows[7], (77, rows[7][1]), (78, "a b " * 80), (79, "a b " * 60), (80, "same " * 200), (81, "same " * 120)]
    same(make_docs, rows)


def test_near_copies_of_one_text(make_docs):
    random.seed(9)
    base = [f"t{random.randrange(500)}" for _ in range(300)]
    rows = []
    for k in range(30):
        w = list(base)
        for _ in range(k % 7):
            w[random.randrange(300)] = f"e{random.randrange(5)}"
        rows.append((k, ". ".join(w)))
    same(make_docs, rows)


@pytest.mark.parametrize("most", [1, 4])
def test_boilerplate_is_sorted_in_parts(make_docs, monkeypatch, most):
    """The same result where minimisers have more runs than are sorted at once."""
    monkeypatch.setattr(S, "RUNS_AT_ONCE", most)
    random.seed(12)
    core = [f"b{random.randrange(90)}" for _ in range(140)]
    rows = []
    for k in range(25):
        w = list(core)
        if k % 3 == 0:
            w[random.randrange(140)] = f"e{k}"
        rows.append((k, " ".join([f"x{k}{j}" for j in range(k % 4)] + w + [f"y{k % 5}"])))
    same(make_docs, [*rows, (90, rows[1][1]), (None, rows[2][1])])


def test_equal_runs_are_found():
    rng = np.random.default_rng(2)
    n, off = rng.integers(1, 4, 60), rng.integers(0, 3, 60)
    runs = [rng.integers(0, 2, m - 1 + L).astype(np.uint32) // 2 + (rng.random(m - 1 + L) < 0.002) for m in n]
    base = np.cumsum([0, *map(len, runs)])[:-1]
    words = np.concatenate(runs).astype(np.uint32)
    gram = np.array([hash(tuple(r[o : o + S.GRAM].tolist())) for r, o in zip(runs, off)])
    first = S.same_runs(words, base, n, off, gram)
    key = [(int(g), int(o), r.tolist()) for g, o, r in zip(gram, off, runs)]
    for a in range(60):
        for b in range(60):
            assert (first[a] == first[b]) == (key[a] == key[b])


CLASHES = ("__id", "__rank", "__node", "__doc", "__th", "__ranges", "__new", "row", "left", "ranges", "doc", "th", "node", "id", "first", "place", "a.b")


def test_values_of_clashing_columns_stay(make_docs):
    from pyspark.sql import functions as F

    words = " ".join(f"q{k}" for k in range(60))
    docs = make_docs([(1, f"Start {words} end"), (2, f"Another one {words} and on"), (3, None), (4, "plain text")])
    docs = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce("doc_id", F.lit(0))).alias(c) for c in CLASHES))
    out = S.drop_repeats(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == 4 and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASHES)


def test_odd_rows(odd_docs, no_docs, make_docs):
    same(make_docs, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert S.repeated_passages(no_docs).count() == 0 and S.drop_repeats(no_docs).count() == 0


def test_cut_keeps_the_rest(make_docs):
    words = " ".join(f"q{k}" for k in range(60))
    out = {r.doc_id: r.text for r in S.drop_repeats(make_docs([(1, f"Start, {words}. End!"), (2, f"Another «one» {words}. And Ünd."), (3, words)])).collect()}
    assert out == {1: f"Start, {words}. End!", 2: "Another «one» And Ünd."}


def test_equal_windows_have_equal_minimisers():
    random.seed(1)
    core = [f"c{k}" for k in range(L)]
    texts = [" ".join([f"x{random.randrange(99)}" for _ in range(random.randrange(80))] + core + [f"y{random.randrange(99)}" for _ in range(random.randrange(80))]) for _ in range(20)]
    words = K.tokenize(pa.array(texts))
    doc, s, n, off, gram = S.runs_of_windows(words)
    seen = set()
    for k, t in enumerate(texts):
        at = t.split().index("c0")
        own = [(g, s_ + o - at) for d, s_, n_, o, g in zip(doc, s, n, off, gram) if d == k and s_ <= at < s_ + n_]
        assert len(own) == 1
        seen.add(own[0])
    assert len(seen) == 1
