import numpy as np
from pyspark.sql import functions as F

from tidewheel.llm import langid as G


def by_hand(text):
    """The hypervector of a text, one trigram at a time."""
    letters = [c for c in " " + "".join(ch.lower() if ch.isalpha() else " " for ch in text) + " "]
    squeezed = [c for k, c in enumerate(letters) if c != " " or k == 0 or letters[k - 1] != " "]
    total = np.zeros(G.DIM)
    for t in zip(squeezed, squeezed[1:], squeezed[2:]):
        a, b, c = (G.character_vectors(np.array([ord(x)], dtype=np.uint64))[0].astype(int) for x in t)
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


def test_bundles_by_hand():
    texts = ["Hello, world!", "", None, "ÉCOLE  d'été 42 fois", "a", "漢字 и кириллица"]
    doc, codes = G.trigrams(texts)
    got = G.bundle(doc, codes, len(texts))
    for k, t in enumerate(texts):
        assert (got[k] == (by_hand(t) if t else 0)).all()


def test_blocks_add_up(monkeypatch):
    doc, codes = G.trigrams(["some text to be read", "another text"])
    whole = G.bundle(doc, codes, 2)
    monkeypatch.setattr(G, "BLOCK", 3)
    assert (G.bundle(doc, codes, 2) == whole).all()


def test_vectors_are_nearly_orthogonal():
    v = G.character_vectors(np.arange(97, 123, dtype=np.uint64)).astype(float)
    cosines = v @ v.T / G.DIM
    assert np.abs(cosines - np.eye(26)).max() < 0.2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = G.prototypes(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1 AND n_chars > 100")
    got = rest.select(F.col("lang").alias("told"), G.identify(profiles).alias("f")).select("told", "f.lang").toPandas()
    assert (got.iloc[:, 0] == got.iloc[:, 1]).mean() > 0.97


def test_decisions_by_hand(make_docs):
    """Language, cosine and decision of every text, from whole hypervectors added up without the text itself."""
    rows = [(1, "the dog and the cat saw the house", "en"), (2, "a house and a dog", "en"), (3, "le chat et le chien voient la maison", "fr"), (4, "la maison et le chien", "fr")]
    rows += [(5, "the", "en"), (6, "zzkq wvxj", "en"), (7, "hund", "de"), (8, "the house and le chien", None), (9, "42 !", "en"), (10, "aaaa aaaa aaaa " * 50, "fr")]
    got = {r.doc_id: r for r in G.identify_language(make_docs(rows)).collect()}
    vectors = {d: by_hand(t) if any(c.isalpha() for c in t) else np.zeros(G.DIM) for d, t, _ in rows}
    counts = {d: len(G.trigrams([t])[0]) for d, t, _ in rows}
    for d, t, lang in rows:
        v = vectors[d]
        if not v.any():
            assert got[d].detected is None and got[d].cosine is None and not got[d].accepted
            continue
        scores = {}
        for name in ("de", "en", "fr"):
            others = [vectors[e] for e, _, other in rows if other == name and (e != d or name == "de")]
            p = sum(others)
            scores[name] = v @ p / np.linalg.norm(v) / np.linalg.norm(p)
        best = max(scores, key=lambda k: (scores[k], k))
        assert got[d].detected == best and abs(got[d].cosine - scores[best]) < 2e-6
        whole = sum(vectors[e] for e, _, other in rows if other == best)
        n = sum(counts[e] for e, _, other in rows if other == best)
        usual = min(1, np.sqrt(counts[d] ** 2 / (v @ v / G.DIM) * (whole @ whole) / G.DIM / n**2))
        assert got[d].accepted == (scores[best] >= G.MIN_SHARE * usual - G.NOISE / np.sqrt(G.DIM))


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert G.keep_known(good).count() == good.count()


def test_foreign_text_goes(make_docs):
    rows = [(k, "the cat and the dog went to the house and saw the other dog there " * 4, "en") for k in range(20)]
    strange = "zqxj vkwq xzzq jqkv wvxq qqzk kxjz vqwx zkqj xwvk jzqq kvxw " * 3
    got = {r.doc_id: r for r in G.identify_language(make_docs([*rows, (99, strange, None)])).collect()}
    assert got[0].accepted and got[0].detected == "en" and not got[99].accepted


def test_odd_rows(odd_docs, no_docs, make_docs):
    rows = G.identify_language(odd_docs).collect()
    for r, d in zip(rows, odd_docs.collect()):
        letters = any(c.isalpha() for c in d.text or "")
        assert (r.detected is not None) == letters and (letters or not r.accepted)
    assert G.keep_known(odd_docs).columns == odd_docs.columns
    assert G.identify_language(no_docs).count() == 0 and G.keep_known(no_docs).count() == 0
    untold = G.identify_language(make_docs([(1, "some words", None)])).first()
    assert untold.detected is None and untold.accepted
