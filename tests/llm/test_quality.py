import numpy as np
import pyarrow as pa

from tidewheel.llm import quality as Q

SF = "/root/testdata/sf0.01"


def walk(forest, row):
    total = forest.base
    inner = forest.feature.shape[1]
    for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf):
        k = 0
        while k < inner:
            k = 2 * k + 1 + int(row[f[k]] > c[k])
        total += leaf[k - inner]
    return 1 / (1 + np.exp(-total))


def test_flat_traversal_is_a_walk_of_each_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = Q.grow(x, y, trees=20, depth=3)
    assert np.allclose(forest.predict(x[:50]), [walk(forest, r) for r in x[:50]])
    assert ((forest.predict(x) >= 0.5) == (y == 1)).mean() > 0.97


def test_splits_are_the_best_of_all():
    """Every split of a tree against trying each value of each feature."""
    for seed in range(12):
        rng = np.random.default_rng(seed)
        x = rng.integers(0, 12, (60, 4)).astype(np.float32)
        y = (rng.random(60) < 0.2 + 0.6 * (x[:, seed % 4] > 5)).astype(float)
        forest = Q.grow(x, y, trees=1, depth=2, bins=400, least=1.0, ridge=1.0)
        p = y.mean()
        g, h = p - y, np.full(60, p * (1 - p))
        rows = {0: np.arange(60)}
        for node in range(3):
            own = rows[node]
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1.0)
            best = 0.0
            for f in range(4):
                for cut in np.unique(x[:, f]):
                    left, right = own[x[own, f] <= cut], own[x[own, f] > cut]
                    if h[left].sum() >= 1.0 and h[right].sum() >= 1.0:
                        best = max(best, score(left) + score(right) - score(own))
            f, cut = forest.feature[0, node], forest.cut[0, node]
            left, right = own[x[own, f] <= cut], own[x[own, f] > cut]
            got = score(left) + score(right) - score(own) if len(right) else 0.0
            assert abs(got - best) < 1e-6 or best < 1e-5
            rows[2 * node + 1], rows[2 * node + 2] = left, right


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").toPandas()
    found = Q.classify_quality(docs, train).toPandas().merge(test, on="doc_id")
    good = found[found.quality == 1]
    assert ((found.score >= 0.5) == (found.quality == 1)).mean() > 0.97 and good.keep.mean() > 0.98


def test_statistics_by_hand():
    x = dict(zip(Q.FEATURES, Q.statistics(pa.array(["Ab 1! ab\n"]))[0].tolist()))
    assert abs(x["upper"] - 1 / 9) < 1e-6 and abs(x["digit"] - 1 / 9) < 1e-6 and abs(x["symbol"] - 1 / 9) < 1e-6
    assert abs(x["distinct_words"] - 2 / 3) < 1e-6 and abs(x["top_word"] - 2 / 3) < 1e-6
    assert Q.statistics(pa.array([None, ""], pa.string())).shape == (2, len(Q.FEATURES))


def test_odd_rows_and_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (7, 0, 0), (None, 1, 0), (1, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = Q.classify_quality(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(r.score is not None and r.keep == (r.score >= 0.5) for r in rows)
    by_text = [(r.text, s.score) for r, s in zip(odd_docs.collect(), rows)]
    assert all(s == 0 for t, s in by_text if t is None or not any(c.isalnum() for c in t))
    none = labels.where("false")
    assert {r.score for r in Q.classify_quality(odd_docs.where("doc_id = 5"), none).collect()} == {0.5}
    assert Q.classify_quality(no_docs, labels).count() == 0
    kept = Q.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns


def test_sample_is_bounded(spark, make_docs):
    docs = make_docs([(k, f"text {k} " + ("!!! " if k % 2 else "") * 9) for k in range(60)])
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) AS quality", "0 AS toxic")
    assert Q.train(docs, labels, max_rows=0).feature.shape[0] == 0
    assert Q.train(docs, labels, max_rows=50).feature.shape[0] > 0
