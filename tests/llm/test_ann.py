import numpy as np

from tidewheel.llm import ann as A

KIND = "vec_id long, embedding array<float>"


def exact(ids, x, k):
    d = ((x[:, None, :].astype(float) - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return {i: [ids[j] for j in np.lexsort((ids, d[r]))[: min(k, len(ids) - 1)]] for r, i in enumerate(ids)}


def recall(spark, path):
    rows = spark.read.parquet(path)
    p = rows.toPandas().sort_values("vec_id")
    x, ids = np.stack(p.embedding.to_numpy()).astype(np.float32), p.vec_id.to_numpy()
    best = exact(ids, x, 10)
    found = A.nearest_neighbours(rows).collect()
    assert len(found) == len(ids)
    return np.mean([len(set(best[r.vec_id]) & set(r.neighbours)) / 10 for r in found])


def test_recall_on_the_given_vectors(spark):
    assert recall(spark, "/root/testdata/sf0.01/embeddings.parquet") >= 0.9


def test_recall_on_more_vectors(spark):
    assert recall(spark, "/root/testdata/sf0.1/embeddings.parquet") >= 0.9


def test_recall_over_many_cells(spark, monkeypatch):
    """Coarse cells with copies at their boundaries, in portions: as tables of millions of vectors are searched."""
    monkeypatch.setattr(A, "cell_count", lambda n: 5)
    monkeypatch.setattr(A, "centre_count", lambda n: 40)
    assert recall(spark, "/root/testdata/sf0.1/embeddings.parquet") >= 0.9


def test_graph_search_is_by_ratio_alone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    q = rng.normal(size=(60, 16)).astype(np.float32)
    d = A.squared(q, x)
    for ratio in (1.05, 1.3, 1.6):
        row, node, e = A.Graph(x).within(q, ratio)
        want = {(r, c) for r, c in zip(*np.nonzero(d <= ratio**2 * d.min(1, keepdims=True)))}
        got = set(zip(row.tolist(), node.tolist()))
        assert len(got & want) >= 0.95 * len(want) and all(e[k] <= e[k + 1] + 1e-6 for k in range(len(e) - 1) if row[k] == row[k + 1])
    row, node, e = A.Graph(x).within(q, 1.0, least=5)
    assert np.bincount(row).min() == 5


def test_graph_of_few_points():
    for n in (1, 2, 3):
        x = np.eye(3, dtype=np.float32)[:n]
        row, node, d = A.Graph(x).within(x, 9.0)
        assert sorted(zip(row.tolist(), node.tolist())) == sorted((r, c) for r in range(n) for c in range(n) if r == c) or len(row) == n * n


def test_answers_do_not_depend_on_portions(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[40:60] = x[40]
    ids = rng.permutation(700).astype(np.int64)

    def run(portion, pending):
        monkeypatch.setattr(A, "PENDING", pending)
        cell = A.Cell(ids[:400], x[:400], 10)
        for a in range(0, 700, portion):
            cell.offer(ids[a : a + portion], x[a : a + portion])
        return cell.found, cell.d, cell.compared

    one, other = run(700, 10**9), run(37, 50)
    assert all((a == b).all() for a, b in zip(one, other))


def test_search_is_exact_within_the_lists_read():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6)).astype(np.float32)
    ids = np.arange(600)
    cell = A.Cell(ids, x, 10)
    cell.offer(ids, x)
    best = exact(ids, x, 10)
    everything = np.flatnonzero(cell.read == len(cell.graph.points))
    assert len(everything) > 20 and all(cell.found[r].tolist() == best[r] for r in everything)


def test_cells_are_groups_of_neighbours_of_equal_weight():
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.normal(size=(50, 4)), rng.normal(size=(50, 4)) + 20]).astype(np.float32)
    cell = A.cells_of(points, np.full(100, 7.0), 4)
    assert np.bincount(cell).tolist() == [25] * 4 and not set(cell[:50]) & set(cell[50:])
    assert A.cells_of(points[:1], np.ones(1), 9).tolist() == [0] and sorted(A.cells_of(points[:3], np.zeros(3), 9)) == [0, 1, 2]
    row, where = A.cells_near(A.Graph(points), cell, points[:10])
    assert where[np.searchsorted(row, np.arange(10))].tolist() == cell[:10].tolist() and len(set(zip(row, where))) == len(row)


def test_lists_are_balanced():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(3000, 8)), 0.01 * rng.normal(size=(3000, 8)) + 5]).astype(np.float32)
    points, price = A.balanced_lists(x)
    size = np.bincount((A.squared(x, points) + price).argmin(1), minlength=len(points))
    assert size.max() <= 8 * size.mean()


def test_few_and_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (3, [9.0, 9.0]), (4, None), (None, [1.0, 1.0]), (5, [1.0]), (6, [float("nan"), 0.0]), (7, [0.0, 0.0]), (8, [None, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS list", "2 AS query", "3 AS v")
    found = {r.vec_id: r for r in A.nearest_neighbours(df, k=2).collect()}
    assert sorted(found) == [1, 2, 3, 7]
    assert found[1].neighbours == [7, 2] and found[1].distances == [0.0, 1.0] and found[2].neighbours == [1, 7]
    assert found[3].neighbours == [1, 7]
    assert A.nearest_neighbours(spark.createDataFrame([], KIND)).count() == 0
    one = A.nearest_neighbours(spark.createDataFrame([(1, [1.0])], KIND)).collect()
    assert [r.neighbours for r in one] in ([], [[]])


def test_ties_beyond_k(spark):
    df = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(30)], KIND)
    for r in A.nearest_neighbours(df, k=5).collect():
        assert r.neighbours == [i for i in range(30) if i != r.vec_id][:5]
