"""Approximate nearest neighbours with balanced posting lists.

1. *Cells.*  sqrt(N) centres by balanced k-means over all vectors, of which neighbouring ones form ``cell_count(N)`` cells (N^(2/3) / 345).
   The centres and a neighbour graph over them are what is broadcast; a vector goes to the cell of its nearest centre, and a boundary
   vector also, as a copy, to every cell with a centre at most ``CELL_RATIO`` times as far.  That is the one shuffle of vectors.
2. *Lists.*  The vectors at home in a cell are clustered by balanced k-means into lists of about ``LIST``; their
   centroids are held in a graph in memory.  Every vector that reaches the cell is posted to its nearest list and, at a
   boundary, to all lists at most ``POST_RATIO`` times as far.
3. *Search.*  Every vector is a query in its home cell: the graph yields the lists whose centroids are at most
   ``SEARCH_RATIO`` times as far as the nearest one, and all that is posted there is compared.  Copies stream through in
   portions, so a task holds its own vectors and one portion.

Distance ratios alone decide about cells and lists; there is no limit on their number, and a floor
(``LEAST``) for queries that sit on a centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.session import cut

K_NEAREST = 10
ROUNDS = 2
CELL_RATIO = 1.1
POST_RATIO = 1.05
SEARCH_RATIO = 1.2
LIST = 128
LEAST = 8
DEGREE = 6
WIDEN = 1.1
PORTION_BYTES = 16 << 20
PENDING = 100_000


def cell_count(n: int) -> int:
    """Cells for ``n`` vectors: their number and their size both grow, so neither the broadcast nor a task grows with ``n``."""
    return max(1, round(n ** (2 / 3) / 345))


def centre_count(n: int) -> int:
    """Centres that route ``n`` vectors to cells; many to a cell, so that they tell boundaries apart."""
    return max(1, round(n**0.5))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


class Graph:
    """Neighbour graph over points; a search gives all points within a ratio of the nearest one's distance.

    A point may have a price, which adds to its squared distances: that of a full list keeps lists balanced.
    Links come from buckets round about sqrt(n) pivots, each point being in its four nearest buckets; so building takes
    n^1.5 distances.  The pivots are where every search starts.
    """

    def __init__(self, points: np.ndarray, price: np.ndarray | float = 0.0, seed: int = 7) -> None:
        self.points = np.ascontiguousarray(points, dtype=np.float32)
        self.norms = ((self.points * self.points).sum(1) + price).astype(np.float32)
        n = len(points)
        self.entries = np.random.default_rng(seed).permutation(n)[: int(np.ceil(np.sqrt(n)))]
        pivots = self.points[self.entries]
        near = min(4, len(pivots))
        source, target = [], []
        buckets = np.concatenate([np.argpartition(squared(self.points[a : a + 4096], pivots), near - 1, axis=1)[:, :near] for a in range(0, n, 4096)]) if n else np.zeros((0, 1), np.int64)
        order = np.argsort(buckets.ravel(), kind="stable")
        edges = _runs(buckets.ravel()[order])
        for a, z in zip(edges[:-1], edges[1:]):
            own = order[a:z] // near
            degree = min(DEGREE, len(own) - 1)
            if degree < 1:
                continue
            d = squared(self.points[own], self.points[own])
            np.fill_diagonal(d, np.inf)
            best = np.argpartition(d, degree - 1, axis=1)[:, :degree]
            source.append(np.repeat(own, degree)), target.append(own[best].ravel())
        if source:
            s, t = np.concatenate(source), np.concatenate(target)
            both = np.unique(np.concatenate([s * n + t, t * n + s]))  # both ways, so that every point can be reached
            s, t = both // n, both % n
            self.links, self.first = t, np.searchsorted(s, np.arange(n + 1))
        else:
            self.links, self.first = np.zeros(0, np.int64), np.zeros(n + 1, np.int64)

    def within(self, queries: np.ndarray, ratio: float, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, squared distance) of the points at most ``ratio`` times as far as the nearest, and of the ``least`` nearest met.

        Sorted by query and distance.  A point is expanded while it is within ``WIDEN`` times the ratio of the nearest one met so far.
        """
        n, block = len(self.points), 256
        found: list[tuple[np.ndarray, ...]] = []
        slot = np.empty(block * n, dtype=np.int32)
        for low in range(0, len(queries), block):
            q = queries[low : low + block]
            own = (q * q).sum(1)
            seen = np.zeros(len(q) * n, dtype=bool)
            row = np.repeat(np.arange(len(q)), len(self.entries))
            node = np.tile(self.entries, len(q))
            best = np.full(len(q), np.inf, dtype=np.float32)
            pool: list[tuple[np.ndarray, ...]] = []
            while len(row):
                seen[row * n + node] = True
                d = np.empty(len(row), dtype=np.float32)
                for a in range(0, len(row), 65536):
                    r, p = row[a : a + 65536], node[a : a + 65536]
                    d[a : a + 65536] = own[r] + self.norms[p] - 2 * np.einsum("ij,ij->i", q[r], self.points[p])
                np.maximum(d, 0, out=d)
                pool.append((row, node, d))
                edges = _runs(row)[:-1]
                here = row[edges]
                best[here] = np.minimum(best[here], np.minimum.reduceat(d, edges))
                # a point that left the range while others came nearer is not expanded
                use = d <= (WIDEN * ratio) ** 2 * best[row]
                row, node = row[use], node[use]
                degree = self.first[node + 1] - self.first[node]
                start = np.cumsum(degree) - degree
                at = np.repeat(self.first[node] - start, degree) + np.arange(int(degree.sum()))
                row, node = np.repeat(row, degree), self.links[at]
                key = row * n + node
                fresh = ~seen[key]
                row, node, key = row[fresh], node[fresh], key[fresh]
                slot[key] = np.arange(len(key), dtype=np.int32)
                once = slot[key] == np.arange(len(key), dtype=np.int32)
                row, node = row[once], node[once]
                order = np.argsort(row, kind="stable")
                row, node = row[order], node[order]
            row, node, d = (np.concatenate([p[k] for p in pool]) for k in range(3)) if pool else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
            if least > 1:
                order = np.argsort(row.astype(np.uint64) << np.uint64(32) | d.view(np.uint32).astype(np.uint64), kind="stable")
                row, node, d = row[order], node[order], d[order]
                use = (d <= ratio * ratio * best[row]) | (np.arange(len(row)) - np.searchsorted(row, row) < least)
                found.append((row[use] + low, node[use], d[use]))
            else:
                use = d <= ratio * ratio * best[row]
                row, node, d = row[use], node[use], d[use]
                order = np.lexsort((node, d, row))
                found.append((row[order] + low, node[order], d[order]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) that can be searched: an id, no null or NaN inside, the usual number of components.

    Where an id has several vectors the smallest one stands.
    """
    clean = cut(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        .where("vec_id IS NOT NULL AND size(embedding) > 0")
        .where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    )
    # only ids are shuffled to learn which of them come more than once
    again = cut(clean.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"))
    if not again.isEmpty():
        several = clean.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        clean = cut(clean.join(again, "vec_id", "left_anti").unionByName(several))
    usual = clean.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return clean.where(F.size("embedding") == (usual[0]["dim"] if usual else 0))


def centroids(base: DataFrame, count: int, dim: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(centres, vectors of each) by balanced k-means over all vectors, from those of the smallest id hashes on.

    A full cluster costs a vector more than an empty one, and centres of very small clusters move into very large ones.
    """
    start = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).toPandas()
    points = np.stack(start["embedding"].to_numpy()).astype(np.float32)
    size, weight = np.ones(len(points)), 0.0
    rng = np.random.default_rng(3)
    for _ in range(rounds if len(points) > 1 else 0):
        shared = base.sparkSession.sparkContext.broadcast((Graph(points), size, weight))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph, full, cost = shared.value
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                x = matrix(batch.column(0))
                row, cell, d = graph.within(x, POST_RATIO)
                if not len(row):
                    continue
                charge = d + cost * full[cell]
                order = np.lexsort((charge, row))
                own = order[_runs(row)[:-1]]
                by = np.argsort(cell[own], kind="stable")
                edges = _runs(cell[own][by])
                values = np.column_stack([np.ones(len(own)), d[own], x[row[own]]])[by]
                for c, v in zip(cell[own][by][edges[:-1]].tolist(), np.add.reduceat(values, edges[:-1])):
                    total[c] = total.get(c, 0) + v
            if total:
                yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["cell", "v"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    total[c] = total.get(c, 0) + np.frombuffer(blob)
            if total:
                yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["cell", "v"])

        total = np.zeros((len(points), dim + 2))
        for row in base.select("embedding").mapInArrow(sums, "cell int, v binary").repartition("cell").mapInArrow(add, "cell int, v binary").toLocalIterator():
            total[row["cell"]] = np.frombuffer(row["v"])
        size = total[:, 0].copy()
        some = size > 0
        points = points.copy()
        points[some] = total[some, 2:] / size[some, None]
        spread = total[:, 1].sum() / max(1.0, size.sum())
        weight = 0.05 * spread / size.mean()
        points = _moved(points, size, spread, rng)
        shared.unpersist()
    return points, size


def cells_of(points: np.ndarray, size: np.ndarray, count: int) -> np.ndarray:
    """The cell of each centre: ``count`` groups of neighbours with about equally many vectors, by halving along the widest direction."""
    out, waiting, name = np.zeros(len(points), dtype=np.int64), [(np.arange(len(points)), min(count, len(points)))], 0
    while waiting:
        own, parts = waiting.pop()
        if parts == 1:
            out[own] = name
            name += 1
            continue
        gap = points[own] - points[own].mean(0)
        direction = np.linalg.svd(gap, full_matrices=False)[2][0]
        order = own[np.argsort(gap @ direction, kind="stable")]
        weight = np.cumsum(size[order] + 1e-9)
        left = parts // 2
        cut_at = int(np.clip(np.searchsorted(weight, weight[-1] * left / parts) + 1, left, len(own) - (parts - left)))
        waiting += [(order[:cut_at], left), (order[cut_at:], parts - left)]
    return out


def _moved(points: np.ndarray, size: np.ndarray, spread: float, rng: np.random.Generator) -> np.ndarray:
    """Centres of very small clusters go beside those of very large ones."""
    mean = size.mean()
    poor, rich = np.flatnonzero(size < mean / 4), np.argsort(-size, kind="stable")
    rich = rich[size[rich] > 2 * mean][: len(poor)]
    points[poor[: len(rich)]] = points[rich] + rng.normal(0, 0.1 * np.sqrt(max(spread, 1e-12) / points.shape[1]), (len(rich), points.shape[1]))
    return points


def balanced_lists(x: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, prices) of lists of about ``LIST`` of the vectors: halving at medians, then k-means in which full lists cost more."""
    stack, groups = [np.arange(len(x))], []
    rng = np.random.default_rng(5)
    while stack:
        own = stack.pop()
        if len(own) <= LIST:
            groups.append(own)
            continue
        a, b = x[own[rng.integers(len(own))]], x[own[rng.integers(len(own))]]
        for _ in range(2):
            side = x[own] @ (b - a)
            order = np.argsort(side, kind="stable")
            left, right = own[order[: len(own) // 2]], own[order[len(own) // 2 :]]
            a, b = x[left].mean(0), x[right].mean(0)
        stack += [left, right]
    points = np.stack([x[g].mean(0) for g in groups]) if groups else np.zeros((0, x.shape[1]), np.float32)
    size = np.array([len(g) for g in groups], dtype=np.float64)
    price, norms = np.zeros(len(points)), (x * x).sum(1)
    for _ in range(rounds if len(points) > 1 else 0):
        own, spread = np.empty(len(x), dtype=np.int64), 0.0
        for a in range(0, len(x), 4096):
            part = (points * points).sum(1)[None, :] - 2 * (x[a : a + 4096] @ points.T)
            own[a : a + 4096] = (part + price[None, :]).argmin(1)
            spread += float((part[np.arange(len(part)), own[a : a + 4096]] + norms[a : a + 4096]).sum())
        size = np.bincount(own, minlength=len(points)).astype(np.float64)
        by = np.argsort(own, kind="stable")
        edges = _runs(own[by])
        points = points.copy()
        points[own[by][edges[:-1]]] = np.add.reduceat(x[by], edges[:-1]) / np.diff(edges)[:, None]
        price = np.maximum(price + 0.02 * spread / len(x) * (size / size.mean() - 1), 0)
        price -= price.min()
    return points.astype(np.float32), price.astype(np.float32)


class Cell:
    """The vectors at home in a cell, as queries, with what has been found for them so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, np.ascontiguousarray(x), k
        self.graph = Graph(*balanced_lists(x))
        count = len(self.graph.points)
        row, chosen, _ = self.graph.within(x, SEARCH_RATIO, LEAST)
        self.read = np.bincount(row, minlength=len(x))
        self.home = chosen[np.searchsorted(row, np.arange(len(x)))] if len(x) else np.zeros(0, np.int64)
        first = chosen == self.home[row]
        self.compared = np.zeros(len(x), dtype=np.int64)
        self.norms = (x * x).sum(1)
        self.wide = np.column_stack([-2 * x, np.ones(len(x), np.float32)])
        # the queries of each list: those of which it is the nearest, and the others
        self.asks = []
        for use in (first, ~first):
            by = np.argsort(chosen[use], kind="stable")
            self.asks.append((row[use][by], np.searchsorted(chosen[use][by], np.arange(count + 1))))
        self.d = np.full((len(x), k), np.inf)
        self.found = np.full((len(x), k), np.iinfo(np.int64).max)
        self.pending: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def offer(self, ids: np.ndarray, members: np.ndarray) -> None:
        """Post vectors to the lists and compare them with the queries of those."""
        row, lists, d = self.graph.within(members, POST_RATIO)
        if len(row):
            # of further lists those that are no nearer to the first one than to the vector: the others lie behind it
            nearest = lists[np.searchsorted(row, row)]
            gap = np.concatenate([((self.graph.points[lists[a : a + 65536]] - self.graph.points[nearest[a : a + 65536]]) ** 2).sum(1) for a in range(0, len(row), 65536)])
            use = (lists == nearest) | (gap >= d)
            row, lists = row[use], lists[use]
        by = np.argsort(lists, kind="stable")
        row, edges = row[by], np.searchsorted(lists[by], np.arange(len(self.graph.points) + 1))
        norms = (members * members).sum(1)
        slack = 1e-5 * (float(norms.max(initial=0)) + self.norms)  # float32 against the exact distances of what was found
        wide = np.column_stack([members, norms])
        for asker, cuts in self.asks:
            for one in range(len(edges) - 1):
                own, q = row[edges[one] : edges[one + 1]], asker[cuts[one] : cuts[one + 1]]
                if not len(own) or not len(q):
                    continue
                self.compared[q] += len(own)
                right = wide[own].T
                step = max(1, (8 << 20) // len(own))
                for a in range(0, len(q), step):
                    p = q[a : a + step]
                    limit = (self.d[p, -1] - self.norms[p] + slack[p]).astype(np.float32)
                    at = np.flatnonzero(self.wide[p] @ right <= limit[:, None])
                    if len(at):
                        self._hold(p[at // len(own)], own[at % len(own)], ids, members)
            self._settle()

    def _hold(self, q: np.ndarray, m: np.ndarray, ids: np.ndarray, members: np.ndarray) -> None:
        other = self.ids[q] != ids[m]
        q, m = q[other], m[other]
        for a in range(0, len(q), 65536):
            r, c = q[a : a + 65536], m[a : a + 65536]
            gap = self.x[r].astype(np.float64) - members[c]
            d = np.einsum("ij,ij->i", gap, gap)
            near = d <= self.d[r, -1]
            self.pending.append((r[near], ids[c[near]], d[near]))
            self.waiting += int(near.sum())
        if self.waiting > PENDING:
            self._settle()

    def _settle(self) -> None:
        """The best ``k`` of what is held and what waits, by distance and id, each id once."""
        if not self.waiting:
            self.pending = []
            return
        q, i, d = (np.concatenate([p[k] for p in self.pending]) for k in range(3))
        self.pending, self.waiting = [], 0
        rows = np.unique(q)
        q = np.concatenate([np.repeat(rows, self.k), q])
        i = np.concatenate([self.found[rows].ravel(), i])
        d = np.concatenate([self.d[rows].ravel(), d])
        order = np.lexsort((i, d, q))
        q, i, d = q[order], i[order], d[order]
        once = np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1])]) | ~np.isfinite(d)
        q, i, d = q[once], i[once], d[once]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        use = rank < self.k
        self.d[q[use], rank[use]], self.found[q[use], rank[use]] = d[use], i[use]

    def answers(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.ids), 4096):
            d, found = self.d[a : a + 4096], self.found[a : a + 4096]
            real = np.isfinite(d)
            offsets = pa.array(np.concatenate([[0], np.cumsum(real.sum(1))]).astype(np.int32))
            yield pa.record_batch(
                [
                    pa.array(self.ids[a : a + 4096]), pa.ListArray.from_arrays(offsets, pa.array(found[real])), pa.ListArray.from_arrays(offsets, pa.array(np.sqrt(d[real]))),
                    pa.array(self.read[a : a + 4096].astype(np.int32)), pa.array(self.compared[a : a + 4096]),
                ],
                names=["vec_id", "neighbours", "distances", "lists_read", "compared"],
            )


def cells_near(graph: Graph, cell_of: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector, cell): the cells that each vector goes to, by vector, its home first."""
    row, centre, _ = graph.within(x, CELL_RATIO)
    key = row * (int(cell_of.max()) + 1) + cell_of[centre]
    first = np.sort(np.unique(key, return_index=True)[1])
    return row[first], cell_of[centre[first]]


RESULT = "vec_id long, neighbours array<long>, distances array<double>, lists_read int, compared long"


def nearest_neighbours(vectors: DataFrame, k: int = K_NEAREST) -> DataFrame:
    """``vec_id, neighbours, distances, lists_read, compared``: the ``k`` other vectors found nearest to each, nearest first (Euclidean).

    Every vector is a query; ``lists_read`` and ``compared`` say how many lists it searched and how many posted vectors it met there.

    * null ``vec_id`` or embedding, a null, NaN or infinite component, or another than the most frequent number of
      components (of equally frequent ones the smallest): neither query nor neighbour, so no row.
    * repeated rows: one vector.  One id with different vectors: the smallest of them.
    * ties of distance: the smaller id first.  Fewer than ``k`` other vectors: as many as there are.
    * an empty table gives no rows; further columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    base = usable(vectors)
    total = base.count()
    if not total:
        return spark.createDataFrame([], RESULT)
    dim = base.select(F.size("embedding")).first()[0]
    points, size = centroids(base, centre_count(total), dim)
    cell_of = cells_of(points, size, cell_count(total))
    cells = int(cell_of.max()) + 1
    shared = spark.sparkContext.broadcast((Graph(points), cell_of))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                x = matrix(batch.column(1))
                row, cell = cells_near(*shared.value, x)
                copy = np.concatenate([[False], row[1:] == row[:-1]]) if len(row) else np.zeros(0, bool)  # the home comes first
                yield pa.record_batch(
                    [pa.array(cell.astype(np.int32)), pa.array(copy), batch.column(0).take(pa.array(row)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(row), [None, pa.py_buffer(np.ascontiguousarray(x[row]))]).cast(pa.binary())],
                    names=["cell", "copy", "vec_id", "v"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a task come sorted by cell, those at home first."""
        portion = max(1, PORTION_BYTES // (4 * dim))
        current, at_home, cell, held = None, True, None, []

        def offer() -> None:
            if held:
                cell.offer(*(np.concatenate([h[k] for h in held]) for k in range(2)))
                held.clear()

        def settle_home() -> Cell:
            own = tuple(np.concatenate([h[k] for h in held]) for k in range(2)) if held else (np.zeros(0, np.int64), np.zeros((0, dim), np.float32))
            held.clear()
            made = Cell(*own, k)
            for a in range(0, len(own[0]), portion):
                made.offer(own[0][a : a + portion], own[1][a : a + portion])
            return made

        for batch in batches:
            where, copy, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            edges = _runs(2 * where.astype(np.int64) + copy)
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if where[a] != current:
                    if current is not None:
                        cell = settle_home() if cell is None else cell
                        offer()
                        yield from cell.answers()
                    current, cell = where[a], None
                if copy[a] and cell is None:
                    cell = settle_home()
                x = np.frombuffer(b"".join(batch.column(3).slice(a, z - a).to_pylist()), np.float32).reshape(z - a, dim)
                held.append((ids[a:z], x))
                if cell is not None and sum(len(h[0]) for h in held) >= portion:
                    offer()
        if current is not None:
            cell = settle_home() if cell is None else cell
            offer()
            yield from cell.answers()

    routed = base.mapInArrow(route, "cell int, copy boolean, vec_id long, v binary").repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "copy")
    return routed.mapInArrow(answer, RESULT)
