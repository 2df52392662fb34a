"""Document quality by histogram gradient-boosted trees over document statistics.

The statistics come from the bytes and the word hashes of whole texts, a batch at a time.  The trees are
grown on the driver from a bounded sample of the labelled rows (``max_rows``), flattened into complete
arrays, and applied by numpy traversal of all trees and rows at once.  Scoring is a narrow projection:
no shuffle, and only ``text`` is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import kernel as K

MAX_ROWS = 20_000
KEEP_FROM = 0.5

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "space", "newline", "non_ascii",
    "strange", "distinct_words", "top_word", "distinct_pairs", "top_pair", "stops", "capitals",
)


def _byte_classes() -> np.ndarray:
    table = np.zeros((7, 256), dtype=bool)
    table[0, ord("A") : ord("Z") + 1] = True
    table[1, ord("0") : ord("9") + 1] = True
    for c in range(33, 127):
        table[2, c] = not chr(c).isalnum()
    for c in b" \t\r\n\x0b\x0c":
        table[3, c] = True
    table[4, 10] = True
    table[5, 128:] = True
    for c in b"#$%&*@^_|~<>{}[]\\=+`!":
        table[6, c] = True
    return table


_CLASSES = _byte_classes()


def _runs(doc: np.ndarray, values: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: how many values, how many distinct ones, and the count of the most frequent."""
    count = np.bincount(doc, minlength=n_docs)
    distinct, top = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    if len(doc):
        order = np.lexsort((values, doc))
        d, v = doc[order], values[order]
        at = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])]))
        distinct = np.bincount(d[at], minlength=n_docs)
        np.maximum.at(top, d[at], np.diff(np.append(at, len(d))))
    return count, distinct, top


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; a null counts as an empty text."""
    out = []
    for a, z in K.chunks(texts):
        part = texts.slice(a, z - a)
        offsets, raw = K.buffers(part)
        n_docs, size = z - a, np.diff(offsets).astype(np.float64)
        share = []
        for row in _CLASSES:
            total = np.concatenate([[0], np.cumsum(row[raw])])
            share.append(np.diff(total[offsets]))
        upper, digit, symbol, space, newline, wide, strange = (x / np.maximum(size, 1) for x in share)
        words = K.tokenize(part)
        doc = words.doc_of_word()
        n, distinct, top = _runs(doc, words.hashes, n_docs)
        pair_doc, pairs = K.ngram_sets(words, 2)
        p, pair_distinct, pair_top = _runs(pair_doc, pairs, n_docs)
        length = np.bincount(doc, weights=(words.ends - words.starts).astype(np.float64), minlength=n_docs)
        some, pairs_some = np.maximum(n, 1), np.maximum(p, 1)
        stops = np.concatenate([[0], np.cumsum(raw == ord("."))])
        out.append(
            np.column_stack([
                np.log1p(size), np.log1p(n), length / some, upper, digit, symbol, space, newline, wide, strange,
                distinct / some, top / some, pair_distinct / pairs_some, pair_top / pairs_some,
                np.diff(stops[offsets]) / some, share[0] / some,
            ])
        )
    return np.concatenate(out).astype(np.float32) if out else np.zeros((0, len(FEATURES)), np.float32)


@dataclass
class Forest:
    """Complete trees in arrays: node k of a tree has the children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; go right where the value is larger
    leaf: np.ndarray  # trees x leaves
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        if not trees or not len(x):
            return 1 / (1 + np.exp(-total))
        tree = np.arange(trees)[None, :]
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), dtype=np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.cut[tree, node])
            total[at : at + 4096] += self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def grow(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 1.0, ridge: float = 1.0
) -> Forest:
    """Boost log-loss on feature histograms; one class, or no rows, gives a forest without trees."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    inner = (1 << depth) - 1
    none = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), base)
    if not len(y) or y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    coded = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    width = bins + 1
    raw = np.full(len(y), base)
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            local = node - first
            best = np.full(count, 1e-6)
            for f in range(x.shape[1]):
                if not len(edges[f]):
                    continue
                at = local * width + coded[:, f]
                gs = np.bincount(at, g, count * width).reshape(count, width).cumsum(1)
                hs = np.bincount(at, h, count * width).reshape(count, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain = gain[:, : len(edges[f])]
                k = gain.argmax(1)
                won = gain[np.arange(count), k]
                better = won > best
                best[better] = won[better]
                feature[first : first + count][better] = f
                cut[first : first + count][better] = edges[f][k[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        raw += leaf[at]
        features.append(feature), cuts.append(cut), leaves.append(leaf)
    return Forest(np.array(features), np.array(cuts), np.array(leaves), base)


def _statistics_column() -> Column:
    @F.arrow_udf("array<float>")
    def of(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    return of(F.col("text").cast("string"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Forest:
    """Fit on at most ``max_rows`` labelled documents, those of the smallest id hashes.

    Several labels of one id count by their mean; several rows of one id by the smallest statistics.
    Rows without an id, and labels without a value, are passed over.
    """
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(sample), "doc_id")  # bounded by max_rows
        .select("doc_id", "good", _statistics_column().alias("x"))
        .groupBy("doc_id", "good")
        .agg(F.min("x").alias("x"))
        .toPandas()
        .sort_values("doc_id")
    )
    if not len(rows):
        return grow(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    return grow(np.stack(rows["x"].to_numpy()).astype(np.float32), rows["good"].to_numpy(dtype=np.float64))


def score(forest: Forest, text: str = "text") -> Column:
    """Probability that a text is good; 0 for a null text and for one without words."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        return pa.array(np.where(x[:, FEATURES.index("log_words")] > 0, forest.predict(x), 0.0))

    return of(F.col(text).cast("string"))


def classify_quality(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, score, keep`` of every row.

    * null, empty or wordless text: score 0, so not kept.  Very long texts: statistics of all their words.
    * null ``doc_id``: scored like any other, reported with a null.  Repeated rows: each is scored.
    * ties: a score equal to ``keep_from`` is kept.
    * no labels, or one class only: every text with words has the share of good labels (0.5 if there are none).
    * an empty table gives no rows; further columns, whatever their names, are ignored.
    """
    forest = train(docs, labels, max_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(forest).alias("score")).select(
        "doc_id", "score", (F.col("score") >= keep_from).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The cases are those of ``classify_quality``: null, empty and wordless texts go, rows without ``doc_id`` are scored like others, equal rows stay or go
    together, very long texts are scored whole, an empty table stays empty, further columns are kept whatever their names.
    """
    return docs.where(score(train(docs, labels, max_rows)) >= keep_from)
