"""Packing of documents into token windows by non-negative least squares.

Documents are cut into pieces of at most ``window`` tokens, and piece lengths are rounded up to a grain, so the
histogram has ``BINS`` bins at any corpus size.  All combinations of at most ``DEPTH`` lengths that fill the window exactly
are columns of a matrix; non-negative least squares finds how often to repeat each so that the histogram
is used up; the counts are rounded, trimmed to what there is, and what is left is packed greedily, largest first, on
the histogram.  All of that is of constant size and runs on the driver.

Handing out places needs the rank of each piece within its length.  Ranks come from hash slots: a count for
each (length, slot), a running sum over slots, and a row number inside a slot, whose size doesn't
grow with the corpus.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm import bpe
from tidewheel.session import cut

WINDOW = 2048
BINS = 128
DEPTH = 3
ROWS_PER_SLOT = 50_000


def combinations(present: list[int], total: int = BINS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most ``depth`` present lengths that add up to ``total``."""
    found, have = [], set(present)

    def extend(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(head)
        elif len(head) < depth:
            if len(head) == depth - 1:
                if left in have and left <= head[-1]:
                    found.append((*head, left))
                return
            for x in present:
                if x <= left and (not head or x <= head[-1]):
                    extend((*head, x), left - x)

    extend((), total)
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Lawson-Hanson active sets: x >= 0 that minimises |a x - b|."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    if not n:
        return x
    gradient = a.T @ b
    limit = 1e-9 * max(1.0, float(np.abs(gradient).max()))
    for _ in range(rounds):
        open_ = np.where(passive, -np.inf, gradient)
        k = int(open_.argmax())
        if open_[k] <= limit:
            break
        passive[k] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (s <= 1e-12)
            if not low.any():
                break
            gap = x[low] - s[low]
            step = float((x[low] / np.where(gap > 0, gap, 1)).min())
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                s = np.zeros(n)
                break
        x = s
        gradient = a.T @ (b - a @ x)
    return np.maximum(x, 0)


def plan_packs(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, number of such packs) that hold each counted piece exactly once.

    ``histogram[k]`` counts the pieces of k grains, k from 1 to BINS.
    """
    bins = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    shapes = combinations([k for k in range(bins, 0, -1) if left[k]], bins)
    plan = []
    if shapes:
        a = np.zeros((bins, len(shapes)))
        for j, shape in enumerate(shapes):
            for k in shape:
                a[k - 1, j] += 1
        scale = float(left.max())
        repeats = np.floor(nnls(a, left[1:] / scale) * scale + 0.5).astype(np.int64)
        for k in range(bins, 0, -1):
            excess = int((a[k - 1] * repeats).sum()) - int(left[k])
            for j in np.flatnonzero((a[k - 1] > 0) & (repeats > 0))[::-1]:
                if excess <= 0:
                    break
                less = min(int(repeats[j]), math.ceil(excess / a[k - 1, j]))
                repeats[j] -= less
                excess -= less * int(a[k - 1, j])
        left[1:] -= (a @ repeats).astype(np.int64)
        plan = [(shapes[j], int(repeats[j])) for j in np.flatnonzero(repeats)]
    while left.any():
        shape, space, used = [], bins, {}
        for k in range(bins, 0, -1):
            while k <= space and left[k] > used.get(k, 0):
                shape.append(k)
                used[k] = used.get(k, 0) + 1
                space -= k
        times = min(int(left[k]) // m for k, m in used.items())
        for k, m in used.items():
            left[k] -= m * times
        plan.append((tuple(shape), times))
    return plan


def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, th, start, length, bin) of each piece of at most ``window`` tokens; bins are grains of length, th is the text's hash."""
    grain = max(1, window // BINS)
    counted = bpe.count_tokens(docs, vocabulary)
    return (
        counted.where("n_tokens > 0")
        .select("doc_id", "th", F.col("n_tokens").alias("n"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / window).cast("int"))).alias("k"))
        .select("doc_id", "th", (F.col("k") * window).alias("start"), F.least(F.lit(window), F.col("n") - F.col("k") * window).alias("length"))
        .withColumn("bin", F.ceil(F.col("length") / grain).cast("int"))
    )


def pack_documents(docs: DataFrame, window: int = WINDOW, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """``pack_id, slot, offset, doc_id, start, length``: where each piece of each document goes.

    Tokens are those of ``bpe.encode``.  ``start`` and ``length`` count tokens of the document, ``offset``
    is the piece's place in the window; pieces of a pack never overlap and never pass its end.  ``window`` is a multiple of ``BINS``.

    * null or empty text: has no tokens, so no row.  A text longer than the window: several pieces, however many.
    * null ``doc_id``: packed like any other and reported with a null.  Repeated rows: each is packed.
    * ties: pieces of one length are ranked by (hash slot, doc_id, start, hash of the text); rows that are equal in those are interchangeable.
    * an empty table gives no rows; further columns, whatever their names, are ignored.
    """
    return _placed(docs, window, vocabulary).drop("th")


def pack_windows(docs: DataFrame, window: int = WINDOW, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """``pack_id, tokens, doc_ids, starts, lengths``: the packed windows themselves, one row each.

    ``tokens`` are the token ids of the pieces end to end; ``doc_ids``, ``starts`` and ``lengths`` name the pieces in that order.
    The cases are those of ``pack_documents``.
    """
    keyed = docs.select(F.xxhash64(F.col("text").cast("string")).alias("doc_id"), "text").where("text IS NOT NULL").dropDuplicates(["doc_id"])
    tokens = bpe.encode(keyed, vocabulary).select(F.col("doc_id").alias("th"), "tokens")  # equal texts once
    piece = F.struct("slot", "doc_id", "start", "length", F.slice("tokens", F.col("start") + 1, F.col("length")).alias("ids"))
    packs = _placed(docs, window, vocabulary).join(tokens, "th").groupBy("pack_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return packs.select("pack_id", F.flatten("p.ids").alias("tokens"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.length").alias("lengths"))


def _placed(docs: DataFrame, window: int, vocabulary: str) -> DataFrame:
    if window % BINS:
        raise ValueError(f"window must be a multiple of {BINS}")
    grain = window // BINS
    spark = docs.sparkSession
    cuts = cut(pieces(docs, window, vocabulary))
    histogram = np.zeros(BINS + 1, dtype=np.int64)
    for row in cuts.groupBy("bin").count().collect():  # BINS rows at most
        histogram[row["bin"]] = row["count"]
    segments, used, packs = [], np.zeros(BINS + 1, dtype=np.int64), 0
    for shape, times in plan_packs(histogram):
        at = 0
        for slot, k in enumerate(shape):
            segments.append((k, int(used[k]), int(used[k]) + times, packs, slot, at * grain))
            used[k] += times
            at += k
        packs += times
    places = spark.createDataFrame(segments, "bin int, low long, high long, first long, slot int, offset int")
    slots = max(1, math.ceil(int(histogram.max()) / ROWS_PER_SLOT))
    slotted = cuts.withColumn("hash_slot", F.pmod(F.xxhash64("doc_id", "start"), F.lit(slots)).cast("int"))
    counts = slotted.groupBy("bin", "hash_slot").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(
        "bin", "hash_slot",
        F.coalesce(F.sum("n").over(Window.partitionBy("bin").orderBy("hash_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    ranked = slotted.withColumn(
        "rank", F.row_number().over(Window.partitionBy("bin", "hash_slot").orderBy("doc_id", "start", "th")) - 1
    ).join(before, ["bin", "hash_slot"])
    ranked = ranked.select("bin", (F.col("rank") + F.col("base")).alias("rank"), "doc_id", "th", "start", "length")
    return ranked.join(
        F.broadcast(places),  # a few rows per length, whatever the corpus holds
        (ranked["bin"] == places["bin"]) & (ranked["rank"] >= places["low"]) & (ranked["rank"] < places["high"]),
    ).select(
        (places["first"] + ranked["rank"] - places["low"]).alias("pack_id"), "slot", "offset", "doc_id", "th", F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length")
    )
