"""Language identification with hyperdimensional profiles.

Every character has a fixed random vector of +1 and -1.  The vector of a letter trigram binds the vectors
of its characters, each permuted (rotated) by its place, by elementwise product.  A text bundles (adds)
the vectors of all its trigrams; a language's profile bundles those of all texts of that language.
A text gets the language of the profile with the largest cosine, its own share taken out.

Trigrams run over lower-cased letters, any run of other characters being one space.  Prototypes are sums, so each task
bundles its own texts and hands on one vector per language; what reaches the driver is one vector
per language, whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import kernel as K

DIM = 1024
BLOCK = 4096
PORTION = 1 << 20
MIN_SHARE = 0.35
NOISE = 2.0


@cache
def _letters() -> np.ndarray:
    """Code point -> the lower-case letter's code point, or a space."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x40000):  # no planes beyond hold letters
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, trigram) of all trigrams; three code points of 21 bits in a trigram."""
    coded = [("\n" + t + "\n").encode("utf-32-le", "surrogatepass") if t else b"" for t in texts]
    sizes = np.array([len(c) // 4 for c in coded], dtype=np.int64)
    points = _letters()[np.frombuffer(b"".join(coded), dtype=np.uint32)]
    doc = np.repeat(np.arange(len(texts)), sizes)
    if len(points):
        keep = np.ones(len(points), dtype=bool)
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32) | (doc[1:] != doc[:-1])
        points, doc = points[keep].astype(np.uint64), doc[keep]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
    same = doc[:-2] == doc[2:]
    return doc[:-2][same], code[same]


def character_vectors(points: np.ndarray) -> np.ndarray:
    """Rows of +1 and -1, each a function of its code point only."""
    words = K.mix(points.astype(np.uint64)[:, None] * np.uint64(DIM // 64) + np.arange(1, DIM // 64 + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(points), -1), axis=1)
    return bits.astype(np.int8) * 2 - 1


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << 21) - 1)
    out = None
    for k, shift in enumerate((42, 21, 0)):
        points, at = np.unique((codes >> np.uint64(shift)) & mask, return_inverse=True)
        part = np.roll(character_vectors(points), 2 - k, axis=1)[at]
        out = part if out is None else out * part
    return out


def bundle(owner: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Sum of the trigram vectors of each owner, n x DIM."""
    total = np.zeros((n, DIM), dtype=np.float32)
    if not len(codes):
        return total
    at, kinds = pd.factorize(codes)
    for low in range(0, len(kinds), BLOCK):
        part = kinds[low : low + BLOCK]
        here = (at >= low) & (at < low + len(part))
        counts = np.bincount(owner[here] * len(part) + at[here] - low, minlength=n * len(part)).reshape(n, len(part))
        total += counts.astype(np.float32) @ trigram_vectors(part).astype(np.float32)
    return total


def _portions(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    for a, z in K.chunks(column, PORTION):
        yield a, column.slice(a, z - a).to_pylist()


@dataclass
class Profile:
    """The bundle of a language and how many trigrams are in it."""

    vector: np.ndarray
    trigrams: float

    @property
    def concentration(self) -> float:
        """Estimated sum of the squared shares of the language's trigrams."""
        return float(self.vector @ self.vector) / DIM / self.trigrams**2


def prototypes(docs: DataFrame) -> dict[str, Profile]:
    """The profile of each language, from all documents whose ``lang`` is known."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for a, texts in _portions(batch.column(0)):
                doc, codes = trigrams(texts)
                names, owner = np.unique(langs[a : a + len(texts)].astype(str), return_inverse=True)
                count = np.bincount(owner[doc], minlength=len(names))
                for name, n, row in zip(names, count, bundle(owner[doc], codes, len(names))):
                    total[name] = total.get(name, 0) + np.append(row.astype(np.float64), n)
        if total:
            yield pa.record_batch([pa.array(list(total)), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["lang", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[name] = total.get(name, 0) + np.frombuffer(blob)
        if total:
            yield pa.record_batch([pa.array(list(total)), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["lang", "v"])

    schema = "lang string, v binary"
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = known.mapInArrow(sums, schema).repartition("lang").mapInArrow(add, schema).collect()
    found = {r["lang"]: np.frombuffer(r["v"]) for r in rows}
    return {k: Profile(v[:-1], float(v[-1])) for k, v in sorted(found.items()) if v[-1] > 0 and v[:-1].any()}


def judge(profiles: dict[str, Profile], vectors: np.ndarray, count: np.ndarray, langs: list[str | None], min_share: float = MIN_SHARE) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """(nearest language, its cosine, accepted) of bundles of ``count`` trigrams, whose texts are part of the profiles of ``langs``.

    A text is taken out of the profile of its own language before it is compared with it, unless nothing would be left of that.
    """
    names = list(profiles)
    if not names or not len(vectors):
        return [None] * len(vectors), np.full(len(vectors), np.nan), count > 0
    own = (vectors * vectors).sum(1)
    whole = np.array([p.vector for p in profiles.values()])
    dot, square = vectors @ whole.T, np.broadcast_to((whole * whole).sum(1), (len(vectors), len(names))).copy()
    place = {name: k for k, name in enumerate(names)}
    mine = np.array([place.get(x, -1) for x in langs])
    r = np.flatnonzero(mine >= 0)
    r = r[count[r] < np.array([p.trigrams for p in profiles.values()])[mine[r]]]
    c = mine[r]
    rest = square[r, c] - 2 * dot[r, c] + own[r]
    dot[r, c], square[r, c] = np.where(rest > 0.5, dot[r, c] - own[r], dot[r, c]), np.where(rest > 0.5, rest, square[r, c])
    cosine = dot / np.maximum(np.sqrt(np.maximum(own, 1e-9))[:, None] * np.sqrt(square), 1e-9)
    best = cosine.argmax(1)
    top = cosine[np.arange(len(best)), best]
    # a text of the language has about this cosine: its trigrams, as many as if all were equally frequent, times the profile's concentration
    spread = count**2 / np.maximum(own / DIM, 1e-9)
    usual = np.sqrt(np.minimum(1.0, spread * np.array([p.concentration for p in profiles.values()])[best]))
    some = own > 0
    accepted = (count > 0) & (~some | (top >= min_share * usual - NOISE / np.sqrt(DIM)))
    return [names[b] if k else None for b, k in zip(best, some)], np.where(some, np.round(top, 6), np.nan), accepted


def identify(profiles: dict[str, Profile], text: str = "text", lang: str | None = None, min_share: float = MIN_SHARE) -> Column:
    """struct<lang, cosine, accepted>: the nearest profile; lang and cosine are null without trigrams or profiles.

    ``lang`` names the column of the language whose profile a text is part of, if it is part of any.
    """

    @F.arrow_udf("struct<lang: string, cosine: double, accepted: boolean>")
    def of(column: pa.Array, known: pa.Array) -> pa.Array:
        langs, cosines, marks = [], [], []
        told = known.to_pylist()
        for a, texts in _portions(column):
            doc, codes = trigrams(texts)
            count = np.bincount(doc, minlength=len(texts)).astype(np.float64)
            found, cosine, accepted = judge(profiles, bundle(doc, codes, len(texts)).astype(np.float64), count, told[a : a + len(texts)], min_share)
            langs += found
            cosines += [None if np.isnan(x) else float(x) for x in cosine]
            marks += accepted.tolist()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(cosines, pa.float64()), pa.array(marks, pa.bool_())], names=["lang", "cosine", "accepted"])

    return of(F.col(text).cast("string"), (F.col(lang) if lang else F.lit(None)).cast("string"))


def identify_language(docs: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """``doc_id, detected, cosine, accepted`` of every row.

    A text is judged by profiles that it is no part of.  It is rejected where it has no letter, or where its cosine with the nearest
    profile is below ``min_share`` of what a text with trigrams so spread has on average, less ``NOISE`` standard deviations
    (1 / sqrt(DIM)) of the cosine of unrelated texts: one rule for texts of every length.

    * null, empty or letterless text: ``detected`` and ``cosine`` are null, and it isn't accepted.  Very long texts count whole.
    * rows without ``lang``: get a language, but are no part of a profile; with no ``lang`` at all nothing is detected
      and every text with letters is accepted.
    * the only text of a language is compared with itself.
    * null ``doc_id``: reported with a null.  Repeated rows: each counts, each is reported.
    * ties: the language that sorts first.  An empty table gives no rows.
    * further columns, whatever their names, are ignored.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), identify(prototypes(docs), lang="lang", min_share=min_share).alias("f"))
    return found.select("doc_id", F.col("f.lang").alias("detected"), F.col("f.cosine").alias("cosine"), F.col("f.accepted").alias("accepted"))


def keep_known(docs: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of ``docs`` that are accepted, with all their columns.

    The cases are those of ``identify_language``: null, empty and letterless texts go, rows without ``doc_id`` or ``lang`` are judged like
    others, equal rows stay or go together, an empty table stays empty, further columns are kept whatever their names.
    """
    return docs.where(identify(prototypes(docs), lang="lang", min_share=min_share)["accepted"])
