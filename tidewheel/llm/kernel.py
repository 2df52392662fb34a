"""Vectorised word kernel shared by the corpus operators.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the
lower-cased text.  Everything works on the Arrow buffers of a string column, so no Python string is
made per document or per word.  Hashes are 64 bits wide and depend on nothing but the words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

CHUNK_BYTES = 1 << 18
_PIECE = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[ord("0") : ord("9") + 1] = True
_WORD_BYTE[ord("a") : ord("z") + 1] = True
_WORD_BYTE[ord("A") : ord("Z") + 1] = True
_WORD_BYTE[128:] = True


@cache
def thrifty() -> None:
    """In a worker process, once: allocators that give large arrays back at once, so that long texts leave little behind."""
    if TaskContext.get() is None:
        return
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):  # no GNU C library
        return
    for option, value in ((-3, 4 << 20), (-1, 4 << 20), (-8, 2)):  # thresholds of mapping and trimming, number of arenas
        mallopt(option, value)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POINT_VALUE = mix(np.arange(1, 0x3001, dtype=np.uint64))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 4 * CHUNK_BYTES)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """The words of a run of documents, end to end."""

    hashes: np.ndarray  # uint64 per word
    starts: np.ndarray  # byte offset of a word in the lower-cased buffer
    ends: np.ndarray
    offsets: np.ndarray  # word offsets of the documents, one more than there are documents
    data: np.ndarray  # the lower-cased bytes
    doc_bytes: np.ndarray  # byte offsets of the documents

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.offsets))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string array; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if off else np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return offsets - offsets[0], raw


def word_spans(data: np.ndarray, doc_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words; a word never crosses from a document into the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_word = _WORD_BYTE[data]
    before = np.empty_like(is_word)
    before[0] = False
    before[1:] = is_word[:-1]
    edges = doc_bytes[:-1]
    before[edges[edges < len(data)]] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[-1] = False
    after[:-1] = is_word[1:]
    edges = doc_bytes[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch of ``data``, which holds bytes or code points."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _PIECE, side="right")))
        piece = data[low : ends[to - 1]]
        power, inverse = _power_tables(len(piece) + 1)
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        if piece.dtype == np.uint8:
            value = _BYTE_VALUE[piece]
        else:
            value = _POINT_VALUE[np.minimum(piece, len(_POINT_VALUE) - 1)]
            high = np.flatnonzero(piece >= len(_POINT_VALUE))
            value[high] = mix(piece[high].astype(np.uint64) + np.uint64(1))
        np.cumsum(value * power[: len(piece)], out=total[1:], dtype=np.uint64)
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (total[e] - total[s]) * inverse[s]
        at = to
    return mix(out)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch of 64-bit values; stretches may overlap."""
    power, inverse = _power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:], dtype=np.uint64)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def tokenize(texts: pa.Array) -> Words:
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    doc_bytes, data = buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends = word_spans(data, doc_bytes)
    offsets = np.searchsorted(starts, doc_bytes)
    return Words(hash_spans(data, starts, ends), starts, ends, offsets, data, doc_bytes)


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``size`` bytes; a longer document is a run by itself."""
    thrifty()
    offsets, _ = buffers(texts)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(to, n)
        at = to


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; the last n-1 places have none."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        total = total * np.uint64(0x2545F4914F6CDD1D) + hashes[j : j + m]
    return mix(total)


def ngram_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all word n-grams, in text order.

    A document of fewer than ``n`` words, but of one at least, has one gram: all of its words.
    """
    lengths = np.diff(words.offsets)
    doc = words.doc_of_word()
    grams = rolling(words.hashes, n)
    if len(grams):
        fits = np.arange(len(grams)) + n <= words.offsets[doc[: len(grams)] + 1]
        docs_out, grams = doc[: len(grams)][fits], grams[fits]
    else:
        docs_out = np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    if len(short):
        extra = np.empty(len(short), dtype=np.uint64)
        for k, d in enumerate(short):
            acc = np.uint64(lengths[d])
            with np.errstate(over="ignore"):
                for h in words.hashes[words.offsets[d] : words.offsets[d + 1]]:
                    acc = acc * np.uint64(0x2545F4914F6CDD1D) + h
            extra[k] = acc
        docs_out = np.concatenate([docs_out, short])
        grams = np.concatenate([grams, mix(extra)])
        order = np.argsort(docs_out, kind="stable")
        docs_out, grams = docs_out[order], grams[order]
    return docs_out, grams


def unique_sets(doc: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (document, gram) once each, sorted by both."""
    if not len(doc):
        return doc, grams
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    keep = np.empty(len(doc), dtype=bool)
    keep[0] = True
    keep[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[keep], grams[keep]
