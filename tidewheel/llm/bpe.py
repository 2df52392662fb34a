"""Byte-level BPE: encoding with a priority queue of merge ranks, decoding by concatenation.

A text is cut by the vocabulary's pattern; the bytes of each part are a doubly linked list of symbols, and a
heap holds the merges of neighbours by (rank, place).  An entry whose symbols have changed since is stale
and skipped when it comes up.  Parts recur: those of a batch of texts are found by numpy on code points, told apart by 64-bit
hashes and merged once each, many in step (a text that doesn't decode to itself is done again without hashes); a worker keeps the tokens of the parts it has met, up to a fixed number.  No shuffle; the vocabulary file (under 1 MB) is read on the driver and broadcast.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import kernel as K

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEEP = 600_000
STEPS = 64
PORTION = 1 << 20
SPACE, LETTER, NUMBER, OTHER = range(4)


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Rank (which is the id) of each vocabulary string; lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec(dict):
    """Part -> its tokens as packed 32-bit ids; parts not met before are merged on demand."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, keep: int = KEEP) -> None:
        super().__init__()
        self.ranks, self.keep, self.pattern = ranks, keep, pattern
        self.older: dict[str, bytes] = {}
        self.bytes = [ranks.get(bytes([a]), -1) for a in range(256)]
        self.pairs = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.bytes_array, self.pairs_array = np.array(self.bytes), np.array(self.pairs).reshape(256, 256)
        halves = {ranks[x[:k]] << 24 | ranks[x[k:]]: rank for x, rank in ranks.items() for k in range(1, len(x)) if x[:k] in ranks and x[k:] in ranks}
        self.pair_keys = pd.Index(np.array([*halves, -1], dtype=np.int64))
        self.pair_ranks = np.array([*halves.values(), -1], dtype=np.int64)
        self.compiled = regex.compile(pattern)
        strings = {i: s for s, i in ranks.items()}
        self.size = max(strings, default=-1) + 1
        ordered = [strings.get(i, b"") for i in range(self.size)]
        self.pool = np.frombuffer(b"".join(ordered), np.uint8)
        self.pool_size = np.array([len(x) for x in ordered], dtype=np.int64)
        self.known = np.array([i in strings for i in range(self.size)], dtype=bool)

    def __missing__(self, part: str) -> bytes:
        self._learn([part])
        return dict.__getitem__(self, part)

    def _learn(self, parts: list[str]) -> None:
        """Keep the tokens of parts not met before; what isn't met again in a while goes, the rest comes back from ``older``."""
        if len(self) + len(parts) > self.keep // 2:
            self.older = dict(self)
            self.clear()
        fresh = []
        for part in parts:
            packed = self.older.get(part)
            if packed is None:
                fresh.append(part)
            else:
                self[part] = packed
        words = [part.encode("utf-8", "surrogatepass") for part in fresh]
        self.update(zip(fresh, self.merge_all(words)))

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word: those of ``merge``, with the queues of all words of about one length run in step."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        for low, high in zip((0, 8, 16, 32), (8, 16, 32, STEPS)):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            for a in range(0, len(some), 5_000):
                own = some[a : a + 5_000].tolist()
                flat, count = self._in_step([words[k] for k in own], high)
                raw, ends = flat.tobytes(), (4 * np.cumsum(count)).tolist()
                for k, start, end in zip(own, [0, *ends], ends):
                    out[k] = raw[start:end]
        for k in np.flatnonzero(sizes > STEPS).tolist():
            out[k] = array("i", self.merge(words[k])).tobytes()
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the two symbols put together, -1 where the vocabulary has no such string."""
        at = self.pair_keys.get_indexer(left << 24 | right)
        return np.where(at >= 0, self.pair_ranks[at], -1)

    def _in_step(self, words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, how many each has) of words of at most ``n`` bytes.

        As in ``merge``, each word has a doubly linked list of symbols and a priority queue of (rank, place, end); here the queue is a row of numbers, from which
        every round takes the least.  An entry whose symbols have changed since is stale and skipped.
        """
        size = np.array([len(w) for w in words], dtype=np.int64)
        text = np.frombuffer(b"".join([w.ljust(n, b"\0") for w in words]), np.uint8).reshape(-1, n)
        row, place, none = np.arange(len(words)), np.arange(n), np.iinfo(np.int64).max
        ids = np.zeros((len(words), n + 1), dtype=np.int64)  # column n stands for the end
        ids[:, :n] = self.bytes_array[text]
        after = np.full((len(words), n + 1), -2, dtype=np.int64)  # start of the next symbol, n at the end; -1 of a symbol that has been merged
        after[:, :n] = np.where(place + 1 < size[:, None], place + 1, n)
        before = np.broadcast_to(np.arange(-1, n), (len(words), n + 1)).copy()
        queue = np.full((len(words), 2 * n), none, dtype=np.int64)
        if n > 1:
            rank = self.pairs_array[text[:, :-1], text[:, 1:]]
            known = (rank >= 0) & (place[1:] < size[:, None])
            queue[:, : n - 1] = np.where(known, rank << 16 | place[:-1] << 8 | np.take_along_axis(after, np.maximum(after[:, : n - 1], 0), 1), none)
        more = np.full(len(words), n - 1)  # the next free place of a queue
        while len(row):
            at = queue[row].argmin(1) if len(row) < len(words) else queue.argmin(1)
            entry = queue[row, at]
            some = entry < none
            row, at, entry = row[some], at[some], entry[some]
            queue[row, at] = none
            i, end = entry >> 8 & 255, entry & 255
            j = after[row, i]
            live = (j >= 0) & (j < n)
            live[live] = after[row[live], j[live]] == end[live]
            r, i, j, end, got, slot = row[live], i[live], j[live], end[live], entry[live] >> 16, at[live]
            ids[r, i], after[r, i], after[r, j], before[r, end] = got, end, -1, i
            right = np.where(end < n, self._rank(got, ids[r, end]), -1)
            use = right >= 0
            queue[r[use], slot[use]] = right[use] << 16 | i[use] << 8 | after[r[use], end[use]]
            p = before[r, i]
            left = np.where(p >= 0, self._rank(ids[r, p], got), -1)
            use = left >= 0
            queue[r[use], more[r[use]]] = left[use] << 16 | p[use] << 8 | end[use]
            more[r[use]] += 1
        symbol = (after[:, :n] >= 0) & (place < size[:, None])
        return ids[:, :n][symbol].astype(np.int32), symbol.sum(1)

    def merge(self, word: bytes) -> list[int]:
        get = self.ranks.get
        whole = get(word)
        if whole is not None:
            return [whole]
        n, pairs = len(word), self.pairs
        ids = [self.bytes[c] for c in word]  # of the symbol that starts here
        after = list(range(1, n + 1))  # start of the next symbol, which is where this one ends; -1 of one that has been merged
        before = list(range(-1, n - 1))
        bits = n.bit_length()
        mask, wide = (1 << bits) - 1, 2 * bits
        # an entry is one number: rank (which is the id), start, end of the merged symbol
        heap = [rank << wide | i << bits | i + 2 for i, rank in enumerate([pairs[a << 8 | b] for a, b in zip(word, word[1:])]) if rank >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, end = entry >> bits & mask, entry & mask
            j = after[i]
            if j < 0 or j >= n or after[j] != end:
                continue  # stale: one of the two was merged meanwhile
            ids[i], after[i], after[j] = entry >> wide, end, -1
            if end < n:
                before[end] = i
                stop = after[end]
                rank = get(word[i:stop])
                if rank is not None:
                    heappush(heap, rank << wide | i << bits | stop)
            p = before[i]
            if p >= 0:
                rank = get(word[p:end])
                if rank is not None:
                    heappush(heap, rank << wide | p << bits | end)
        return [x for x, stop in zip(ids, after) if stop >= 0]

    def split(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """(all texts in one, starts of the parts, hashes of the parts, number of parts of each text)."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if self.pattern == PATTERN:
            starts = part_starts(points, offsets)
        else:
            found = [m.start() + o for t, o in zip(texts, offsets) for m in self.compiled.finditer(t)]
            starts = np.array(found, dtype=np.int64)
        hashes = K.hash_spans(points, starts, np.append(starts[1:], len(points)))
        return whole, starts, hashes, np.diff(np.searchsorted(starts, offsets))

    def _kinds(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(tokens of each kind of part, kind of each part, where each text's parts begin, with the end)."""
        whole, starts, hashes, per_text = self.split(texts)
        ends = np.append(starts[1:], len(whole))
        same, kinds = pd.factorize(hashes)
        first = np.empty(len(kinds), dtype=np.int64)
        first[same[::-1]] = np.arange(len(same) - 1, -1, -1)
        parts = [whole[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist())]
        self._learn([p for p in parts if p not in self])
        return [self[p] for p in parts], same, np.concatenate([[0], np.cumsum(per_text)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each text has."""
        packed, same, bounds = self._kinds(texts)
        size = np.array([len(p) // 4 for p in packed], dtype=np.int64)
        ids = _gather(np.frombuffer(b"".join(packed), np.int32), size, same)
        total = np.concatenate([[0], np.cumsum(size[same])])
        return ids, np.diff(total[bounds])

    def encode_one(self, text: str) -> np.ndarray:
        """The ids of a text, part by part, without hashes."""
        return np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(self[m.group()], np.int32) for m in self.compiled.finditer(text))])

    def count(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has."""
        packed, same, bounds = self._kinds(texts)
        size = np.array([len(p) // 4 for p in packed], dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(size[same])])
        return np.diff(total[bounds])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids' vocabulary strings, end to end."""
        return _gather(self.pool, self.pool_size, ids)


def _gather(pool: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` that ``which`` names, end to end; stretch k has size[k] items."""
    if not len(which):
        return pool[:0]
    base = np.concatenate([[0], np.cumsum(size)])[:-1]
    take = size[which]
    at = np.cumsum(take) - take
    return pool[np.repeat(base[which] - at, take) + np.arange(int(take.sum()))]


@cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    everything = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, everything):
            table[m.start() : m.end()] = kind
    return table


def part_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the parts of ``PATTERN`` begin; the parts cover the texts without gaps."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    fresh = np.zeros(n, dtype=bool)
    fresh[offsets[:-1][offsets[:-1] < n]] = True
    change = fresh.copy()
    change[1:] |= kind[1:] != kind[:-1]
    s = np.flatnonzero(change)
    e = np.append(s[1:], n)
    k, first = kind[s], fresh[s]
    before_space = np.zeros(len(s), dtype=bool)  # a run that takes the single space before it
    before_space[1:] = (k[1:] != SPACE) & (k[:-1] == SPACE) & ~first[1:] & (points[s[1:] - 1] == 32)
    followed = np.zeros(len(s), dtype=bool)
    followed[:-1] = ~first[1:]
    blank = k == SPACE
    gives = blank & followed & (points[e - 1] == 32)
    begin = np.zeros(n + 1, dtype=bool)
    begin[(s - before_space)[~blank]] = True
    begin[s[blank & ~(gives & (e - s == 1))]] = True
    begin[(e - 1)[blank & followed & ~gives]] = True
    quote = (k == OTHER) & (e - s == 1) & (points[s] == 39) & ~before_space & followed
    at = np.flatnonzero(quote)
    at = at[k[at + 1] == LETTER]
    if len(at):
        one = points[s[at + 1]]
        two = np.where(e[at + 1] - s[at + 1] > 1, points[np.minimum(s[at + 1] + 1, n - 1)], 0)
        takes = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        takes = np.where(pair, 2, takes)
        use = takes > 0
        begin[s[at + 1][use]] = False
        begin[(s[at + 1] + takes)[use]] = True
    return np.flatnonzero(begin[:n])


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec of a broadcast vocabulary; it outlives a task, so met parts serve later ones."""
    if shared.value["key"] not in _codecs:
        _codecs.clear()
        _codecs[shared.value["key"]] = Codec(shared.value["ranks"], shared.value["pattern"])
    return _codecs[shared.value["key"]]


def _shared(df: DataFrame, vocabulary: str, pattern: str):
    ranks = read_vocabulary(vocabulary)
    return df.sparkSession.sparkContext.broadcast({"key": (vocabulary, pattern, len(ranks)), "ranks": ranks, "pattern": pattern})


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens, tokens, decoded`` of every row; ``decoded`` says that decoding gives the text back.

    * null text: null tokens, 0 of them, and ``decoded`` is null.  Empty text: no tokens, decoded.  Whole texts count.
    * null ``doc_id``: reported with a null.  Repeated rows: each is reported.
    * ties of rank: the leftmost merge first.  An empty table gives no rows; further columns are ignored.
    """
    shared = _shared(docs, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            keys, column = batch.columns
            for a, z in K.chunks(column, PORTION):
                part = column.slice(a, z - a)
                _, raw = K.buffers(part)
                ids, size = codec.encode(["" if t is None else t for t in part.to_pylist()])
                missing = np.array(part.is_null())
                again = codec.decode(ids)
                if len(again) == len(raw) and np.array_equal(again, raw):
                    good = np.ones(z - a, dtype=bool)
                else:
                    cuts, bounds = np.concatenate([[0], np.cumsum(size)]), K.buffers(part)[0]
                    own = [ids[cuts[k] : cuts[k + 1]] for k in range(z - a)]
                    for k in range(z - a):
                        if not np.array_equal(codec.decode(own[k]), raw[bounds[k] : bounds[k + 1]]):  # two kinds of parts with one hash
                            own[k] = codec.encode_one(part[k].as_py() or "")
                    ids, size = np.concatenate(own), np.array([len(x) for x in own])
                    good = np.array([np.array_equal(codec.decode(x), raw[bounds[k] : bounds[k + 1]]) for k, x in enumerate(own)])
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                tokens = pa.ListArray.from_arrays(offsets, pa.array(ids), mask=pa.array(missing))
                yield pa.record_batch(
                    [keys.slice(a, z - a), pa.array(size.astype(np.int32)), tokens, pa.array(good, mask=missing)], names=["doc_id", "n_tokens", "tokens", "decoded"]
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens int, tokens array<int>, decoded boolean")


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, th, n_tokens`` of every row, as ``encode`` has them, and the hash of the text; a null text has none."""
    shared = _shared(docs, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            keys, hashes, column = batch.columns
            for a, z in K.chunks(column, PORTION):
                size = codec.count(["" if t is None else t for t in column.slice(a, z - a).to_pylist()])
                yield pa.record_batch([keys.slice(a, z - a), hashes.slice(a, z - a), pa.array(size.astype(np.int32))], names=["doc_id", "th", "n_tokens"])

    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return narrow.mapInArrow(run, "doc_id long, th long, n_tokens int")


def decode(rows: DataFrame, tokens: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` of rows of token ids.

    Null tokens give a null text, no tokens an empty one; a null id or one outside the vocabulary makes the text null.
    Bytes that are no UTF-8, as of a list of tokens cut in mid-character, become U+FFFD.
    """
    shared = _shared(rows, vocabulary, PATTERN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            ids = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            fits = (ids >= 0) & (ids < codec.size)
            fits[fits] = codec.known[ids[fits]]
            count = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(count)])
            good = np.array(lists.is_valid()) & (np.concatenate([[0], np.cumsum(~fits)])[bounds[1:]] == np.concatenate([[0], np.cumsum(~fits)])[bounds[:-1]])
            ids = np.where(fits, ids, 0)
            raw = codec.decode(ids).tobytes() if len(ids) and codec.size else b""
            at = np.concatenate([[0], np.cumsum(codec.pool_size[ids])])[bounds].tolist() if codec.size else [0] * len(bounds)
            texts = [raw[p:q].decode("utf-8", "replace") if g else None for p, q, g in zip(at, at[1:], good)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    narrow = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(tokens).cast("array<int>").alias("tokens"))
    return narrow.mapInArrow(run, "doc_id long, text string")
