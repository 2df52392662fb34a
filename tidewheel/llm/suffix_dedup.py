"""Repeated passages across documents, by a sparse suffix array.

A passage is a window of ``LENGTH`` words.  Every window has a minimiser: the k-gram of words with the smallest hash
in it, a function of the window's words alone.  So equal windows have equal minimisers, and runs of windows with
one minimiser (about twenty) travel as one record.  All windows of all documents take part.

1. One pass counts the documents of every minimiser, with partial sums before the shuffle.  Those of one document only are gone after that.
2. The runs of shared minimisers are joined to them, all others never leave their task, and fetch their words.  All suffixes that
   start at a shared minimiser are sorted deep-shallow: multikey quicksort, all groups at once, down to ``SHALLOW`` words, then a blind trie for each group that still has
   a longer common prefix.  For a window with l words before its minimiser, the suffixes whose common prefix
   reaches LENGTH - l words are a stretch of the array; equal windows are those of a stretch whose l words before agree.
   A minimiser with more than ``RUNS_AT_ONCE`` runs (boilerplate) is sorted in parts by document first; of runs that are
   equal as a whole one of each part goes on, so no task has to hold them all.
3. A window is repeated where it occurs in two documents; its owner is the smallest document.  Repeated windows join into passages.

Rows that share a ``doc_id`` are one document; rows without an id are together one document, the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm import kernel as K
from tidewheel.session import cut

LENGTH = 50
GRAM = 12
SPREAD = LENGTH - GRAM + 1  # k-grams of a window
SHALLOW = 20
RUNS_AT_ONCE = 100_000
NO_ID = (1 << 63) - 1
_PLACE = np.uint64((1 << 28) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def runs_of_windows(words: K.Words) -> tuple[np.ndarray, ...]:
    """(document, first window, number of windows, place of the minimiser, minimiser)."""
    wh = words.hashes
    if len(wh) < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    grams = K.rolling(wh, GRAM)
    best = _sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), SPREAD)
    doc = words.doc_of_word()[: len(best)]
    whole = np.arange(len(best)) + LENGTH <= words.offsets[doc + 1]
    s = np.flatnonzero(whole)
    if not len(s):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    at = (best[s] & _PLACE).astype(np.int64)
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    s, at = s[first], at[first]
    return doc[s], s - words.offsets[doc[s]], count, at - s, grams[at]


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text")
    ).where("text IS NOT NULL")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, ths = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        column = batch.column(2)
        for a, z in K.chunks(column):
            doc, s, n, off, gram = runs_of_windows(K.tokenize(column.slice(a, z - a)))
            if len(doc):
                yield pa.record_batch(
                    [pa.array(x) for x in (gram.view(np.int64), docs[a:z][doc], ths[a:z][doc], s.astype(np.int32), n.astype(np.int8), off.astype(np.int8))],
                    names=["gram", "doc", "th", "s", "n", "off"],
                )


# deep-shallow suffix sorting
def _quicksort(words: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey quicksort of all groups at once: (order, group of each place, LCP with the place before within SHALLOW).

    Each round splits every open group by a pivot of the word at its depth into smaller, equal and larger;
    the equal part goes one word deeper.  A suffix that ends has the smallest word.
    """
    n = len(start)
    order = np.argsort(group, kind="stable")
    head = np.concatenate([[True], group[order][1:] != group[order][:-1]]) if n else np.zeros(0, bool)
    lcp = np.where(head, -1, 0).astype(np.int64)
    at = np.full(n, depth, dtype=np.int64)  # depth of the group at a place
    while True:
        block = np.cumsum(head) - 1
        size = np.bincount(block)
        firsts = np.flatnonzero(head)
        live = (size[block] > 1) & (at < SHALLOW)
        if not live.any():
            break
        place = np.flatnonzero(live)
        rows = order[place]
        d = at[place]
        word = np.where(d < length[rows], words[np.minimum(start[rows] + d, len(words) - 1)].astype(np.int64), -1)
        b = block[place]
        full = np.zeros(n, dtype=np.int64)
        full[place] = word
        lo, mid, hi = (full[p] for p in (firsts, firsts + size // 2, firsts + size - 1))
        pivot = np.maximum(np.minimum(lo, mid), np.minimum(np.maximum(lo, mid), hi))[b]
        side = np.where(word < pivot, 0, np.where(word == pivot, 1, 2))
        moved = np.lexsort((side, b))
        order[place] = rows[moved]
        side, d, pivot = side[moved], d[moved], pivot[moved]
        cut_here = np.concatenate([[False], (b[1:] == b[:-1]) & (side[1:] != side[:-1])])
        head[place[cut_here]] = True
        lcp[place[cut_here]] = d[cut_here]
        deeper = side == 1
        ended = deeper & (pivot == -1)
        at[place] = np.where(ended, SHALLOW, d + deeper)
    return order, head, lcp


class _BlindTrie:
    """Sorts suffixes that share their first words: branches are told by single words, the rest is skipped on the way down."""

    def __init__(self, words: np.ndarray, depth: int) -> None:
        self.words, self.depth, self.root = words, depth, None

    def _word(self, s: tuple[int, int], d: int) -> int:
        return int(self.words[s[0] + d]) if d < s[1] else -1

    def _common(self, a: tuple[int, int], b: tuple[int, int]) -> int:
        m = min(a[1], b[1])
        differ = np.flatnonzero(self.words[a[0] + self.depth : a[0] + m] != self.words[b[0] + self.depth : b[0] + m])
        return self.depth + int(differ[0]) if len(differ) else m

    def add(self, row: int, start: int, length: int) -> None:
        s = (start, length)
        if self.root is None:
            self.root = [s, [row]]  # a leaf: suffix, its rows
            return
        path, node = [], self.root
        while isinstance(node[1], dict):  # a branching: depth, word -> child
            path.append(node)
            node = node[1].get(self._word(s, node[0])) or next(iter(node[1].values()))
        leaf = node
        common = self._common(s, leaf[0])
        if common == length and common == leaf[0][1]:
            leaf[1].append(row)
            return
        parent, node = None, self.root
        while isinstance(node[1], dict) and node[0] < common:
            parent, node = node, node[1][self._word(s, node[0])]
        if isinstance(node[1], dict) and node[0] == common:
            node[1][self._word(s, common)] = [s, [row]]
            return
        branch = [common, {self._word(leaf[0], common): node, self._word(s, common): [s, [row]]}]
        if parent is None:
            self.root = branch
        else:
            parent[1][self._word(s, parent[0])] = branch

    def walk(self) -> tuple[list[int], list[int]]:
        """Rows in order, and of each the common prefix with the one before (of the first: -1)."""
        rows, common = [], []
        stack = [(self.root, -1)]
        while stack:
            node, before = stack.pop()
            if isinstance(node[1], dict):
                kids = [node[1][w] for w in sorted(node[1])]
                stack.extend((kid, node[0]) for kid in kids[:0:-1])
                stack.append((kids[0], before))
            else:
                rows += node[1]
                common += [before] + [node[0][1]] * (len(node[1]) - 1)
        return rows, common


def sort_suffixes(words: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(order, LCP) of suffixes within groups; members of a group share their first ``depth`` words. LCP is -1 at a group's first."""
    order, head, lcp = _quicksort(words, start, length, group, depth)
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(order)))
    for a, m in zip(first[size > 1].tolist(), size[size > 1].tolist()):
        rows = order[a : a + m]
        trie = _BlindTrie(words, min(depth, int(length[rows].min())))
        for row in rows.tolist():
            trie.add(row, int(start[row]), int(length[row]))
        sorted_rows, common = trie.walk()
        order[a : a + m] = sorted_rows
        lcp[a + 1 : a + m] = common[1:]
    return order, lcp


def equal_windows(
    words: np.ndarray, base: np.ndarray, n: np.ndarray, off: np.ndarray, gram: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, window within the run, owner) of the windows that occur in two documents.

    Record i has n[i] windows from words[base[i]] on, its minimiser off[i] words later; it stands for documents from low[i] to high[i].
    """
    start = base + off
    order, lcp = sort_suffixes(words, start, n - 1 + LENGTH - off, gram, GRAM)
    left = np.zeros(len(base), dtype=np.uint64)
    out: list[tuple[np.ndarray, ...]] = []
    for before in range(SPREAD):
        stretch = np.cumsum(lcp < LENGTH - before)
        use = (before <= off[order]) & (before >= off[order] - n[order] + 1)
        rows, part = order[use], stretch[use]
        if len(rows):
            by = np.lexsort((left[rows], part))
            rows, part = rows[by], part[by]
            new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (left[rows][1:] != left[rows][:-1])]))
            least, most = np.minimum.reduceat(low[rows], new), np.maximum.reduceat(high[rows], new)
            size = np.diff(np.append(new, len(rows)))
            twice = np.repeat(least < most, size)
            out.append((rows[twice], (off[rows] - before)[twice], np.repeat(least, size)[twice]))
        more = off > before
        left[more] = K.mix(left[more] * np.uint64(0x2545F4914F6CDD1D) + words[start[more] - before - 1].astype(np.uint64) + np.uint64(1))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    row, t, owner = (np.concatenate([o[k] for o in out]) for k in range(3))
    by = np.lexsort((t, row))
    return row[by], t[by], owner[by]


def _portions(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Whole groups of the keys, by which rows are sorted, in portions of bounded size unless one group is larger."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= RUNS_AT_ONCE:
            table = pa.Table.from_batches(held)
            other = np.zeros(table.num_rows, dtype=bool)
            for key in keys:
                column = table.column(key).to_numpy()
                other |= column != column[-1]
            if other.any():
                cut_at = int(np.flatnonzero(other)[-1]) + 1
                yield table.slice(0, cut_at)
                held = table.slice(cut_at).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _runs(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(words end to end, where each run's words begin, number of windows, place of the minimiser, minimiser)."""
    column = table.column("words").combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    words = np.frombuffer(column.buffers()[2], np.uint32, count=int(offsets[-1]) // 4)
    return words, offsets[:-1] // 4, *(table.column(c).to_numpy().astype(np.int64) for c in ("n", "off", "gram"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, th, s, m, owner) of the repeated windows, runs of windows with one owner being one row."""
    for table in _portions(batches, "gram"):
        words, base, n, off, gram = _runs(table)
        low, high, doc, th, s = (table.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "doc", "th", "s"))
        row, t, owner = equal_windows(words, base, n, off, gram, low, high)
        if len(row):
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (t[1:] != t[:-1] + 1) | (owner[1:] != owner[:-1])]))
            size, first = np.diff(np.append(new, len(row))), row[new]
            columns = gram[first], doc[first], th[first], s[first].astype(np.int32), t[new].astype(np.int32), size.astype(np.int32), owner[new]
            yield pa.record_batch([pa.array(c) for c in columns], names=["gram", "doc", "th", "s", "t", "m", "owner"])


def same_runs(words: np.ndarray, base: np.ndarray, n: np.ndarray, off: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Of each run the first one in suffix order that is equal to it as a whole."""
    start, length = base + off, n - 1 + LENGTH - off
    order, lcp = sort_suffixes(words, start, length, gram, GRAM)
    same = np.concatenate([[False], (lcp[1:] == length[order][1:]) & (length[order][1:] == length[order][:-1])])
    stretch = np.cumsum(~same)
    left = np.zeros(len(base), dtype=np.uint64)
    for before in range(int(off.max(initial=0))):
        more = off > before
        left[more] = K.mix(left[more] * np.uint64(0x2545F4914F6CDD1D) + words[start[more] - before - 1].astype(np.uint64) + np.uint64(1))
    by = np.lexsort((left[order], off[order], stretch))
    rows, part = order[by], stretch[by]
    new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (off[rows][1:] != off[rows][:-1]) | (left[rows][1:] != left[rows][:-1])])) if len(rows) else np.zeros(0, np.int64)
    out = np.empty(len(base), dtype=np.int64)
    out[rows] = np.repeat(rows[new], np.diff(np.append(new, len(rows))))
    return out


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every run with the one (d0, t0, s0) that stands for it; that one keeps its words, and the range of documents it stands for."""
    for table in _portions(batches, "gram", "part"):
        words, base, n, off, gram = _runs(table)
        first = same_runs(words, base, n, off, gram)
        doc, th, s = (table.column(c).to_numpy().astype(np.int64) for c in ("doc", "th", "s"))
        low, high = np.full(len(doc), np.iinfo(np.int64).max), np.full(len(doc), np.iinfo(np.int64).min)
        np.minimum.at(low, first, doc)
        np.maximum.at(high, first, doc)
        stands = first == np.arange(len(first))
        blobs = pc.if_else(pa.array(stands), table.column("words").combine_chunks(), pa.scalar(None, pa.binary()))
        columns = [gram, doc, th, s.astype(np.int32), doc[first], th[first], s[first].astype(np.int32), n.astype(np.int8), off.astype(np.int8), low, high]
        yield pa.record_batch([*(pa.array(c) for c in columns), blobs], names=["gram", "doc", "th", "s", "d0", "t0", "s0", "n", "off", "low", "high", "words"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc, th, s, m, owner): m windows from word s on of the text with hash th of ``doc`` that other documents have too."""
    texts = _identified(docs)
    records = texts.mapInArrow(_records, "gram long, doc long, th long, s int, n byte, off byte")
    shared = cut(
        records.groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("runs"))
        .where("low < high").select("gram", F.ceil(F.col("runs") / RUNS_AT_ONCE).cast("int").alias("parts"))
    )
    runs = records.join(shared.hint("shuffle_hash"), "gram")
    part = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    wanted = runs.groupBy("doc", "th").agg(F.collect_list(F.struct("gram", "s", "n", "off", "parts", part.alias("part"))).alias("k"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            for a, z in K.chunks(column):
                words = K.tokenize(column.slice(a, z - a))
                short = (words.hashes >> np.uint64(32)).astype(np.uint32)
                lists = batch.column(3).slice(a, z - a)
                flat = lists.flatten()
                fields = {name: flat.field(i) for i, name in enumerate(("gram", "s", "n", "off", "parts", "part"))}
                owner = np.repeat(np.arange(z - a), pc.list_value_length(lists).to_numpy())
                s = fields["s"].to_numpy() + words.offsets[owner]
                size = fields["n"].to_numpy().astype(np.int64) - 1 + LENGTH
                ends = np.cumsum(size)
                at = np.repeat(s - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
                blobs = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), pa.py_buffer(short[at])])
                doc, th = (batch.column(c).slice(a, z - a).take(pa.array(owner)) for c in range(2))
                yield pa.record_batch([doc, th, *(fields[c] for c in fields), blobs], names=["doc", "th", *fields, "words"])

    fetched = (
        texts.join(wanted.hint("shuffle_hash"), ["doc", "th"]).select("doc", "th", "text", "k")
        .mapInArrow(contexts, "doc long, th long, gram long, s int, n byte, off byte, parts int, part int, words binary")
    )
    found = "gram long, doc long, th long, s int, t int, m int, owner long"
    at_once = (
        fetched.where("parts = 1").select("gram", "doc", "th", "s", "n", "off", F.col("doc").alias("low"), F.col("doc").alias("high"), "words")
        .repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare, found)
        .select("doc", "th", (F.col("s") + F.col("t")).alias("s"), "m", "owner")
    )
    if shared.where("parts > 1").isEmpty():
        return at_once
    collapsed = cut(
        fetched.where("parts > 1").drop("parts").repartition("gram", "part").sortWithinPartitions("gram", "part")
        .mapInArrow(_collapse, "gram long, doc long, th long, s int, d0 long, t0 long, s0 int, n byte, off byte, low long, high long, words binary")
    )
    compared = (
        collapsed.where("words IS NOT NULL").select("gram", "doc", "th", "s", "n", "off", "low", "high", "words")
        .repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare, found)
        .select("gram", F.col("doc").alias("d0"), F.col("th").alias("t0"), F.col("s").alias("s0"), "t", "m", "owner")
    )
    placed = collapsed.select("gram", "doc", "th", "s", "d0", "t0", "s0").join(compared, ["gram", "d0", "t0", "s0"])
    return at_once.unionByName(placed.select("doc", "th", (F.col("s") + F.col("t")).alias("s"), "m", "owner"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, start_word, n_words, first_doc_id``: the maximal passages whose every window of 50 words occurs in another document too.

    ``first_doc_id`` is the smallest document among the owners of those windows; it is the document itself in the passage's first copy.
    Words are numbered from 0.

    * null, empty or short (under 50 words) text: no passage.  Very long texts are taken whole.
    * null ``doc_id``: such rows are together one document, after all others, reported with a null.
    * repeated rows, and different texts under one id: one document, so what only they share isn't repeated; equal passages of equal rows are one row.
    * ties: of equal windows the smallest ``doc_id`` is the owner.  An empty table gives no rows; further columns are ignored.
    """
    spans = repeated_windows(docs).select("doc", "th", F.col("s").alias("b"), (F.col("s") + F.col("m") - 1 + LENGTH).alias("e"), "owner")
    inside = Window.partitionBy("doc", "th").orderBy("b", "e")
    fresh = F.col("b") > F.coalesce(F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    islands = spans.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc", "th", "island").agg(F.min("b").alias("b"), F.max("e").alias("e"), F.min("owner").alias("owner"))
    named = [F.when(F.col(c) != NO_ID, F.col(c)) for c in ("doc", "owner")]
    return merged.select(named[0].alias("doc_id"), F.col("b").cast("int").alias("start_word"), (F.col("e") - F.col("b")).cast("int").alias("n_words"), named[1].alias("first_doc_id")).distinct()


def _without(text: Column, ranges: Column) -> Column:
    """The text without the words of the ranges (first word, number of windows), each with what follows it up to the next word."""

    @F.arrow_udf("string")
    def of(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, ranges in zip(texts, lists):
            text, ranges = text.as_py(), ranges.as_py()
            if not ranges:
                out.append(text)
                continue
            raw = text.encode("utf-8", "surrogatepass")
            data = np.frombuffer(raw, np.uint8)
            starts, _ = K.word_spans(data, np.array([0, len(data)]))
            gone = np.zeros(len(starts) + 1, dtype=np.int64)
            for r in ranges:
                gone[r["s"]] += 1
                gone[min(len(starts), r["s"] + r["m"] - 1 + LENGTH)] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            at, kept = 0, []
            for b, e in edge.reshape(-1, 2).tolist():
                kept.append(raw[at : starts[b]])
                at = int(starts[e]) if e < len(starts) else len(raw)
            kept.append(raw[at:])
            out.append(b"".join(kept).decode("utf-8", "replace").rstrip() if edge[-1] == len(starts) else b"".join(kept).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return of(text, ranges)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with each repeated passage left in its first document only; same columns.

    Where words go, ``text`` and ``n_chars`` (if there is one) change; a row that is left without a word goes.
    Every other row stays as it is, whatever it holds.  The cases are those of ``repeated_passages``.
    """
    gone = repeated_windows(docs).where("owner < doc").groupBy("doc", "th").agg(F.collect_list(F.struct("s", "m")).alias("ranges"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # further columns travel inside, so that no name can clash
    keyed = docs.select(row.alias("row"), F.coalesce(row["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(row["text"].cast("string")).alias("th"))
    joined = keyed.join(gone.hint("shuffle_hash"), ["doc", "th"], "left")
    text = F.col("row")["text"].cast("string")
    changed = F.col("ranges").isNotNull() & text.isNotNull()
    new = joined.withColumn("left", F.when(changed, _without(text, F.col("ranges"))).otherwise(text))
    kept = new.where(~changed | F.col("left").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
    fresh = {"text": F.when(changed, F.col("left")).otherwise(text)}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(changed, F.length("left")).otherwise(F.col("row")["n_chars"])
    return kept.select(*((fresh[c] if c in fresh else F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
