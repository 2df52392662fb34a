"""License scan by patience alignment of texts with license templates.

A template matches where its words occur in order, close together.  Words that are unique in both the text
and the template are anchors; their longest increasing subsequence is kept, and the gaps between them are aligned
the same way, a gap without unique words by all its matches (longest increasing subsequence again, which
is the longest common subsequence).  Where a stretch holds more or other words than the template, piles that also keep the latest start
give the longest common subsequence of any stretch.  Coverage is the share of the template's words in the best stretch of text.

Whole license texts (``license_texts.BODIES``) are aligned that way with nothing that must match; short notices, in which one
word makes another license, name the words that tell them from others.

Before aligning, a text must hold enough of a template's words, and so must a stretch of it; that bound is exact and leaves few stretches.  Templates are constants of this module: nothing is joined or shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import kernel as K
from tidewheel.llm.license_texts import BODIES, IDENTIFIERS

MIN_COVERAGE = 0.8
STRETCH = 1.5
_turn = count()  # tells equal matches of overlapping ranges apart

#: (license, words that must match or None for a whole text, notice)
TEMPLATES: tuple[tuple[str, str | None, str], ...] = (
    ("MIT", "mit", "released under the MIT License"),
    ("MIT", "mit", "licensed under the MIT License"),
    ("MIT", "deal sublicense", "to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("Apache-2.0", "apache", "licensed under the Apache License Version 2.0"),
    ("Apache-2.0", "apache", "released under the Apache License 2.0"),
    ("GPL-3.0", "gnu general 3", "licensed under the GNU General Public License version 3"),
    ("GPL-3.0", "gnu general 3", "under the terms of the GNU General Public License as published by the Free Software Foundation either version 3"),
    ("GPL-2.0", "gnu general 2", "licensed under the GNU General Public License version 2"),
    ("GPL-2.0", "gnu general 2", "under the terms of the GNU General Public License as published by the Free Software Foundation either version 2"),
    ("LGPL-3.0", "gnu lesser 3", "licensed under the GNU Lesser General Public License version 3"),
    ("LGPL-2.1", "gnu lesser 2", "licensed under the GNU Lesser General Public License version 2.1"),
    ("AGPL-3.0", "gnu affero 3", "licensed under the GNU Affero General Public License version 3"),
    ("BSD-2-Clause", "bsd 2", "licensed under the BSD 2 Clause License"),
    ("BSD-3-Clause", "bsd 3", "licensed under the BSD 3 Clause License"),
    ("BSD", "bsd", "released under the BSD License"),
    ("BSD", "redistributions binary", "Redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("ISC", "isc", "released under the ISC License"),
    ("MPL-2.0", "mozilla", "subject to the terms of the Mozilla Public License v. 2.0"),
    ("MPL-2.0", "mozilla", "licensed under the Mozilla Public License version 2.0"),
    ("CC-BY-4.0", "creative attribution 4", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "creative sharealike 4", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "creative noncommercial 4", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "cc 4", "licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "cc sa 4", "licensed under CC BY SA 4.0"),
    ("CC-BY-NC-4.0", "cc nc 4", "licensed under CC BY NC 4.0"),
    ("CC-BY-ND-4.0", "cc nd 4", "licensed under CC BY ND 4.0"),
    ("CC-BY-NC-SA-4.0", "cc nc sa 4", "licensed under CC BY NC SA 4.0"),
    ("CC-BY-NC-ND-4.0", "cc nc nd 4", "licensed under CC BY NC ND 4.0"),
    ("CC0-1.0", "cc0", "released under CC0 1.0 Universal"),
    ("Unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("Proprietary", "rights reserved", "all rights reserved"),
    ("Proprietary", "rights reserved", "copyright all rights reserved"),
    *IDENTIFIERS,
    *((name, None, text) for name, text in BODIES),
)


@dataclass
class Template:
    name: str
    words: np.ndarray  # hashes
    needs: np.ndarray
    whole: bool = False


def compiled(templates: tuple[tuple[str, str | None, str], ...] = TEMPLATES) -> list[Template]:
    return [Template(name, K.tokenize(pa.array([text])).hashes, K.tokenize(pa.array([needs or ""])).hashes, needs is None) for name, needs, text in templates]


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience piles; of several that which ends first, and so on backwards."""
    tops: list[int] = []
    piles: list[list[int]] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v), piles.append([i])
        else:
            tops[k] = v
            piles[k].append(i)
    out: list[int] = []
    for pile in reversed(piles):  # values fall along a pile
        out.append(next(i for i in pile if not out or i < out[-1] and values[i] < values[out[-1]]))
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of a patience alignment, increasing in both."""
    found: list[tuple[int, int]] = []
    stack = [(0, len(text), 0, len(template))]
    while stack:
        a, b, p, q = stack.pop()
        if a >= b or p >= q:
            continue
        in_text: dict[int, list[int]] = {}
        in_template: dict[int, list[int]] = {}
        for k in range(a, b):
            in_text.setdefault(text[k], []).append(k)
        for k in range(p, q):
            in_template.setdefault(template[k], []).append(k)
        anchors = sorted((in_text[w][0], t[0]) for w, t in in_template.items() if len(t) == 1 and len(in_text.get(w, ())) == 1)
        if anchors:
            kept = [anchors[i] for i in increasing([t for _, t in anchors])]
            found += kept
            edges = [(a - 1, p - 1), *kept, (b, q)]
            stack += [(x + 1, z, y + 1, w) for (x, y), (z, w) in zip(edges, edges[1:])]
        else:
            every = [(k, t) for k in range(a, b) for t in reversed(in_template.get(text[k], ()))]
            found += [every[i] for i in increasing([t for _, t in every])]
    return sorted(found)


def best_stretch(text: list[int], places: list[int], template: list[int], needs: set[int]) -> tuple[int, int, int]:
    """(matched words, first, last) of the best match within a stretch of at most ``_width`` words, (0, 0, 0) without one.

    ``text`` are the words of the template at ``places``.  Of all subsequences common to a stretch and the template that hold the words
    ``needs`` the longest counts; of equally long ones that which ends first, then the shortest.
    """
    n, width = len(template), _width(len(template))
    if len(text) == n and places[-1] - places[0] < width and len(align(text, template)) == n and needs <= set(text):
        return n, places[0], places[-1]  # word by word, with nothing to choose from
    at: dict[int, list[int]] = {}
    for t in reversed(range(n)):
        at.setdefault(template[t], []).append(t)
    bit = {w: 1 << i for i, w in enumerate(sorted(needs))}
    # patience piles by the needed words held, matched words and template words passed: the latest start
    start = np.full((1 << len(bit), n + 1, n + 1), -1, dtype=np.int64)
    best = (0, 0, 0)
    for word, place in zip(text, places):
        start[0, 0] = place
        for t in at[word]:  # from the last on, so that a place of the text counts once
            grown = np.full((len(start), n + 1), -1, dtype=np.int64)
            grown[:, 1:] = start[:, :-1, t]
            if b := bit.get(word, 0):
                masks = np.arange(len(grown))
                held = masks[masks & b > 0]
                grown[held] = np.maximum(grown[held], grown[held ^ b])
                grown[masks & b == 0] = -1
            start[:, :, t + 1 :] = np.maximum(start[:, :, t + 1 :], grown[:, :, None])
            fits = np.flatnonzero((grown[-1] >= 0) & (place - grown[-1] < width))
            if len(fits) and (fits[-1], grown[-1, fits[-1]]) > (best[0], best[1] if best[2] == place else place):
                best = (int(fits[-1]), int(grown[-1, fits[-1]]), place)
    return best


def patience_stretch(text: list[int], places: list[int], template: list[int]) -> tuple[int, int, int]:
    """(matched words, first, last) of the stretch of at most ``_width`` words that holds most of a patience alignment; the first of equal ones."""
    at = [places[i] for i, _ in align(text, template)]
    best, low = (0, 0, 0), 0
    for high, place in enumerate(at):
        while place - at[low] >= _width(len(template)):
            low += 1
        if high - low + 1 > best[0]:
            best = high - low + 1, at[low], place
    return best


def scan(words: K.Words, templates: list[Template], min_coverage: float) -> Iterator[tuple[int, str, float, int, int]]:
    """(document, license, coverage, first word, number of words) of the best match of each license.

    Where stretches of two licenses overlap, the one with more matched words stands (LGPL words contain GPL words).
    """
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t.words for t in templates), *(t.needs for t in templates)]))
    if not len(vocabulary):
        return
    at = np.searchsorted(vocabulary, words.hashes)
    at[at == len(vocabulary)] = 0
    hit = np.flatnonzero(vocabulary[at] == words.hashes)
    if not len(hit):
        return
    doc = (np.searchsorted(words.offsets, hit, side="right") - 1).astype(np.int64)
    code = at[hit]
    holds = np.unique(doc)
    count = np.bincount(np.searchsorted(holds, doc) * len(vocabulary) + code, minlength=len(holds) * len(vocabulary)).reshape(len(holds), -1)
    heaps: dict[int, list[tuple]] = {}
    for k, t in enumerate(templates):
        kinds, times = np.unique(np.searchsorted(vocabulary, t.words), return_counts=True)
        enough = np.minimum(count[:, kinds], times).sum(1) >= min_coverage * len(t.words) - 1e-9
        enough &= (count[:, np.searchsorted(vocabulary, t.needs)] > 0).all(1)
        own = np.searchsorted(vocabulary, t.words)
        needs = np.searchsorted(vocabulary, t.needs)
        for d in holds[enough]:
            low, high = np.searchsorted(doc, (d, d + 1))
            use = np.isin(code[low:high], kinds)
            heaps.setdefault(int(d), []).extend(_matches(code[low:high][use], hit[low:high][use] - words.offsets[d], own, needs, min_coverage, t, k))
    for d, heap in sorted(heaps.items()):
        heapify(heap)
        taken: dict[int, tuple[int, int, str]] = {}  # by word
        best: dict[str, tuple[float, int, int]] = {}
        while heap:
            _, coverage, first, last, name, k, _, _, _, (text, place) = heappop(heap)
            own = first, last, name
            cover = next((taken[w] for w in range(first, last + 1) if taken.get(w, own)[2] != name), own)
            if cover is own:
                taken.update(dict.fromkeys(range(first, last + 1), own))
                best[name] = min(best.get(name, (0.0, 0, 0)), (coverage, first, last - first + 1))
            words_of, needs = (np.searchsorted(vocabulary, v) for v in (templates[k].words, templates[k].needs))
            for part in (place < cover[0], place > cover[1]):  # further stretches beside the one taken
                for match in _matches(text[part], place[part], words_of, needs, min_coverage, templates[k], k):
                    heappush(heap, match)
        for name, (coverage, first, n) in sorted(best.items()):
            yield d, name, -coverage, first, n


def _matches(text: np.ndarray, places: np.ndarray, template: np.ndarray, needs: np.ndarray, min_coverage: float, known: Template, k: int) -> Iterator[tuple]:
    """The best match of each range of candidates, to be taken in order: most words first; at the end the range itself."""
    own, least = template.tolist(), min_coverage * len(template) - 1e-9
    for a, z in _candidates(text, places, template, needs, least):
        range_ = text[a:z].tolist(), places[a:z].tolist(), own
        n, first, last = patience_stretch(*range_) if known.whole else best_stretch(*range_, set(needs.tolist()))
        if n and n >= least:
            yield -n, -round(n / len(own), 6), first, last, known.name, k, int(places[a]), z - a, next(_turn), (text[a:z], places[a:z])


def _width(words: int) -> int:
    return max(words, int(STRETCH * words))


def _candidates(text: np.ndarray, places: np.ndarray, template: np.ndarray, needs: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Ranges of which one holds each stretch with enough of the template's words and all needed ones.

    Stretches that share words are one range up to a length, so that a text of nothing but notices takes time in proportion.
    """
    width = _width(len(template))
    end = np.searchsorted(places, places + width)
    enough, held = np.zeros(len(text), dtype=np.int64), np.ones(len(text), dtype=bool)
    for kind, most in zip(*np.unique(template, return_counts=True)):
        before = np.concatenate([[0], np.cumsum(text == kind)])
        count = before[end] - before[:-1]
        enough += np.minimum(count, most)
        if kind in needs:
            held &= count > 0
    low, high = 0, 0
    for k in np.flatnonzero(held & (enough >= least)).tolist():
        if k >= high or places[end[k] - 1] - places[low] >= 4 * width:
            if high:
                yield low, high
            low = k
        high = int(end[k])
    if high:
        yield low, high


def scan_licenses(docs: DataFrame, min_coverage: float = MIN_COVERAGE, templates: tuple[tuple[str, str | None, str], ...] = TEMPLATES) -> DataFrame:
    """``doc_id, license, coverage, start_word, n_words``: the best match of each license that a text states.

    Words are numbered from 0; a license has several templates, of which the best counts.

    * null, empty or wordless text: no row.  Very long texts are scanned whole.
    * null ``doc_id``: reported with a null.  Repeated rows: each is reported.
    * ties of coverage: in a run of overlapping stretches the one that ends first, then the shortest; of several runs the earliest.  Coverage equal to ``min_coverage`` matches.
    * no templates: no row.  An empty table gives no rows; further columns, whatever their names, are ignored.
    """
    known = compiled(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.columns
            for a, z in K.chunks(column):
                rows = list(scan(K.tokenize(column.slice(a, z - a)), known, min_coverage))
                if rows:
                    d, name, coverage, first, n = zip(*rows)
                    yield pa.record_batch(
                        [ids.slice(a, z - a).take(pa.array(d)), pa.array(name), pa.array(coverage), pa.array(first, pa.int32()), pa.array(n, pa.int32())],
                        names=["doc_id", "license", "coverage", "start_word", "n_words"],
                    )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, license string, coverage double, start_word int, n_words int")
