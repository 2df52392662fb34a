"""URL filter by a path-template tree per host.

1. Segments that are variable by their shape (numbers, dates, hex, uuids, slugs) become a wildcard of that shape, in
   SQL functions, and pages are counted by (host, path).
2. Level by level, values of a segment that are rare among many siblings become ``*``; a few aggregations and joins a level, on
   counts, so no host has to fit into one task.
3. Per host, on what little is left: sibling branches whose children look alike and whose label rates don't differ
   significantly are merged, from the root down; each leaf is a template.
4. A template is rejected where its share of good labels, smoothed towards the share over all pages, is under ``min_purity``.
"""

from __future__ import annotations

import math
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import cut

MANY = 20
RARE = 0.05
Z_LIMIT = 1.96
LIKE = 0.5
WEIGHT = 4.0
MIN_PURITY = 0.5

SHAPES = (
    (r"^[0-9]+$", "<num>"),
    (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "<date>"),
    (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "<uuid>"),
    (r"^(?=.*[0-9])[0-9a-f]{8,}$", "<hex>"),
    (r"^[^-_]+([-_][^-_]+){3,}$", "<slug>"),
    (r"^.{40,}$", "<long>"),
)


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a leading ``www.``; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def shaped_path(url: Column) -> Column:
    """Segments of the path, variable ones by their shape; a short extension stays."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1))

    def shape(s: Column) -> Column:
        stem, ext = F.regexp_replace(s, r"(?<=.)\.[a-z]{2,5}$", ""), F.regexp_extract(s, r".(\.[a-z]{2,5})$", 1)
        kind = F.lit(None).cast("string")
        for pattern, name in reversed(SHAPES):
            kind = F.when(stem.rlike(pattern), F.lit(name)).otherwise(kind)
        return F.when(kind.isNull(), s).otherwise(F.concat(kind, ext))

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)


def _generalise(paths: DataFrame) -> DataFrame:
    """Adds ``segs``: ``path`` with the rare ones among many values of a segment as ``*``.

    A level can have many values only where a host has ``MANY`` paths that reach it, so a few very long URLs add no round.
    """
    paths = cut(paths.withColumn("segs", F.col("path")))
    reach = paths.groupBy("host", F.size("path").alias("depth")).agg(F.count(F.lit(1)).alias("n"))
    deeper = Window.partitionBy("host").orderBy(F.desc("depth"))
    levels = reach.withColumn("reach", F.sum("n").over(deeper)).where(F.col("reach") >= MANY).agg(F.max("depth")).collect()[0][0] or 0
    for level in range(levels):
        here = paths.where(F.size("segs") > level)
        key = [F.col("host"), F.slice("segs", 1, level).alias("head"), F.get("segs", F.lit(level)).alias("seg")]
        siblings = Window.partitionBy("host", "head")
        rare = (
            here.select(*key, "n").groupBy("host", "head", "seg").agg(F.sum("n").alias("n"))
            .select("host", "head", "seg", (F.count(F.lit(1)).over(siblings) >= MANY).alias("many"), (F.col("n") < RARE * F.sum("n").over(siblings)).alias("few"))
            .where("many AND few").select("host", "head", "seg", F.lit(True).alias("rare"))
        )
        if rare.isEmpty():
            continue
        keyed = paths.withColumns({"head": F.slice("segs", 1, level), "seg": F.get("segs", F.lit(level))}).join(rare, ["host", "head", "seg"], "left")
        star = F.concat(F.slice("segs", 1, level), F.array(F.lit("*")), F.slice("segs", level + 2, F.greatest(F.size("segs"), F.lit(1))))
        paths = cut(keyed.withColumn("segs", F.when(F.col("rare"), star).otherwise(F.col("segs"))).select("host", "path", "n", "labelled", "good", "segs"))
    return paths


class _Node:
    """A branch: its children, the counts (pages, labelled, good) of paths that end here and of all below, and those paths."""

    __slots__ = ("kids", "own", "total", "paths")

    def __init__(self) -> None:
        self.kids: dict[str, _Node] = {}
        self.own = self.total = (0, 0, 0)
        self.paths: list[tuple[str, ...]] = []


def _plus(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(x + y for x, y in zip(a, b))


def _alike(a: _Node, b: _Node) -> bool:
    """Similar children (Jaccard of their segments) and no significant difference of label rates."""
    ka, kb = set(a.kids), set(b.kids)
    if bool(a.own[0]) != bool(b.own[0]) and not (ka and kb):
        return False
    if (ka or kb) and len(ka & kb) < LIKE * len(ka | kb):
        return False
    (_, la, ga), (_, lb, gb) = a.total, b.total
    pooled = (ga + gb + 1) / (la + lb + 2)
    error = math.sqrt(pooled * (1 - pooled) * (1 / (la + 1) + 1 / (lb + 1)))
    return abs((ga + 0.5) / (la + 1) - (gb + 0.5) / (lb + 1)) <= Z_LIMIT * error


def _merge(into: _Node, other: _Node) -> None:
    waiting = [(into, other)]
    while waiting:
        into, other = waiting.pop()
        into.own, into.total = _plus(into.own, other.own), _plus(into.total, other.total)
        into.paths += other.paths
        for name, kid in other.kids.items():
            if name in into.kids:
                waiting.append((into.kids[name], kid))
            else:
                into.kids[name] = kid


def templates(rows: list[tuple[tuple[str, ...], int, int, int]]) -> dict[tuple[str, ...], tuple[str, int, int, int]]:
    """Segments -> (template, pages, labelled, good) for the paths of one host.  Nothing recurses, so a path may have any number of segments."""
    root = _Node()
    for segs, *counts in rows:
        node = root
        node.total = _plus(node.total, counts)
        for s in segs:
            node = node.kids.setdefault(s, _Node())
            node.total = _plus(node.total, counts)
        node.own = _plus(node.own, counts)
        node.paths.append(segs)
    found: dict[tuple[str, ...], tuple[str, int, int, int]] = {}
    waiting: list[tuple[_Node, tuple | None]] = [(root, None)]
    while waiting:
        node, shown = waiting.pop()  # names from here back to the root, linked
        if node.paths:
            names, link = [], shown
            while link:
                names.append(link[0])
                link = link[1]
            named = ("/" + "/".join(reversed(names)), *node.own)
            found.update(dict.fromkeys(node.paths, named))
        groups: list[tuple[list[str], _Node]] = []
        for name in sorted(node.kids, key=lambda k: (-node.kids[k].total[0], k)):
            kid = node.kids[name]
            for members, merged in groups:
                if _alike(merged, kid):
                    members.append(name)
                    _merge(merged, kid)
                    break
            else:
                groups.append(([name], kid))
        for members, merged in groups:
            one = members[0] if len(members) == 1 else "{" + "|".join(sorted(members)) + "}"
            waiting.append((merged, (one, shown)))
    return found


def filter_urls(pages: DataFrame, labels: DataFrame, min_purity: float = MIN_PURITY) -> DataFrame:
    """``page_id, host, template, labelled, purity, rejected`` of every page.

    ``labels`` is (page_id, good): the label of a page. The mean over all labelled pages is what purity is smoothed towards with ``WEIGHT`` votes.

    * null or empty URL, or one without a host: null host, template and purity, 0 labelled, not rejected.
    * null ``page_id``: has no label, reported with a null.  Repeated rows: each counts, each is reported.
    * very long URLs: every segment counts, however many there are.
    * several labels of one page: their mean, of at least a half is good.  No labels at all: purity is null and nothing is rejected.
    * ties: siblings are merged in the order of their pages, then of their names; purity equal to ``min_purity`` stays.
    * an empty table gives no rows; further columns, whatever their names, are ignored.
    """
    marks = labels.select(F.col("page_id").cast("long").alias("page_id"), F.col("good").cast("double").alias("good")).where("page_id IS NOT NULL AND good IS NOT NULL")
    marks = marks.groupBy("page_id").agg((F.avg("good") >= 0.5).cast("int").alias("good"))
    url = F.col("url").cast("string")
    # only the URL is read, and only (id, host, path) is shuffled
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), shaped_path(url).alias("path"))
    known = cut(known.join(marks, "page_id", "left"))
    sums = [F.count(F.lit(1)).alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")]
    paths = _generalise(known.where("host IS NOT NULL").groupBy("host", "path").agg(*sums))
    whole = paths.agg(F.sum("labelled"), F.sum("good")).collect()[0]
    prior = whole[1] / whole[0] if whole[0] else None

    def per_host(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[Any, ...]] = [(tuple(s), int(n), int(a), int(g)) for s, n, a, g in zip(pdf["segs"], pdf["n"], pdf["labelled"], pdf["good"])]
        found = templates(rows)
        out = [found[r[0]] for r in rows]
        return pd.DataFrame({"host": pdf["host"], "segs": pdf["segs"], "template": [o[0] for o in out], "labelled": [o[2] for o in out], "good": [o[3] for o in out]})

    lean = paths.groupBy("host", "segs").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    named = lean.groupBy("host").applyInPandas(per_host, "host string, segs array<string>, template string, labelled long, good long")
    purity = F.lit(None).cast("double") if prior is None else F.round((F.col("good") + WEIGHT * prior) / (F.col("labelled") + WEIGHT), 6)
    judged = paths.select("host", "path", "segs").join(named, ["host", "segs"]).select("host", "path", "template", "labelled", purity.alias("purity"))
    return known.select("page_id", "host", "path").join(judged, ["host", "path"], "left").select(
        "page_id", "host", "template", F.coalesce("labelled", F.lit(0)).cast("long").alias("labelled"), "purity", F.coalesce(F.col("purity") < min_purity, F.lit(False)).alias("rejected")
    )
