"""What leaves the engine: page payloads, snapshots, manifests, text reports, and where they may be written."""

from __future__ import annotations

import os
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions.text import shorten
from tidewheel.functions.timewin import to_iso
from tidewheel.functions.urls import published_url_udf

PROTECTED = ("/", "/bin", "/boot", "/dev", "/etc", "/home", "/lib", "/proc", "/root", "/sbin", "/sys", "/usr", "/var")


def item_json(url: Column, tags: Column, similar: Column) -> Column:
    """The nine fields of an item; an unsafe URL is null."""
    names = ("item_id", "kind", "published_at", "source_id", "source_name", "title")
    return F.struct(tags.alias("keywords"), *(F.col(n) for n in names), similar.alias("similar_count"), published_url_udf(url).alias("url"))


def page_payloads(pages: DataFrame) -> DataFrame:
    """(page, payload) from rows with page, place, total_pages, tags, similar_count, cluster_head and the item fields.

    Only heads of clusters are listed; facets count the collapsed items too.
    """
    item = item_json(F.col("url"), F.col("tags"), F.col("similar_count"))
    facets = F.struct(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("keywords"), F.sort_array(F.collect_set("kind")).alias("kinds"),
        F.sort_array(F.collect_set(F.struct(F.col("source_id").alias("id"), F.col("source_name").alias("name")))).alias("sources"),
    )
    rows = pages.withColumn("__item", item)
    heads = F.transform(F.sort_array(F.collect_list(F.when(F.col("cluster_head"), F.struct("place", "__item")))), lambda x: x["__item"])
    grouped = rows.groupBy("page").agg(facets.alias("facets"), heads.alias("items"), F.max("total_pages").alias("total_pages"))
    return grouped.select("page", F.to_json(F.struct("facets", "items", "page", "total_pages")).alias("payload"))


def write_payloads(payloads: DataFrame, path: str) -> None:
    """One JSON text file a page, under page=<n>."""
    payloads.repartition("page").write.mode("overwrite").partitionBy("page").text(path)


def snapshot(health: DataFrame, run_id: str, generated_at: datetime) -> DataFrame:
    """One row: the JSON of all sources' health, ordered by source."""
    rows = F.sort_array(F.collect_list(F.struct("source_id", *(c for c in health.columns if c != "source_id"))))
    return health.agg(rows.alias("sources")).select(F.to_json(F.struct(F.lit(to_iso(generated_at)).alias("generated_at"), F.lit(run_id).alias("run_id"), "sources")).alias("value"))


def new_run_id(now: datetime) -> str:
    """Sorts by time."""
    return f"{now:%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"


def manifest(spark: SparkSession, run_id: str, command: str, started: datetime, ok: bool, counts: dict[str, int], notes: list[str], finished: datetime | None = None) -> DataFrame:
    row = (run_id, command, to_iso(started), to_iso(finished) if finished else None, ok, counts, {}, notes)
    return spark.createDataFrame([row], "run_id string, command string, started_at string, finished_at string, ok boolean, counts map<string, int>, durations_ms map<string, int>, notes array<string>")


def doctor_table(report: DataFrame) -> DataFrame:
    """Lines of the report by source: a row of cells, and the proposed change where there is one."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat_ws(" | ", *(cell(c) for c in ("source_id", "kind", "status", "last_status", "last_rung", "error_class", "consecutive_failures")))
    change = F.when(F.col("proposed_status").isNotNull(), F.concat(F.lit(" -> "), "proposed_status", F.lit(": "), "reason")).otherwise(F.lit(""))
    return report.orderBy("source_id").select(F.concat(line, change).alias("line"))


def patch_lines(report: DataFrame) -> DataFrame:
    """Proposed changes as configuration lines."""
    changed = report.where("proposed_status IS NOT NULL").orderBy("group_id", "source_id")
    return changed.select("group_id", F.concat(F.lit("- id: "), F.col("source_id").cast("string"), F.lit("\n  status: "), "proposed_status", F.lit("\n  evidence: "), "reason").alias("patch"))


def gate_lines(daily: bool, weekly: bool) -> str:
    """What is due, a ``key=value`` a line."""
    return "\n".join(f"{name}={str(flag).lower()}" for name, flag in (("daily", daily), ("weekly", weekly)))


def eval_report(scored: DataFrame, cases: DataFrame) -> DataFrame:
    """(n, line): a Markdown report of scores (item_id, score) with the cases' titles, keywords found and keywords expected, in the order of item_id."""
    none = F.array().cast("array<string>")
    number = lambda c: F.format_string("%.3f", c)
    rows = cases.join(scored.select("item_id", "score"), "item_id", "left")
    cells = (shorten(F.col("title")), F.when(F.col("score").isNotNull(), number("score")).otherwise(F.lit("TODO")), F.array_join(F.coalesce("predicted", none), ", "), F.array_join(F.coalesce("expected", none), ", "))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("item_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("x")))), lambda r: r["x"])
    whole = rows.agg(F.avg("score").alias("mean"), F.count("score").alias("labelled"), F.count(F.lit(1)).alias("n"), listed.alias("rows"))
    unlabelled = (F.col("n") - F.col("labelled")).cast("string")
    head = F.when(F.col("mean").isNull(), F.concat(F.lit("mean jaccard: n/a (0/"), F.col("n").cast("string"), F.lit(" labelled)"))).otherwise(
        F.concat(F.lit("mean jaccard: "), number("mean"), F.lit(" ("), F.col("labelled").cast("string"), F.lit(" labelled / "), unlabelled, F.lit(" unlabelled)"))
    )
    lines = F.concat(F.array(head, F.lit(""), F.lit("| title | jaccard | predicted | expected |"), F.lit("|---|---|---|---|")), F.col("rows"))
    return whole.select(F.posexplode(lines).alias("n", "line"))


def asset_versions(files: DataFrame) -> DataFrame:
    """(name, version): the first eight hex digits of each file's hash, from rows of the binary file source."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.substring(F.sha2("content", 256), 1, 8).alias("version")).orderBy("name")


# datasets of the pages that show them
def sources_by_group(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """All groups by id, each with its sources by id; a group without any has an empty array."""
    columns = [c for c in sources.columns if c != "group_id"]
    own = sources.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("source_id", *(c for c in columns if c != "source_id")))).alias("sources"))
    return groups.join(own, "group_id", "left").withColumn("sources", F.coalesce("sources", F.filter(F.array(F.struct(*(F.lit(None).cast(sources.schema[c].dataType).alias(c) for c in ["source_id", *(c for c in columns if c != "source_id")]))), lambda _: F.lit(False)))).orderBy("group_id")


def linked_keywords(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of keywords with ``slug``, the page to link to, which is null where a keyword has none."""
    return rows.join(pages.select("keyword", "slug"), "keyword", "left").withColumn("linked", F.col("slug").isNotNull())


def home_page(cloud: DataFrame, stats: DataFrame, latest: DataFrame, digests: DataFrame) -> DataFrame:
    """One row: the arrays that the front page shows, each in its own order."""
    listed = lambda df, *order: df.agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("x"))))["x"].alias("v"))
    newest = lambda df, *order: df.agg(F.reverse(F.sort_array(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("x")))))["x"].alias("v"))
    parts = {
        "cloud": listed(cloud, "keyword"), "stats": stats.agg(F.first(F.struct(*stats.columns)).alias("v")), "latest": newest(latest, "published_at", "item_id"),
        "digests": newest(digests, "period_start", "created_at", "digest_id"),
    }
    found = [df.select(F.to_json("v").alias(name)) for name, df in parts.items()]
    out = found[0]
    for other in found[1:]:
        out = out.crossJoin(other)
    return out


def health_page(view: DataFrame) -> DataFrame:
    """(section, rows): sources that are live and that are disabled, by id."""
    return view.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("source_id", *(c for c in view.columns if c not in ("section", "source_id"))))).alias("rows")).orderBy("section")


def size_report(sizes: DataFrame, warn: int = 100 << 20, fail: int = 200 << 20) -> DataFrame:
    """One row: total, class, and the folders' bytes in order."""
    from tidewheel.functions.text import size_class

    total = F.coalesce(F.sum("bytes"), F.lit(0))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("folder", "bytes"))), lambda x: F.concat(x["folder"], F.lit("="), x["bytes"].cast("string"))), ", ")
    return sizes.agg(total.alias("total"), parts.alias("folders")).select("total", size_class(F.col("total"), warn, fail).alias("level"), "folders")


def visible_digests(digests: DataFrame, kind: str | None = None, topics: tuple[str, ...] = (), last_visit: str | None = None) -> DataFrame:
    """Digests of a kind and of followed topics (none followed: all), with ``is_new`` since the last visit."""
    rows = digests if kind is None else digests.where(F.col("kind") == kind)
    rows = rows.where(F.col("category").isin(*topics)) if topics else rows
    return rows.withColumn("is_new", F.lit(False) if last_visit is None else F.col("created_at") > last_visit)


def first_seen_order(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Distinct values in the order they first appear."""
    at = Window.partitionBy(column).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(at)).where("__n = 1").orderBy(*order).select(column)


def contained(root: str, path: str) -> str:
    """``path`` under ``root`` with links resolved, or ValueError."""
    base, target = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if target != base and os.path.commonpath([base, target]) != base:
        raise ValueError(f"{path!r} leaves {root!r}")
    return target


def safe_output(path: str, sources: tuple[str, ...] = ()) -> str:
    """A folder that may be replaced: no link, no protected root, no folder that holds what is read."""
    if os.path.islink(path):
        raise ValueError(f"{path!r} is a link")
    target = os.path.realpath(path)
    if target in PROTECTED or target == os.path.expanduser("~"):
        raise ValueError(f"{path!r} is protected")
    for s in sources:
        if os.path.commonpath([os.path.realpath(s), target]) == target:
            raise ValueError(f"{path!r} holds {s!r}")
    return target
