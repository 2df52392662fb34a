"""Windowed keyword trends over items, their keywords, sources and groups.

``items``: item_id, source_id, kind, published_at (timestamp), title.  ``keywords``: item_id, keyword, rank, method.
``sources``: source_id, name, kind, group_id, enabled.  ``groups``: group_id, category, enabled.

A count is always of distinct items.  Current and preceding window come from one scan of both; dimensions are small beside the
facts and left to the planner, which broadcasts them while they fit its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.text import is_rising, weight_step
from tidewheel.functions.timewin import ZONE, Span, local_date_column
from tidewheel.operators.rules import Rules, canonical, pinned


def in_category(items: DataFrame, sources: DataFrame, groups: DataFrame) -> DataFrame:
    """Items with the category of their source's group; items of unknown sources go."""
    star = sources.select("source_id", "group_id").join(groups.select("group_id", "category"), "group_id").select("source_id", "category")
    return items.join(star, "source_id")


def mentions(items: DataFrame, keywords: DataFrame, rules: Rules, span: Span) -> DataFrame:
    """Canonical keywords of the items of ``span``, with all columns of ``items``; several rows of a keyword are possible."""
    own = items.where(span.contains(F.col("published_at")))
    return canonical(own.join(keywords.select("item_id", "keyword"), "item_id"), rules)


def keyword_counts(items: DataFrame, keywords: DataFrame, rules: Rules, span: Span) -> DataFrame:
    return mentions(items, keywords, rules, span).groupBy("keyword").agg(F.countDistinct("item_id").alias("cnt"))


def two_windows(items: DataFrame, keywords: DataFrame, rules: Rules, now: Span, before: Span, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, keyword, cnt, prev_cnt) of keywords that occur in ``now``; the spans adjoin."""
    both = mentions(items, keywords, rules, Span(before.start, now.end, now.days + before.days))
    current = now.contains(F.col("published_at"))
    # an item lies in one window, so distinct (keyword, item) pairs are counted by window after one shuffle
    once = both.groupBy(*by, "keyword", "item_id").agg(F.max(current).alias("current"))
    return (
        once.groupBy(*by, "keyword")
        .agg(F.count_if("current").alias("cnt"), F.count_if(~F.col("current")).alias("prev_cnt"))
        .where("cnt > 0")
    )


def cloud(
    items: DataFrame, keywords: DataFrame, rules: Rules, now: Span, before: Span, limit: int = 60, least: int = 3, ratio: float = 3.0
) -> DataFrame:
    """The ``limit`` most frequent keywords and all pinned ones that occur: keyword, cnt, prev_cnt, delta, rising."""
    counts = two_windows(items, keywords, rules, now, before)
    # the top-N runs as a distributed limit; pinned terms are few and joined by a filter
    top = counts.orderBy(F.desc("cnt"), "keyword").limit(limit)
    chosen = top.unionAll(counts.where(pinned(F.col("keyword"), rules))).distinct() if rules.pin else top
    return chosen.select(
        "keyword", "cnt", "prev_cnt", (F.col("cnt") - F.col("prev_cnt")).alias("delta"), is_rising(F.col("cnt"), F.col("prev_cnt"), least, ratio).alias("rising")
    )


def rising_strip(terms: DataFrame, limit: int = 8) -> DataFrame:
    return terms.where("rising").orderBy(F.desc("cnt"), "keyword").limit(limit)


def weight_steps(terms: DataFrame) -> DataFrame:
    """Cloud terms with their size step; lowest and highest count are those of the chosen terms."""
    bounds = terms.agg(F.min("cnt").alias("low"), F.max("cnt").alias("high"))
    return terms.crossJoin(bounds).select("keyword", "cnt", weight_step(F.col("cnt"), F.col("low"), F.col("high")).alias("step"))


def stats(items: DataFrame, keywords: DataFrame, sources: DataFrame, rules: Rules, span: Span) -> DataFrame:
    """One row; items and sources count whether or not they have keywords."""
    own = items.where(span.contains(F.col("published_at")))
    totals = own.agg(F.countDistinct("item_id").alias("item_count"), F.countDistinct("source_id").alias("source_count"))
    words = keyword_counts(items, keywords, rules, span).agg(
        F.count(F.lit(1)).alias("keyword_count"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("mention_count"), F.min_by("keyword", F.struct(-F.col("cnt"), "keyword")).alias("top_keyword")
    )
    best = top_sources(items, sources, span, 1).agg(F.first("name").alias("top_source"))
    return totals.crossJoin(words).crossJoin(best)


def top_sources(items: DataFrame, sources: DataFrame, span: Span, limit: int = 10) -> DataFrame:
    """source_id, name (the id where unknown), kind, n; most items first, then by id."""
    own = items.where(span.contains(F.col("published_at"))).groupBy("source_id").agg(F.countDistinct("item_id").alias("n"), F.min("kind").alias("item_kind"))
    named = own.join(sources.select("source_id", "name", "kind"), "source_id", "left")
    return (
        named.select("source_id", F.coalesce("name", F.col("source_id").cast("string")).alias("name"), F.coalesce("kind", "item_kind").alias("kind"), "n")
        .orderBy(F.desc("n"), "source_id")
        .limit(limit)
    )


def latest_items(items: DataFrame, sources: DataFrame, limit: int = 10, since: Column | None = None) -> DataFrame:
    """Newest first; no upper bound, so future items count.  The limit runs before the join."""
    own = items if since is None else items.where(F.col("published_at") >= since)
    newest = own.orderBy(F.desc("published_at"), F.desc("item_id")).limit(limit)
    return newest.join(sources.select("source_id", "name"), "source_id", "left").select(
        "item_id", "source_id", F.coalesce("name", F.col("source_id").cast("string")).alias("source_name"), newest["kind"], "published_at"
    )


def last_contributed(items: DataFrame) -> DataFrame:
    return items.groupBy("source_id").agg(F.max("published_at").alias("last_at"))


def item_tags(ids: DataFrame, keywords: DataFrame, rules: Rules) -> DataFrame:
    """item_id, tags: sorted distinct canonical keywords; an empty array where there are none."""
    own = ids.select("item_id").distinct()
    wanted = keywords.select("item_id", "keyword").join(own, "item_id", "left_semi")  # only these are canonicalised and grouped
    tags = canonical(wanted, rules).groupBy("item_id").agg(F.sort_array(F.collect_set("keyword")).alias("tags"))
    return own.join(tags, "item_id", "left").select("item_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def category_item_count(items: DataFrame, sources: DataFrame, groups: DataFrame, span: Span) -> DataFrame:
    own = items.where(span.contains(F.col("published_at")))
    return in_category(own, sources, groups).groupBy("category").agg(F.countDistinct("item_id").alias("item_count"))


def keyword_detail(items: DataFrame, keywords: DataFrame, rules: Rules, span: Span, min_mentions: int = 3) -> DataFrame:
    """keyword, cnt, sources of keywords with at least ``min_mentions`` items."""
    return (
        mentions(items, keywords, rules, span).groupBy("keyword")
        .agg(F.countDistinct("item_id").alias("cnt"), F.countDistinct("source_id").alias("sources")).where(F.col("cnt") >= min_mentions)
    )


def timeline(items: DataFrame, keywords: DataFrame, rules: Rules, span: Span, min_mentions: int = 3, zone: str = ZONE) -> DataFrame:
    """keyword, counts: one count of distinct items for each local day of the span, zeros included."""
    from tidewheel.functions.timewin import local_date

    first = F.lit(local_date(span.start, zone))
    daily = (
        mentions(items, keywords, rules, span).select("keyword", "item_id", F.datediff(local_date_column(F.col("published_at"), zone), first).alias("d")).distinct()
        .groupBy("keyword", "d").agg(F.count(F.lit(1)).alias("n"))
    )
    by_day = daily.groupBy("keyword").agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("m"), F.sum("n").alias("total")).where(F.col("total") >= min_mentions)
    spine = F.sequence(F.lit(0), F.lit(span.days - 1))
    return by_day.select("keyword", F.transform(spine, lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0).cast("long"))).alias("counts"))


def cooccurrence(items: DataFrame, keywords: DataFrame, rules: Rules, span: Span, limit: int = 10, min_mentions: int = 3) -> DataFrame:
    """keyword, other, n: the partners most often on the same items; the threshold isn't asked of a partner.

    The self-join is spelled as an array per item, so the facts are shuffled once by item.
    """
    tags = mentions(items, keywords, rules, span).groupBy("item_id").agg(F.sort_array(F.collect_set("keyword")).alias("tags"))
    pairs = tags.select("tags", F.explode("tags").alias("keyword")).select("keyword", F.explode("tags").alias("other"))
    counted = pairs.groupBy("keyword", "other").agg(F.count(F.lit(1)).alias("n"))
    # a keyword paired with itself carries its own count
    both = counted.select("*", F.max(F.when(F.col("keyword") == F.col("other"), F.col("n"))).over(Window.partitionBy("keyword")).alias("own"))
    ranked = both.where((F.col("own") >= min_mentions) & (F.col("keyword") != F.col("other"))).withColumn(
        "rn", F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("n"), "other"))
    )
    return ranked.where(F.col("rn") <= limit).select("keyword", "other", "n", "rn")


def latest_by_kind(
    items: DataFrame, keywords: DataFrame, rules: Rules, span: Span, limit: int = 5, by: tuple[str, ...] = ("keyword", "kind"), only: DataFrame | None = None
) -> DataFrame:
    """The newest ``limit`` items of each keyword and kind, of the combinations in ``only`` if that is given."""
    found = mentions(items, keywords, rules, span).select(*by, "item_id", "published_at")
    once = (found if only is None else found.join(only.select(*by), list(by), "left_semi")).distinct()
    ranked = once.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("published_at"), F.desc("item_id"))))
    return ranked.where(F.col("rn") <= limit)


def coverage(sources: DataFrame, items: DataFrame, now: Column, quiet_after: int = 30) -> DataFrame:
    """Configured sources with the age of their last item and whether they went quiet."""
    from tidewheel.functions.timewin import recency_days, recency_label

    joined = sources.join(last_contributed(items), "source_id", "left")
    days = recency_days(F.col("last_at"), now)
    return joined.select("source_id", "name", "enabled", days.alias("days"), recency_label(days).alias("label"), (F.col("enabled") & (days.isNull() | (days >= quiet_after))).alias("quiet"))


def coverage_rollup(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.sort_array(F.collect_list(F.when(F.col("quiet"), F.col("name")))).alias("quiet_names"), F.count_if("quiet").alias("quiet_count"), F.count_if("enabled").alias("live_count")
    )


# items browser
def numbered(items: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """A global row number without one task for all rows.

    Rows are range-partitioned by ``order`` (a total order), counted by partition, and numbered within; the range partitioning is materialised
    first, since its sampled bounds must be the same for both uses.
    """
    from tidewheel.session import cut

    spread = cut(items.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}))
    counts = spread.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    low = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    return spread.join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + low + 1).drop("__p", "__i", "__before")  # one row a partition


def pages(items: DataFrame, per_page: int = 20) -> DataFrame:
    """Items newest first with page, place on the page and total pages."""
    order = [F.desc("published_at"), F.desc("item_id")]
    rows = numbered(items, order)
    total = items.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / per_page)).cast("long").alias("total_pages"))
    page = F.floor((F.col("rn") - 1) / per_page) + 1
    return rows.crossJoin(total).withColumns({"page": page, "place": (F.col("rn") - 1) % per_page + 1}).withColumns(
        {"has_prev": F.col("page") > 1, "has_next": F.col("page") < F.col("total_pages")}
    )


def page_index(items: DataFrame, per_page: int = 20) -> DataFrame:
    """page, total_pages, items, has_prev, has_next of every page; without items there is one page, which is empty."""
    count = items.agg(F.count(F.lit(1)).alias("n")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("n") / per_page)).cast("long"))
    rows = count.select("n", "total_pages", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total_pages"))).alias("page"))
    left = F.least(F.lit(per_page).cast("long"), F.col("n") - (F.col("page") - 1) * per_page)
    return rows.select("page", "total_pages", left.alias("items"), (F.col("page") > 1).alias("has_prev"), (F.col("page") < F.col("total_pages")).alias("has_next"))


def facets(page_items: DataFrame) -> DataFrame:
    """Distinct sorted kinds, sources and keywords of each page (items with ``tags``)."""
    return page_items.groupBy("page").agg(
        F.sort_array(F.collect_set("kind")).alias("kinds"),
        F.sort_array(F.collect_set("source_id")).alias("sources"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("keywords"),
    )
