"""Digests: inputs of all categories and periods in one plan, what is due, and the text without a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.text import chips_json, digest_id, is_rising
from tidewheel.functions.timewin import Span
from tidewheel.operators import trends
from tidewheel.operators.extract import digest_reply
from tidewheel.operators.rules import Rules
from tidewheel.session import cut

DAILY_TOP, WEEKLY_TOP = 12, 20


def inputs(
    items: DataFrame, keywords: DataFrame, sources: DataFrame, groups: DataFrame, rules: Rules, now: Span, before: Span, top: int = DAILY_TOP, least: int = 3, ratio: float = 3.0
) -> DataFrame:
    """category, keyword, cnt, prev_cnt, rising, rn: the ``top`` keywords of every category."""
    star = trends.in_category(items, sources, groups)
    counts = trends.two_windows(star, keywords, rules, now, before, by=("category",))
    ranked = counts.withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("cnt"), "keyword"))).where(F.col("rn") <= top)
    return ranked.withColumn("rising", is_rising(F.col("cnt"), F.col("prev_cnt"), least, ratio)).select("category", "keyword", "cnt", "prev_cnt", "rising", "rn")


def top_items(items: DataFrame, keywords: DataFrame, sources: DataFrame, groups: DataFrame, rules: Rules, now: Span, chosen: DataFrame, limit: int = 3) -> DataFrame:
    """The newest items of each chosen (category, keyword), all at once rather than a query a keyword."""
    star = trends.in_category(items, sources, groups)
    return trends.latest_by_kind(star, keywords, rules, now, limit, by=("category", "keyword"), only=chosen)


def template(rows: DataFrame, counts: DataFrame, kind: str, key: str, min_items: int = 10) -> DataFrame:
    """Title, body and chips of each category with at least ``min_items`` items, from the ranked keywords alone."""
    ordered = F.sort_array(F.collect_list(F.struct("rn", "keyword", "cnt", "rising")))
    grouped = rows.groupBy("category").agg(ordered.alias("k"))
    joined = counts.where(F.col("item_count") >= min_items).join(grouped, "category", "left").withColumn("k", F.coalesce("k", F.expr("filter(array(named_struct('rn', 0, 'keyword', '', 'cnt', 0L, 'rising', false)), x -> false)")))

    def listed(a: Column) -> Column:
        return F.transform(a, lambda x: F.concat(x["keyword"], F.lit(" ("), x["cnt"].cast("string"), F.lit(")")))

    rising = F.transform(F.filter("k", lambda x: x["rising"]), lambda x: x["keyword"])
    lead = F.when(F.size(rising) > 0, F.concat(F.lit("Rising: "), F.array_join(rising, ", "), F.lit(". "))).otherwise(F.lit("No rising keywords this period. "))
    all_words = F.when(F.size("k") > 0, F.array_join(listed(F.col("k")), ", ")).otherwise(F.lit("none"))
    body = F.concat(lead, F.lit("Top keywords across "), F.col("item_count").cast("string"), F.lit(" items: "), all_words, F.lit("."))
    brief = F.array_join(F.transform(listed(F.slice("k", 1, 5)), lambda x: F.concat(F.lit("- "), x)), "\n")
    text = F.when(F.size("k") > 0, F.concat(F.lit("**TL;DR**\n\n"), brief, F.lit("\n\n"), body)).otherwise(body)
    return joined.select(
        digest_id(F.lit(kind), F.col("category"), F.lit(key)).alias("digest_id"), "category",
        F.concat(F.lit(f"{kind.capitalize()} "), F.col("category"), F.lit(f" digest - {key}")).alias("title"), text.alias("body_md"), chips_json(F.col("k")).alias("top_keywords"),
    )


def payloads(rows: DataFrame, counts: DataFrame, examples: DataFrame, kind: str, start: str, end: str, cap: int = 300) -> DataFrame:
    """(category, payload): the JSON that describes a category's period to a model.

    ``examples`` (category, keyword, rn, title, summary) are the items shown with a keyword; their summaries are cut to ``cap``.
    """
    shown = F.struct("title", F.substring(F.coalesce("summary", F.lit("")), 1, cap).alias("summary"))
    told = examples.groupBy("category", "keyword").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", shown.alias("x")))), lambda e: e["x"]).alias("examples"))
    none = F.array().cast("array<struct<title: string, summary: string>>")
    word = F.struct("keyword", F.col("cnt").alias("mentions"), "rising", F.coalesce("examples", none).alias("examples"))
    words = rows.join(told, ["category", "keyword"], "left").groupBy("category").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", word.alias("w")))), lambda k: k["w"]).alias("keywords"))
    whole = counts.join(words, "category")
    fields = (F.col("category"), F.lit(kind).alias("cadence"), F.lit(start).alias("period_start"), F.lit(end).alias("period_end"), F.col("item_count"), F.col("keywords"))
    return whole.select("category", F.to_json(F.struct(*fields)).alias("payload"))


def generate(
    rows: DataFrame, counts: DataFrame, asked: DataFrame, model: Callable[[str], str] | None, kind: str, key: str, min_items: int = 10, name: str = "model", version: str = "v1"
) -> DataFrame:
    """Digests of all categories with enough items: a model's where its reply is a valid digest, else the template's (``model`` is ``template`` then).

    ``asked`` (category, payload) is what the model is shown.
    """
    plain = template(rows, counts, kind, key, min_items)
    if model is None:
        return plain.withColumns({"model": F.lit("template"), "prompt_version": F.lit("none")})

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for category, payload in zip(*(c.to_pylist() for c in frame.columns)):
                try:
                    title, bullets, body = digest_reply(model(payload))
                except Exception:  # a model is foreign code, and a reply that is no digest counts as none
                    continue
                brief = "**TL;DR**\n\n" + "\n".join(f"- {b}" for b in bullets) + "\n\n" if bullets else ""
                yield pa.record_batch([pa.array([category]), pa.array([title]), pa.array([brief + body])], names=["category", "m_title", "m_body"])

    enough = asked.join(plain.select("category"), "category", "left_semi").select("category", "payload")
    told = cut(enough.repartition("category").mapInArrow(run, "category string, m_title string, m_body string"))
    by_model = F.col("m_title").isNotNull()
    return plain.join(told, "category", "left").select(
        "digest_id", "category", F.coalesce("m_title", "title").alias("title"), F.coalesce("m_body", "body_md").alias("body_md"), "top_keywords",
        F.when(by_model, F.lit(name)).otherwise(F.lit("template")).alias("model"), F.when(by_model, F.lit(version)).otherwise(F.lit("none")).alias("prompt_version"),
    )


def newest_first(digests: DataFrame, limit: int | None = None) -> DataFrame:
    """Digests by period, then by when they were made, the latest first; ``limit`` of them, or all."""
    ordered = digests.orderBy(F.desc("period_start"), F.desc("created_at"), F.desc("digest_id"))
    return ordered if limit is None else ordered.limit(limit)


def due(categories: DataFrame, periods: DataFrame, done: DataFrame, kind: str) -> DataFrame:
    """(category, key) pairs without a digest yet; one made from the template doesn't count as done."""
    pairs = categories.crossJoin(periods).withColumn("digest_id", digest_id(F.lit(kind), F.col("category"), F.col("key")))
    return pairs.join(done.where("model <> 'template'").select("digest_id"), "digest_id", "left_anti")


def latest_per_category(digests: DataFrame) -> DataFrame:
    order = F.struct("period_start", "created_at", "digest_id")
    return digests.groupBy("category").agg(F.max_by("digest_id", order).alias("digest_id"), F.max_by("period_start", order).alias("period_start"))


def all_done(categories: DataFrame, done: DataFrame) -> DataFrame:
    """One row: whether every category is done; true where there is none."""
    marked = categories.join(done.select("category", F.lit(True).alias("is_done")), "category", "left")
    return marked.agg(F.coalesce(F.bool_and(F.coalesce("is_done", F.lit(False))), F.lit(True)).alias("all_done"))
