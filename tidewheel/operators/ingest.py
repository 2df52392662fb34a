"""Raw items to items: projection, identity, cleaning and first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.text import blank_to_null, item_identity
from tidewheel.functions.udfs import clean_summary_udf, simhash_udf
from tidewheel.functions.urls import canonical_url_udf
from tidewheel.operators import store


def normalize(raw: DataFrame, fetched_at: Column) -> DataFrame:
    """Items of raw items (with source_id and kind); an empty ``published_at`` falls back to ``fetched_at`` like a missing one."""
    lean = raw.select("source_id", "kind", blank_to_null(F.col("external_id")).alias("external_id"), canonical_url_udf("url").alias("canonical_url"), "title", "summary", "author", "published_at", "lang")
    stamped = fetched_at.cast("string")
    return lean.select(
        item_identity(F.col("kind"), F.col("canonical_url"), F.col("external_id")).alias("item_id"), "source_id", "kind", "external_id", "canonical_url", "title",
        clean_summary_udf("summary").alias("summary"), "author", F.coalesce(F.nullif("published_at", F.lit("")), stamped).alias("published_at"), stamped.alias("fetched_at"),
        simhash_udf("title").alias("content_hash"), F.lit(None).cast("string").alias("transcript_ref"), "lang",
    )


def new_items(raw: DataFrame, truth: DataFrame, fetched_at: Column, seq: str = "seq", cap: int = 50) -> DataFrame:
    """What an ingest adds: at most ``cap`` of a source in feed order, normalised, first of its identity, not there yet."""
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(seq))
    capped = raw.withColumn("__place", place).where(F.col("__place") <= cap)
    with_seq = normalize_with(capped, fetched_at, seq)
    return store.absent(with_seq, truth, ["item_id"], seq).drop(seq)


def normalize_with(raw: DataFrame, fetched_at: Column, keep: str) -> DataFrame:
    """``normalize`` that carries one column of the raw rows along."""
    packed = raw.withColumn("lang", F.struct("lang", keep))
    out = normalize(packed, fetched_at)
    return out.withColumn(keep, F.col(f"lang.{keep}")).withColumn("lang", F.col("lang.lang"))


def renormalized(items: DataFrame) -> DataFrame:
    """Items whose stored summary cleaning would change, with the new one; null summaries stay."""
    fresh = items.withColumn("__new", clean_summary_udf("summary"))
    return fresh.where(F.col("summary") != F.col("__new")).select("item_id", F.col("__new").alias("summary"))
