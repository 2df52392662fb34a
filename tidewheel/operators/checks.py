"""Constraint checks: each gives the violating rows; ``require`` turns them into an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("rss", "youtube", "reddit")


def duplicate_keys(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(check, key, n): keys that occur more than once; a key with a null is no key."""
    whole = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return whole.select(F.lit(name).alias("check"), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("key"), "n")


def long_keywords(keywords: DataFrame, limit: int = 60) -> DataFrame:
    return keywords.where(F.length("keyword") > limit).groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).select(F.lit("keyword_length").alias("check"), F.col("keyword").alias("key"), "n")


def not_in(df: DataFrame, column: str, allowed: tuple[str, ...], name: str) -> DataFrame:
    bad = df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed))
    return bad.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "key", "n")


def unserved_kinds(sources: DataFrame, groups: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Enabled (as configured, whatever the status) sources of enabled groups whose kind no reader serves."""
    own = sources.where("enabled").join(groups.where("enabled").select("group_id"), "group_id", "left_semi")
    return not_in(own, "kind", kinds, "unserved_kind")


def orphans(df: DataFrame, column: str, parents: DataFrame, key: str, name: str) -> DataFrame:
    """(check, key, n): values without a parent; a null has none to miss."""
    lost = df.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")
    return lost.groupBy(F.col(column).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "key", "n")


#: Keys of the cached tables.
KEYS = {
    "source_groups": ["group_id"], "sources": ["source_id"], "items": ["item_id"], "item_keywords": ["item_id", "keyword", "method"], "digests": ["digest_id"], "keyword_aliases": ["alias"],
}


def cache_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """What would keep the tables from being cached: repeated keys, and keywords of items that aren't there."""
    parts = [duplicate_keys(df, KEYS[name], f"{name}_pk") for name, df in sorted(tables.items()) if name in KEYS]
    if {"items", "item_keywords"} <= set(tables):
        parts.append(orphans(tables["item_keywords"], "item_id", tables["items"], "item_id", "item_keywords_fk"))
    return violations(*parts)


def rebuild_cache(tables: dict[str, DataFrame], prefix: str = "") -> dict[str, int]:
    """Checks the tables, then names a view for each; rows by table.  A violation raises, and no view changes then."""
    require(cache_violations(tables))
    counts = {name: df.count() for name, df in tables.items()}
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    return counts


def open_cache(spark: SparkSession, names: list[str], prefix: str = "") -> dict[str, DataFrame]:
    """The tables behind the views of ``rebuild_cache``."""
    return {name: spark.table(prefix + name) for name in names}


def violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require(found: DataFrame) -> None:
    """Raises with the first violations, of which there may be many."""
    rows = found.orderBy("check", "key").take(20)
    if rows:
        raise ValueError("; ".join(f"{r['check']}: {r['key']} ({r['n']})" for r in rows))
