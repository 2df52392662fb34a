"""Keyword rules: aliases (one hop), mutes on the canonical form, pins."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.text import normalize_keyword


@dataclass(frozen=True)
class Rules:
    aliases: dict[str, str] = field(default_factory=dict)
    mute: tuple[str, ...] = ()
    pin: tuple[str, ...] = ()


def canonical(rows: DataFrame, rules: Rules, column: str = "keyword") -> DataFrame:
    """``column`` normalised, then its alias if there is one; rows whose canonical keyword is muted go.

    Rules are joined as small tables, whose size Spark knows.  A mute on the text of an alias doesn't touch what it stands for, and a pin is never resolved.
    """
    out = rows.withColumn(column, normalize_keyword(F.col(column)))
    spark = rows.sparkSession
    if rules.aliases:
        names = spark.createDataFrame(pa.table({column: list(rules.aliases), "__canonical": list(rules.aliases.values())}))
        out = out.join(names, column, "left").withColumn(column, F.coalesce("__canonical", column)).drop("__canonical")
    if rules.mute:
        out = out.join(spark.createDataFrame(pa.table({column: list(rules.mute)})), column, "left_anti")
    return out


def pinned(keyword: Column, rules: Rules) -> Column:
    return keyword.isin(*rules.pin) if rules.pin else F.lit(False)
