"""Truth tables as date-partitioned Parquet, and DML on them as joins.

Each function gives the rows that a write would add or leave; ``Store`` writes them.  Rewrites touch only the date partitions that change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def first_wins(batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of each key the row that came first."""
    order = Window.partitionBy(*keys).orderBy(seq)
    return batch.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def absent(batch: DataFrame, truth: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The rows of a batch that an idempotent insert adds: first of their key and not there yet."""
    return first_wins(batch, keys, seq).join(truth.select(*keys), keys, "left_anti")


def upserted(truth: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Truth with the batch's rows over those of the same key."""
    return truth.join(batch.select(*keys), keys, "left_anti").unionByName(batch)


def rewritten(truth: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Truth with ``columns`` as in the matching change; unmatched changes are ignored."""
    marked = changes.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    joined = truth.join(marked, keys, "left")
    return joined.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in truth.columns))


def deleted(truth: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return truth.join(ids.select(*keys).distinct(), keys, "left_anti")


class Store:
    """Tables under a root folder, partitioned by ``dt``, the date that their timestamp text starts with."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        """The table, or no rows where it has never been written."""
        full = T.StructType([*schema.fields, T.StructField("dt", T.DateType())])
        try:
            return self.spark.read.schema(full).parquet(self.path(table))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], full)

    def append(self, table: str, rows: DataFrame, stamp: str) -> None:
        self._dated(rows, stamp).write.mode("append").partitionBy("dt").parquet(self.path(table))

    def insert(self, table: str, batch: DataFrame, schema: T.StructType, keys: list[str], stamp: str, seq: str) -> int:
        """Insert if absent; the number of rows written.  A run repeated adds nothing."""
        new = absent(batch, self.read(table, schema), keys, seq).select(*schema.fieldNames()).persist()
        try:
            self.append(table, new, stamp)
            return new.count()
        finally:
            new.unpersist()

    def replace_partitions(self, table: str, rows: DataFrame) -> None:
        """Overwrites the partitions that ``rows`` (with ``dt``) hold, and no other."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(self.path(table))

    def rewrite(self, table: str, schema: T.StructType, changes: DataFrame, keys: list[str], columns: list[str]) -> int:
        """``columns`` of the rows that ``changes`` names; the number of rows that match.  Rows stay in their partition, and only partitions with a match are written."""
        truth = self.read(table, schema)
        hit = truth.join(changes, keys, "left_semi")
        touched = {r["dt"]: r["n"] for r in hit.groupBy("dt").agg(F.count(F.lit(1)).alias("n")).collect()}
        if touched:
            staged = f"{self.root}/.staged-{table}"
            rewritten(truth.where(F.col("dt").isin(*touched)), changes, keys, columns).write.mode("overwrite").partitionBy("dt").parquet(staged)
            self.replace_partitions(table, self.spark.read.schema(truth.schema).parquet(staged))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return sum(touched.values())

    def delete(self, table: str, schema: T.StructType, ids: DataFrame, keys: list[str]) -> int:
        """Delete by key; partitions without a match aren't rewritten, emptied ones are removed."""
        truth = self.read(table, schema)
        touched = [r[0] for r in truth.join(ids, keys, "left_semi").select("dt").distinct().collect()]
        if not touched:
            return 0
        part = truth.where(F.col("dt").isin(*touched))
        left = deleted(part, ids, keys)
        n = part.count() - left.count()
        kept = [r[0] for r in left.select("dt").distinct().collect()]
        staged = f"{self.root}/.staged-{table}"
        left.write.mode("overwrite").partitionBy("dt").parquet(staged)
        if kept:
            self.replace_partitions(table, self.spark.read.schema(truth.schema).parquet(staged))
        jvm = self.spark._jvm
        fs_path = jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for day in set(touched) - set(kept):
            fs.delete(fs_path(f"{self.path(table)}/dt={day}"), True)
        fs.delete(fs_path(staged), True)
        return n

    @staticmethod
    def _dated(rows: DataFrame, stamp: str) -> DataFrame:
        at: Column = F.col(stamp)
        return rows.withColumn("dt", F.to_date(F.substring(at.cast("string"), 1, 10)))
