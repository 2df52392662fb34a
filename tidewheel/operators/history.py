"""Fetch history: health rollups, streaks, cadence, lifecycle proposals, run summaries.

``log``: source_id, seq (append order), started_at, status (ok, empty, error, skipped), items_new, error, duration_ms, rung, resolved_url.
Skipped rows are no attempts.  Everything is one shuffle by source: the streak too, since it is the number of failures after the last success.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.text import deep_link, error_class

FLAG_FROM = 5
DEAD_FROM = 16
LIVE = ("active", "degraded")


def attempts(log: DataFrame) -> DataFrame:
    return log.where(F.col("status") != "skipped")


def health(log: DataFrame, quiet: Column | None = None) -> DataFrame:
    """One row of rollups per source with at least one attempt; ``quiet`` (of source_id) sources are never flagged."""
    order = F.struct("started_at", "seq")
    good, failed = F.col("status").isin("ok", "empty"), F.col("status") == "error"
    # the window and the aggregation share one shuffle by source
    rows = attempts(log).withColumn("__good", F.max(F.when(good, order)).over(Window.partitionBy("source_id")))
    since = failed & (F.col("__good").isNull() | (order > F.col("__good")))
    found = rows.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("status") == "ok").alias("ok_attempts"),
        F.count_if(F.col("status") == "empty").alias("empty_attempts"),
        F.count_if(failed).alias("failed_attempts"),
        F.count_if(good).alias("successful_attempts"),
        F.max_by("status", order).alias("last_status"),
        F.max("started_at").alias("last_started_at"),
        F.max("__good.started_at").alias("last_successful_at"),
        F.max(F.when(failed, F.col("started_at"))).alias("last_failed_at"),
        F.max(F.when(failed, F.struct("started_at", "seq", "error")))["error"].alias("last_error"),
        F.max_by("rung", order).alias("last_rung"),
        F.max_by("resolved_url", order).alias("last_resolved_url"),
        F.coalesce(F.sum("items_new"), F.lit(0)).alias("total_items_new"),
        F.max_by("items_new", order).alias("latest_items_new"),
        F.count_if(since).alias("consecutive_failures"),
    )
    flagged = F.col("consecutive_failures") >= FLAG_FROM
    return found.select("*", error_class(F.col("last_error")).alias("error_class"), (flagged & ~quiet if quiet is not None else flagged).alias("flagged"))


def last_attempt(log: DataFrame) -> DataFrame:
    """source_id, last_at: of the last attempt by time, whatever order the log was appended in."""
    return attempts(log).groupBy("source_id").agg(F.max("started_at").alias("last_at"))


def cadence(sources: DataFrame, log: DataFrame, now: Column, hours: Column) -> DataFrame:
    """Sources with ``due``: no interval, no attempt yet, or the interval (inclusive) is over.  ``hours`` may look at all source columns."""
    joined = sources.join(last_attempt(log), "source_id", "left").withColumn("hours", hours)
    elapsed = F.unix_micros(now) - F.unix_micros(F.col("last_at").cast("timestamp"))
    due = (F.col("hours") <= 0) | F.col("last_at").isNull() | (elapsed >= F.col("hours").cast("long") * 3_600_000_000)
    return joined.withColumn("due", due)


def fetch_results(decided: DataFrame, fetched: DataFrame, run_id: str, at: Column) -> DataFrame:
    """Log rows of a run: a row ``skipped`` for each source that isn't due, and one for each that was fetched.

    ``decided`` is that of ``cadence``, ``fetched`` has source_id, status, items_new, error, rung and resolved_url.
    """
    columns = ["source_id", "status", "items_new", "error", "rung", "resolved_url"]
    none = F.lit(None).cast("string")
    skipped = decided.where(~F.col("due")).select("source_id", F.lit("skipped").alias("status"), F.lit(0).cast(fetched.schema["items_new"].dataType).alias("items_new"), *(none.alias(c) for c in columns[3:]))
    both = skipped.unionByName(fetched.join(decided.where("due").select("source_id"), "source_id", "left_semi").select(*columns))
    return both.withColumns({"run_id": F.lit(run_id), "started_at": at})


def fetchable(sources: DataFrame, groups: DataFrame) -> DataFrame:
    """Of enabled groups: enabled sources, and dead ones that have evidence to re-check."""
    open_groups = groups.where("enabled").select("group_id")
    return sources.where(F.col("enabled") | ((F.col("status") == "dead") & F.col("evidence").isNotNull())).join(open_groups, "group_id", "left_semi")


def proposal(status: Column, last_status: Column, rung: Column, error: Column, streak: Column, quiet: Column) -> tuple[Column, Column]:
    """(proposed status, reason), both null where nothing should change."""
    served = last_status.isin("ok", "empty")
    fallback = rung.isNotNull() & (rung != "direct")
    via = F.coalesce(rung, F.lit("direct"))
    may_fall = ~quiet & (last_status == "error") & status.isin(*LIVE)
    gone = F.coalesce(error.contains("404") | error.contains("410"), F.lit(False))
    paid = F.coalesce(error.contains("402"), F.lit(False))
    cases = [
        (served & (status == "degraded") & ~fallback, F.lit("active"), F.lit("direct feed serves again")),
        (served & (status == "active") & fallback, F.lit("degraded"), F.concat(F.lit("served by fallback "), via)),
        (served & (status == "dead"), F.when(fallback, F.lit("degraded")).otherwise(F.lit("active")), F.concat(F.lit("re-check served by "), via)),
        (may_fall & paid, F.lit("paywalled"), F.lit("HTTP 402, to be confirmed")),
        (may_fall & (streak >= DEAD_FROM) & gone, F.lit("gone"), F.concat(streak.cast("string"), F.lit(" failures in a row, target is gone"))),
        (may_fall & (streak >= DEAD_FROM), F.lit("dead"), F.concat(streak.cast("string"), F.lit(" failures in a row"))),
    ]
    new, why = F.lit(None).cast("string"), F.lit(None).cast("string")
    for when, to, reason in reversed(cases):
        new, why = F.when(when, to).otherwise(new), F.when(when, reason).otherwise(why)
    return new, why


def doctor(sources: DataFrame, health_rows: DataFrame, quiet: Column | None = None) -> DataFrame:
    """All configured sources with what their history proposes."""
    joined = sources.select("source_id", "kind", "group_id", "enabled", "status").join(
        health_rows.select("source_id", "last_status", "last_rung", "error_class", "consecutive_failures", "flagged", "last_error"), "source_id", "left"
    )
    new, why = proposal(F.col("status"), F.col("last_status"), F.col("last_rung"), F.col("last_error"), F.col("consecutive_failures"), quiet if quiet is not None else F.lit(False))
    return joined.select(
        "source_id", "kind", "group_id", "enabled", "status", "last_status", "last_rung", "error_class",
        F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"), F.coalesce("flagged", F.lit(False)).alias("flagged"), "last_error",
        new.alias("proposed_status"), why.alias("reason"),
    )


def health_view(sources: DataFrame, health_rows: DataFrame) -> DataFrame:
    """Configured sources with ``section`` live or disabled, and a link to the items of live ones; rows of unknown sources go."""
    live = F.col("status").isin(*LIVE)
    joined = sources.join(health_rows.select("source_id", "attempts", "consecutive_failures", "last_status"), "source_id", "left")
    return joined.select(
        "source_id", "name", F.when(live, F.lit("live")).otherwise(F.lit("disabled")).alias("section"), deep_link(F.col("source_id").cast("string"), live).alias("items_href"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"), "last_status",
    )


def run_summary(log: DataFrame, run: Column) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return log.groupBy(run.alias("run")).agg(
        F.count(F.lit(1)).alias("sources"), count("ok").alias("ok"), count("empty").alias("empty"), count("error").alias("failed"), count("skipped").alias("skipped"),
        F.coalesce(F.sum("items_new"), F.lit(0)).alias("items_new"),
    )


def tallies(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("sources"), F.count_if("flagged").alias("flagged"), F.count_if(F.col("proposed_status").isNotNull()).alias("proposed"))
