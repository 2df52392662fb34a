"""The driver's tables seen as the domain tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.timewin import preceding, trailing
from tidewheel.operators.rules import Rules

INSTANT = datetime(1998, 7, 8, 13, tzinfo=UTC)
WEEK = trailing(INSTANT, 7)
BEFORE_WEEK = preceding(WEEK)
MONTH = trailing(INSTANT, 30)
LOG_NOW = datetime(2024, 1, 31, 12, tzinfo=UTC)
RULES = Rules(aliases={"hot rod": "rod", "red ring": "blue ring"}, mute=("cold gear",), pin=("small widget", "blue anvil"))


class Tables:
    """Lazy domain views of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def items(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("kind"),
            F.col("o_orderdate").cast("timestamp").alias("published_at"),
        )

    @property
    def keywords(self) -> DataFrame:
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_linestatus")
        return lines.join(self.raw("part").select("p_partkey", "p_name"), lines["l_partkey"] == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("item_id"), F.col("p_name").alias("keyword"), F.col("l_linenumber").alias("rank"),
            F.when(F.col("l_linestatus") == "O", F.lit("llm")).otherwise(F.lit("fallback")).alias("method"),
        )

    @property
    def sources(self) -> DataFrame:
        turn = F.col("c_custkey") % 20
        status = F.when(turn == 0, F.lit("dead")).when(turn == 1, F.lit("degraded")).when(turn == 10, F.lit("paywalled")).otherwise(F.lit("active"))
        return self.raw("customer").select(
            F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("group_id"),
            status.alias("status"), status.isin("active", "degraded").alias("enabled"), F.when(turn == 0, F.lit("seen down")).alias("evidence"),
        )

    @property
    def groups(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("group_id"), F.col("r_name").alias("category"), (F.col("n_nationkey") % 7 != 0).alias("enabled"))

    @property
    def log(self) -> DataFrame:
        kind = F.col("event_type")
        status = F.when(kind == "error", F.lit("error")).when(kind == "view", F.lit("skipped")).when(kind == "signup", F.lit("empty")).otherwise(F.lit("ok"))
        turn = F.col("event_id") % 5
        text = F.when(turn == 0, F.lit("HTTP 404")).when(turn == 1, F.lit("HTTP 503")).when(turn == 2, F.lit("SSL handshake")).when(turn == 3, F.lit("read timed out")).otherwise(F.lit("odd HTTP 301"))
        return self.raw("events").select(
            F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("started_at"), status.alias("status"),
            F.when(status == "ok", F.col("event_id") % 7).otherwise(F.lit(0)).alias("items_new"), F.when(status == "error", text).alias("error"),
            F.when(F.col("event_id") % 3 == 0, F.lit("alt_endpoint")).otherwise(F.lit("direct")).alias("rung"), F.lit(None).cast("string").alias("resolved_url"),
        )


#: The same views for DuckDB.
VIEWS = {
    "items": "SELECT o_orderkey AS item_id, o_custkey AS source_id, o_orderpriority AS kind, o_orderdate AS published_at FROM orders",
    "keywords": "SELECT l_orderkey AS item_id, p_name AS keyword, l_linenumber AS rank, CASE WHEN l_linestatus = 'O' THEN 'llm' ELSE 'fallback' END AS method FROM lineitem JOIN part ON l_partkey = p_partkey",
    "sources": """SELECT *, status IN ('active', 'degraded') AS enabled FROM (SELECT c_custkey AS source_id, c_name AS name, lower(c_mktsegment) AS kind, c_nationkey AS group_id,
      CASE c_custkey % 20 WHEN 0 THEN 'dead' WHEN 1 THEN 'degraded' WHEN 10 THEN 'paywalled' ELSE 'active' END AS status, CASE WHEN c_custkey % 20 = 0 THEN 'seen down' END AS evidence FROM customer)""",
    "groups": "SELECT n_nationkey AS group_id, r_name AS category, n_nationkey % 7 <> 0 AS enabled FROM nation JOIN region ON n_regionkey = r_regionkey",
    "log": """SELECT source_id, seq, started_at, status, CASE WHEN status = 'ok' THEN seq % 7 ELSE 0 END AS items_new,
      CASE WHEN status = 'error' THEN CASE seq % 5 WHEN 0 THEN 'HTTP 404' WHEN 1 THEN 'HTTP 503' WHEN 2 THEN 'SSL handshake' WHEN 3 THEN 'read timed out' ELSE 'odd HTTP 301' END END AS error,
      CASE WHEN seq % 3 = 0 THEN 'alt_endpoint' ELSE 'direct' END AS rung
      FROM (SELECT user_id AS source_id, event_id AS seq, ts AS started_at, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'skipped' WHEN 'signup' THEN 'empty' ELSE 'ok' END AS status FROM events)""",
    "canon": """SELECT * FROM (SELECT item_id, source_id, kind, published_at, CASE k WHEN 'hot rod' THEN 'rod' WHEN 'red ring' THEN 'blue ring' ELSE k END AS keyword FROM (
      SELECT i.*, regexp_replace(lower(regexp_replace(trim(w.keyword), '\\s+', ' ', 'g')), '[.,;:!?''"]+$', '') AS k FROM items i JOIN keywords w USING (item_id))) WHERE keyword <> 'cold gear'""",
    "star": "SELECT s.source_id, g.category, g.enabled FROM sources s JOIN groups g USING (group_id)",
    "counts": """SELECT keyword, count(DISTINCT CASE WHEN published_at >= TIMESTAMP '1998-07-01 06:00:00' THEN item_id END) AS cnt,
      count(DISTINCT CASE WHEN published_at < TIMESTAMP '1998-07-01 06:00:00' THEN item_id END) AS prev_cnt
      FROM canon WHERE published_at >= TIMESTAMP '1998-06-24 06:00:00' AND published_at < TIMESTAMP '1998-07-08 06:00:00' GROUP BY keyword""",
    "cloud": """SELECT keyword, cnt, prev_cnt, cnt - prev_cnt AS delta, cnt >= 3 AND (prev_cnt = 0 OR cnt::DOUBLE / prev_cnt >= 3.0) AS rising FROM (
      SELECT *, row_number() OVER (ORDER BY cnt DESC, keyword) AS rn FROM counts WHERE cnt > 0) WHERE rn <= 20 OR keyword IN ('small widget', 'blue anvil')""",
    "attempts": "SELECT * FROM log WHERE status <> 'skipped'",
    "health": """SELECT source_id, count(*) AS attempts, count(*) FILTER (status = 'ok') AS ok_attempts, count(*) FILTER (status = 'empty') AS empty_attempts,
      count(*) FILTER (status = 'error') AS failed_attempts, count(*) FILTER (status IN ('ok', 'empty')) AS successful_attempts, arg_max(status, (started_at, seq)) AS last_status,
      max(started_at) AS last_started_at, max(started_at) FILTER (status IN ('ok', 'empty')) AS last_successful_at, max(started_at) FILTER (status = 'error') AS last_failed_at,
      arg_max(error, (started_at, seq)) FILTER (status = 'error') AS last_error, arg_max(rung, (started_at, seq)) AS last_rung, sum(items_new)::BIGINT AS total_items_new, arg_max(items_new, (started_at, seq)) AS latest_items_new,
      count(*) FILTER (status = 'error' AND (good IS NULL OR (started_at, seq) > good)) AS consecutive_failures
      FROM (SELECT *, max(CASE WHEN status IN ('ok', 'empty') THEN (started_at, seq) END) OVER (PARTITION BY source_id) AS good FROM attempts) GROUP BY source_id""",
    "health_rows": """SELECT *, consecutive_failures >= 5 AS flagged, CASE WHEN last_error IS NULL THEN NULL WHEN last_error = 'HTTP 404' THEN 'http_4xx' WHEN last_error = 'HTTP 503' THEN 'http_5xx'
      WHEN last_error = 'SSL handshake' THEN 'tls' WHEN last_error = 'read timed out' THEN 'connection' ELSE 'other' END AS error_class FROM health""",
    "last_items": "SELECT source_id, max(published_at) AS last_at FROM items GROUP BY source_id",
    "coverage": """SELECT source_id, name, enabled, days, CASE WHEN days IS NULL THEN 'never' WHEN days = 0 THEN 'today' WHEN days = 1 THEN '1 day ago' ELSE days || ' days ago' END AS label,
      enabled AND (days IS NULL OR days >= 30) AS quiet FROM (SELECT s.*, greatest(date_diff('day', last_at::DATE, DATE '1998-07-08'), 0)::INTEGER AS days FROM sources s LEFT JOIN last_items USING (source_id))""",
    "tags": "SELECT item_id, list_sort(list(DISTINCT keyword)) AS tags FROM canon GROUP BY item_id",
    "paged": """SELECT *, CAST((rn - 1) // 20 + 1 AS BIGINT) AS page, CAST((rn - 1) % 20 + 1 AS BIGINT) AS place FROM (
      SELECT i.*, row_number() OVER (ORDER BY published_at DESC, item_id DESC) AS rn FROM items i WHERE published_at >= TIMESTAMP '1998-04-09 13:00:00' AND published_at < TIMESTAMP '1998-07-08 13:00:00')""",
    "digest_rows": """SELECT category, keyword, cnt, prev_cnt, cnt >= 3 AND (prev_cnt = 0 OR cnt::DOUBLE / prev_cnt >= 3.0) AS rising, rn::INTEGER AS rn FROM (
      SELECT *, row_number() OVER (PARTITION BY category ORDER BY cnt DESC, keyword) AS rn FROM (
        SELECT category, keyword, count(DISTINCT CASE WHEN published_at >= TIMESTAMP '1998-07-01 06:00:00' THEN item_id END) AS cnt,
          count(DISTINCT CASE WHEN published_at < TIMESTAMP '1998-07-01 06:00:00' THEN item_id END) AS prev_cnt
        FROM canon JOIN star USING (source_id) WHERE published_at >= TIMESTAMP '1998-06-24 06:00:00' AND published_at < TIMESTAMP '1998-07-08 06:00:00' GROUP BY 1, 2) WHERE cnt > 0) WHERE rn <= 12""",
    "category_counts": """SELECT category, count(DISTINCT item_id) AS item_count FROM items JOIN star USING (source_id)
      WHERE published_at >= TIMESTAMP '1998-07-01 06:00:00' AND published_at < TIMESTAMP '1998-07-08 06:00:00' GROUP BY category""",
}


def sql(body: str) -> str:
    """``body`` with the views it needs, directly or through others, in front."""
    import re

    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    return ("WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed) + "\n" if needed else "") + body
