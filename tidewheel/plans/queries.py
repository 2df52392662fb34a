"""Queries of the operators over the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions import text, timewin, udfs, urls
from tidewheel.operators import checks, digest, extract, history, neardup, store, trends
from tidewheel.operators.rules import canonical
from tidewheel.plans.adapters import BEFORE_WEEK, INSTANT, LOG_NOW, MONTH, RULES, WEEK, Tables, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WEEK_SQL = "published_at >= TIMESTAMP '1998-07-01 06:00:00' AND published_at < TIMESTAMP '1998-07-08 06:00:00'"
MONTH_SQL = "published_at >= TIMESTAMP '1998-06-08 06:00:00' AND published_at < TIMESTAMP '1998-07-08 06:00:00'"


def query(oracle: str | None = None) -> Callable:
    """Registers f(tables) under its name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return register


def stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def shown(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# trends
@query("SELECT * FROM cloud")
def keyword_cloud(t: Tables) -> DataFrame:
    return trends.cloud(t.items, t.keywords, RULES, WEEK, BEFORE_WEEK, limit=20)


@query(f"SELECT keyword, count(DISTINCT item_id) AS cnt FROM canon JOIN star USING (source_id) WHERE category = 'ASIA' AND {WEEK_SQL} GROUP BY keyword")
def keyword_counts_category(t: Tables) -> DataFrame:
    own = trends.in_category(t.items, t.sources, t.groups).where("category = 'ASIA'")
    return trends.keyword_counts(own, t.keywords, RULES, WEEK)


@query(f"""SELECT (SELECT count(DISTINCT item_id) FROM items WHERE {WEEK_SQL}) AS item_count, (SELECT count(DISTINCT source_id) FROM items WHERE {WEEK_SQL}) AS source_count,
  (SELECT count(*) FROM counts WHERE cnt > 0) AS keyword_count, (SELECT sum(cnt)::BIGINT FROM counts) AS mention_count, (SELECT keyword FROM counts ORDER BY cnt DESC, keyword LIMIT 1) AS top_keyword,
  (SELECT name FROM (SELECT source_id, count(DISTINCT item_id) n FROM items WHERE {WEEK_SQL} GROUP BY 1) JOIN sources USING (source_id) ORDER BY n DESC, source_id LIMIT 1) AS top_source""")  # fmt: skip
def trend_stats(t: Tables) -> DataFrame:
    return trends.stats(t.items, t.keywords, t.sources, RULES, WEEK)


@query(f"""SELECT source_id, coalesce(name, source_id::VARCHAR) AS name, coalesce(s.kind, k) AS kind, n FROM (
  SELECT source_id, count(DISTINCT item_id) AS n, min(kind) AS k FROM items WHERE {MONTH_SQL} GROUP BY 1) LEFT JOIN sources s USING (source_id) ORDER BY n DESC, source_id LIMIT 10""")
def top_sources(t: Tables) -> DataFrame:
    return trends.top_sources(t.items, t.sources, MONTH)


@query(f"""SELECT item_id, source_id, coalesce(name, source_id::VARCHAR) AS source_name, i.kind, {stamp('published_at')} AS published_at FROM items i LEFT JOIN sources s USING (source_id)
  ORDER BY i.published_at DESC, item_id DESC LIMIT 10""")
def latest_items(t: Tables) -> DataFrame:
    found = trends.latest_items(t.items, t.sources)
    return found.withColumn("published_at", shown("published_at"))


@query(f"""SELECT item_id, source_id, coalesce(name, source_id::VARCHAR) AS source_name, i.kind, {stamp('published_at')} AS published_at FROM items i LEFT JOIN sources s USING (source_id)
  WHERE i.published_at >= TIMESTAMP '2001-07-20 00:00:00' ORDER BY i.published_at DESC, item_id DESC LIMIT 50""")
def latest_items_since(t: Tables) -> DataFrame:
    found = trends.latest_items(t.items, t.sources, 50, F.lit("2001-07-20").cast("timestamp"))
    return found.withColumn("published_at", shown("published_at"))


@query(f"SELECT source_id, {stamp('last_at')} AS last_at FROM last_items")
def last_contributed(t: Tables) -> DataFrame:
    return trends.last_contributed(t.items).withColumn("last_at", shown("last_at"))


@query("SELECT * FROM coverage")
def coverage_rows(t: Tables) -> DataFrame:
    return trends.coverage(t.sources, t.items, F.lit(INSTANT))


@query("SELECT array_to_string(list_sort(list(name) FILTER (quiet)), ',') AS quiet_names, count(*) FILTER (quiet) AS quiet_count, count(*) FILTER (enabled) AS live_count FROM coverage")
def coverage_rollup(t: Tables) -> DataFrame:
    rows = trends.coverage_rollup(trends.coverage(t.sources, t.items, F.lit(INSTANT)))
    return rows.withColumn("quiet_names", F.array_join("quiet_names", ","))


@query("SELECT item_id, array_to_string(coalesce(tags, []), '|') AS tags FROM items LEFT JOIN tags USING (item_id)")
def item_tags(t: Tables) -> DataFrame:
    return trends.item_tags(t.items, t.keywords, RULES).withColumn("tags", F.array_join("tags", "|"))


@query("SELECT * FROM category_counts")
def category_item_count(t: Tables) -> DataFrame:
    return trends.category_item_count(t.items, t.sources, t.groups, WEEK)


@query(f"SELECT keyword, count(DISTINCT item_id) AS cnt, count(DISTINCT source_id) AS sources FROM canon WHERE {MONTH_SQL} GROUP BY 1 HAVING count(DISTINCT item_id) >= 3")
def keyword_detail_counts(t: Tables) -> DataFrame:
    return trends.keyword_detail(t.items, t.keywords, RULES, MONTH)


@query(f"""SELECT keyword, array_to_string(list(n ORDER BY d), ',') AS counts FROM (SELECT k.keyword, d.d, count(DISTINCT c.item_id) AS n FROM (SELECT keyword FROM canon WHERE {MONTH_SQL} GROUP BY 1 HAVING count(DISTINCT item_id) >= 3) k
  CROSS JOIN (SELECT unnest(range(30)) AS d) d LEFT JOIN (SELECT *, date_diff('day', DATE '1998-06-08', CAST(timezone('America/Edmonton', timezone('UTC', published_at)) AS DATE)) AS day FROM canon WHERE {MONTH_SQL}) c
  ON c.keyword = k.keyword AND c.day = d.d GROUP BY 1, 2) GROUP BY keyword""")  # fmt: skip
def keyword_timeline(t: Tables) -> DataFrame:
    found = trends.timeline(t.items, t.keywords, RULES, MONTH)
    return found.select("keyword", F.array_join(F.transform("counts", lambda n: n.cast("string")), ",").alias("counts"))


@query(f"""SELECT * FROM (SELECT keyword, other, n, row_number() OVER (PARTITION BY keyword ORDER BY n DESC, other)::INTEGER AS rn FROM (
  SELECT a.keyword, b.keyword AS other, count(DISTINCT a.item_id) AS n FROM canon a JOIN canon b ON a.item_id = b.item_id AND a.keyword <> b.keyword WHERE a.{MONTH_SQL.replace('AND published_at', 'AND a.published_at')}
  GROUP BY 1, 2) WHERE keyword IN (SELECT keyword FROM canon WHERE {MONTH_SQL} GROUP BY 1 HAVING count(DISTINCT item_id) >= 3)) WHERE rn <= 10""")
def keyword_cooccurrence(t: Tables) -> DataFrame:
    return trends.cooccurrence(t.items, t.keywords, RULES, MONTH)


@query(f"""SELECT keyword, kind, item_id, {stamp('published_at')} AS published_at, rn::INTEGER AS rn FROM (SELECT *, row_number() OVER (PARTITION BY keyword, kind ORDER BY published_at DESC, item_id DESC) AS rn
  FROM (SELECT DISTINCT keyword, kind, item_id, published_at FROM canon WHERE {MONTH_SQL})) WHERE rn <= 5""")
def keyword_latest_by_kind(t: Tables) -> DataFrame:
    return trends.latest_by_kind(t.items, t.keywords, RULES, MONTH).withColumn("published_at", shown("published_at"))


@query("""SELECT keyword, cnt, least(5, 1 + floor(5 * CASE WHEN hi <= lo THEN 0.5 WHEN cnt <= lo THEN 0.0 ELSE (ln(cnt + 1) - ln(lo + 1)) / (ln(hi + 1) - ln(lo + 1)) END))::INTEGER AS step
  FROM cloud CROSS JOIN (SELECT min(cnt) AS lo, max(cnt) AS hi FROM cloud)""")
def cloud_weight_buckets(t: Tables) -> DataFrame:
    return trends.weight_steps(keyword_cloud(t))


@query("SELECT * FROM cloud WHERE rising ORDER BY cnt DESC, keyword LIMIT 8")
def rising_strip(t: Tables) -> DataFrame:
    return trends.rising_strip(keyword_cloud(t))


@query("SELECT p_partkey, p_name, CASE k WHEN 'hot rod' THEN 'rod' WHEN 'red ring' THEN 'blue ring' ELSE k END AS keyword FROM (SELECT *, lower(trim(p_name)) AS k FROM part) WHERE k <> 'cold gear'")
def keyword_normalize(t: Tables) -> DataFrame:
    noisy = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" !?").substr(F.lit(2), F.lit(2)))
    return canonical(t.raw("part").select("p_partkey", "p_name", noisy.alias("keyword")), RULES)


# items browser
def _recent(t: Tables) -> DataFrame:
    return t.items.where((F.col("published_at") >= F.lit("1998-04-09 13:00:00").cast("timestamp")) & (F.col("published_at") < F.lit(INSTANT)))


@query("SELECT item_id, page, place, (SELECT greatest(1, ceil(count(*) / 20.0))::BIGINT FROM paged) AS total_pages, page > 1 AS has_prev, page < (SELECT max(page) FROM paged) AS has_next FROM paged")
def items_page(t: Tables) -> DataFrame:
    return trends.pages(_recent(t)).select("item_id", "page", "place", "total_pages", "has_prev", "has_next")


@query("""SELECT page, array_to_string(list_sort(list(DISTINCT kind)), '|') AS kinds, count(DISTINCT source_id) AS n_sources, coalesce(array_to_string(list_sort(list(DISTINCT k) FILTER (k IS NOT NULL)), '|'), '') AS keywords
  FROM paged LEFT JOIN (SELECT item_id, unnest(tags) AS k FROM tags) USING (item_id) GROUP BY page""")
def page_facets(t: Tables) -> DataFrame:
    paged = trends.pages(_recent(t))
    tagged = paged.join(trends.item_tags(paged, t.keywords, RULES), "item_id")
    found = trends.facets(tagged)
    return found.select("page", F.array_join("kinds", "|").alias("kinds"), F.size("sources").cast("long").alias("n_sources"), F.array_join("keywords", "|").alias("keywords"))


@query("SELECT item_id FROM paged JOIN tags USING (item_id) WHERE kind = '1-URGENT' AND len(list_filter(tags, lambda x: contains(x, 'ring'))) > 0")
def item_filter(t: Tables) -> DataFrame:
    own = _recent(t)
    tagged = own.join(trends.item_tags(own, t.keywords, RULES), "item_id")
    return tagged.where(text.matches_filter(F.col("kind"), F.col("source_id"), F.col("tags"), want_kind="1-URGENT", want_keyword=" RING ")).select("item_id")


# history
@query(f"""SELECT source_id, attempts, ok_attempts, empty_attempts, failed_attempts, successful_attempts, last_status, {stamp('last_started_at')} AS last_started_at, {stamp('last_successful_at')} AS last_successful_at,
  {stamp('last_failed_at')} AS last_failed_at, last_error, last_rung, total_items_new, latest_items_new, consecutive_failures, error_class, flagged FROM health_rows""")
def source_health(t: Tables) -> DataFrame:
    found = history.health(t.log).drop("last_resolved_url")
    return found.withColumns({c: shown(c) for c in ("last_started_at", "last_successful_at", "last_failed_at")})


@query("""SELECT source_id, hours, CASE WHEN hours <= 0 OR last_at IS NULL THEN true ELSE epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(last_at) >= hours::BIGINT * 3600000000 END AS due FROM (
  SELECT source_id, CASE WHEN status = 'dead' THEN 720 WHEN kind = 'machinery' THEN 20 ELSE 2 * (source_id % 3) END::INTEGER AS hours, last_at
  FROM sources LEFT JOIN (SELECT source_id, max(started_at) AS last_at FROM attempts GROUP BY 1) USING (source_id))""")
def cadence_due(t: Tables) -> DataFrame:
    hours = F.when(F.col("status") == "dead", F.lit(720)).when(F.col("kind") == "machinery", F.lit(20)).otherwise(2 * (F.col("source_id") % 3)).cast("int")
    return history.cadence(t.sources, t.log, F.lit(LOG_NOW), hours).select("source_id", "hours", "due")


@query("""SELECT source_id, kind, group_id, enabled, status, last_status, last_rung, error_class, coalesce(consecutive_failures, 0) AS consecutive_failures, coalesce(flagged, false) AS flagged, last_error,
  CASE WHEN last_status IN ('ok', 'empty') THEN CASE WHEN status = 'degraded' AND last_rung = 'direct' THEN 'active' WHEN status = 'active' AND last_rung <> 'direct' THEN 'degraded'
    WHEN status = 'dead' THEN CASE WHEN last_rung <> 'direct' THEN 'degraded' ELSE 'active' END END
  WHEN last_status = 'error' AND enabled AND consecutive_failures >= 16 THEN CASE WHEN contains(last_error, '404') THEN 'gone' ELSE 'dead' END END AS proposed_status FROM sources LEFT JOIN health_rows USING (source_id)""")
def doctor_report(t: Tables) -> DataFrame:
    return history.doctor(t.sources, history.health(t.log)).drop("reason")


@query("""SELECT count(*) AS sources, count(*) FILTER (coalesce(flagged, false)) AS flagged, count(*) FILTER (CASE WHEN last_status IN ('ok', 'empty') THEN (status = 'degraded' AND last_rung = 'direct') OR (status = 'active' AND last_rung <> 'direct')
  OR status = 'dead' ELSE last_status = 'error' AND enabled AND consecutive_failures >= 16 END) AS proposed FROM sources LEFT JOIN health_rows USING (source_id)""")
def doctor_tallies(t: Tables) -> DataFrame:
    return history.tallies(history.doctor(t.sources, history.health(t.log)))


@query("""SELECT source_id, name, CASE WHEN enabled THEN 'live' ELSE 'disabled' END AS section, CASE WHEN enabled THEN '../items/#source=' || source_id END AS items_href, coalesce(attempts, 0) AS attempts, coalesce(consecutive_failures, 0) AS consecutive_failures, last_status
  FROM sources LEFT JOIN health_rows USING (source_id)""")
def health_view_split(t: Tables) -> DataFrame:
    return history.health_view(t.sources, history.health(t.log))


@query("""SELECT strftime(started_at, '%Y-%m-%d') AS run, count(*) AS sources, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'error') AS failed,
  count(*) FILTER (status = 'skipped') AS skipped, sum(items_new)::BIGINT AS items_new FROM log GROUP BY 1""")
def run_summary(t: Tables) -> DataFrame:
    return history.run_summary(t.log, F.date_format("started_at", "yyyy-MM-dd"))


@query("SELECT s.source_id, s.status FROM sources s JOIN groups g USING (group_id) WHERE g.enabled AND (s.enabled OR (s.status = 'dead' AND s.evidence IS NOT NULL))")
def fetchable_sources(t: Tables) -> DataFrame:
    return history.fetchable(t.sources, t.groups).select("source_id", "status")


@query("""SELECT seq, error, CASE WHEN error IS NULL THEN NULL WHEN error = 'HTTP 404' THEN 'http_4xx' WHEN error = 'HTTP 503' THEN 'http_5xx' WHEN error = 'SSL handshake' THEN 'tls' WHEN error = 'read timed out' THEN 'connection' ELSE 'other' END AS class,
  CASE WHEN error IS NULL THEN NULL ELSE 'fetch_error' END AS coarse FROM log""")
def error_classes(t: Tables) -> DataFrame:
    return t.log.select("seq", "error", text.error_class(F.col("error")).alias("class"), F.when(F.col("error").isNotNull(), text.coarse_error(F.col("error"))).alias("coarse"))


# digests
def _digest_rows(t: Tables) -> DataFrame:
    return digest.inputs(t.items, t.keywords, t.sources, t.groups, RULES, WEEK, BEFORE_WEEK)


@query("SELECT * FROM digest_rows")
def digest_inputs(t: Tables) -> DataFrame:
    return _digest_rows(t)


@query(f"""SELECT category, keyword, item_id, {stamp('published_at')} AS published_at, rn::INTEGER AS rn FROM (SELECT *, row_number() OVER (PARTITION BY category, keyword ORDER BY published_at DESC, item_id DESC) AS rn
  FROM (SELECT DISTINCT category, keyword, item_id, published_at FROM canon JOIN star USING (source_id) WHERE {WEEK_SQL})) WHERE rn <= 3 AND (category, keyword) IN (SELECT (category, keyword) FROM digest_rows)""")
def digest_top_items(t: Tables) -> DataFrame:
    found = digest.top_items(t.items, t.keywords, t.sources, t.groups, RULES, WEEK, _digest_rows(t))
    return found.withColumn("published_at", shown("published_at"))


@query("""SELECT 'daily-' || category || '-1998-07-07' AS digest_id, category, 'Daily ' || category || ' digest - 1998-07-07' AS title,
  '**TL;DR**' || chr(10) || chr(10) || array_to_string(list_transform(k[1:5], lambda x: '- ' || x), chr(10)) || chr(10) || chr(10) ||
  CASE WHEN len(r) > 0 THEN 'Rising: ' || array_to_string(r, ', ') || '. ' ELSE 'No rising keywords this period. ' END || 'Top keywords across ' || item_count || ' items: ' || array_to_string(k, ', ') || '.' AS body_md,
  '[' || array_to_string(j, ',') || ']' AS top_keywords FROM category_counts JOIN (SELECT category, list(keyword || ' (' || cnt || ')' ORDER BY rn) AS k, coalesce(list(keyword ORDER BY rn) FILTER (rising), []) AS r,
  list('{"count":' || cnt || ',"keyword":"' || keyword || '"}' ORDER BY rn) AS j FROM digest_rows GROUP BY 1) USING (category) WHERE item_count >= 3""")
def digest_template(t: Tables) -> DataFrame:
    counts = trends.category_item_count(t.items, t.sources, t.groups, WEEK)
    return digest.template(_digest_rows(t), counts, "daily", "1998-07-07", min_items=3)


def digests(t: Tables) -> DataFrame:
    """Stand-ins for stored digests: one per order status, day and region of the customer."""
    rows = trends.in_category(t.items, t.sources, t.groups).where("item_id % 50 = 0")
    return rows.select(
        text.digest_id(F.lit("daily"), F.col("category"), F.date_format("published_at", "yyyy-MM-dd")).alias("digest_id"), "category", F.col("published_at").alias("period_start"),
        F.col("item_id").alias("created_at"), F.when(F.col("item_id") % 100 == 0, F.lit("template")).otherwise(F.lit("model")).alias("model"),
    )


DIGESTS_SQL = """(SELECT 'daily-' || category || '-' || strftime(published_at, '%Y-%m-%d') AS digest_id, category, published_at AS period_start, item_id AS created_at, CASE WHEN item_id % 100 = 0 THEN 'template' ELSE 'model' END AS model
  FROM items JOIN star USING (source_id) WHERE item_id % 50 = 0)"""


@query(f"SELECT category, arg_max(digest_id, (period_start, created_at, digest_id)) AS digest_id, {stamp('max(period_start)')} AS period_start FROM {DIGESTS_SQL} GROUP BY category")
def latest_digest_per_category(t: Tables) -> DataFrame:
    return digest.latest_per_category(digests(t)).withColumn("period_start", shown("period_start"))


@query(f"""SELECT * FROM (SELECT category, key, 'daily-' || category || '-' || key AS digest_id FROM (SELECT DISTINCT category FROM groups WHERE enabled) CROSS JOIN
  (SELECT strftime(DATE '1998-07-08' - INTERVAL (d) DAY, '%Y-%m-%d') AS key FROM (SELECT unnest(range(1, 31)) AS d))) WHERE digest_id NOT IN (SELECT digest_id FROM {DIGESTS_SQL} WHERE model <> 'template')""")
def digest_due(t: Tables) -> DataFrame:
    periods = t.spark.createDataFrame([(s.key,) for s in timewin.recent_days(INSTANT, 30)], "key string")
    categories = t.groups.where("enabled").select("category").distinct()
    return digest.due(categories, periods, digests(t), "daily").select("category", "key", "digest_id")


@query(f"SELECT coalesce(bool_and(c.category IN (SELECT category FROM {DIGESTS_SQL} WHERE period_start >= TIMESTAMP '2001-01-01')), true) AS all_done FROM (SELECT DISTINCT category FROM groups WHERE enabled) c")
def digest_all_done(t: Tables) -> DataFrame:
    done = digests(t).where(F.col("period_start") >= F.lit("2001-01-01").cast("timestamp")).select("category").distinct()
    return digest.all_done(t.groups.where("enabled").select("category").distinct(), done)


@query("""SELECT category, '[' || array_to_string(list('{"count":' || cnt || ',"keyword":"' || keyword || '"}' ORDER BY rn), ',') || ']' AS chips, sum(cnt)::BIGINT AS total FROM digest_rows GROUP BY category""")
def chips_json(t: Tables) -> DataFrame:
    chips = _digest_rows(t).groupBy("category").agg(text.chips_json(F.sort_array(F.collect_list(F.struct("rn", "keyword", "cnt")))).alias("chips"))
    back = F.aggregate(text.parse_chips(F.col("chips")), F.lit(0).cast("long"), lambda n, x: n + x["count"])
    return chips.select("category", "chips", back.alias("total"))


# extraction
@query("SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM keywords WHERE method = 'llm')")
def untagged_items(t: Tables) -> DataFrame:
    return extract.untagged(t.items.select("item_id"), t.keywords.where("method = 'llm'"))


@query("SELECT item_id FROM keywords GROUP BY item_id HAVING bool_and(method = 'fallback')")
def fallback_only_items(t: Tables) -> DataFrame:
    return extract.fallback_only(t.keywords)


def documents(t: Tables) -> DataFrame:
    lines = F.split("text", "\n", 2)
    return t.raw("documents").select(F.col("doc_id").alias("item_id"), lines[0].alias("title"), F.substring(F.get(lines, F.lit(1)), 1, udfs.SUMMARY_CHARS).alias("summary"))


@query("SELECT doc_id AS item_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 25 AS BIGINT) AS batch, CASE WHEN (row_number() OVER (ORDER BY doc_id) - 1) // 25 < 30 THEN 'llm' ELSE 'fallback' END AS route FROM documents")
def extract_batches(t: Tables) -> DataFrame:
    return extract.batches(t.raw("documents").select(F.col("doc_id").alias("item_id")), budget=30).select("item_id", "batch", "route")


@query()
def fallback_keywords(t: Tables) -> DataFrame:
    return extract.extract(documents(t))


@query("""SELECT batch, to_json(list(struct_pack(item_id := doc_id::VARCHAR, title := split_part(text, chr(10), 1), summary := substr(CASE WHEN strpos(text, chr(10)) > 0 THEN text[strpos(text, chr(10)) + 1:] ELSE '' END, 1, 500)) ORDER BY doc_id))::VARCHAR AS payload
  FROM (SELECT doc_id, text, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 25 AS BIGINT) AS batch FROM documents) GROUP BY batch""")
def prompt_payloads(t: Tables) -> DataFrame:
    return extract.payloads(extract.batches(documents(t)))


@query("""WITH d AS (SELECT doc_id AS item_id, list_distinct(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z]+')) AS expected, list_distinct(regexp_extract_all(lower(source || ' ' || lang || ' ' || split_part(text, '.', 1)), '[a-z]+')) AS predicted FROM documents),
  s AS (SELECT item_id, len(list_intersect(predicted, expected)) AS i, len(list_distinct(list_concat(predicted, expected))) AS u, len(expected) AS e FROM d)
  SELECT count(*) AS items, count(*) FILTER (e > 0) AS scored, round(avg(CASE WHEN e > 0 THEN i / u::DOUBLE END), 9) AS mean FROM s""")
def eval_jaccard(t: Tables) -> DataFrame:
    docs = t.raw("documents")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    expected = docs.select(F.col("doc_id").alias("item_id"), words(F.split("text", "\n", 2)[0]).alias("expected"))
    predicted = docs.select(F.col("doc_id").alias("item_id"), words(F.concat_ws(" ", "source", "lang", F.split("text", r"\.", 2)[0])).alias("predicted"))
    return extract.score_predictions(predicted, expected).agg(F.count(F.lit(1)).alias("items"), F.count("score").alias("scored"), F.round(F.avg("score"), 9).alias("mean"))


# storage and checks
@query("""SELECT item_id, seq FROM (SELECT user_id AS item_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1 AND item_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def idempotent_insert(t: Tables) -> DataFrame:
    batch = t.raw("events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"))
    truth = t.raw("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("item_id"))
    return store.absent(batch, truth, ["item_id"], "seq")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0")
def upsert_digest(t: Tables) -> DataFrame:
    truth = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return store.upserted(truth, truth.where("id % 3 = 0").withColumn("name", F.lit("new")), ["id"])


@query("SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'changed' ELSE kind END AS kind FROM items")
def rewrite_items(t: Tables) -> DataFrame:
    truth = t.items.select("item_id", "kind")
    changes = truth.where("item_id % 4 = 0").withColumn("kind", F.lit("changed")).unionAll(t.spark.createDataFrame([(-1, "lost")], "item_id long, kind string"))
    return store.rewritten(truth, changes, ["item_id"], ["kind"])


@query("SELECT item_id, count(*) AS n FROM keywords WHERE item_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY item_id")
def delete_keywords(t: Tables) -> DataFrame:
    gone = t.raw("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item_id"))
    return store.deleted(t.keywords, gone, ["item_id"]).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'text' AS check, sha256(text) AS key, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1
  UNION ALL SELECT 'keyword_pk', item_id || '|' || keyword || '|' || method, count(*) FROM keywords GROUP BY item_id, keyword, method HAVING count(*) > 1
  UNION ALL SELECT 'unserved_kind', s.kind, count(*) FROM sources s JOIN groups g USING (group_id) WHERE s.enabled AND g.enabled AND s.kind NOT IN ('building', 'machinery') GROUP BY s.kind""")
def constraint_violations(t: Tables) -> DataFrame:
    hashed = t.raw("documents").select(F.sha2("text", 256).alias("h"))
    return checks.violations(
        checks.duplicate_keys(hashed, ["h"], "text"), checks.duplicate_keys(t.keywords, ["item_id", "keyword", "method"], "keyword_pk"), checks.unserved_kinds(t.sources, t.groups, ("building", "machinery"))
    )


# text, URLs, near duplicates
@query("SELECT page_id, sha256('rss' || chr(0) || CASE WHEN page_id % 2 = 0 THEN page_id::VARCHAR ELSE url END) AS item_id FROM pages")
def item_identity(t: Tables) -> DataFrame:
    ext = F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")).otherwise(F.lit(""))
    return t.raw("pages").select("page_id", text.item_identity(F.lit("rss"), F.col("url"), ext).alias("item_id"))


@query("""SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]+)', 1)) || CASE WHEN length(p) > 1 AND p LIKE '%/' THEN p[:-2] ELSE p END ||
  CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM (SELECT *, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS p, array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
  lambda x: NOT regexp_matches(x, '^(utm_|ref=|gclid=|fbclid=)') AND x <> ''), '&') AS q FROM pages)""")
def canonical_urls(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", urls.canonical_url_udf("url").alias("url"))


@query("""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(url, '://([^/?#]+)', 1)), ':(80|443)$', '') || CASE WHEN rest = '' OR rest[1] IN ('?', '#') THEN '/' ELSE '' END || rest AS url
  FROM (SELECT *, regexp_extract(url, '://[^/?#]+(.*)$', 1) AS rest FROM pages)""")
def published_urls(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", urls.published_url_udf("url").alias("url"))


@query("""SELECT page_id, split_part(base, '?', 1) || CASE WHEN q = '' THEN '' ELSE '?' || regexp_replace(q, '(^|&)(token)=[^&]*', '\\1\\2=REDACTED', 'g') END AS url FROM (
  SELECT page_id, base, CASE WHEN strpos(base, '?') > 0 THEN base[strpos(base, '?') + 1:] ELSE '' END AS q FROM (SELECT page_id, split_part(url || '&token=1', '#', 1) AS base FROM pages))""")
def redacted_urls(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", urls.redacted_url_udf(F.concat("url", F.lit("&token=1"))).alias("url"))


@query("""SELECT page_id, rtrim(substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:script[^>]*>.*?</script|style[^>]*>.*?</style)[^>]*>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')), 1, 2000)) AS summary FROM pages""")
def clean_pages(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", udfs.clean_summary_udf("html").alias("summary"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages""")
def page_titles(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", udfs.clean_title_udf(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"))


@query("SELECT page_id, CAST(NULL AS VARCHAR) AS feed, 1 AS alternates FROM pages")
def feed_discovery(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", urls.discovered_feed_udf("html", "url").alias("feed"), F.size(urls.alternate_endpoints_udf("url")).alias("alternates"))


@query()
def title_simhash(t: Tables) -> DataFrame:
    return documents(t).select("item_id", udfs.simhash_udf("title").alias("content_hash"))


@query("""SELECT a.doc_id AS id_a, b.doc_id AS id_b, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM (SELECT doc_id, ('0x' || md5(split_part(text, chr(10), 1))[1:15])::BIGINT AS h FROM documents) a
  JOIN (SELECT doc_id, ('0x' || md5(split_part(text, chr(10), 1))[1:15])::BIGINT AS h FROM documents) b ON a.doc_id < b.doc_id AND bit_count(xor(a.h, b.h)) <= 3""")
def hamming_pairs(t: Tables) -> DataFrame:
    twin = documents(t).select("item_id", F.concat(F.lit("0"), F.substring(F.md5("title"), 1, 15)).alias("content_hash"))
    return neardup.near_pairs(twin, 3)


def _stamped(t: Tables) -> DataFrame:
    return documents(t).select("item_id", F.timestamp_seconds(F.col("item_id") * 60).alias("published_at"), udfs.simhash_udf("title").alias("content_hash"))


@query()
def near_dup_pages(t: Tables) -> DataFrame:
    return neardup.collapse_pages(trends.pages(_stamped(t)))


@query()
def near_dup_groups(t: Tables) -> DataFrame:
    return neardup.group_near_duplicates(_stamped(t).withColumn("window", F.floor(F.col("item_id") / 100)), ["window"])


@query("""SELECT doc_id, CASE WHEN length(flat) <= 1500 THEN flat WHEN length(said) > 750 THEN said WHEN length(word) >= 750 THEN rtrim(word) ELSE rtrim(flat[:1500]) END AS excerpt FROM (
  SELECT *, regexp_extract(flat[:1500], '^(.*[.!?]) ', 1) AS said, regexp_extract(flat[:1500], '^(.*) ', 1) AS word FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents))""")
def transcript_excerpt(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", udfs.excerpt_udf("text").alias("excerpt"))


@query()
def keyword_slugs(t: Tables) -> DataFrame:
    return t.raw("part").select("p_name").distinct().select("p_name", udfs.keyword_slug_udf("p_name").alias("slug"))


@query(f"""SELECT keyword, array_to_string(list(printf('%.2f', 2 + d * (116 / 29.0::DOUBLE)) || ',' || CASE WHEN hi = lo THEN '12.00' ELSE printf('%.2f', 2 + 20 * (1 - (n - lo) / (hi - lo)::DOUBLE)) END ORDER BY d), ' ') AS points FROM (
  SELECT *, min(n) OVER (PARTITION BY keyword) AS lo, max(n) OVER (PARTITION BY keyword) AS hi FROM (SELECT k.keyword, d.d, count(DISTINCT c.item_id) AS n FROM (SELECT keyword FROM canon WHERE {MONTH_SQL} GROUP BY 1 HAVING count(DISTINCT item_id) >= 3) k
  CROSS JOIN (SELECT unnest(range(30)) AS d) d LEFT JOIN (SELECT *, date_diff('day', DATE '1998-06-08', CAST(timezone('America/Edmonton', timezone('UTC', published_at)) AS DATE)) AS day FROM canon WHERE {MONTH_SQL}) c
  ON c.keyword = k.keyword AND c.day = d.d GROUP BY 1, 2)) GROUP BY keyword""")
def keyword_sparklines(t: Tables) -> DataFrame:
    counts = trends.timeline(t.items, t.keywords, RULES, MONTH)
    return counts.select("keyword", udfs.sparkline_udf("counts").alias("points"))


@query("""SELECT event_id, strftime(CAST(timezone('America/Edmonton', timezone('UTC', ts)) AS DATE), '%Y-%m-%d') AS local_date, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso,
  strftime(CAST(timezone('America/Edmonton', timezone('UTC', ts)) AS DATE), '%G-W%V') AS week FROM events""")
def local_days(t: Tables) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    day = timewin.local_date_column(at)
    return t.raw("events").select("event_id", F.date_format(day, "yyyy-MM-dd").alias("local_date"), timewin.iso_column(at).alias("iso"), timewin.iso_week_key(day).alias("week"))


@query("SELECT source_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS n FROM log) WHERE n <= 50")
def per_source_cap(t: Tables) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy("seq")
    return t.log.withColumn("n", F.row_number().over(order)).where("n <= 50").select("source_id", "seq")
