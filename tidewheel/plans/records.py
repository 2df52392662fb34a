"""Queries of text functions, record scans, replies, pages and stored tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import text, timewin
from tidewheel.operators import checks, digest, extract, history, model, neardup, output, store, trends
from tidewheel.plans.adapters import LOG_NOW, MONTH, RULES, WEEK, Tables
from tidewheel.plans.queries import DIGESTS_SQL, MONTH_SQL, digests, documents, query, shown, stamp
from tidewheel.session import shared_path
from tidewheel.sources import records
from tidewheel.streaming import ingest

TITLE = "split_part(text, chr(10), 1)"


# text
@query(f"""SELECT doc_id, CASE WHEN length({TITLE}) > 60 THEN rtrim({TITLE}[:59]) || '…' ELSE {TITLE} END AS short, CASE WHEN strpos(text, chr(10)) > 0 AND text[strpos(text, chr(10)) + 1:] <> '' THEN
  {TITLE} || chr(10) || text[strpos(text, chr(10)) + 1:] ELSE {TITLE} END AS whole FROM documents WHERE text IS NOT NULL""")
def title_columns(t: Tables) -> DataFrame:
    lines = F.split("text", "\n", 2)
    return t.raw("documents").where("text IS NOT NULL").select("doc_id", text.shorten(lines[0]).alias("short"), text.item_text(lines[0], F.get(lines, F.lit(1))).alias("whole"))


@query("""SELECT p_partkey, slug, regexp_full_match(slug, '([a-z0-9]+-)*[a-z0-9]+') AS valid, CASE WHEN p_partkey % 2 = 0 THEN slug ELSE 'weekly-' || slug END AS period FROM (
  SELECT p_partkey, replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '--' WHEN 1 THEN '-' ELSE '_' END) AS slug FROM part)""")
def slugs(t: Tables) -> DataFrame:
    turn = F.col("p_partkey") % 3
    slug = F.replace("p_name", F.lit(" "), F.when(turn == 0, F.lit("--")).when(turn == 1, F.lit("-")).otherwise(F.lit("_")))
    named = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("daily-")).otherwise(F.lit("weekly-")), slug)
    return t.raw("part").select("p_partkey", slug.alias("slug"), text.valid_slug(slug).alias("valid"), text.digest_slug(named, F.lit("daily")).alias("period"))


@query("SELECT p_partkey, '[\"' || p_name || '\"]' AS bare FROM part")
def fenced_replies(t: Tables) -> DataFrame:
    bare = F.concat(F.lit('["'), "p_name", F.lit('"]'))
    turn = F.col("p_partkey") % 3
    fenced = F.when(turn == 0, F.concat(F.lit("```json\n"), bare, F.lit("\n```"))).when(turn == 1, F.concat(F.lit("  ```\n"), bare, F.lit("\n```\n"))).otherwise(bare)
    return t.raw("part").select("p_partkey", text.strip_code_fence(fenced).alias("bare"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 90 <= 60 THEN (o_orderkey % 90)::DOUBLE END AS wait, CASE WHEN o_totalprice >= 200000 THEN 'fail' WHEN o_totalprice >= 100000 THEN 'warn' ELSE 'ok' END AS size,
  strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS at, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def small_columns(t: Tables) -> DataFrame:
    wait = F.when(F.col("o_orderkey") % 5 == 0, F.lit("soon")).otherwise((F.col("o_orderkey") % 90).cast("string"))
    day = timewin.leading_date(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
    return t.raw("orders").select(
        "o_orderkey", text.retry_after(wait).alias("wait"), text.size_class(F.col("o_totalprice"), 100_000, 200_000).alias("size"), timewin.epoch_iso(F.col("o_orderkey")).alias("at"), F.date_format(day, "yyyy-MM-dd").alias("day")
    )


_SAID = ("HTTP 429", "HTTP 403", "too large a body", "Timeout after 3 s", "unsafe: host", "unparseable feed", "no idea")
_COARSE = ("rate_limited", "runner_blocked_or_forbidden", "oversized", "timeout", "policy_blocked", "parse_error", "fetch_error")


@query(f"""SELECT event_id, (['{"', '".join(_COARSE)}'])[event_id % 7 + 1] AS reason, CASE event_id % 3 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'runner_blocked_or_forbidden' ELSE 'http_503' END AS status FROM events""")
def error_reasons(t: Tables) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("event_id") % 7 + 1).cast("int"))
    code = F.element_at(F.array(F.lit(429), F.lit(403), F.lit(503)), (F.col("event_id") % 3 + 1).cast("int"))
    return t.raw("events").select("event_id", text.coarse_error(said).alias("reason"), text.status_reason(code).alias("status"))


# replies of a model
def _asked(t: Tables) -> DataFrame:
    return t.raw("part").select(F.floor(F.col("p_partkey") / 10).alias("batch"), F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("title"), F.lit("").alias("summary"))


@query("""SELECT p_partkey::VARCHAR AS item_id, keyword, rank FROM (SELECT p_partkey, unnest([p_name, p_name || ' set', 'a third one']) AS keyword, unnest([1, 2, 3]) AS rank FROM part)
  WHERE rank <= 2 AND (p_partkey // 10) % 3 <> 0 AND (p_partkey // 10) % 4 <> 1 AND (p_partkey // 10) % 5 <> 2""")
def checked_replies(t: Tables) -> DataFrame:
    """Replies that leave an item out, bring a keyword of one letter, or are no JSON, void their whole batch."""
    n = F.col("batch")
    words = F.array(F.col("title"), F.concat("title", F.lit(" set")), F.when(n % 4 == 1, F.lit("x")).otherwise(F.lit("a third one")))
    own = F.struct(F.when((n % 3 == 0) & (F.col("item_id").cast("long") % 10 == 3), F.lit("other")).otherwise(F.col("item_id")).alias("item_id"), words.alias("keywords"))
    replies = _asked(t).groupBy("batch").agg(F.to_json(F.collect_list(own)).alias("reply"))
    fenced = replies.select("batch", F.when(n % 5 == 2, F.lit("I'd rather not")).otherwise(F.concat(F.lit("```json\n"), "reply", F.lit("\n```"))).alias("reply"))
    return extract.ranked(extract.checked_replies(fenced, _asked(t), keep=2).where("ok"))


@query("""WITH RECURSIVE b AS (SELECT p_partkey // 10 AS batch, row_number() OVER (ORDER BY p_partkey // 10) AS k FROM part GROUP BY 1), s AS (SELECT 0::BIGINT AS k, -1::BIGINT AS batch, 0 AS attempt, 0 AS made, 0 AS again, '' AS status, false AS valid, true AS more
  UNION ALL SELECT k, batch, attempt, made, again, status, valid, more FROM (SELECT b.k, b.batch, CASE WHEN s.k = b.k THEN 2 ELSE 1 END AS attempt, s.made + 1 AS made, s.again + CASE WHEN s.k = b.k THEN 1 ELSE 0 END AS again,
    CASE WHEN b.batch % 7 = 5 THEN 'error' ELSE 'ok' END AS status, b.batch % 7 <> 5 AND b.batch % 3 <> 1 AS valid, true AS more
    FROM s JOIN b ON b.k = CASE WHEN s.attempt = 1 AND s.status = 'ok' AND NOT s.valid AND s.again < 4 THEN s.k ELSE s.k + 1 END WHERE s.made < 15))
  SELECT batch, attempt::INTEGER AS attempt, status, valid FROM s WHERE k > 0""")
def model_calls(t: Tables) -> DataFrame:
    """Calls within a budget of 15, four of them second tries."""
    import json

    def answer(rows: list[dict]) -> model.Completion:
        batch = int(rows[0]["item_id"]) // 10
        if batch % 7 == 5:
            raise OSError("down")
        return model.Completion("nothing" if batch % 3 == 1 else json.dumps([{"item_id": r["item_id"], "keywords": []} for r in rows]), 10, 2)

    return extract.ask(_asked(t), answer, budget=15, retries=4).select("batch", "attempt", "status", "valid")


@query("""SELECT doc_id AS item_id, split_part(text, chr(10), 1) AS title, 'eval' AS source_id, 'rss' AS kind, 'eval:' || doc_id AS canonical_url, 'eval-' || doc_id AS content_hash, '2026-01-01T00:00:00+00:00' AS published_at FROM documents""")
def eval_items(t: Tables) -> DataFrame:
    return extract.eval_items(documents(t), "2026-01-01T00:00:00+00:00").select("item_id", "title", "source_id", "kind", "canonical_url", "content_hash", "published_at")


@query("""WITH c AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS e, CASE WHEN p_partkey % 4 > 0 THEN [string_split(p_name, ' ')[1]] ELSE [] END AS p, p_partkey % 5 > 0 AS told FROM part WHERE p_partkey <= 50),
  s AS (SELECT *, CASE WHEN told THEN len(p) / len(e)::DOUBLE END AS score FROM c) SELECT n::INTEGER AS n, line FROM (
  SELECT 0 AS n, printf('mean jaccard: %.3f (', avg(score)) || count(score) || ' labelled / ' || (count(*) - count(score)) || ' unlabelled)' AS line FROM s UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| title | jaccard | predicted | expected |' UNION ALL SELECT 3, '|---|---|---|---|'
  UNION ALL SELECT 3 + row_number() OVER (ORDER BY p_partkey), '| ' || p_name || ' | ' || coalesce(printf('%.3f', score), 'TODO') || ' | ' || array_to_string(p, ', ') || ' | ' || CASE WHEN told THEN array_to_string(e, ', ') ELSE '' END || ' |' FROM s)""")
def eval_report(t: Tables) -> DataFrame:
    part, none = t.raw("part").where("p_partkey <= 50"), F.array().cast("array<string>")
    words = F.split("p_name", " ")
    cases = part.select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 5 > 0, words).otherwise(none).alias("expected"), F.when(F.col("p_partkey") % 4 > 0, F.slice(words, 1, 1)).otherwise(none).alias("predicted")
    )
    return output.eval_report(extract.score_predictions(cases.select("item_id", "predicted"), cases.select("item_id", "expected")), cases)


# records
def _written(t: Tables, rows: DataFrame, name: str) -> str:
    path = shared_path(t.spark, name)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).repartition(4).write.text(path)
    # the text source names its files .txt; a record tree holds .jsonl
    jvm = t.spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(t.spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(root):
        if f.getPath().getName().endswith(".txt"):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(root, f.getPath().getName()[:-4] + ".jsonl"))
    return path


@query("SELECT o_orderkey::VARCHAR AS item_id, o_custkey::VARCHAR AS source_id, 'rss' AS kind, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%dT00:00:00+00:00') AS published_at FROM orders")
def scan_items(t: Tables) -> DataFrame:
    at = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'00:00:00+00:00")
    text_of = lambda c: F.col(c).cast("string")
    rows = t.raw("orders").select(
        text_of("o_orderkey").alias("item_id"), text_of("o_custkey").alias("source_id"), F.lit("rss").alias("kind"), F.concat(F.lit("https://e.com/"), text_of("o_orderkey")).alias("canonical_url"),
        F.col("o_orderpriority").alias("title"), at.alias("published_at"), at.alias("fetched_at"), F.lit("0" * 16).alias("content_hash"),
    )
    return records.scan(t.spark, _written(t, rows, "items"), "items").select("item_id", "source_id", "kind", "title", "published_at")


@query("SELECT item_id::VARCHAR AS item_id, keyword, rank::INTEGER AS rank, method FROM keywords")
def scan_keywords(t: Tables) -> DataFrame:
    rows = t.keywords.select(F.col("item_id").cast("string").alias("item_id"), "keyword", F.col("rank").cast("int").alias("rank"), "method", F.lit("2026-01-01").alias("extracted_at"))
    return records.scan(t.spark, _written(t, rows, "keywords"), "item_keywords").select("item_id", "keyword", "rank", "method")


@query(f"SELECT source_id::VARCHAR AS source_id, {stamp('started_at')} AS started_at, status, items_new::INTEGER AS items_new, error, rung FROM log")
def scan_fetch_log(t: Tables) -> DataFrame:
    rows = t.log.select(F.col("source_id").cast("string").alias("source_id"), F.lit("r").alias("run_id"), shown("started_at"), "status", F.col("items_new").cast("int").alias("items_new"), "error", "rung", F.lit(1).alias("further"))
    return records.scan(t.spark, _written(t, rows, "log"), "fetch_log").select("source_id", "started_at", "status", "items_new", "error", "rung")


@query("""SELECT CASE p_partkey % 5 WHEN 1 THEN 'further fields: more' WHEN 2 THEN 'kind: fax' WHEN 3 THEN 'title: missing' ELSE 'not an object' END AS fault, count(*) AS n FROM part WHERE p_partkey % 5 > 0 GROUP BY 1""")
def record_faults(t: Tables) -> DataFrame:
    turn = F.col("p_partkey") % 5
    base = {c: F.lit("v") for c in ("item_id", "source_id", "canonical_url", "published_at", "fetched_at", "content_hash")}
    row = F.struct(*(c.alias(n) for n, c in base.items()), F.when(turn != 3, F.col("p_name")).alias("title"), F.when(turn == 2, F.lit("fax")).otherwise(F.lit("rss")).alias("kind"), F.when(turn == 1, F.lit(1)).alias("more"))
    value = F.when(turn == 4, F.lit("{broken")).otherwise(F.to_json(row))
    parsed = t.raw("part").select(value.alias("value")).select("value", F.from_json("value", records.ITEMS).alias("r"))
    return parsed.select(records.fault(F.col("value"), F.col("r"), records.TABLES["items"]).alias("fault")).where("fault IS NOT NULL").groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


# stored tables
@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 30 = 7 THEN 'new' ELSE c_name END AS name, strftime(DATE '2026-01-01' + INTERVAL (c_custkey % 10) DAY, '%Y-%m-%d') AS dt FROM customer")
def rewritten_partitions(t: Tables) -> DataFrame:
    """A stored table after a rewrite that touches some of its partitions."""
    rows = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("c_custkey") % 10).cast("int")), "yyyy-MM-dd").alias("at"))
    own = store.Store(t.spark, shared_path(t.spark, "store"))
    own.append("customer", rows, "at")
    changes = rows.where("id % 30 = 7").withColumn("name", F.lit("new")).select("id", "name").unionAll(t.spark.createDataFrame([(-1, "lost")], "id long, name string"))
    own.rewrite("customer", rows.schema, changes, ["id"], ["name"])
    return own.read("customer", rows.schema).select("id", "name", F.date_format("dt", "yyyy-MM-dd").alias("dt"))


@query("""SELECT 'item_keywords_fk' AS check, l_orderkey::VARCHAR AS key, count(*) AS n FROM lineitem WHERE l_orderkey % 50 = 0 GROUP BY l_orderkey UNION ALL
  SELECT 'items_pk', o_orderkey::VARCHAR, 2 FROM orders WHERE o_orderkey % 70 = 1 AND o_orderkey % 50 <> 0 UNION ALL SELECT 'item_keywords_pk', l_orderkey || '|' || p_name || '|llm', count(*) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_name HAVING count(*) > 1""")
def cache_violations(t: Tables) -> DataFrame:
    """Items of which some come twice and some are missing, with all keywords."""
    items = t.items.select("item_id").where("item_id % 50 <> 0")
    twice = items.unionAll(items.where("item_id % 70 = 1"))
    return checks.cache_violations({"items": twice, "item_keywords": t.keywords.select("item_id", "keyword", F.lit("llm").alias("method"))})


# pages
@query("SELECT page, total AS total_pages, CASE WHEN page = total THEN n - (total - 1) * 20 ELSE 20 END::BIGINT AS items, page > 1 AS has_prev, page < total AS has_next FROM (SELECT count(*) AS n, greatest(1, ceil(count(*) / 20.0))::BIGINT AS total FROM orders), (SELECT unnest(range(1, 100000)) AS page) WHERE page <= total")
def page_index(t: Tables) -> DataFrame:
    return trends.page_index(t.items)


@query("SELECT 1::BIGINT AS page, 1::BIGINT AS total_pages, 0::BIGINT AS items, false AS has_prev, false AS has_next")
def empty_page_index(t: Tables) -> DataFrame:
    return trends.page_index(t.items.where("false"))


@query(f"SELECT keyword, n, (rn - 1) // 20 + 1 AS page, (rn - 1) % 20 + 1 AS place FROM (SELECT *, row_number() OVER (ORDER BY n DESC, keyword) AS rn FROM (SELECT keyword, count(DISTINCT item_id) AS n FROM canon WHERE {MONTH_SQL} GROUP BY 1))")
def paged_groups(t: Tables) -> DataFrame:
    groups = trends.keyword_counts(t.items, t.keywords, RULES, MONTH).select("keyword", F.col("cnt").alias("n"))
    return neardup.paginate(groups, [F.desc("n"), F.asc("keyword")]).select("keyword", "n", "page", "place")


@query("SELECT group_id, category, enabled, coalesce(array_to_string(list(source_id || ':' || name ORDER BY source_id) FILTER (source_id IS NOT NULL), ','), '') AS sources FROM groups LEFT JOIN (SELECT source_id, name, group_id FROM sources WHERE source_id % 4 > 0) USING (group_id) GROUP BY 1, 2, 3")
def sources_by_group(t: Tables) -> DataFrame:
    found = output.sources_by_group(t.groups, t.sources.where("source_id % 4 > 0").select("source_id", "name", "group_id"))
    return found.withColumn("sources", F.array_join(F.transform("sources", lambda s: F.concat(s["source_id"].cast("string"), F.lit(":"), s["name"])), ",")).select("group_id", "category", "enabled", "sources")


@query(f"SELECT keyword, cnt, slug, slug IS NOT NULL AS linked FROM cloud LEFT JOIN (SELECT keyword, replace(keyword, ' ', '-') AS slug FROM canon WHERE {MONTH_SQL} GROUP BY keyword HAVING count(DISTINCT item_id) >= 8) USING (keyword)")
def linked_keywords(t: Tables) -> DataFrame:
    from tidewheel.plans.queries import keyword_cloud

    pages = trends.keyword_detail(t.items, t.keywords, RULES, MONTH, 8).select("keyword", F.replace("keyword", F.lit(" "), F.lit("-")).alias("slug"))
    return output.linked_keywords(keyword_cloud(t).select("keyword", "cnt"), pages)


@query("SELECT CASE WHEN enabled THEN 'live' ELSE 'disabled' END AS section, count(*) AS n, min(source_id) AS first, max(source_id) AS last FROM sources GROUP BY 1")
def health_page(t: Tables) -> DataFrame:
    rows = output.health_page(history.health_view(t.sources, history.health(t.log)))
    ids = F.transform("rows", lambda r: r["source_id"])
    return rows.select("section", F.size("rows").cast("long").alias("n"), ids[0].alias("first"), F.element_at(ids, -1).alias("last"))


@query(f"SELECT digest_id, category, {stamp('p')} AS period_start FROM (SELECT digest_id, category, period_start AS p, created_at FROM {DIGESTS_SQL}) ORDER BY p DESC, created_at DESC, digest_id DESC LIMIT 5")
def latest_digests(t: Tables) -> DataFrame:
    return digest.newest_first(digests(t), 5).select("digest_id", "category", shown("period_start"))


@query(f"SELECT digest_id, created_at, model FROM {DIGESTS_SQL}")
def all_digests(t: Tables) -> DataFrame:
    return digest.newest_first(digests(t)).select("digest_id", "created_at", "model")


@query("""SELECT source_id, CASE WHEN source_id % 4 = 0 THEN 'ok' ELSE 'skipped' END AS status, CASE WHEN source_id % 4 = 0 THEN 3 ELSE 0 END::BIGINT AS items_new FROM sources""")
def fetch_results(t: Tables) -> DataFrame:
    decided = t.sources.select("source_id", (F.col("source_id") % 4 == 0).alias("due"))
    none = F.lit(None).cast("string")
    fetched = t.sources.where("source_id % 2 = 0").select("source_id", F.lit("ok").alias("status"), F.lit(3).cast("long").alias("items_new"), none.alias("error"), F.lit("direct").alias("rung"), none.alias("resolved_url"))
    return history.fetch_results(decided, fetched, "r", F.lit(LOG_NOW)).select("source_id", "status", "items_new")


# digests by a model
def _examples(t: Tables, rows: DataFrame) -> DataFrame:
    found = digest.top_items(t.items, t.keywords, t.sources, t.groups, RULES, WEEK, rows, limit=2)
    return found.select("category", "keyword", "rn", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("title"), F.lit("s" * 400).alias("summary"))


@query("""SELECT category, '{"category":"' || category || '","cadence":"daily","period_start":"a","period_end":"b","item_count":' || item_count || ',"keywords":[' || words || ']}' AS payload FROM category_counts JOIN (
  SELECT category, array_to_string(list('{"keyword":"' || keyword || '","mentions":' || cnt || ',"rising":' || rising || ',"examples":[' || coalesce(x, '') || ']}' ORDER BY rn), ',') AS words FROM digest_rows LEFT JOIN (
    SELECT category, keyword, array_to_string(list('{"title":"item ' || item_id || '","summary":"' || repeat('s', 300) || '"}' ORDER BY published_at DESC, item_id DESC), ',') AS x FROM (
      SELECT *, row_number() OVER (PARTITION BY category, keyword ORDER BY published_at DESC, item_id DESC) AS k FROM (SELECT DISTINCT category, keyword, item_id, published_at FROM canon JOIN star USING (source_id)
        WHERE published_at >= TIMESTAMP '1998-07-01 06:00:00' AND published_at < TIMESTAMP '1998-07-08 06:00:00')) WHERE k <= 2 GROUP BY 1, 2) USING (category, keyword) GROUP BY 1) USING (category)""")
def digest_payloads(t: Tables) -> DataFrame:
    from tidewheel.plans.queries import digest_inputs

    rows = digest_inputs(t)
    counts = trends.category_item_count(t.items, t.sources, t.groups, WEEK)
    return digest.payloads(rows, counts, _examples(t, rows), "daily", "a", "b")


@query("""SELECT category, CASE WHEN category < 'B' THEN 'model' ELSE 'template' END AS model, CASE WHEN category < 'B' THEN 'v1' ELSE 'none' END AS prompt_version,
  CASE WHEN category < 'B' THEN 'On ' || category ELSE 'Daily ' || category || ' digest - 1998-07-07' END AS title, category < 'B' AS told FROM category_counts WHERE item_count >= 3""")
def generated_digests(t: Tables) -> DataFrame:
    """A model that answers for some categories; the others fall back to the template."""
    import json

    from tidewheel.plans.queries import digest_inputs

    def answer(payload: str) -> str:
        category = json.loads(payload)["category"]
        return json.dumps({"title": f"On {category}", "tldr": ["one", " "], "body_md": "A body."}) if category < "B" else '{"title": ""}'

    rows = digest_inputs(t)
    counts = trends.category_item_count(t.items, t.sources, t.groups, WEEK)
    made = digest.generate(rows, counts, digest.payloads(rows, counts, _examples(t, rows), "daily", "a", "b"), answer, "daily", "1998-07-07", min_items=3)
    return made.select("category", "model", "prompt_version", "title", (F.col("body_md") == "**TL;DR**\n\n- one\n\nA body.").alias("told"))


# streams, as batch queries of the same plan
@query("SELECT strftime(CAST(timezone('America/Edmonton', timezone('UTC', ts)) AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def daily_counts(t: Tables) -> DataFrame:
    found = ingest.daily_counts(t.raw("events").select(F.col("ts").cast("timestamp").alias("at")))
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query("""SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT ts, unnest(range(7)) AS k FROM events) JOIN (SELECT unnest(generate_series(TIMESTAMP '2023-12-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY)) AS d) ON date_trunc('day', ts) - to_days(k::INTEGER) = d GROUP BY 1""")
def trailing_counts(t: Tables) -> DataFrame:
    found = ingest.trailing_counts(t.raw("events").select(F.col("ts").cast("timestamp").alias("at")))
    return found.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")
