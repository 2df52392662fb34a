from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import udfs
from tidewheel.functions.timewin import preceding, trailing
from tidewheel.operators import checks, digest, extract, history, ingest, neardup, store, trends
from tidewheel.operators.rules import Rules

NOW = datetime(2026, 7, 8, 13, tzinfo=UTC)
WEEK = trailing(NOW, 7)
RULES = Rules({"gen ai": "genai"}, ("webinar",))


@pytest.fixture(scope="module")
def canned(spark):
    items = spark.createDataFrame(
        [("i1", "s1", "2026-07-05 10:00:00"), ("i2", "s1", "2026-07-06 10:00:00"), ("i3", "s2", "2026-07-07 10:00:00"), ("i4", "s2", "2026-06-28 10:00:00"), ("i5", "s1", "2026-05-01 10:00:00")], "item_id string, source_id string, p string"
    ).select("item_id", "source_id", F.lit("rss").alias("kind"), F.to_timestamp("p").alias("published_at"))
    words = [("i1", "Gen AI", 1, "llm"), ("i1", "llm", 2, "llm"), ("i1", "webinar", 3, "llm"), ("i1", "genai", 1, "fallback"), ("i2", "genai", 1, "llm"), ("i3", "genai", 1, "llm"), ("i3", "agents", 2, "llm"), ("i4", "genai", 1, "llm"), ("i4", "llm", 2, "llm"), ("i5", "old", 1, "llm")]
    keywords = spark.createDataFrame(words, "item_id string, keyword string, rank int, method string")
    sources = spark.createDataFrame([("s1", "S1", "rss", "g1", True), ("s2", "S2", "rss", "g1", True), ("s3", "S3", "rss", "g2", True)], "source_id string, name string, kind string, group_id string, enabled boolean")
    groups = spark.createDataFrame([("g1", "ai", True), ("g2", "dev", True)], "group_id string, category string, enabled boolean")
    return items, keywords, sources, groups


def test_cloud(canned):
    items, keywords, _, _ = canned
    rows = trends.cloud(items, keywords, RULES, WEEK, preceding(WEEK)).orderBy(F.desc("cnt"), "keyword").collect()
    assert [(r.keyword, r.cnt, r.delta) for r in rows] == [("genai", 3, 2), ("agents", 1, 1), ("llm", 1, 0)]
    pinned = trends.cloud(items, keywords, Rules(RULES.aliases, RULES.mute, ("llm", "webinar", "old")), WEEK, preceding(WEEK), limit=1).collect()
    assert {r.keyword for r in pinned} == {"genai", "llm"}


def test_stats_and_sources(canned):
    items, keywords, sources, groups = canned
    r = trends.stats(items, keywords, sources, RULES, WEEK).first()
    assert (r.item_count, r.source_count, r.keyword_count, r.mention_count, r.top_keyword, r.top_source) == (3, 2, 3, 5, "genai", "S1")
    assert {x.name: (x.n, x.source_id) for x in trends.top_sources(items, sources, WEEK).collect()} == {"S2": (1, "s2"), "S1": (2, "s1")}
    empty = trends.stats(items.where("false"), keywords, sources, RULES, WEEK).first()
    assert (empty.item_count, empty.mention_count, empty.top_keyword) == (0, 0, None)
    assert [r.item_id for r in trends.latest_items(items, sources, 2).collect()] == ["i3", "i2"]
    assert {(x.category, x.item_count) for x in trends.category_item_count(items, sources, groups, WEEK).collect()} == {("ai", 3)}
    tags = {x.item_id: x.tags for x in trends.item_tags(items, keywords, RULES).collect()}
    assert tags["i1"] == ["genai", "llm"] and tags["i5"] == ["old"]


def test_details(canned):
    items, keywords, _, _ = canned
    lines = {r.keyword: r.counts for r in trends.timeline(items, keywords, RULES, WEEK, min_mentions=1).collect()}
    assert lines["genai"] == [0, 0, 0, 0, 1, 1, 1] and all(len(v) == 7 for v in lines.values())
    pairs = [(r.keyword, r.other, r.n) for r in trends.cooccurrence(items, keywords, RULES, WEEK, min_mentions=3).collect()]
    assert sorted(pairs) == [("genai", "agents", 1), ("genai", "llm", 1)]
    rows = trends.coverage(canned[2], items, F.lit(NOW), 30).collect()
    assert {(r.source_id, r.label, r.quiet) for r in rows} == {("s1", "2 days ago", False), ("s2", "1 day ago", False), ("s3", "never", True)}


def test_plan_of_the_cloud(canned, spark):
    from tidewheel.plans.queries import QUERIES

    plan = QUERIES["keyword_cloud"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "PushedFilters: [IsNotNull(o_orderdate)" in plan and "o_totalprice" not in plan.split("== Physical Plan ==")[1]


def fetch_log(spark, rows):
    full = [(s, k, datetime(2026, 1, 1 + k % 28, tzinfo=UTC), status, n, e, rung, url) for k, (s, status, n, e, rung, url) in enumerate(rows)]
    return spark.createDataFrame(full, "source_id string, seq long, started_at timestamp, status string, items_new int, error string, rung string, resolved_url string")


def test_health(spark):
    rows = [("s1", "skipped", 0, None, None, None), ("s1", "ok", 2, None, "direct", None), ("s1", "empty", 0, None, "direct", None), ("s1", "error", 0, "HTTP 500", None, None), ("s1", "ok", 4, None, "alt_endpoint", "alt.xml"), ("s3", "skipped", 0, None, None, None)]
    rows += [("s2", "error", 0, "boom", None, None)] * 5 + [("s2", "skipped", 0, None, None, None)]
    got = {r.source_id: r for r in history.health(fetch_log(spark, rows)).collect()}
    a, b = got["s1"], got["s2"]
    assert set(got) == {"s1", "s2"}
    assert (a.attempts, a.ok_attempts, a.empty_attempts, a.failed_attempts, a.successful_attempts, a.consecutive_failures, a.total_items_new, a.latest_items_new, a.last_error, a.error_class, a.last_resolved_url) == (4, 2, 1, 1, 3, 0, 6, 4, "HTTP 500", "http_5xx", "alt.xml")
    assert (b.consecutive_failures, b.flagged, b.attempts) == (5, True, 5)
    quiet = history.health(fetch_log(spark, rows), F.col("source_id") == "s2").where("source_id = 's2'").first()
    assert not quiet.flagged


@pytest.mark.parametrize("status, last, rung, error, streak, quiet, out", [
    ("degraded", "ok", "direct", None, 0, False, "active"), ("active", "empty", "mirror", None, 0, False, "degraded"), ("dead", "ok", "mirror", None, 0, True, "degraded"), ("dead", "ok", None, None, 0, False, "active"), ("active", "ok", "direct", None, 0, False, None),
    ("active", "error", None, "HTTP 402", 1, False, "paywalled"), ("active", "error", None, "HTTP 404", 16, False, "gone"), ("active", "error", None, "x", 16, False, "dead"), ("active", "error", None, "x", 15, False, None), ("active", "error", None, "x", 99, True, None),
    ("paywalled", "error", None, "x", 99, False, None), ("active", None, None, None, None, False, None),
])
def test_proposals(spark, status, last, rung, error, streak, quiet, out):
    row = spark.createDataFrame([(status, last, rung, error, streak, quiet)], "s string, l string, r string, e string, n int, q boolean")
    new, why = history.proposal(*(F.col(c) for c in "slrenq"))
    got = row.select(new.alias("new"), why.alias("why")).first()
    assert got.new == out and (got.why is None) == (out is None)


def test_cadence(spark):
    log = fetch_log(spark, [("a", "ok", 0, None, None, None), ("b", "ok", 0, None, None, None), ("c", "skipped", 0, None, None, None)])
    sources = spark.createDataFrame([("a", 24), ("b", 60), ("c", 99), ("d", 0)], "source_id string, h int")
    now = F.lit(datetime(2026, 1, 2, tzinfo=UTC))
    assert {r.source_id: r.due for r in history.cadence(sources, log, now, F.col("h")).collect()} == {"a": True, "b": False, "c": True, "d": True}


def test_greedy_clusters(spark):
    hashes = np.array([0b0, 0b111, 0b1111111, 0b1 << 20, 0b11], dtype=np.uint64)
    assert neardup.greedy(hashes, 3).tolist() == [0, 0, 1, 0, 0]
    assert neardup.greedy(np.array([0, 0b111111, 0b111], dtype=np.uint64), 3).tolist() == [0, 1, 0]  # a bridge joins the first only
    rows = spark.createDataFrame([(1, k, k, f"{int(h):016x}") for k, h in enumerate(hashes)], "page long, item_id long, place long, content_hash string")
    got = {r.item_id: (r.cluster, r.is_first, r.cluster_size) for r in neardup.collapse_pages(rows).collect()}
    assert got[0] == (0, True, 4) and got[2] == (1, True, 1) and got[3] == (0, False, 4)


def test_near_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 30)
    hashes = [int(b) ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 5))) for b in base for _ in range(4)]
    rows = spark.createDataFrame([(k, f"{h & (1 << 64) - 1:016x}") for k, h in enumerate(hashes)], "item_id long, content_hash string")
    for limit in (0, 3, 6):
        want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= limit}
        assert {tuple(r) for r in neardup.near_pairs(rows, limit).collect()} == want


def test_numbering(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("x"))
    assert [(r.x, r.rn) for r in trends.numbered(rows, [F.desc("x")]).orderBy("rn").collect()] == [(999 - k, k + 1) for k in range(1000)]


def test_store(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("item_id string, v int, published_at string")
    batch = spark.createDataFrame([("a", 1, "2026-07-01T00:00:00+00:00", 1), ("a", 2, "2026-07-01T00:00:00+00:00", 2), ("b", 3, "2026-07-02T00:00:00+00:00", 3)], "item_id string, v int, published_at string, seq int")
    s = store.Store(spark, str(tmp_path))
    assert s.read("items", schema).count() == 0
    assert s.insert("items", batch, schema, ["item_id"], "published_at", "seq") == 2 and s.insert("items", batch, schema, ["item_id"], "published_at", "seq") == 0
    assert sorted((r.item_id, r.v) for r in s.read("items", schema).collect()) == [("a", 1), ("b", 3)]
    assert s.delete("items", schema, spark.createDataFrame([("b",), ("zz",)], "item_id string"), ["item_id"]) == 1
    assert [r.item_id for r in s.read("items", schema).collect()] == ["a"] and not (tmp_path / "items" / "dt=2026-07-02").exists()
    assert s.delete("items", schema, spark.createDataFrame([("zz",)], "item_id string"), ["item_id"]) == 0


def test_rewrite_and_cache(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("item_id string, v int, published_at string")
    rows = spark.createDataFrame([("a", 1, "2026-07-01T00"), ("b", 2, "2026-07-02T00"), ("c", 3, "2026-07-02T00")], schema)
    s = store.Store(spark, str(tmp_path))
    s.append("items", rows, "published_at")
    before = {p.name for p in (tmp_path / "items" / "dt=2026-07-01").glob("*.parquet")}
    assert s.rewrite("items", schema, spark.createDataFrame([("b", 9), ("zz", 0)], "item_id string, v int"), ["item_id"], ["v"]) == 1
    assert sorted((r.item_id, r.v, str(r.dt)) for r in s.read("items", schema).collect()) == [("a", 1, "2026-07-01"), ("b", 9, "2026-07-02"), ("c", 3, "2026-07-02")]
    assert {p.name for p in (tmp_path / "items" / "dt=2026-07-01").glob("*.parquet")} == before
    words = spark.createDataFrame([("a", "k", "llm"), ("c", "k", "llm")], "item_id string, keyword string, method string")
    tables = {"items": rows, "item_keywords": words}
    assert checks.rebuild_cache(tables, "t_") == {"items": 3, "item_keywords": 2} and checks.open_cache(spark, ["items"], "t_")["items"].count() == 3
    for bad in ({"items": rows.unionAll(rows)}, {"item_keywords": words.unionAll(words)}, {"item_keywords": words.unionAll(spark.createDataFrame([("q", "k", "llm")], words.schema))}):
        with pytest.raises(ValueError):
            checks.rebuild_cache(tables | bad, "t_")
    assert checks.open_cache(spark, ["items"], "t_")["items"].count() == 3


def test_the_last_attempt_is_by_time(spark):
    """A log that was appended out of order gives the same as an ordered one."""
    log = spark.createDataFrame([("a", 1, "2026-01-02 00:00:00", "ok"), ("a", 2, "2026-01-01 00:00:00", "error"), ("a", 3, "2026-01-03 00:00:00", "skipped")], "source_id string, seq long, t string, status string")
    log = log.selectExpr("source_id", "seq", "to_timestamp(t) AS started_at", "status", "0 AS items_new", "'HTTP 503' AS error", "'direct' AS rung", "cast(null AS string) AS resolved_url")
    assert str(history.last_attempt(log).first().last_at) == "2026-01-02 00:00:00"
    own = history.health(log).first()
    assert own.last_status == "ok" and own.consecutive_failures == 0


def test_pages_of_nothing(spark):
    assert [tuple(r) for r in trends.page_index(spark.range(0)).collect()] == [(1, 1, 0, False, False)]
    assert [r["items"] for r in trends.page_index(spark.range(45)).orderBy("page").collect()] == [20, 20, 5]


def test_dml(spark):
    truth = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    change = spark.createDataFrame([("b", 9), ("c", 7)], "k string, v int")
    assert sorted(map(tuple, store.rewritten(truth, change, ["k"], ["v"]).collect())) == [("a", 1), ("b", 9)]
    assert sorted(map(tuple, store.upserted(truth, change, ["k"]).collect())) == [("a", 1), ("b", 9), ("c", 7)]


def test_extraction(spark):
    items = spark.createDataFrame([(f"i{k:02d}", "Graph databases grow", "Graph databases scale well. Graph queries are fast.") for k in range(60)], "item_id string, title string, summary string")
    assert {r.batch: r["count"] for r in extract.batches(items).groupBy("batch").count().collect()} == {0: 25, 1: 25, 2: 10}

    def model(rows):
        import json

        if rows[0]["item_id"] == "i25":
            raise RuntimeError("down")
        words = ["https://x"] if rows[0]["item_id"] == "i50" else [f"k{n}" * 2 for n in range(10)]
        return "```json\n" + json.dumps([{"item_id": r["item_id"], "keywords": words} for r in rows]) + "\n```"

    got = extract.extract(items, model).collect()
    by = {}
    for r in got:
        by.setdefault(r.item_id, []).append((r.rank, r.keyword, r.method))
    assert len(by) == 60 and len(by["i00"]) == 8 and sorted(by["i00"])[0] == (1, "k0k0", "llm")
    assert {m for i in ("i25", "i50", "i59") for *_, m in by[i]} == {"fallback"} and any("graph" in k for _, k, _ in by["i50"])
    assert {r.method for r in extract.extract(items, model, budget=0).collect()} == {"fallback"}


def test_replies_and_scores(spark):
    asked = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (2, "d")], "batch long, item_id string")
    replies = spark.createDataFrame([(0, '[{"item_id":"a","keywords":["xx"]},{"item_id":"b","keywords":[]}]'), (1, '[{"item_id":"c","keywords":["x"]}]'), (2, "nonsense")], "batch long, reply string")
    got = {(r.batch, r.item_id): r.ok for r in extract.checked_replies(replies, asked).collect()}
    assert got == {(0, "a"): True, (0, "b"): True, (1, None): False, (2, None): False}
    expected = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", ["z"])], "item_id string, expected array<string>")
    predicted = spark.createDataFrame([("a", ["y", "w"]), ("b", ["q"])], "item_id string, predicted array<string>")
    assert {r.item_id: r.score for r in extract.score_predictions(predicted, expected).collect()} == {"a": 1 / 3, "b": None, "c": 0.0}
    assert extract.digest_reply('{"title":" T ","tldr":["a"," "],"body_md":"b"}') == ("T", ["a"], "b")
    for bad in ("[]", '{"title":"","tldr":[],"body_md":"b"}', "x"):
        with pytest.raises(ValueError):
            extract.digest_reply(bad)


def test_digests(canned, spark):
    items, keywords, sources, groups = canned
    rows = digest.inputs(items, keywords, sources, groups, RULES, WEEK, preceding(WEEK))
    assert [(r.keyword, r.cnt, r.prev_cnt, r.rising) for r in rows.orderBy("rn").collect()] == [("genai", 3, 1, True), ("agents", 1, 0, False), ("llm", 1, 1, False)]
    made = digest.template(rows, trends.category_item_count(items, sources, groups, WEEK), "daily", "2026-07-07", min_items=3).first()
    assert made.digest_id == "daily-ai-2026-07-07" and made.body_md.startswith("**TL;DR**\n\n- genai (3)\n- agents (1)") and "Rising: genai. Top keywords across 3 items" in made.body_md
    assert digest.template(rows, trends.category_item_count(items, sources, groups, WEEK), "daily", "k").count() == 0
    empty = spark.createDataFrame([], "category string")
    assert digest.all_done(empty, spark.createDataFrame([], "category string")).first().all_done


def test_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v int")
    assert [(r.key, r.n) for r in checks.duplicate_keys(df, ["k"], "pk").collect()] == [("a", 2)]
    with pytest.raises(ValueError, match="pk: a"):
        checks.require(checks.duplicate_keys(df, ["k"], "pk"))
    checks.require(checks.duplicate_keys(df, ["v"], "v"))


def test_ingest(spark):
    raw = spark.createDataFrame(
        [("s", "rss", "e1", "https://E.com/a/?utm_x=1", "T", "<p>S</p>", None, "", "en", 1), ("s", "rss", "e1", "https://e.com/b", "T2", None, None, "2026-01-01T00:00:00+00:00", None, 2), ("s", "rss", " ", "https://e.com/c", "T3", None, None, None, None, 3)],
        "source_id string, kind string, external_id string, url string, title string, summary string, author string, published_at string, lang string, seq int",
    )
    truth = spark.createDataFrame([], "item_id string")
    got = {r.title: r for r in ingest.new_items(raw, truth, F.lit("2026-02-02T00:00:00+00:00")).collect()}
    assert set(got) == {"T", "T3"} and got["T"].published_at == "2026-02-02T00:00:00+00:00" and got["T"].canonical_url == "https://e.com/a" and got["T"].summary == "S" and got["T3"].external_id is None
    again = ingest.new_items(raw, spark.createDataFrame([(r.item_id,) for r in got.values()], "item_id string"), F.lit("x"))
    assert again.count() == 0
    assert ingest.new_items(raw, truth, F.lit("x"), cap=1).count() == 1
    assert udfs.simhash("T") == got["T"].content_hash


def test_keywords_of_a_long_text_take_no_quadratic_time():
    """A text of very many different words; a tie is ordered by the phrase."""
    from time import process_time

    began = process_time()
    assert len(extract.score_phrases(" ".join(f"word{k}" for k in range(30_000)))) == 8
    assert process_time() - began < 8
    assert extract.score_phrases("bb aa. bb aa.", 3) == ["bb aa", "aa", "bb"]


def test_fallback_scores_a_text_once(spark):
    items = spark.createDataFrame([(1, "Alpha beta", "gamma")], "item_id long, title string, summary string")
    found = extract.extract(items)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and found.count() == 4


def test_pairs_of_one_hash_are_spread(spark, monkeypatch):
    """All pairs of many equal hashes, near ones and repeated rows, in several tasks."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rows = [(k, f"{7 if k < 40 else 6 if k < 55 else 1 << k % 60:016x}") for k in range(70)] + [(3, f"{7:016x}"), (60, f"{6:016x}")]
    want = sorted((*sorted((a, b)), (int(x, 16) ^ int(y, 16)).bit_count()) for k, (a, x) in enumerate(rows) for b, y in rows[k + 1 :] if a != b and (int(x, 16) ^ int(y, 16)).bit_count() <= 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = neardup.near_pairs(spark.createDataFrame(rows, "item_id long, content_hash string"), 1)
        assert sorted(map(tuple, found.collect())) == want
        one = found.where("distance = 0 AND id_a < 40 AND id_b < 40")
        assert one.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
