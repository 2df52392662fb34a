import json
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import extract, output
from tidewheel.operators.rules import Rules
from tidewheel.sources import feeds

NOW = datetime(2026, 7, 8, tzinfo=UTC)


def test_page_payloads(spark, tmp_path):
    kind = "page long, place long, total_pages long, item_id string, kind string, published_at string, source_id string, source_name string, title string, url string, tags array<string>, similar_count long, cluster_head boolean"
    rows = [(1, 1, 2, "i1", "rss", "t", "s1", "S1", "T", "https://e.com/a", ["x"], 1, True), (1, 2, 2, "i2", "rss", "t", "s2", "S2", "T", "javascript:x", ["y"], 0, False), (2, 1, 2, "i3", "reddit", "t", "s1", "S1", "U", "javascript:x", [], 0, True)]
    found = output.page_payloads(spark.createDataFrame(rows, kind))
    one, two = (json.loads(r.payload) for r in found.orderBy("page").collect())
    assert [i["item_id"] for i in one["items"]] == ["i1"] and one["items"][0]["similar_count"] == 1 and one["facets"] == {"keywords": ["x", "y"], "kinds": ["rss"], "sources": [{"id": "s1", "name": "S1"}, {"id": "s2", "name": "S2"}]}
    assert "url" not in two["items"][0] and (two["page"], two["total_pages"]) == (2, 2)
    output.write_payloads(found, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).count() == 2


def test_snapshot_manifest_and_reports(spark):
    health = spark.createDataFrame([("b", 2), ("a", 1)], "source_id string, attempts int")
    value = json.loads(output.snapshot(health, "r", NOW).first().value)
    assert [s["source_id"] for s in value["sources"]] == ["a", "b"] and value["generated_at"] == "2026-07-08T00:00:00+00:00"
    assert output.new_run_id(NOW).startswith("20260708T000000Z-") and output.manifest(spark, "r", "ingest", NOW, True, {"n": 1}, []).first().counts == {"n": 1}
    report = spark.createDataFrame([("b", "rss", "g", "active", "error", None, "tls", 16, "dead", "why"), ("a", "rss", "g", "active", "ok", "direct", None, 0, None, None)], "source_id string, kind string, group_id string, status string, last_status string, last_rung string, error_class string, consecutive_failures int, proposed_status string, reason string")
    assert [r.line for r in output.doctor_table(report).collect()] == ["a | rss | active | ok | direct | - | 0", "b | rss | active | error | - | tls | 16 -> dead: why"]
    assert output.patch_lines(report).first().patch == "- id: b\n  status: dead\n  evidence: why"
    sizes = output.size_report(spark.createDataFrame([("b", 5), ("a", 7)], "folder string, bytes long"), warn=10, fail=20).first()
    assert (sizes.total, sizes.level, sizes.folders) == (12, "warn", "a=7, b=5")


def test_digest_views(spark):
    rows = spark.createDataFrame([("1", "daily", "ai", "2026-01-02"), ("2", "weekly", "dev", "2026-01-03"), ("3", "daily", "dev", "2026-01-01")], "digest_id string, kind string, category string, created_at string")
    assert {r.digest_id: r.is_new for r in output.visible_digests(rows, "daily", (), "2026-01-01").collect()} == {"1": True, "3": False}
    assert output.visible_digests(rows, None, ("dev",)).count() == 2
    assert [r.category for r in output.first_seen_order(rows, "category", ["digest_id"]).collect()] == ["ai", "dev"]


def test_paths(tmp_path):
    assert output.contained(str(tmp_path), "a/b") == str(tmp_path / "a" / "b")
    os.symlink("/etc", tmp_path / "link")
    for bad in ("../x", "/etc/passwd", "link/x"):
        with pytest.raises(ValueError):
            output.contained(str(tmp_path), bad)
    assert output.safe_output(str(tmp_path / "out")) == str(tmp_path / "out")
    for bad, sources in (("/", ()), (str(tmp_path / "link"), ()), (str(tmp_path), (str(tmp_path / "data"),))):
        with pytest.raises(ValueError):
            output.safe_output(bad, sources)


def test_extraction_pipelines(spark):
    items = spark.createDataFrame([("a", "Gen AI tools", "<p>Gen AI tools</p>"), ("b", "Old news", None)], "item_id string, title string, summary string")
    keywords = spark.createDataFrame([("b", "news", 1, "fallback")], "item_id string, keyword string, rank int, method string")
    model = lambda rows: json.dumps([{"item_id": r["item_id"], "keywords": ["Gen AI", "genai", "webinar", "zz"]} for r in rows])
    new = extract.extract_new(items, keywords, Rules({"gen ai": "genai"}, ("webinar",)), model).orderBy("rank").collect()
    assert [(r.item_id, r.keyword, r.rank) for r in new] == [("a", "genai", 1), ("a", "zz", 4)]
    assert {(r.item_id, r.keyword) for r in extract.backfill(items, keywords, model).collect()} == {("b", k) for k in ("Gen AI", "genai", "webinar", "zz")}
    fresh, left = extract.renormalize(items, keywords.unionAll(spark.createDataFrame([("a", "x", 1, "llm")], keywords.schema)))
    assert {r.item_id: r.summary for r in fresh.collect()} == {"a": "Gen AI tools", "b": None} and [r.item_id for r in left.collect()] == ["b"]
    assert extract.grouped(extract.extract_new(items, keywords, Rules(), model)).first().keywords == ["gen ai", "genai", "webinar", "zz"]
    extract.quality_gate(keywords)
    with pytest.raises(ValueError):
        extract.quality_gate(keywords.withColumn("keyword", F.lit("x" * 61)))


def test_transports():
    calls, waits = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise feeds.Refused(503, 7 if len(calls) == 2 else None)
        return b"ok"

    assert feeds.retrying(flaky, sleep=waits.append)("u") == b"ok" and waits == [1.0, 7]
    with pytest.raises(feeds.Refused):
        feeds.retrying(lambda u: (_ for _ in ()).throw(feeds.Refused(403)), sleep=waits.append)("u")
    assert len(waits) == 2
    seen = []
    cached = feeds.Conditional(lambda u, h: seen.append(h) or ((304, {}, b"") if h else (200, {"etag": "e"}, b"<rss><channel><item><title>t</title></item></channel></rss>")))
    assert len(feeds.parse_feed(cached("u"))) == 1 and feeds.parse_feed(cached("u")) == [] and seen == [{}, {"If-None-Match": "e"}]
