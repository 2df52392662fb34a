import json

import pytest

from tidewheel.operators.store import Store
from tidewheel.sources import config, feeds, records
from tidewheel.sources.registry import CannedReader, Registry
from tidewheel.sources.transcripts import TranscriptStore, transcripts
from tidewheel.streaming import ingest as streams

RSS = b"""<rss><channel><language>en</language><item><title>A &lt;b&gt;bold&lt;/b&gt;</title><link>https://e.com/a</link><guid>g1</guid><pubDate>Mon, 06 Jul 2026 10:00:00 +0200</pubDate><author>x</author><description>d</description></item>
<item><title>B</title><link>https://e.com/b</link><pubDate>never</pubDate></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom" xmlns:yt="u"><entry><id>i</id><yt:videoId>v1</yt:videoId><title>T</title><link rel="alternate" href="https://y.com/v1"/><author><name>N</name></author><updated>2026-07-06T10:00:00Z</updated></entry></feed>"""


def test_feeds():
    a, b = feeds.parse_feed(RSS)
    assert a == {"url": "https://e.com/a", "title": "A bold", "external_id": "g1", "summary": "d", "author": "x", "published_at": "2026-07-06T08:00:00+00:00", "lang": "en"}
    assert b["published_at"] is None and b["external_id"] is None
    (v,) = feeds.parse_feed(ATOM)
    assert (v["external_id"], v["url"], v["author"], v["published_at"]) == ("v1", "https://y.com/v1", "N", "2026-07-06T10:00:00+00:00")
    assert feeds.parse_feed(b"<rss><channel></channel></rss>") == []
    assert len(feeds.parse_feed(RSS[:-10])) == 2
    with pytest.raises(ValueError):
        feeds.parse_feed(b"<html><oops")


def test_listing(spark):
    good = {"data": {"children": [{"data": {"id": "a", "title": "T &amp; x", "selftext": "", "author": "u", "permalink": "/r/x/1", "created_utc": 0.0}}, {"data": {"id": "b", "title": "U", "selftext": "s", "url": "https://e.com"}}]}}
    rows = feeds.parse_listing(spark.createDataFrame([("ok", json.dumps(good)), ("bad", "{"), ("empty", '{"data":{"children":[]}}')], "source_id string, payload string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source_id, []).append(r)
    assert [(r.url, r.title, r.summary, r.published_at) for r in by["ok"]] == [("https://www.reddit.com/r/x/1", "T & x", None, "1970-01-01T00:00:00+00:00"), ("https://e.com", "U", "s", None)]
    assert by["bad"][0].error == "malformed listing json" and by["empty"][0].error is None


def getter(pages):
    def get(url):
        if url not in pages:
            raise OSError("HTTP 404")
        return pages[url]

    return get


def test_ladder(spark):
    pages = {"https://a.com/feed/": RSS, "https://b.com/": b'<link rel="alternate" type="application/rss+xml" href="/rss.xml">', "https://b.com/rss.xml": RSS, "https://c.substack.com/archive": b'<a href="/p/one">One</a>', "https://d.com/m": RSS, "https://e.com/f": b"<rss><channel/></rss>"}
    get = getter(pages)
    got = [feeds.acquire(u, get, m) for u, m in (("https://a.com/feed", None), ("https://b.com/x", None), ("https://c.substack.com/feed", None), ("https://d.com/f", "https://d.com/m"), ("https://e.com/f", None), ("https://z.com/f", None))]
    assert [g["rung"] for g in got] == ["alt_endpoint", "autodiscovery", "substack_archive", "mirror", "direct", None]
    assert got[4]["items"] == [] and got[5]["error"] and json.loads(got[0]["trace"])[0]["outcome"] == "error"
    sources = spark.createDataFrame([("a", "https://a.com/feed", None), ("z", "https://z.com/f", None)], "source_id string, url string, active_url string")
    rows = {r.source_id: r for r in feeds.fetch_all(sources, get).collect()}
    assert len(rows["a"]["items"]) == 2 and rows["z"].reason == "fetch_error" and rows["z"].rung is None


@pytest.mark.parametrize("url", ["http://e.com/", "ftp://e.com", "https://u@e.com/", "https://127.0.0.1/", "https://10.1.1.1/", "https://e.com:22/", "https:///x", "https://2130706433/", "https://e.com/\x01"])
def test_addresses_that_are_refused(url):
    with pytest.raises(ValueError):
        feeds.checked_address(url)


def test_data_source(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(RSS), (tmp_path / "b.xml").write_bytes(b"<oops")
    spark.dataSource.register(feeds.FeedPayloads)
    rows = spark.read.format("feed_payloads").load(str(tmp_path)).collect()
    assert sorted((r.file, r.position) for r in rows) == [("a.xml", 0), ("a.xml", 1), ("b.xml", -1)] and [bool(r.error) for r in rows if r.file == "b.xml"] == [True]
    query = spark.readStream.format("feed_payloads").load(str(tmp_path)).writeStream.format("memory").queryName("feed_rows").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        assert spark.sql("SELECT count(*) AS n FROM feed_rows").first().n == 3
    finally:
        query.stop()


def test_files_that_come_late(spark, tmp_path):
    """A file is read whatever its name, once it is newer than what has been read."""
    import os

    source = tmp_path / "in"
    source.mkdir()
    (source / "m.xml").write_bytes(RSS)
    os.utime(source / "m.xml", (1_000, 1_000))
    reader = feeds.FeedStream({"path": str(source)})
    rows, end = reader.read(reader.initialOffset())
    assert len(list(rows)) == 2
    (source / "a.xml").write_bytes(RSS)
    rows, later = reader.read(end)
    assert [r[0] for r in rows] == ["a.xml"] * 2 and [r[0] for r in reader.readBetweenOffsets(end, later)] == ["a.xml"] * 2
    assert reader.read(later)[1] == later
    for k in range(2):
        query = feeds.feed_stream(spark, str(source)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 4 + 2 * k
        (source / "b.xml").write_bytes(RSS)


def test_records(spark, tmp_path):
    day = tmp_path / "log" / "2026" / "07"
    day.mkdir(parents=True)
    (day / "08.jsonl").write_text('{"source_id":"a","status":"ok","started_at":"t","extra":1}\n\n{"source_id":"b","status":"ok","started_at":"t"}\n')
    assert records.read_lines(spark, str(tmp_path / "log"), records.FETCH_LOG).count() == 2 and records.read_lines(spark, str(tmp_path / "none"), records.ITEMS).count() == 0
    ordered = records.read_sequenced(spark, str(tmp_path / "log"), records.FETCH_LOG).orderBy("started_at", "seq").collect()
    assert [r.source_id for r in ordered] == ["a", "b"]
    (day / "09.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        records.read_lines(spark, str(tmp_path / "log"), records.FETCH_LOG).collect()
    assert records.read_lines(spark, str(tmp_path / "log"), records.FETCH_LOG, strict=False).where("source_id IS NOT NULL").count() == 2
    (tmp_path / "runs").mkdir()
    for k in ("r1", "r2"):
        (tmp_path / "runs" / f"{k}.json").write_text(json.dumps({"run_id": k, "command": "x", "counts": {"n": 1}}, indent=1))
    assert records.latest_manifest(records.read_documents(spark, str(tmp_path / "runs"), records.MANIFEST)).first().run_id == "r2"
    sizes = {r.folder: r.bytes for r in records.folder_sizes(spark, str(tmp_path)).collect()}
    assert set(sizes) == {"log", "runs"}


def test_config(spark, tmp_path):
    (tmp_path / "groups").mkdir()
    (tmp_path / "groups" / "ai.yml").write_text("group: ai\nname: AI\ncategory: ai\nsources:\n- {id: a, kind: rss, url: 'https://e.com/f'}\n- {id: b, kind: reddit, subreddit: x, enabled: false}\n- {id: c, kind: youtube, channel_id: q, status: degraded, config: {b: 1, a: 2}}\n")
    (tmp_path / "keywords.yml").write_text("aliases: {gen ai: genai}\nmute: [webinar]\npin: [anthropology]\n")
    found = config.Config(str(tmp_path))
    rows = {r.source_id: r for r in found.sources(spark).collect()}
    assert rows["b"].status == "dead" and not rows["b"].enabled and rows["b"].url == "https://www.reddit.com/r/x/new.json" and rows["c"].enabled and rows["c"].config_json == '{"a":2,"b":1}'
    assert found.rules().aliases == {"gen ai": "genai"} and found.groups(spark).first().category == "ai" and found.problems({"rss", "youtube"}) == [] and found.settings() == {}
    assert len(found.problems({"rss"})) == 1
    bad = {"x.yml": {"group": "x", "sources": [{"id": "a", "kind": "rss"}, {"id": "a", "kind": "rss", "url": "u"}, {"id": "a", "kind": "rss", "url": "u", "status": "dead"}, {"id": "d", "kind": "rss", "url": "v", "status": "active", "enabled": False}]}, "y.yml": {"group": "x"}}
    assert len(config.problems(bad)) == 6


def test_registry_and_transcripts(spark, tmp_path):
    registry = Registry()
    registry.register("rss", CannedReader({"a": [1], "b": ValueError("x")}, [2]))
    with pytest.raises(ValueError):
        registry.register("rss", None)
    with pytest.raises(KeyError):
        registry.reader("x")
    assert registry.reader("rss")("a") == [1] and registry.reader("rss")("q") == [2]
    with pytest.raises(ValueError):
        registry.reader("rss")("b")
    calls = []
    store = TranscriptStore(str(tmp_path / "t"), lambda v: calls.append(v) or "word " * 10, max_chars=12)
    ref = store.ensure("v1")
    assert store.ensure("v1") == ref and calls == ["v1"] and store.read(ref) == "word word wo" and store.read(None) is None
    with pytest.raises(ValueError):
        store.read("../x")
    assert {r.transcript_ref: r.transcript for r in transcripts(spark, str(tmp_path / "t")).collect()} == {ref: "word word wo"}


def test_stream_into_the_store(spark, tmp_path):
    source, kind = tmp_path / "in", "item_id string, published_at string, seq long"
    source.mkdir()
    rows = [("a", "2026-07-01T00:00:00+00:00", 1), ("a", "2026-07-01T00:00:00+00:00", 2), ("b", "2026-07-02T00:00:00+00:00", 3)]
    for k in range(2):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(kind).parquet(str(source))
        query = streams.idempotent_sink(stream, Store(spark, str(tmp_path / "truth")), "items", ["item_id"], "published_at", "seq", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "truth" / "items")).count() == 2


def test_streak_state(spark, tmp_path):
    source, kind = tmp_path / "in", "source_id long, seq long, status string"
    source.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches = [[(1, 1, "error"), (1, 2, "error"), (2, 1, "ok")], [(1, 3, "skipped"), (1, 4, "error"), (2, 2, "error")], [(1, 5, "empty")]]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(source))
        stream = streams.streaks(spark.readStream.schema(kind).parquet(str(source)))
        query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert dict(seen[:2]) == {1: 2, 2: 0} and dict(seen[2:4]) == {1: 3, 2: 1} and seen[4:] == [(1, 0)]


def test_daily_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2026-03-08 07:30:00",), ("2026-03-09 05:30:00",), ("2026-03-09 06:30:00",)], "t string").selectExpr("to_timestamp(t) AS at")
    got = {str(r.day): r.n for r in streams.daily_counts(rows).collect()}
    assert got == {"2026-03-08": 2, "2026-03-09": 1} and streams.trailing_counts(rows).count() >= 7


def test_daily_counts_as_a_stream(spark, tmp_path):
    """A day is one row, written when the watermark has passed its end; what comes later than that is dropped."""
    source = tmp_path / "in"
    source.mkdir()
    out = []
    for times in (["2026-03-08 07:30:00", "2026-03-08 20:00:00"], ["2026-03-09 05:30:00", "2026-03-12 12:00:00"], ["2026-03-08 08:00:00", "2026-03-13 12:00:00"]):
        spark.createDataFrame([(t,) for t in times], "t string").selectExpr("to_timestamp(t) AS at").coalesce(1).write.mode("append").parquet(str(source))
        stream = streams.daily_counts(spark.readStream.schema("at timestamp").parquet(str(source)), "1 day")
        query = stream.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    days = [str(d) for d, _ in out]
    assert len(days) == len(set(days)) and dict((str(d), n) for d, n in out)["2026-03-08"] == 3
