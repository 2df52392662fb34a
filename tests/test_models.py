"""Calls of a model, digests by a model, readers that check their records, and the guarded way out."""

import json

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import digest, extract, model
from tidewheel.sources import feeds, records
from tidewheel.sources.guard import Guarded, Unsafe


def answer(text="x", **usage):
    return 200, json.dumps({"choices": [{"message": {"content": text}}], "usage": usage}).encode()


def test_attempts_and_pauses():
    said, slept = [(503, b""), OSError("reset"), answer("hello", prompt_tokens=3, completion_tokens=1)], []

    def transport(_):
        x = said.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    call = model.completing(transport, sleep=slept.append, jitter=lambda: 0.5)
    assert call({}) == ("hello", 3, 1) and slept == [1.5, 2.5]
    said[:] = [(429, b"")] * 3
    with pytest.raises(model.ModelError, match="3 attempts: HTTP 429"):
        call({})
    said[:] = [(401, b"")]
    with pytest.raises(model.ModelError, match="HTTP 401"):
        call({})
    for body in (b"{", b"{}", b'{"choices": []}', b'{"choices": [{"message": {"content": null}}]}'):
        said[:] = [(200, body)]
        with pytest.raises(model.ModelError, match="malformed"):
            call({})


def items(spark, n=100):
    rows = [(f"i{k:03d}", "Tide tables", "Tide tables tell of the tide.") for k in range(n)]
    return spark.createDataFrame(rows, "item_id string, title string, summary string")


def good(rows):
    return json.dumps([{"item_id": r["item_id"], "keywords": ["tide"]} for r in rows])


def test_a_malformed_reply_is_asked_for_once_more(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def first_bad(rows):
        with open(seen, "a+") as f:
            f.seek(0)
            again = rows[0]["item_id"] in f.read().split()
            f.write(rows[0]["item_id"] + "\n")
        return good(rows) if again or rows[0]["item_id"] != "i025" else "nonsense"

    kept = []
    found = extract.extract(items(spark), first_bad, retries=4, log=kept.append)
    assert {r.method for r in found.collect()} == {"llm"} and found.count() == 100
    calls = kept[0].orderBy("batch", "attempt").collect()
    assert [(c.batch, c.attempt, c.status, c.valid) for c in calls] == [(0, 1, "ok", True), (1, 1, "ok", False), (1, 2, "ok", True), (2, 1, "ok", True), (3, 1, "ok", True)]
    log = model.log_rows(kept[0], "r1", "extract", "m", "2026-01-01T00:00:00+00:00").collect()
    assert len(log) == 5 and {r.input_items for r in log} == {25} and set(kept[0].columns) >= {"tokens_in", "tokens_out"}
    out = model.outcome(kept[0], extract.batches(items(spark))).first()
    assert (out.batches, out.by_model, out.by_fallback, out.retries, out.budget_exhausted) == (4, 4, 0, 1, False)


def test_budgets(spark):
    def never(rows):
        return "nonsense"

    def down(rows):
        raise OSError("down")

    asked = extract.batches(items(spark))
    got = lambda m, **k: [(c.batch, c.attempt, c.status) for c in extract.ask(asked, m, **k).orderBy("batch", "attempt").collect()]
    assert got(never, retries=2) == [(0, 1, "ok"), (0, 2, "ok"), (1, 1, "ok"), (1, 2, "ok"), (2, 1, "ok"), (3, 1, "ok")]
    assert got(never, budget=3) == [(0, 1, "ok"), (0, 2, "ok"), (1, 1, "ok")]
    assert got(down) == [(k, 1, "error") for k in range(4)]
    assert got(good, budget=2) == [(0, 1, "ok"), (1, 1, "ok")]
    assert model.outcome(extract.ask(asked, good, budget=2), asked, 2).first().budget_exhausted
    assert not model.outcome(extract.ask(asked, good, budget=4), asked, 4).first().budget_exhausted
    assert {r.method for r in extract.extract(items(spark), good, budget=2).collect()} == {"llm", "fallback"}


def test_payload_with_transcripts(spark):
    rows = spark.createDataFrame([(0, "a", "T", "s", "youtube", "t1"), (0, "b", "T", None, "rss", "t1"), (0, "c", "T", "s" * 900, "youtube", None)], "batch long, item_id string, title string, summary string, kind string, transcript_ref string")
    told = spark.createDataFrame([("t1", "spoken " * 400)], "transcript_ref string, transcript string")
    got = json.loads(extract.payloads(rows, transcripts=told).first().payload)
    assert [("transcript" in x, len(x["summary"])) for x in got] == [(True, 1), (False, 0), (False, 500)] and len(got[0]["transcript"]) <= 1500
    assert "transcript" not in extract.payloads(rows).first().payload


def test_digests_by_a_model(spark):
    rows = spark.createDataFrame([("ai", "tide", 4, 1, True, 1), ("sea", "wave", 3, 3, False, 1)], "category string, keyword string, cnt long, prev_cnt long, rising boolean, rn int")
    counts = spark.createDataFrame([("ai", 12), ("sea", 11), ("low", 2)], "category string, item_count long")
    examples = spark.createDataFrame([("ai", "tide", 1, "One", "s" * 900), ("ai", "tide", 2, "Two", None)], "category string, keyword string, rn int, title string, summary string")
    asked = digest.payloads(rows, counts, examples, "daily", "2026-01-01", "2026-01-02")
    shown = {r.category: json.loads(r.payload) for r in asked.collect()}
    assert [(len(x["summary"]), x["title"]) for x in shown["ai"]["keywords"][0]["examples"]] == [(300, "One"), (0, "Two")] and shown["sea"]["keywords"][0]["examples"] == [] and shown["ai"]["item_count"] == 12

    def told(payload):
        if json.loads(payload)["category"] == "sea":
            raise OSError("down")
        return json.dumps({"title": " The tide ", "tldr": ["up", ""], "body_md": "It rose."})

    got = {r.category: r for r in digest.generate(rows, counts, asked, told, "daily", "2026-01-01", name="m1").collect()}
    assert set(got) == {"ai", "sea"} and (got["ai"].model, got["ai"].title, got["ai"].body_md) == ("m1", "The tide", "**TL;DR**\n\n- up\n\nIt rose.")
    assert (got["sea"].model, got["sea"].prompt_version) == ("template", "none") and got["sea"].digest_id == "daily-sea-2026-01-01"
    assert {r.model for r in digest.generate(rows, counts, asked, None, "daily", "k").collect()} == {"template"}


ITEM = {"item_id": "a", "source_id": "s", "kind": "rss", "canonical_url": "u", "title": "t", "published_at": "2026-01-02", "fetched_at": "x", "content_hash": "0"}


def test_scans_are_ordered_and_checked(spark, tmp_path):
    folder = tmp_path / "items" / "2026" / "01"
    folder.mkdir(parents=True)
    rows = [ITEM | {"item_id": "c"}, ITEM | {"item_id": "b", "summary": None}, ITEM | {"item_id": "d", "published_at": "2026-01-01"}]
    (folder / "01.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    assert [r.item_id for r in records.scan(spark, str(tmp_path / "items"), "items").collect()] == ["d", "b", "c"]
    assert records.scan(spark, str(tmp_path / "none"), "items").count() == 0
    for bad, said in (({"extra": 1}, "further fields: extra"), ({"kind": "fax"}, "kind: fax"), ({"title": None}, "title: missing"), ({"title": ["x"]}, None)):
        (folder / "02.jsonl").write_text("\n" + json.dumps(ITEM | bad) + "\n")
        if said is None:
            continue
        with pytest.raises(Exception, match=said):
            records.scan(spark, str(tmp_path / "items"), "items").collect()
        assert [(r.line, r.fault) for r in records.faults(spark, str(tmp_path / "items"), "items").collect()] == [(2, said)]
    (folder / "02.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="not an object"):
        records.scan(spark, str(tmp_path / "items"), "items").collect()


def test_other_scans(spark, tmp_path):
    for name in ("log", "digests", "llm"):
        (tmp_path / name).mkdir()
    lines = [{"source_id": s, "run_id": "r", "started_at": t, "status": "ok", "new_field": 1} for s, t in (("a", "2"), ("b", "1"), ("c", "2"))]
    (tmp_path / "log" / "1.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert [r.source_id for r in records.scan(spark, str(tmp_path / "log"), "fetch_log").collect()] == ["b", "a", "c"]
    (tmp_path / "log" / "2.jsonl").write_text(json.dumps(lines[0] | {"rung": "stairs"}))
    with pytest.raises(Exception, match="rung: stairs"):
        records.scan(spark, str(tmp_path / "log"), "fetch_log").collect()
    whole = {c.split()[0]: "x" for c in records.DIGESTS.split(", ")} | {"kind": "daily"}
    for k in ("d2", "d1"):
        (tmp_path / "digests" / f"{k}.json").write_text(json.dumps(whole | {"digest_id": k}, indent=1))
    assert [r.digest_id for r in records.scan(spark, str(tmp_path / "digests"), "digests", one_per_file=True).collect()] == ["d1", "d2"]
    calls = [{"run_id": "r", "purpose": p, "model": "m", "status": "ok", "created_at": t} for p, t in (("extract", "2"), ("digest", "2"), ("extract", "1"))]
    (tmp_path / "llm" / "1.jsonl").write_text("\n".join(map(json.dumps, calls)))
    assert [(r.created_at, r.purpose) for r in records.scan(spark, str(tmp_path / "llm"), "llm_log").collect()] == [("1", "extract"), ("2", "digest"), ("2", "extract")]


def web(pages, seen=None):
    def exchange(method, url, headers, body):
        if seen is not None:
            seen.append((method, url, dict(headers)))
        return pages[url]

    return exchange


def public(host, port):
    return ["93.184.216.34"]


def test_redirects():
    seen = []
    pages = {"https://a.com/1": (302, {"Location": "/2"}, []), "https://a.com/2": (301, {"location": "https://b.com/x"}, []), "https://b.com/x": (200, {}, [b"he", b"re"])}
    assert Guarded(web(pages, seen), public).request("GET", "https://a.com/1", {"Authorization": "s", "Accept": "x"})[2] == b"here"
    assert [("Authorization" in h, "Accept" in h) for _, _, h in seen] == [(True, True), (True, True), (False, True)]
    loop = {"https://a.com/1": (302, {"location": "/2"}, []), "https://a.com/2": (302, {"location": "/1"}, [])}
    endless = {f"https://a.com/{k}": (302, {"location": f"/{k + 1}"}, []) for k in range(9)}
    cases = [
        (loop, "https://a.com/1", "loop"), (endless, "https://a.com/0", "redirects"), ({"https://a.com/": (302, {}, [])}, "https://a.com/", "redirect"), ({"https://a.com/": (302, {"location": "http://a.com/"}, [])}, "https://a.com/", "address"),
        ({"https://a.com/": (302, {"location": "https://10.0.0.1/"}, [])}, "https://a.com/", "address"), ({}, "ftp://a.com/", "address"), ({"https://a.com/": (200, {}, [b"x" * 9, b"y"])}, "https://a.com/", "body"),
    ]
    for pages, url, kind in cases:
        with pytest.raises(Unsafe) as e:
            Guarded(web(pages), public, most=9)(url)
        assert e.value.kind == kind
    with pytest.raises(Unsafe) as e:
        Guarded(web({"https://a.com/": (302, {"location": "http://b.com/"}, [])}), public, plain_hosts=frozenset({"b.com"}))("https://a.com/")
    assert e.value.kind == "downgrade"


def test_names_are_resolved_before_anything_is_sent():
    seen = []
    for found in (["10.0.0.1"], ["93.184.216.34", "::1"], []):
        with pytest.raises(Unsafe):
            Guarded(web({}, seen), lambda h, p, found=found: found)("https://a.com/")
    assert not seen
    with pytest.raises(feeds.Refused):
        Guarded(web({"https://a.com/": (404, {}, [])}), public)("https://a.com/")
    with pytest.raises(Unsafe):
        Guarded(web({"https://a.com/": (303, {"location": "/2"}, [])}), public).request("POST", "https://a.com/", body=b"x")


def test_listing_and_the_feed_beside_it():
    child = {"data": {"permalink": "/r/x/1", "title": "A &amp; B", "id": "1", "selftext": "", "author": "z", "created_utc": 0}}
    body = json.dumps({"data": {"children": [child]}}).encode()
    feed = b"<rss><channel><item><title>F</title><link>https://e.com/1</link></item></channel></rss>"
    asked = []

    def get(pages):
        def one(url):
            asked.append(url)
            if url not in pages:
                raise feeds.Refused(403)
            return pages[url]

        return one

    url = "https://www.reddit.com/r/x/new.json?sort=new"
    direct = feeds.acquire_listing(url, get({"https://www.reddit.com/r/x/new.json?sort=new&limit=50": body}))
    assert direct["rung"] == "direct" and direct["items"][0]["url"] == "https://www.reddit.com/r/x/1" and direct["items"][0]["title"] == "A & B" and direct["items"][0]["published_at"] == "1970-01-01T00:00:00+00:00"
    plain = "https://www.reddit.com/r/x/new.json"
    beside = feeds.acquire_listing(plain, get({"https://www.reddit.com/r/x/new.rss": feed}))
    assert (beside["rung"], beside["resolved_url"], beside["items"][0]["title"]) == ("alt_endpoint", "https://www.reddit.com/r/x/new.rss", "F") and len(json.loads(beside["trace"])) == 2
    asked.clear()
    broken = feeds.acquire_listing(plain, get({"https://www.reddit.com/r/x/new.json?limit=50": b"{}", "https://www.reddit.com/r/x/new.rss": feed}))
    assert broken["rung"] is None and broken["error"] == "malformed listing json" and len(asked) == 1
    assert feeds.acquire_listing(plain, get({}))["error"]


def test_listings_of_sources(spark):
    def get(url):
        return b'{"data": {"children": [{"data": {"title": "T", "permalink": "/r/q"}}]}}' if "limit=50" in url else b"<rss><channel><item><title>F</title><link>https://e.com/1</link></item></channel></rss>"

    rows = spark.createDataFrame([("a", "https://www.reddit.com/r/q/new.json", None, "reddit"), ("b", "https://e.com/feed", None, "rss")], "source_id string, url string, active_url string, kind string")
    got = {r.source_id: r["items"][0].title for r in feeds.fetch_all(rows, get).select("source_id", F.col("items")).collect()}
    assert got == {"a": "T", "b": "F"}
