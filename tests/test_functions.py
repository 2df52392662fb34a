from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import text, timewin, udfs, urls
from tidewheel.operators.rules import Rules, canonical


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw, out", [("foo !", "foo "), ("   ", ""), ("\t Data  Lake ", "data lake"), ("Lake!!", "lake"), ("'so said'", "'so said"), ("dbt,", "dbt"), ("a  b", "a b"), ("!!!", ""), (None, None)])
def test_normalize_keyword(spark, raw, out):
    assert one(spark, raw, text.normalize_keyword) == out


def test_rules(spark):
    df = spark.createDataFrame([("Gen AI",), ("genai",), ("webinar",), ("webinars",)], "keyword string")
    assert sorted(r.keyword for r in canonical(df, Rules({"gen ai": "genai"}, ("webinar",))).collect()) == ["genai", "genai", "webinars"]
    assert sorted(r.keyword for r in canonical(df, Rules({"gen ai": "genai"}, ("genai",))).collect()) == ["webinar", "webinars"]
    assert canonical(df, Rules({"gen ai": "genai"}, ("gen ai",))).count() == 4


@pytest.mark.parametrize("more", [0, 5000])
def test_rules_of_any_number(spark, more):
    df = spark.createDataFrame([("Gen AI",), ("x",), ("a7",), ("m7",)], "keyword string")
    aliases = {"gen ai": "genai"} | {f"a{k}": f"b{k}" for k in range(more)}
    got = [r.keyword for r in canonical(df, Rules(aliases, ("x", *(f"m{k}" for k in range(more))))).collect()]
    assert sorted(got) == (["b7", "genai"] if more else ["a7", "genai", "m7"])


@pytest.mark.parametrize("now, before, out", [(3, 1, True), (9, 3, True), (10, 4, False), (2, 0, False), (3, 0, True), (5, 5, False), (2, 1, False)])
def test_rising(spark, now, before, out):
    assert spark.range(1).select(text.is_rising(F.lit(now), F.lit(before)).alias("r")).first().r is out


def at(s):
    return datetime.fromisoformat(s).replace(tzinfo=UTC)


@pytest.mark.parametrize("instant, start, end, key", [
    ("2026-07-08T13:00", "2026-07-07T06:00", "2026-07-08T06:00", "2026-07-07"), ("2026-11-02T13:00", "2026-11-01T06:00", "2026-11-02T07:00", "2026-11-01"), ("2026-07-08T01:00", "2026-07-06T06:00", "2026-07-07T06:00", "2026-07-06"),
])
def test_previous_day(instant, start, end, key):
    found = timewin.previous_day(at(instant))
    assert (found.start, found.end, found.key) == (at(start), at(end), key)


@pytest.mark.parametrize("instant, start, end, key", [("2026-07-13T13:00", "2026-07-06T06:00", "2026-07-13T06:00", "2026-W28"), ("2026-03-09T13:00", "2026-03-02T07:00", "2026-03-09T06:00", "2026-W10")])
def test_previous_week(instant, start, end, key):
    found = timewin.previous_iso_week(at(instant))
    assert (found.start, found.end, found.key) == (at(start), at(end), key)


@pytest.mark.parametrize("instant, start, end", [("2026-03-09T13:00", "2026-03-02T07:00", "2026-03-09T06:00"), ("2026-11-02T13:00", "2026-10-26T06:00", "2026-11-02T07:00")])
def test_trailing_window_over_clock_changes(instant, start, end):
    found = timewin.trailing(at(instant), 7)
    assert (found.start, found.end) == (at(start), at(end))
    before = timewin.preceding(found)
    assert before.end == found.start and timewin.local_date(before.start) == timewin.local_date(found.start) - timedelta(days=7)
    with pytest.raises(ValueError):
        timewin.trailing(at(instant), 0)


def test_recent_days_tile():
    days = timewin.recent_days(at("2026-07-08T13:00"), 3)
    assert " ".join(d.key for d in days) == "2026-07-07 2026-07-06 2026-07-05" and all(a.start == b.end for a, b in zip(days, days[1:]))
    assert timewin.recent_days(at("2026-07-08T13:00"), 0) == []


def test_gate_and_next_run():
    monday = at("2026-07-13T12:00")  # 06:00 there
    assert timewin.digest_gate(monday, False, False) == (True, True) and timewin.digest_gate(monday, True, True) == (False, False)
    assert timewin.digest_gate(at("2026-07-13T09:00"), False, False) == (False, False) and timewin.digest_gate(at("2026-07-14T12:00"), False, False) == (True, False)
    assert timewin.next_run(at("2026-07-13T12:00"), True) == at("2026-07-14T11:00") and timewin.next_run(at("2026-07-13T09:00"), False) == at("2026-07-13T11:00")


def test_hours_fall_into_one_day_each(spark):
    start = at("2026-03-05T07:00")
    rows = spark.createDataFrame([(start + timedelta(hours=k),) for k in range(168)], "t timestamp")
    got = {r.d: r["count"] for r in rows.groupBy(timewin.local_date_column(F.col("t")).alias("d")).count().collect()}
    assert sum(got.values()) == 168 and got[date(2026, 3, 8)] == 23


def test_dates_as_columns(spark):
    assert one(spark, "2026-07-08T00:00:00+00:00", timewin.leading_date) == date(2026, 7, 8)
    with pytest.raises(Exception, match="no leading date"):
        one(spark, "soon", timewin.leading_date)
    assert one(spark, 0, timewin.epoch_iso, "long") == "1970-01-01T00:00:00+00:00"
    assert timewin.to_iso(timewin.from_iso("2026-07-08T01:02:03Z")) == "2026-07-08T01:02:03+00:00"
    labels = [spark.range(1).select(timewin.recency_label(F.lit(d).cast("int")).alias("r")).first().r for d in (None, 0, 1, 9)]
    assert labels == ["never", "today", "1 day ago", "9 days ago"]


@pytest.mark.parametrize("error, out", [
    (None, None), ("HTTP 403", "http_4xx"), ("returned HTTP 500 twice", "http_5xx"), ("HTTP 429", "http_4xx"), ("HTTP 301", "other"), ("x: unparseable feed: y", "unparseable"), ("malformed json", "unparseable"),
    ("SSL: bad", "tls"), ("Connection refused", "connection"), ("Network is unreachable", "connection"), ("read timed out", "connection"), ("what", "other"), ("HTTP 302 timeout", "connection"),
])
def test_error_class(spark, error, out):
    assert one(spark, error, text.error_class) == out


@pytest.mark.parametrize("url, out", [
    ("HTTPS://Example.COM/A/", "https://example.com/A"), ("https://e.com/", "https://e.com/"), ("http://e.com:80/x", "http://e.com/x"), ("https://e.com:8443/x", "https://e.com:8443/x"), ("https://u:p@e.com/x#f", "https://e.com/x"),
    ("https://e.com/?utm_source=a&b=2&fbclid=c&a=1", "https://e.com/?b=2&a=1"), ("/relative", "/relative"), (" mailto:a@b ", "mailto:a@b"), ("https://[2001:DB8::1]:443/x//", "https://[2001:db8::1]/x/"), ("https://e.com:bad/", "https://e.com:bad/"),
    ("https://e.com/?q=a%20b", "https://e.com/?q=a+b"),
])
def test_canonical_url(url, out):
    assert urls.canonical_url(url) == out
    assert out.endswith("x/") or urls.canonical_url(out) == out  # only one slash goes at a time


@pytest.mark.parametrize("url, base, out", [
    ("https://e.com", None, "https://e.com/"), (" https://E.com:443/a?b#c ", None, "https://e.com/a?b#c"), ("javascript:alert(1)", None, None), ("/a", None, None), ("/a", "https://e.com/b", "https://e.com/a"), ("//f.com/x", "https://e.com", "https://f.com/x"),
    ("https://u@e.com/", None, None), ("https://127.0.0.1/", None, None), ("http://10.0.0.1/", None, None), ("https://[::1]/", None, None), ("https://e .com/", None, None), ("java%73cript:x", "https://e.com", None), ("", None, None), (None, None, None), ("https://e.com:x/", None, None),
])
def test_published_url(url, base, out):
    assert urls.published_url(url, base) == out


def test_other_urls():
    assert urls.redacted_url("https://u:p@e.com:8/x?api-key=1&q=2#f") == "https://e.com:8/x?api-key=REDACTED&q=2"
    assert urls.alternate_endpoints("https://e.com/feed") == ["https://e.com/feed/", "https://e.com/feed/atom/", "https://e.com/?feed=rss2"]
    page = '<link rel="alternate" type="application/rss+xml" href="https://other.com/f"><link rel="alternate" type="application/atom+xml" href="/atom.xml">'
    assert urls.discovered_feed(page, "https://e.com/") == "https://e.com/atom.xml"
    assert urls.archive_posts('<a href="/p/x?y=1">The <b>X</b></a><a href="/p/x">again</a><a href="https://o.com/p/z">no</a>', "https://e.com/archive") == [("https://e.com/p/x", "The X")]


@pytest.mark.parametrize("raw", ["", "a &amp; b", "x < y and a > b", "&lt;b&gt;bold&lt;/b&gt;", "&amp;lt;div&amp;gt;deep&amp;lt;/div&amp;gt;", "<p>one</p><p>two</p>", "<script>var a = '</p>';</script>text", "<style>p{}</style>t", '<a title="a>b">link</a>', "<div", "w " * 2500, "<b>un<i>closed"])
def test_clean_summary_is_a_fixed_point(raw):
    clean = udfs.clean_summary(raw)
    assert udfs.clean_summary(clean) == clean and len(clean) <= 2000 and "<p>" not in clean


def test_text_helpers(spark):
    assert udfs.clean_summary("&lt;div class=&quot;a&quot;&gt;News&lt;/div&gt;") == "News" and udfs.clean_summary("<p>a</p><p>b</p>") == "a b"
    assert udfs.clean_title("<b>A</b> &amp; &lt;i&gt; B") == "A & <i> B"
    assert udfs.excerpt("One two. Three four five six", 20) == "One two. Three four" and udfs.excerpt("A b c. " + "x" * 9, 12) == "A b c."
    assert udfs.excerpt("y" * 30, 10) == "y" * 10 and udfs.excerpt(" a  b ", 10) == "a b"
    assert udfs.render_markdown("**T**\n\n- a\n- b <x>\n\nline\nmore") == "<p><strong>T</strong></p>\n<ul><li>a</li><li>b &lt;x&gt;</li></ul>\n<p>line more</p>"
    assert udfs.keyword_slug("C++") != udfs.keyword_slug("C") and udfs.keyword_slug("!!").startswith("kw-")
    assert udfs.sparkline([1, 1, 1]).count("12.00") == 3 and udfs.sparkline([]) == "" and udfs.sparkline([0, 10]).endswith("118.00,2.00")
    assert one(spark, "daily-ai-2026", lambda c: text.digest_slug(c, F.lit("daily"))) == "ai-2026"
    assert one(spark, "```json\n[1]\n```", text.strip_code_fence) == "[1]"
    assert [one(spark, s, text.valid_slug) for s in ("a-b", "A", "a--b")] == [True, False, False]
    assert [one(spark, n, text.size_class, "long") for n in (1, 100 << 20, 200 << 20)] == ["ok", "warn", "fail"]
    assert [one(spark, s, text.retry_after) for s in ("5", "61", "x")] == [5.0, None, None]
    assert [one(spark, s, text.coarse_error) for s in ("HTTP 429", "403", "too large", "Timeout", "bad scheme", "malformed", "?")] == ["rate_limited", "runner_blocked_or_forbidden", "oversized", "timeout", "policy_blocked", "parse_error", "fetch_error"]


def test_simhash():
    a, b, c = (int(udfs.simhash(t), 16) for t in ("Company launches new model for developers today", "Company launches new model for developers", "Weather in the mountains stays cold and dry all week"))
    assert (a ^ b).bit_count() <= 12 < 20 <= (a ^ c).bit_count() and udfs.simhash("!!") == "0" * 16 and len(udfs.simhash("x")) == 16


def test_identity(spark):
    import hashlib

    row = spark.createDataFrame([("rss", "u", "e"), ("rss", "u", ""), ("rss", "u", None)], "k string, u string, e string").select(text.item_identity(F.col("k"), F.col("u"), F.col("e")).alias("r")).collect()
    want = [hashlib.sha256(f"rss\0{x}".encode()).hexdigest() for x in ("e", "u", "u")]
    assert [r.r for r in row] == want


def test_chips(spark):
    bad = ["[", None, '[{"keyword":"a"},{"keyword":"b","count":2}]']
    assert [[c.keyword for c in one(spark, b, text.parse_chips)] for b in bad] == [[], [], ["b"]]
