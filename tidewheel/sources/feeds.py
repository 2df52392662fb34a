"""Feed payloads as rows: RSS, Atom, listings and archive pages, from files or through a transport.

``feed_payloads`` is a Python data source (batch and stream): each partition reads a share of the files of a folder.  ``acquire`` walks the addresses of
a source through an injected transport, so that a failing source gives a row with an error and never a failed task.
"""

from __future__ import annotations

import glob
import ipaddress
import json
import os
import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tidewheel.functions.text import coarse_error
from tidewheel.functions.udfs import clean_title, clean_title_udf
from tidewheel.functions.urls import alternate_endpoints, archive_posts, authority, discovered_feed, redacted_url, site_root
from tidewheel.functions.timewin import to_iso

RAW = "url string, title string, external_id string, summary string, author string, published_at string, lang string"
CAP = 50
LISTING = "struct<data: struct<children: array<struct<data: struct<id: string, title: string, selftext: string, author: string, permalink: string, url: string, created_utc: double>>>>>"
_WEB = {"http": 80, "https": 443}


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _date(text: str | None) -> str | None:
    if not text:
        return None
    try:
        found = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        try:
            found = parsedate_to_datetime(text.strip())
        except (ValueError, TypeError, IndexError):
            return None
    return to_iso(found if found.tzinfo else found.replace(tzinfo=UTC))


def parse_feed(content: bytes) -> list[dict[str, str | None]]:
    """Entries of an RSS or Atom feed in feed order; entries before a break in broken XML count, without any it raises ValueError."""
    parser = ElementTree.XMLPullParser(["start", "end"])
    entries, lang, broken, stack = [], None, None, []
    try:
        parser.feed(content)
        parser.close()
    except ElementTree.ParseError as e:
        broken = e
    try:
        for event, node in parser.read_events():
            tag = _name(node.tag)
            if event == "start":
                stack.append(tag)
                continue
            stack.pop()
            if tag == "language" and stack[-1:] == ["channel"]:
                lang = (node.text or "").strip() or None
            if tag in ("item", "entry"):
                entries.append(_entry(node))
                node.clear()
    except ElementTree.ParseError as e:
        broken = e
    if broken is not None and not entries:
        raise ValueError(f"unparseable feed: {broken}")
    for e in entries:
        e["lang"] = e["lang"] or lang
    return entries


def _entry(node: ElementTree.Element) -> dict[str, str | None]:
    first: dict[str, ElementTree.Element] = {}
    link = None
    for child in node.iter():
        tag = _name(child.tag)
        if tag == "link" and child.get("href") and child.get("rel", "alternate") == "alternate":
            link = link or child.get("href")
        first.setdefault(tag, child)

    def text(*tags: str) -> str | None:
        for t in tags:
            if t in first:
                inner = "".join(first[t].itertext()).strip()
                if inner:
                    return inner
        return None

    author = first.get("author")
    name = text("name") if author is not None and len(author) else text("author", "creator")
    dates = (_date(text(t)) for t in ("pubdate", "published", "date", "updated"))
    return {
        "url": link or text("link") or "", "title": clean_title(text("title") or ""), "external_id": text("videoid") or text("guid", "id"),
        "summary": text("description", "summary", "content", "encoded"), "author": name, "published_at": next((d for d in dates if d), None), "lang": text("language"),
    }


def parse_listing(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Rows of listing JSON, natively: one row a child, at most CAP a payload.  A listing with one bad child is bad as a whole: an error row."""
    parsed = payload.withColumn("l", F.from_json(F.col(column), LISTING))
    children = F.col("l.data.children")
    ok = children.isNotNull() & F.forall(children, lambda c: c["data"].isNotNull())
    marked = parsed.withColumns({"error": F.when(ok, F.lit(None).cast("string")).otherwise(F.lit("malformed listing json")), "c": F.when(ok, F.slice(children, 1, CAP))})
    rest = [c for c in payload.columns if c != column]
    d = "c1.data"
    rows = marked.select(*rest, "error", F.explode_outer("c").alias("c1"))
    link = F.when(F.length(f"{d}.permalink") > 0, F.concat(F.lit("https://www.reddit.com"), F.col(f"{d}.permalink"))).otherwise(F.coalesce(F.col(f"{d}.url"), F.lit("")))
    return rows.select(
        *rest, "error", F.when(F.col("c1").isNotNull(), link).alias("url"), clean_title_udf(F.coalesce(F.col(f"{d}.title"), F.lit(""))).alias("title"), F.nullif(F.col(f"{d}.id"), F.lit("")).alias("external_id"),
        F.nullif(F.col(f"{d}.selftext"), F.lit("")).alias("summary"), F.col(f"{d}.author").alias("author"),
        F.date_format(F.timestamp_seconds(F.floor(f"{d}.created_utc")), "yyyy-MM-dd'T'HH:mm:ssxxx").alias("published_at"), F.lit(None).cast("string").alias("lang"),
    )


# addresses and policy
def checked_address(url: str, plain_hosts: frozenset[str] = frozenset()) -> str:
    """The address in normal form, or ValueError: https (http for listed hosts), no user, usual ports, no address that isn't public."""
    if any(ord(c) < 32 or ord(c) == 127 for c in url):
        raise ValueError("unsafe: control characters")
    parts = urlsplit(url)
    scheme, host = parts.scheme.lower(), (parts.hostname or "").rstrip(".")
    if scheme not in _WEB or (scheme == "http" and host not in plain_hosts):
        raise ValueError(f"scheme of {redacted_url(url)} isn't allowed")
    if "@" in parts.netloc:
        raise ValueError(f"credential in {redacted_url(url)}")
    if not host or "%" in host:
        raise ValueError("unsafe: host")
    if (parts.port or _WEB[scheme]) not in _WEB.values():
        raise ValueError("unsafe: port")
    try:
        if not ipaddress.ip_address(host).is_global:
            raise ValueError("unsafe: address isn't public")
    except ValueError as e:
        if "public" in str(e) or re.fullmatch(r"[0-9.]+|0x[0-9a-f.x]+", host):
            raise ValueError("unsafe: address") from e
    return urlunsplit((scheme, authority(scheme, host.encode("idna").decode(), parts.port), parts.path, parts.query, ""))


def archive_address(url: str) -> str | None:
    parts = urlsplit(url)
    own = (parts.hostname or "").endswith(".substack.com") and parts.path in ("/feed", "/feed/")
    return f"{parts.scheme}://{parts.netloc}/archive" if own else None


def acquire(url: str, get: Callable[[str], bytes], mirror: str | None = None) -> dict:
    """items, rung, resolved_url, trace, error: the first address that serves.

    A feed that parses stops the walk, even an empty one; only a failure goes on to the next.
    """
    trace: list[dict] = []

    def attempt(rung: str, address: str, read: Callable[[bytes], list[dict]]) -> list[dict] | None:
        try:
            found = read(get(checked_address(address)))
        except (ValueError, OSError) as e:
            trace.append({"rung": rung, "url": redacted_url(address), "outcome": "error", "reason": str(e)})
            return None
        trace.append({"rung": rung, "url": redacted_url(address), "outcome": "served", "items": len(found)})
        return found

    def posts(base: str) -> Callable[[bytes], list[dict]]:
        def read(page: bytes) -> list[dict]:
            found = archive_posts(page.decode("utf-8", "replace"), base)
            if not found:
                raise ValueError("unparseable archive: no posts")
            return [dict.fromkeys(("external_id", "summary", "author", "published_at", "lang")) | {"url": u, "title": t} for u, t in found]

        return read

    def steps() -> Iterator[tuple[str, str, Callable[[bytes], list[dict]]]]:
        yield "direct", url, parse_feed
        if not (urlsplit(url).hostname or "").endswith(".substack.com"):
            for other in alternate_endpoints(url):
                yield "alt_endpoint", other, parse_feed
        archive = archive_address(url)
        if archive:
            yield "substack_archive", archive, posts(archive)
        root = site_root(url)
        try:
            link = discovered_feed(get(checked_address(root)).decode("utf-8", "replace"), root)
        except (ValueError, OSError) as e:
            trace.append({"rung": "autodiscovery", "url": redacted_url(root), "outcome": "error", "reason": str(e)})
        else:
            if link is not None:
                yield "autodiscovery", link, parse_feed
        if mirror:
            yield "mirror", mirror, parse_feed

    for rung, address, read in steps():
        items = attempt(rung, address, read)
        if items is not None:
            return {"items": items[:CAP], "rung": rung, "resolved_url": None if rung == "direct" else address, "trace": json.dumps(trace, sort_keys=True), "error": None}
    return {"items": [], "rung": None, "resolved_url": None, "trace": json.dumps(trace, sort_keys=True), "error": "; ".join(t.get("reason", "") for t in trace)}


def listing_address(url: str, limit: int = CAP) -> str:
    """A listing's address with its number of rows; other parameters stay."""
    parts = urlsplit(url)
    query = dict(parse_qsl(parts.query)) | {"limit": str(limit)}
    return urlunsplit((parts.scheme, parts.netloc, parts.path, urlencode(query), parts.fragment))


def listing_feed(url: str) -> str:
    """The feed beside a listing."""
    return (url[: -len(".json")] if url.endswith(".json") else url.rstrip("/")) + ".rss"


def listing_items(body: bytes) -> list[dict]:
    """Raw items of listing JSON; one bad child makes the whole listing bad."""
    try:
        children = [c["data"] for c in json.loads(body)["data"]["children"]]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("malformed listing json") from e
    out = []
    for d in children:
        link = f"https://www.reddit.com{d['permalink']}" if d.get("permalink") else d.get("url") or ""
        at = d.get("created_utc")
        out.append({
            "url": link, "title": clean_title(d.get("title") or ""), "external_id": d.get("id") or None, "summary": d.get("selftext") or None, "author": d.get("author"),
            "published_at": None if at is None else datetime.fromtimestamp(int(at), UTC).isoformat(), "lang": None,
        })
    return out


def acquire_listing(url: str, get: Callable[[str], bytes]) -> dict:
    """As ``acquire``, for a listing: its JSON, and where that isn't served the feed beside it, once.  JSON that is served but malformed ends it."""
    trace: list[dict] = []

    def done(items: list[dict], rung: str | None, address: str | None, error: str | None) -> dict:
        return {"items": items[:CAP], "rung": rung, "resolved_url": address, "trace": json.dumps(trace, sort_keys=True), "error": error}

    for rung, address, read in (("direct", listing_address(url), listing_items), ("alt_endpoint", listing_feed(url), parse_feed)):
        try:
            body = get(checked_address(address))
        except (ValueError, OSError) as e:
            trace.append({"rung": rung, "url": redacted_url(address), "outcome": "error", "reason": str(e)})
            continue
        try:
            items = read(body)
        except ValueError as e:
            trace.append({"rung": rung, "url": redacted_url(address), "outcome": "error", "reason": str(e)})
            return done([], None, None, str(e))
        trace.append({"rung": rung, "url": redacted_url(address), "outcome": "served", "items": min(len(items), CAP)})
        return done(items, rung, None if rung == "direct" else address, None)
    return done([], None, None, "; ".join(t["reason"] for t in trace))


def fetch_all(sources: DataFrame, get: Callable[[str], bytes]) -> DataFrame:
    """One row per source: items (array), rung, resolved_url, trace, error; sources are spread over tasks and fail alone."""
    item = f"array<struct<{RAW.replace(' string', ': string')}>>"

    def run(frames):
        import pyarrow as pa

        kind = pa.list_(pa.struct([(c.split()[0], pa.string()) for c in RAW.split(", ")]))
        for frame in frames:
            rows = [(i, acquire_listing(u, get) if k == "reddit" else acquire(u, get, m)) for i, u, m, k in zip(*(c.to_pylist() for c in frame.columns))]
            if rows:
                fields = ("rung", "resolved_url", "trace", "error")
                yield pa.record_batch(
                    [pa.array([i for i, _ in rows]), pa.array([r["items"] for _, r in rows], kind), *(pa.array([r[f] for _, r in rows], pa.string()) for f in fields)],
                    names=["source_id", "items", *fields],
                )

    kind = F.col("kind") if "kind" in sources.columns else F.lit("rss").alias("kind")
    narrow = sources.select(F.col("source_id").cast("string").alias("source_id"), "url", "active_url", kind).repartition("source_id")
    found = narrow.mapInArrow(run, f"source_id string, items {item}, rung string, resolved_url string, trace string, error string")
    return found.withColumn("reason", F.when(F.col("error").isNotNull(), coarse_error(F.col("error"))))


# data source
class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


def _rows(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        yield from _parsed(os.path.basename(path), f.read())


def _parsed(name: str, content: bytes) -> Iterator[tuple]:
    fields = [c.split()[0] for c in RAW.split(", ")]
    try:
        for k, e in enumerate(parse_feed(content)[:CAP]):
            yield (name, k, *(e[c] for c in fields), None)
    except ValueError as e:
        yield (name, -1, *(None for _ in fields), str(e))


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.spread = options["path"], int(options.get("partitions", "8"))

    def partitions(self) -> list[InputPartition]:
        paths = sorted(p for e in ("xml", "rss", "atom") for p in glob.glob(f"{self.path}/**/*.{e}", recursive=True))
        return [_Files(paths[k :: self.spread]) for k in range(min(self.spread, max(1, len(paths))))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            yield from _rows(path)


class FeedStream(SimpleDataSourceStreamReader):
    """New files since the last batch, in order of modification time and name, which are the offset: a file that comes late is read whatever its name.

    For small folders; ``feed_stream`` lists and reads large ones on the executors.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"time": 0, "name": ""}

    def _after(self, start: dict) -> list[tuple[int, str, str]]:
        found = ((os.stat(p).st_mtime_ns, os.path.basename(p), p) for p in glob.glob(f"{self.path}/*.xml"))
        return sorted(f for f in found if f[:2] > (start["time"], start["name"]))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        new = self._after(start)
        end = {"time": new[-1][0], "name": new[-1][1]} if new else start
        return iter([r for _, _, p in new for r in _rows(p)]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for t, name, p in self._after(start) if (t, name) <= (end["time"], end["name"]) for r in _rows(p)])

    def commit(self, end: dict) -> None:
        pass


class FeedPayloads(DataSource):
    """``spark.read.format("feed_payloads").load(folder)``: file, position, the raw item columns, error."""

    @classmethod
    def name(cls) -> str:
        return "feed_payloads"

    def schema(self) -> str:
        return f"file string, position int, {RAW}, error string"

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))

    def simpleStreamReader(self, schema) -> FeedStream:
        return FeedStream(dict(self.options))


def feed_stream(spark: SparkSession, folder: str, pattern: str = "*.xml") -> DataFrame:
    """A stream of file, position, the raw item columns and error, by the file source: files are told by path, listed by Spark and parsed on the executors."""
    fields = [c.split()[0] for c in RAW.split(", ")]

    def parse(frames):
        import pyarrow as pa

        for frame in frames:
            rows = [r for path, content in zip(*(c.to_pylist() for c in frame.columns)) for r in _parsed(os.path.basename(path), content)]
            if rows:
                file, position, *rest = zip(*rows)
                yield pa.record_batch([pa.array(file), pa.array(position, pa.int32()), *(pa.array(c, pa.string()) for c in rest)], names=["file", "position", *fields, "error"])

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(parse, f"file string, position int, {RAW}, error string")


# transports
class Refused(OSError):
    """A response that isn't a success."""

    def __init__(self, status: int, retry_after: float | None = None) -> None:
        super().__init__(f"HTTP {status}")
        self.status, self.retry_after = status, retry_after


def retrying(get: Callable[[str], bytes], attempts: int = 3, sleep: Callable[[float], None] | None = None, cap: float = 30.0) -> Callable[[str], bytes]:
    """``get`` tried again after 429, 5xx and broken connections, 1, 2, 4 ... seconds apart or as the server asks; other refusals end it."""
    import time

    pause = sleep or time.sleep

    def again(url: str) -> bytes:
        for k in range(attempts):
            try:
                return get(url)
            except OSError as e:
                status = getattr(e, "status", None)
                last = k == attempts - 1 or (status is not None and status != 429 and status < 500)
                if last:
                    raise
                asked = getattr(e, "retry_after", None)
                pause(min(cap, 2.0**k if asked is None else asked))
        raise OSError("no attempt")

    return again


class Conditional:
    """Remembers validators of each address: an unchanged feed is answered by an empty one."""

    def __init__(self, get: Callable[[str, dict[str, str]], tuple[int, dict[str, str], bytes]]) -> None:
        self._get, self._known = get, {}

    def __call__(self, url: str) -> bytes:
        status, headers, body = self._get(url, self._known.get(url, {}))
        if status == 304:
            return b"<rss><channel/></rss>"
        if status >= 400:
            raise Refused(status)
        known = {"If-None-Match": headers.get("etag"), "If-Modified-Since": headers.get("last-modified")}
        self._known[url] = {k: v for k, v in known.items() if v}
        return body
