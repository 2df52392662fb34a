"""Text, error and trend functions as native columns, so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = r"(?U)^\s+|\s+$"
SPACES = r"(?U)\s+"
CLOUD_STEPS = 5


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE, "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), SPACES, " ")


def normalize_keyword(c: Column) -> Column:
    """Trim, collapse spaces, lower, then drop trailing punctuation; what that uncovers isn't trimmed again."""
    return F.regexp_replace(F.lower(collapse(c)), r"""[.,;:!?'"]+$""", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def valid_slug(c: Column) -> Column:
    return c.rlike("^([a-z0-9]+-)*[a-z0-9]+$")


def digest_slug(digest_id: Column, kind: Column) -> Column:
    prefix = F.concat(kind, F.lit("-"))
    return F.when(F.startswith(digest_id, prefix), F.substr(digest_id, F.length(prefix) + 1)).otherwise(digest_id)


def digest_id(kind: Column, category: Column, key: Column) -> Column:
    return F.concat_ws("-", kind, category, key)


def strip_code_fence(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"^```[A-Za-z]*[ \t]*\n?|\n?```$", "")


def shorten(c: Column, width: int = 60) -> Column:
    return F.when(F.length(c) > width, F.concat(F.rtrim(F.substring(c, 1, width - 1)), F.lit("…"))).otherwise(c)


def item_text(title: Column, summary: Column) -> Column:
    return F.concat_ws("\n", title, F.nullif(summary, F.lit("")))


def item_identity(kind: Column, url: Column, external_id: Column) -> Column:
    """sha256 of kind, NUL and the external id, or the URL where that is null or empty."""
    return F.sha2(F.concat(kind, F.char(F.lit(0)), F.coalesce(F.nullif(external_id, F.lit("")), url)), 256)


def simhash_bigint(hex16: Column) -> Column:
    return F.conv(hex16, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def usable_keyword(c: Column) -> Column:
    """2 to 60 characters after trimming and no URL."""
    t = F.lower(strip(c))
    return F.length(t).between(2, 60) & ~F.contains(t, F.lit("://")) & ~F.startswith(t, F.lit("www."))


def is_rising(now: Column, before: Column, least: int = 3, ratio: float = 3.0) -> Column:
    return F.when(now < least, F.lit(False)).when(before <= 0, F.lit(True)).otherwise(now / before >= F.lit(ratio))


def weight_step(count: Column, low: Column, high: Column, steps: int = CLOUD_STEPS) -> Column:
    """Log-scaled step from 1 to ``steps``; the middle one where all counts are equal."""
    share = (
        F.when(high <= low, F.lit(0.5)).when(count <= low, F.lit(0.0))
        .otherwise((F.log(count + 1) - F.log(low + 1)) / (F.log(high + 1) - F.log(low + 1)))
    )
    return F.least(F.lit(steps), F.lit(1) + F.floor(share * steps).cast("int"))


def error_class(error: Column) -> Column:
    code = F.regexp_extract(error, r"\bHTTP (\d{3})\b", 1)
    text = F.lower(error)

    def any_of(*needles: str) -> Column:
        return text.rlike("|".join(needles))

    return (
        F.when(error.isNull(), F.lit(None).cast("string"))
        .when(code.rlike("^4"), F.lit("http_4xx"))
        .when(code.rlike("^5"), F.lit("http_5xx"))
        .when(any_of("unparseable feed", "malformed"), F.lit("unparseable"))
        .when(any_of("ssl", "tls", "certificate"), F.lit("tls"))
        .when(any_of("no route to host|network is unreachable", "name or service not known", "connection re(fused|set)", "time(d out|out)"), F.lit("connection"))
        .otherwise(F.lit("other"))
    )


def coarse_error(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.contains("429"), F.lit("rate_limited"))
        .when(low.contains("403"), F.lit("runner_blocked_or_forbidden"))
        .when(low.rlike("too large|exceeded size limit"), F.lit("oversized"))
        .when(low.contains("timeout"), F.lit("timeout"))
        .when(low.rlike("unsafe|credential|scheme"), F.lit("policy_blocked"))
        .when(low.rlike("unparseable|malformed"), F.lit("parse_error"))
        .otherwise(F.lit("fetch_error"))
    )


def status_reason(status: Column) -> Column:
    return F.when(status == 429, F.lit("rate_limited")).when(status == 403, F.lit("runner_blocked_or_forbidden")).otherwise(F.concat(F.lit("http_"), status.cast("string")))


def size_class(total: Column, warn: int = 100 << 20, fail: int = 200 << 20) -> Column:
    return F.when(total >= fail, F.lit("fail")).when(total >= warn, F.lit("warn")).otherwise(F.lit("ok"))


def retry_after(value: Column) -> Column:
    seconds = value.try_cast("double")
    return F.when(seconds.between(0, 60), seconds)


def deep_link(source_id: Column, enabled: Column) -> Column:
    quoted = F.replace(F.url_encode(source_id), F.lit("+"), F.lit("%20"))
    return F.when(enabled, F.concat(F.lit("../items/#source="), quoted))


def chips_json(chips: Column) -> Column:
    """An array of (keyword, cnt) as JSON text with sorted keys."""
    return F.to_json(F.transform(chips, lambda x: F.struct(x["cnt"].alias("count"), x["keyword"].alias("keyword"))))


def parse_chips(text: Column) -> Column:
    """The tolerant reverse: bad JSON is an empty array, incomplete entries are left out."""
    found = F.coalesce(F.from_json(text, "array<struct<keyword: string, count: long>>"), F.array().cast("array<struct<keyword: string, count: long>>"))
    return F.filter(found, lambda x: x["keyword"].isNotNull() & x["count"].isNotNull())


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def matches_filter(kind: Column, source_id: Column, tags: Column, want_kind: str = "", want_source: str = "", want_keyword: str = "") -> Column:
    """Facet predicate: an empty wish is true, a keyword is a part of any tag in any case."""
    hit = F.lit(True)
    if want_kind:
        hit &= kind == want_kind
    if want_source:
        hit &= source_id.cast("string") == want_source
    if want_keyword.strip():
        hit &= F.exists(tags, lambda t: F.contains(F.lower(t), F.lit(want_keyword.strip().lower())))
    return hit
