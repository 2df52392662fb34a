"""Keyword extraction: selecting items, batches, reply checks, fallback keywords, evaluation.

A model is any function from a list of items to a reply text; without one the fallback extractor speaks for every batch.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections import Counter
from collections.abc import Callable
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions.text import jaccard, strip_code_fence, usable_keyword
from tidewheel.functions.udfs import excerpt_udf
from tidewheel.operators.model import calls
from tidewheel.session import cut

BATCH = 25
KEEP = 8
STOP = frozenset(
    "a about after all also an and any are as at be been before but by can could did do does for from had has have he her his how i if in into is it its just like more most my no not of on one "
    "or other our out over said she so some such than that the their them then there these they this to up us was we were what when which who will with would you your".split()
)


def untagged(items: DataFrame, keywords: DataFrame) -> DataFrame:
    return items.join(keywords.select("item_id"), "item_id", "left_anti")


def fallback_only(keywords: DataFrame) -> DataFrame:
    """Ids whose every row is of the fallback."""
    return keywords.groupBy("item_id").agg(F.bool_and(F.col("method") == "fallback").alias("f")).where("f").select("item_id")


def batches(items: DataFrame, size: int = BATCH, budget: int | None = None) -> DataFrame:
    """Items by id with their batch number; batches from ``budget`` on go to the fallback."""
    from tidewheel.operators.trends import numbered

    rows = numbered(items, [F.col("item_id").asc()]).withColumn("batch", F.floor((F.col("rn") - 1) / size))
    return rows.withColumn("route", F.when(F.lit(True) if budget is None else F.col("batch") < budget, F.lit("llm")).otherwise(F.lit("fallback")))


def checked_replies(replies: DataFrame, asked: DataFrame, keep: int = KEEP) -> DataFrame:
    """batch, ok, item_id, keywords of replies (batch, reply): a batch is valid as a whole or not at all.

    Valid: a JSON array that names each asked item once and nothing else, every keyword usable.  ``keep`` cuts after the checks.
    """
    kind = "array<struct<item_id: string, keywords: array<string>>>"
    parsed = replies.select("batch", F.from_json(strip_code_fence(F.col("reply")), kind).alias("r"))
    want = asked.groupBy("batch").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("want"))
    named = F.sort_array(F.transform("r", lambda x: x["item_id"]))
    good_words = F.forall("r", lambda x: x["keywords"].isNotNull() & F.forall(x["keywords"], lambda w: F.coalesce(usable_keyword(w), F.lit(False))))
    judged = want.join(parsed, "batch", "left").withColumn("ok", F.coalesce((named == F.col("want")) & good_words, F.lit(False)))
    return judged.select("batch", "ok", F.explode_outer(F.when(F.col("ok"), F.col("r"))).alias("x")).select("batch", "ok", "x.item_id", F.slice("x.keywords", 1, keep).alias("keywords"))


def ranked(rows: DataFrame) -> DataFrame:
    """item_id, keyword, rank from 1, from arrays."""
    return rows.select("item_id", F.posexplode("keywords").alias("p", "keyword")).select("item_id", "keyword", (F.col("p") + 1).alias("rank"))


def score_phrases(text: str, top: int = KEEP, longest: int = 3) -> list[str]:
    """Phrases of up to three words after the published single-document scheme of YAKE: frequent, early, spread, not stop words.

    Ties are ordered by the phrase.
    """
    sentences = [re.findall(r"\w[\w'-]*", s) for s in re.split(r"[.!?\n]+", text)]
    lows = [[w.lower() for w in s] for s in sentences]
    count = Counter(chain.from_iterable(lows))
    if not count:
        return []
    content = [n for w, n in count.items() if w not in STOP]
    mean = sum(content) / len(content) if content else 1.0
    deviation = math.sqrt(sum((n - mean) ** 2 for n in content) / len(content)) if content else 0.0
    upper, where = Counter(), {w: [] for w in count}
    for k, (s, low) in enumerate(zip(sentences, lows)):
        upper.update([x for w, x in zip(s[1:], low[1:]) if w[0].isupper()])
        for w in low:
            where[w].append(k)
    phrases: Counter[tuple[str, ...]] = Counter()
    for n in range(1, longest + 1):
        phrases.update(chain.from_iterable(zip(*(low[i:] for i in range(n))) for low in lows))
    # of what stands before and after a word, how many kinds there are and how many in all
    pairs = set(chain.from_iterable(zip(low, low[1:]) for low in lows))
    before, after = Counter([w for _, w in pairs]), Counter([w for w, _ in pairs])
    preceded, followed = Counter(chain.from_iterable(low[1:] for low in lows)), Counter(chain.from_iterable(low[:-1] for low in lows))
    most, total = max(count.values()), len(sentences)

    def weight(w: str) -> float:
        places = where[w]
        position = math.log(math.log(3 + places[len(places) // 2]))
        casing = upper[w] / (1 + math.log(count[w]))
        frequency = count[w] / (mean + deviation)
        relation = 1 + sum((kinds[w] / all_[w] if all_[w] else 0) * count[w] / most for kinds, all_ in ((before, preceded), (after, followed)))
        spread = len(set(places)) / total
        return relation * position / (casing + frequency / relation + spread / relation)

    weights = {w: weight(w) for w in count if w not in STOP}
    scores = {}
    for part, n in phrases.items():
        if part[0] in weights and part[-1] in weights and (len(part) > 1 or len(part[0]) > 1):
            own = [weights[w] for w in part if w in weights]
            scores[part] = math.prod(own) / (n * (1 + sum(own)))
    worst = max(heapq.nsmallest(top, scores.values()), default=0.0)
    best = sorted((p for p, x in scores.items() if x <= worst + 2e-9), key=lambda p: (round(scores[p], 9), p))  # ties of rounded scores too
    return [" ".join(p) for p in best[:top]]


def sane(keyword: str) -> str | None:
    text = keyword.strip()
    low = text.lower()
    return text if 2 <= len(text) <= 60 and "://" not in low and not low.startswith("www.") else None


@F.arrow_udf(T.ArrayType(T.StringType()))
def fallback_keywords(column: pa.Array) -> pa.Array:
    """At most KEEP keywords of each text; an unusable one is left out."""
    out = [None if t is None else [k for k in map(sane, score_phrases(t)) if k is not None] for t in column.to_pylist()]
    return pa.array(out, pa.list_(pa.string()))


#: Else the filter that Spark infers from an explode is pushed below and scores every text a second time.
fallback_keywords = fallback_keywords.asNondeterministic()


def valid_reply(text: str, rows: list[dict]) -> bool:
    """What ``checked_replies`` accepts, for one reply: a JSON array that names each asked item once and nothing else, every keyword usable."""
    bare = re.sub(r"^\s*```[A-Za-z]*\s*|\s*```\s*$", "", text)
    try:
        data = json.loads(bare)
    except ValueError:
        return False
    if not isinstance(data, list) or not all(isinstance(x, dict) and isinstance(x.get("keywords"), list) for x in data):
        return False
    named = sorted(str(x.get("item_id")) for x in data)
    return named == sorted(str(r["item_id"]) for r in rows) and all(isinstance(w, str) and sane(w) is not None for x in data for w in x["keywords"])


def ask(asked: DataFrame, model: Callable[[list[dict]], object], budget: int | None = None, retries: int | None = None) -> DataFrame:
    """The calls of a model for the batches of ``asked`` (batch, item_id, title, summary), as in ``model.calls``."""
    return calls(asked, model, valid_reply, ("item_id", "title", "summary"), budget, retries)


def extract(items: DataFrame, model: Callable[[list[dict]], object] | None = None, size: int = BATCH, budget: int | None = None, retries: int | None = None, log: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """item_id, keyword, rank, method: a model's keywords where its batch is valid, the fallback's elsewhere.

    ``budget`` bounds the calls, ``retries`` the second tries after a malformed reply (None: one a batch); ``log`` is given the calls made.
    Calls are made once: they are written to the shared folder before they are used.
    """
    text = F.concat_ws("\n", "title", F.nullif("summary", F.lit("")))
    if model is None:
        return ranked(items.select("item_id", fallback_keywords(text).alias("keywords"))).withColumn("method", F.lit("fallback"))
    routed = cut(batches(items, size))
    made = cut(ask(routed, model, budget, retries))
    if log is not None:
        log(made)
    found = checked_replies(made.where("valid").select("batch", "reply"), routed).where("ok")
    told = ranked(found).withColumn("method", F.lit("llm"))
    rest = routed.withColumn("__id", F.col("item_id").cast("string")).join(found.select(F.col("item_id").alias("__id")), "__id", "left_anti")
    return told.unionByName(ranked(rest.select(F.col("__id").alias("item_id"), fallback_keywords(text).alias("keywords"))).withColumn("method", F.lit("fallback")))


def payloads(asked: DataFrame, cap: int = 500, transcripts: DataFrame | None = None) -> DataFrame:
    """(batch, payload): the JSON that describes a batch's items, summaries cut to ``cap``.

    With ``transcripts`` (transcript_ref, transcript) an item of kind youtube that has one carries an excerpt of it.
    """
    fields = [F.col("item_id").cast("string").alias("item_id"), F.col("title"), F.substring(F.coalesce("summary", F.lit("")), 1, cap).alias("summary")]
    if transcripts is not None:
        told = transcripts.where("transcript <> ''").select("transcript_ref", excerpt_udf("transcript").alias("__excerpt"))
        asked = asked.join(told, "transcript_ref", "left")
        fields.append(F.when(F.col("kind") == "youtube", F.col("__excerpt")).alias("transcript"))
    one = F.struct(*fields)
    return asked.groupBy("batch").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(F.col("item_id").alias("k"), one.alias("v")))), lambda x: x["v"])).alias("payload"))


def score_predictions(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """item_id, score: Jaccard of keyword sets, null for items without labels; a labelled item without prediction counts as empty."""
    none = F.array().cast("array<string>")
    return expected.join(predicted, "item_id", "left").select(
        "item_id", F.when(F.size("expected") > 0, jaccard(F.coalesce("predicted", none), F.col("expected"))).alias("score")
    )


def digest_reply(text: str):
    """(title, bullets, body) of a model's digest; anything else raises ValueError."""
    data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("not an object")
    title, tldr, body = data.get("title"), data.get("tldr"), data.get("body_md")
    if not (isinstance(title, str) and isinstance(body, str) and isinstance(tldr, list) and all(isinstance(b, str) for b in tldr)):
        raise ValueError("wrong fields")
    if not title.strip() or not body.strip():
        raise ValueError("nothing to say")
    return title.strip(), list(filter(None, map(str.strip, tldr))), body.strip()



def eval_items(cases: DataFrame, at: str) -> DataFrame:
    """Labelled cases as items, so that they take the same way as any other; what extraction doesn't look at is filled in."""
    given = {"item_id": F.col("item_id"), "title": F.col("title"), "summary": F.col("summary"), "source_id": F.lit("eval"), "kind": F.lit("rss"), "published_at": F.lit(at), "fetched_at": F.lit(at)}
    made = {"canonical_url": F.concat(F.lit("eval:"), "item_id"), "content_hash": F.concat(F.lit("eval-"), "item_id")}
    empty = {c: F.lit(None).cast("string") for c in ("external_id", "author", "transcript_ref", "lang")}
    return cases.select(*(c.alias(name) for name, c in (given | made | empty).items()))


# pipelines
def quality_gate(keywords: DataFrame, limit: int = 60) -> None:
    """Raises where a keyword is longer than ``limit``."""
    from tidewheel.operators.checks import long_keywords, require

    require(long_keywords(keywords, limit))


def grouped(keywords: DataFrame) -> DataFrame:
    """item_id, keywords in rank order."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "keyword")))
    return keywords.groupBy("item_id").agg(F.transform(ordered, lambda x: x["keyword"]).alias("keywords"))


def extract_new(items: DataFrame, keywords: DataFrame, rules, model: Callable[[list[dict]], str] | None = None, budget: int | None = None) -> DataFrame:
    """Keywords of items that have none, under the rules; of equal ones of an item the first by rank stays, so ranks may have gaps."""
    from tidewheel.operators.rules import canonical
    from tidewheel.operators.store import first_wins

    found = canonical(extract(untagged(items, keywords), model, budget=budget), rules)
    return first_wins(found, ["item_id", "keyword", "method"], "rank")


def backfill(items: DataFrame, keywords: DataFrame, model: Callable[[list[dict]], str], budget: int | None = None) -> DataFrame:
    """A model's keywords, as they come, for items that so far have only the fallback's."""
    again = items.join(fallback_only(keywords), "item_id", "left_semi")
    return extract(again, model, budget=budget).where("method = 'llm'")


def renormalize(items: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with summaries cleaned anew, keywords without those of changed items)."""
    from tidewheel.operators.ingest import renormalized
    from tidewheel.operators.store import deleted, rewritten

    changed = renormalized(items)
    return rewritten(items, changed, ["item_id"], ["summary"]), deleted(keywords, changed, ["item_id"])
