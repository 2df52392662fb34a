"""Calls of a language model: attempts, budgets, one log row a call.

A *transport* is any function from a payload to (status, body); a *model* is any function from the rows of a batch to
``Completion``.  Budgets run over the batches in order, so budgeted calls are made in one ordered task: their number is the budget, not
the data.  Without a budget batches are spread over all tasks.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRYABLE = (429, 500, 502, 503, 504)
CALLS = "batch long, attempt int, status string, valid boolean, reply string, input_items int, tokens_in int, tokens_out int"


class ModelError(Exception):
    """A call that brought no completion."""


class Completion(NamedTuple):
    text: str
    tokens_in: int | None = None
    tokens_out: int | None = None


def completion_of(body: bytes) -> Completion:
    """The text and token counts of a chat-completions answer; anything else raises ModelError."""
    try:
        data = json.loads(body)
        text, usage = data["choices"][0]["message"]["content"], data.get("usage") or {}
        if not isinstance(text, str):
            raise TypeError("content is no text")
        return Completion(text, usage.get("prompt_tokens"), usage.get("completion_tokens"))
    except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
        raise ModelError(f"malformed answer: {e}") from e


def completing(
    transport: Callable[[dict[str, Any]], tuple[int, bytes]], attempts: int = 3, base: float = 1.0, cap: float = 30.0,
    sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random,
) -> Callable[[dict[str, Any]], Completion]:
    """``transport`` tried again after broken connections and ``RETRYABLE`` answers, with growing pauses; other refusals end it."""
    if attempts < 1:
        raise ValueError("at least one attempt")

    def call(payload: dict[str, Any]) -> Completion:
        said = ""
        for k in range(attempts):
            try:
                status, body = transport(payload)
            except (OSError, ModelError) as e:
                said = str(e)
            else:
                if 200 <= status < 300:
                    return completion_of(body)
                said = f"HTTP {status}"
                if status not in RETRYABLE:
                    raise ModelError(said)
            if k < attempts - 1:
                sleep(min(cap, base * 2.0**k) + jitter() * base)
        raise ModelError(f"{attempts} attempts: {said}")

    return call


def calls(
    asked: DataFrame, model: Callable[[list[dict]], Any], valid: Callable[[str, list[dict]], bool], fields: tuple[str, ...], budget: int | None = None, retries: int | None = None
) -> DataFrame:
    """The calls made for the batches of ``asked`` (batch and ``fields``, the first of which orders a batch): one row each, as in ``CALLS``.

    A reply that isn't valid is asked for once more, at most ``retries`` times in all (None: once a batch); an error isn't.  After ``budget`` calls
    no more are made, for no batch.  A refused call is no row.  ``model`` gives a text or a Completion.
    """
    whole = asked.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = again = 0
        for frame in frames:
            out: list[tuple] = []
            for entry in frame.to_pylist():
                for attempt in (1, 2):
                    if budget is not None and made >= budget or attempt == 2 and retries is not None and again >= retries:
                        break
                    made, again = made + 1, again + (attempt == 2)
                    try:
                        got = model(entry["rows"])
                        got = got if isinstance(got, Completion) else Completion(got)
                    except Exception:  # a model is foreign code: whatever it raises is a call that failed
                        out.append((entry["batch"], attempt, "error", False, None, len(entry["rows"]), None, None))
                        break
                    good = valid(got.text, entry["rows"])
                    out.append((entry["batch"], attempt, "ok", good, got.text, len(entry["rows"]), got.tokens_in, got.tokens_out))
                    if good:
                        break
            if out:
                names = [c.split()[0] for c in CALLS.split(", ")]
                types = (pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    bounded = budget is not None or retries is not None
    placed = whole.repartition(1).sortWithinPartitions("batch") if bounded else whole
    return placed.mapInArrow(run, CALLS)


def log_rows(made: DataFrame, run_id: str, purpose: str, name: str, at: str) -> DataFrame:
    """The log of calls, a row each."""
    return made.select(
        F.lit(run_id).alias("run_id"), F.lit(purpose).alias("purpose"), F.lit(name).alias("model"), "input_items", "tokens_in", "tokens_out", "status", F.lit(at).alias("created_at")
    )


def outcome(made: DataFrame, batches: DataFrame, budget: int | None = None) -> DataFrame:
    """One row: batches, those of the model and of the fallback, retries, and whether the budget ran out."""
    good = made.where("valid").select("batch").distinct().withColumn("good", F.lit(True))
    counted = batches.select("batch").distinct().join(good, "batch", "left").agg(
        F.count(F.lit(1)).alias("batches"), F.count("good").alias("by_model"), (F.count(F.lit(1)) - F.count("good")).alias("by_fallback")
    )
    total = made.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("attempt") == 2).alias("retries"), F.countDistinct("batch").alias("asked"))
    ran_out = F.lit(False) if budget is None else (F.col("calls") >= budget) & ((F.col("asked") < F.col("batches")) | F.col("unfinished"))
    last = made.groupBy("batch").agg(F.max_by(F.struct("attempt", "status", "valid"), "attempt").alias("l"))
    unfinished = last.agg(F.coalesce(F.bool_or((F.col("l.attempt") == 1) & (F.col("l.status") == "ok") & ~F.col("l.valid")), F.lit(False)).alias("unfinished"))
    return counted.crossJoin(total).crossJoin(unfinished).select("batches", "by_model", "by_fallback", "retries", ran_out.alias("budget_exhausted"))
