"""Transcripts kept by reference: gzip files, fetched once, cut to a length, never read from outside their folder."""

from __future__ import annotations

import gzip
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS = 60_000


class TranscriptStore:
    def __init__(self, root: str, fetch: Callable[[str], str | None], max_chars: int = MAX_CHARS) -> None:
        self.root, self.fetch, self.max_chars = os.path.realpath(root), fetch, max_chars

    def _path(self, ref: str) -> str:
        path = os.path.realpath(os.path.join(self.root, ref))
        if os.path.commonpath([path, self.root]) != self.root:
            raise ValueError(f"{ref!r} leaves the transcript folder")
        return path

    def ensure(self, video: str) -> str | None:
        """The reference of the transcript; a known one isn't fetched again, a failure is None."""
        ref = f"{video}.txt.gz"
        path = self._path(ref)
        if os.path.exists(path):
            return ref
        try:
            text = self.fetch(video)
        except Exception:  # the fetcher is foreign code; a transcript is optional
            return None
        if not text:
            return None
        os.makedirs(self.root, exist_ok=True)
        with open(path, "wb") as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as f:
            f.write(text[: self.max_chars].encode())
        return ref

    def read(self, ref: str | None) -> str | None:
        if not ref:
            return None
        try:
            with gzip.open(self._path(ref), "rt", encoding="utf-8") as f:
                return f.read()
        except OSError:
            return None


@F.arrow_udf(T.StringType())
def _gunzip(column: pa.Array) -> pa.Array:
    return pa.array([None if c is None else gzip.decompress(c).decode() for c in column.to_pylist()], pa.string())


def transcripts(spark: SparkSession, root: str) -> DataFrame:
    """(transcript_ref, transcript) of all files, to be joined to items."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(root)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("transcript_ref"), _gunzip("content").alias("transcript"))
