"""JSON record trees: append-only lines under date folders, one-file-per-key records, and their orderings."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

ITEMS = "item_id string, source_id string, kind string, external_id string, canonical_url string, title string, summary string, author string, published_at string, fetched_at string, content_hash string, transcript_ref string, lang string"
KEYWORDS = "item_id string, keyword string, rank int, method string, model string, extracted_at string"
DIGESTS = "digest_id string, kind string, category string, period_start string, period_end string, title string, body_md string, top_keywords string, model string, prompt_version string, created_at string"
FETCH_LOG = "source_id string, run_id string, started_at string, status string, items_new int, error string, duration_ms int, rung string, resolved_url string, acquisition_trace string"
LLM_LOG = "run_id string, purpose string, model string, input_items int, tokens_in int, tokens_out int, status string, created_at string"
MANIFEST = "run_id string, command string, started_at string, finished_at string, ok boolean, counts map<string, int>, durations_ms map<string, int>, notes array<string>"
EVAL = "item_id string, title string, summary string, expected_keywords array<string>"



class Record(NamedTuple):
    """A table of records: its columns, those that may be missing or null, the values of enumerations, its order, and whether more fields may come."""

    schema: str
    optional: tuple[str, ...]
    values: dict[str, tuple[str, ...]]
    order: tuple[str, ...]
    open: bool = False


_KIND = ("rss", "youtube", "reddit", "x")
_RUNG = ("direct", "alt_endpoint", "autodiscovery", "substack_archive", "mirror", "third_party")
TABLES = {
    "items": Record(ITEMS, ("external_id", "summary", "author", "transcript_ref", "lang"), {"kind": _KIND}, ("published_at", "item_id")),
    "item_keywords": Record(KEYWORDS, ("model",), {"method": ("llm", "fallback")}, ("item_id", "rank", "keyword", "method")),
    "digests": Record(DIGESTS, (), {"kind": ("daily", "weekly")}, ("digest_id",)),
    "fetch_log": Record(
        FETCH_LOG, ("items_new", "error", "duration_ms", "rung", "resolved_url", "acquisition_trace"), {"status": ("ok", "empty", "error", "skipped"), "rung": _RUNG}, ("started_at", "seq"), open=True
    ),
    "llm_log": Record(LLM_LOG, ("input_items", "tokens_in", "tokens_out"), {}, ("created_at", "run_id", "purpose")),
    "eval": Record(EVAL, ("summary", "expected_keywords"), {}, ("item_id",)),
}


def fault(value: Column, record: Column, table: Record) -> Column:
    """What is wrong with a line of JSON and the record parsed from it, or null: not an object, a wrong type, a missing or further field, a value outside its enumeration."""
    kind = T.StructType.fromDDL(table.schema)
    names = [f.name for f in kind]
    keys = F.json_object_keys(value)
    # a field that has a value in the JSON and none in the record has another type
    wrong = [F.when(record[n].isNull() & F.get_json_object(value, f"$.{n}").isNotNull(), F.lit(f"{n}: wrong type")) for n in names]
    missing = [F.when(record[n].isNull(), F.lit(f"{n}: missing")) for n in names if n not in table.optional]
    outside = [F.when(~record[n].isin(*allowed), F.concat(F.lit(f"{n}: "), record[n])) for n, allowed in table.values.items()]
    more = F.array_except(keys, F.array(*map(F.lit, names)))
    further = [] if table.open else [F.when(F.size(more) > 0, F.concat(F.lit("further fields: "), F.array_join(F.array_sort(more), ", ")))]
    return F.coalesce(F.when(keys.isNull(), F.lit("not an object")), *wrong, *missing, *outside, *further)


def scan(spark: SparkSession, path: str, table: str, one_per_file: bool = False) -> DataFrame:
    """The records of a table in its order; a missing folder is an empty table, and a faulty record an error that names its file and place.

    Lines of ``*.jsonl`` below ``path``, or one object a ``*.json`` file (``one_per_file``).  Of the fetch log the lines' places (``seq``) keep append order.
    """
    own = TABLES[table]
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json" if one_per_file else "*.jsonl")
    try:
        text = reader.text(path, wholetext=one_per_file)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], own.schema)
    seq = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = text.select("value", seq.alias("seq")).where(F.trim("value") != "").select("value", "seq", F.from_json("value", own.schema).alias("r"))
    broken = fault(F.col("value"), F.col("r"), own)
    place = F.concat(F.col("seq.f"), F.lit(": "), broken, F.lit(" in "), F.substring("value", 1, 200))
    checked = rows.select(F.when(broken.isNotNull(), F.raise_error(place).cast(T.StructType.fromDDL(own.schema))).otherwise(F.col("r")).alias("r"), "seq")
    ordered = checked.select("r.*", "seq").orderBy(*own.order)
    return ordered if "seq" in own.order else ordered.drop("seq")


def faults(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(file, line, fault) of the faulty lines below ``path``; lines are numbered from 1 in files that were read as a whole."""
    own = TABLES[table]
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    lines = whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "value")).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", own.schema))
    return parsed.select("file", (F.col("n") + 1).alias("line"), fault(F.col("value"), F.col("r"), own).alias("fault")).where("fault IS NOT NULL")


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """All ``*.jsonl`` below ``path``; a missing folder is an empty table, a broken line an error where ``strict``, else left out."""
    kind = T.StructType.fromDDL(schema)
    reader = spark.read.schema(kind).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    try:
        return reader.json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kind)


def read_sequenced(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines with ``seq``, their place in (file, offset) order, so that ties of time keep append order."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    rows = text.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).where(F.trim("value") != "")
    parsed = rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "f", "b", "i")
    return parsed.select("r.*", F.struct("f", "b", "i").alias("seq"))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def latest_manifest(manifests: DataFrame) -> DataFrame:
    return manifests.agg(F.max_by(F.struct(*manifests.columns), "run_id").alias("m")).where("m IS NOT NULL").select("m.*")


def tolerant(column, schema: str):
    """A JSON text that may be broken: null then."""
    return F.from_json(column, schema, {"mode": "PERMISSIVE"})


def folder_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(folder, bytes) by the first folder below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    root = path.rstrip("/").split("://")[-1]
    below = F.regexp_extract("path", rf"{root}/([^/]+)", 1)
    return files.groupBy(below.alias("folder")).agg(F.sum("length").alias("bytes"))
