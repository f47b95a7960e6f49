"""State, documents and raw bodies: readers and sinks over files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import timestamps, urls
from pagewright.operators import state

STATE_SCHEMA = (
    "identifier string, last_updated string, timestamp_source string, content_hash string, structured_hash string, "
    "last_modified_header string, etag_header string, crawl_timestamp string, detected_language string, "
    "language_confidence double, language_source string, is_rtl boolean, script_hint string"
)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of URL -> state as rows; unreadable text gives none. String values come as `legacy`."""
    return parse_state(spark.read.text(path, wholetext=True))


def parse_state(raw: DataFrame) -> DataFrame:
    """The states that the JSON texts in `value` hold."""
    values = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("url", "v"))
    return values.select("url", F.from_json("v", STATE_SCHEMA).alias("s"), F.when(~F.col("v").startswith("{"), F.col("v")).alias("legacy")).select("url", "s.*", "legacy")


def write_state(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, prefix, text) of Markdown files, by their names."""
    return named_documents(spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.input_file_name().alias("path"), "value"))


def named_documents(files: DataFrame) -> DataFrame:
    """(doc_key, prefix, text) of (path, value) rows."""
    files = files.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("doc_key"), F.col("value").alias("text"))
    return files.select("doc_key", F.regexp_extract("doc_key", "^([^_]*)", 1).alias("prefix"), "text")


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents as Parquet, a folder per host label."""
    docs.withColumn("prefix", urls.domain_prefix(F.col("url"))).write.mode("overwrite").partitionBy("prefix").parquet(path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(path, content_hash, length) of bodies that aren't HTML."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("content_hash"), "length")


def analyse_bodies(bodies: DataFrame, id_col: str, as_of: Column, keep: Sequence[str] = ()) -> DataFrame:
    """bodies(id, content_type, body, last_modified) as state: (id, *keep, content_hash, fuzzy_hash, last_updated, timestamp_source).

    A row for each body, in one narrow projection; `keep` names more of its columns that go along. Only bodies of text, JSON or XML have a fuzzy hash; the time is the header's, where it is a reasonable one.
    """
    readable = F.coalesce(F.lower("content_type").rlike("^(text/|application/json|application/xml)"), F.lit(False))
    fuzzy = F.when(readable, state.fuzzy_hash(F.decode("body", "UTF-8")))
    at = timestamps.normalize(F.col("last_modified"), as_of)
    return bodies.select(
        id_col, *keep, F.sha2("body", 256).alias("content_hash"), fuzzy.alias("fuzzy_hash"), timestamps.utc_text(at).alias("last_updated"),
        F.when(at.isNotNull(), "http_header").otherwise("none").alias("timestamp_source"),
    )
