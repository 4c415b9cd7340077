"""Captured items: JSON lines with aliases, made rows of one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.functions import text as X

#: Every name that a captured item may use.
ITEM = (
    "url string, status_url string, status_id string, text string, tweet_text string, raw_text string, handle string, author_handle string, "
    "author_name string, created_at string, captured_at string, links array<string>"
)
ENVELOPE = f"items array<struct<{ITEM.replace(' string', ':string').replace(' array', ':array')}>>, batches bigint, metrics struct<scroll_y:double,page_height:double,visible_articles:bigint>"


def _first(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names])


def _time(name: str) -> Column:
    """ISO text with an offset, or the plain form with a blank; null for anything else."""
    return F.coalesce(F.try_to_timestamp(F.col(name)), F.try_to_timestamp(F.col(name), F.lit("yyyy-MM-dd HH:mm:ss")))


def normalise(items: DataFrame) -> DataFrame:
    """Rows with a status id: id, url, author, text, links, times and ``content_hash``.
    Items without an id in their URL are dropped, as nothing could ever match them."""
    url = _first("status_url", "url")
    handle = F.regexp_replace(_first("author_handle", "handle"), "^@+", "")
    rows = items.select(
        F.coalesce(F.nullif("status_id", F.lit("")), X.status_id(url)).alias("status_id"),
        X.normalize_status_url(url, handle).alias("status_url"),
        handle.alias("author_handle"),
        F.trim(F.coalesce("author_name", F.lit(""))).alias("author_name"),
        F.coalesce(_first("tweet_text", "text"), F.lit("")).alias("text"),
        F.trim(F.coalesce("raw_text", F.lit(""))).alias("raw_text"),
        F.array_distinct(F.coalesce("links", F.array().cast("array<string>"))).alias("links"),
        _time("created_at").alias("created_at"),
        _time("captured_at").alias("captured_at"),
    ).where("status_id IS NOT NULL")
    return rows.withColumn("content_hash", X.content_hash(F.col("status_id"), F.col("text"), F.col("raw_text"), F.to_json("links")))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return normalise(spark.read.schema(ITEM).json(path))


def from_envelopes(lines: DataFrame, at: str, order: str | None = None) -> DataFrame:
    """Items of the last line like ``..._JSON={...}`` of column ``value``, with its
    numbers of batches and metrics. ``at`` is the time of capture as ISO text; items
    without one of their own get it less a microsecond for each place, so that a
    newest-first sort keeps the order of the screen. ``order`` names the column that
    orders the lines (the lines' own order in their file without one)."""
    body = F.regexp_extract("value", r"_JSON=(\{.*)$", 1)
    place = F.col(order) if order else F.monotonically_increasing_id()
    last = lines.select(body.alias("body"), place.alias("place")).where("body <> ''").agg(F.max_by("body", "place").alias("body"))
    e = last.select(F.from_json("body", ENVELOPE).alias("e"))
    items = e.select(F.posexplode("e.items").alias("place", "item"), F.col("e.batches").alias("batches"), F.col("e.metrics").alias("metrics"))
    base = F.unix_micros(F.to_timestamp(F.lit(at))) - F.col("place")
    captured = F.coalesce(F.nullif(F.col("item.captured_at"), F.lit("")), F.date_format(F.timestamp_micros(base), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return items.withColumn("captured", captured).select("item.*", "captured", "place", "batches", "metrics.*").drop("captured_at").withColumnRenamed("captured", "captured_at")
