"""Aggregator payloads: {items: [{id, title, url, extra: {date}, pubDate}]}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.dates import parse_iso_time


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text_at(v: Column, path: str) -> Column:
    """The string at path; null for other JSON types."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def number_at(v: Column, path: str) -> Column:
    """The number at path as double; null for other JSON types."""
    return F.when(_kind(v, path).rlike("^(BIGINT|DOUBLE|DECIMAL.*|INT|FLOAT)$"), F.try_variant_get(v, path, "double"))


def parse_aggregator_time(v: Column, tz: str = "Asia/Shanghai") -> Column:
    """Epoch milliseconds, else an ISO text, else pubDate as wall time in tz; a shape that fails falls through."""
    ms = number_at(v, "$.extra.date")
    return F.coalesce(
        F.timestamp_millis(F.when(F.abs(ms) < 2.5e14, ms.cast("bigint"))),
        parse_iso_time(text_at(v, "$.extra.date")),
        F.to_utc_timestamp(F.try_to_timestamp(text_at(v, "$.pubDate"), F.lit("yyyy-MM-dd HH:mm:ss")), tz),
    )


def aggregator_entries(payload: Column, max_items: int = 30) -> Column:
    """url, title, published_at of the first max_items entries of a payload; null where they are not what they should be."""
    items = F.slice(F.try_variant_get(F.try_parse_json(payload), "$.items", "array<variant>"), 1, max_items)
    filled = lambda i, path: F.nullif(text_at(i, path), F.lit(""))
    return F.transform(items, lambda i: F.struct(filled(i, "$.url").alias("url"), filled(i, "$.title").alias("title"), parse_aggregator_time(i).alias("published_at")))


def aggregator_error(payload: Column, entries: Column) -> Column:
    """A payload without an items list fails."""
    return F.when(entries.isNull(), F.lit("no items list"))


def finish_aggregator(rows: DataFrame) -> DataFrame:
    """Entries with url and title as items; content and author are null."""
    none = F.lit(None).cast("string")
    return rows.filter("url is not null and title is not null").withColumns({"content": none, "author": none})


def parse_aggregator(payloads: DataFrame, max_items: int = 30) -> DataFrame:
    """Items of each payload (source_id, payload): the first max_items entries, of those the objects with text url and
    title; content and author are null."""
    rows = payloads.select("source_id", F.posexplode(aggregator_entries(F.col("payload"), max_items)).alias("pos", "i"))
    return finish_aggregator(rows.select("source_id", "pos", "i.*")).select("source_id", "pos", "url", "title", "content", "author", "published_at")


def aggregator_outcomes(payloads: DataFrame) -> DataFrame:
    """source_id, ok: a payload without an items list is a failure."""
    has = F.schema_of_variant(F.try_variant_get(F.try_parse_json("payload"), "$.items", "variant")).startswith("ARRAY")
    return payloads.groupBy("source_id").agg((F.min(F.coalesce(has, F.lit(False)).cast("int")) == 1).alias("ok"))
