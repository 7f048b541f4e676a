"""Work queues, calendar lists and dashboard reads. Ties always end on id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.dates import placeholder_date
from feedloom.functions.text import titled
from feedloom.operators.prefix import numbered, ranged

#: Items of one page of a topic.
PAGE = 1000


def newest() -> list[Column]:
    return [F.col("published_at").desc_nulls_last(), F.col("fetched_at").desc(), F.col("id")]


def unclassified(items: DataFrame, limit: int = 50) -> DataFrame:
    """The newest unlabelled items."""
    return items.filter((F.col("kind") == "unclassified") | F.col("kind").isNull()).orderBy(F.col("fetched_at").desc(), "id").limit(limit)


def unpushed_events(items: DataFrame, metadata: DataFrame, pushes: DataFrame, today: Column | None = None) -> DataFrame:
    """Events without a push; with today, only undated ones and those from today on."""
    rows = items.filter(F.col("kind") == "event").join(metadata.withColumnRenamed("item_id", "id"), "id", "left")
    rows = rows.join(pushes.select(F.col("item_id").alias("id")), "id", "left_anti")
    if today is not None:
        rows = rows.filter(F.col("event_date").isNull() | (F.col("event_date") >= today))
    return rows.orderBy(*newest())


def write_assignments(rows: DataFrame, path: str) -> None:
    """Add rows of the assignment ledger (item_id, topic_id, digest_date), a folder for each date, so that eligible_for_digest reads
    the dates it asks for."""
    rows.repartition("digest_date").write.mode("append").partitionBy("digest_date").parquet(path)


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """The ledger that write_assignments wrote."""
    return spark.read.schema("item_id bigint, topic_id string, digest_date date").parquet(path)


def eligible_for_digest(items: DataFrame, assignments: DataFrame, since: Column, limit: int = 50) -> DataFrame:
    """Labelled items that are no events and were in no digest since that date, the newest first."""
    used = assignments.filter(F.col("digest_date") >= since).select(F.col("item_id").alias("id"))
    rows = items.filter(F.col("kind").isin("news", "tool", "other") & F.col("classified_at").isNotNull())
    return rows.join(used, "id", "left_anti").orderBy(*newest()).limit(limit)


def unsynced_calendar(items: DataFrame, metadata: DataFrame, ledger: DataFrame, today: Column, include_undated: bool = False) -> DataFrame:
    """Events with a metadata row from today on (or undated) that are not in the ledger, by date."""
    dated = F.col("event_date") >= today
    rows = items.filter(F.col("kind") == "event").join(metadata.withColumnRenamed("item_id", "id"), "id")
    rows = rows.filter(dated | F.col("event_date").isNull() if include_undated else dated)
    rows = rows.join(ledger.select(F.col("item_id").alias("id")), "id", "left_anti")
    return rows.orderBy(F.col("event_date").asc_nulls_last(), F.col("fetched_at").desc(), "id")


def list_pending(items: DataFrame, metadata: DataFrame, ledger: DataFrame, today: Column, include_undated: bool = False, limit: int | None = None) -> DataFrame:
    """unsynced_calendar with a placeholder date and its flag."""
    rows = unsynced_calendar(items, metadata, ledger, today, include_undated)
    rows = rows.limit(limit) if limit else rows
    return rows.select(
        F.col("id").alias("item_id"),
        titled(F.col("title"), "(untitled event)").alias("title"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("event_date", placeholder_date(today)).alias("event_date"),
        "registration_deadline", "location", "registration_url", "registration_contact",
        F.col("event_date").isNull().alias("is_placeholder_date"),
    )


def digests_on(digests: DataFrame, day: Column) -> DataFrame:
    return digests.filter(F.col("digest_date") == day).orderBy("kind")


def topics_on(topics: DataFrame, assignments: DataFrame, items: DataFrame, sources: DataFrame, day: Column, page_size: int = PAGE) -> DataFrame:
    """Topics of a day, each with its items (newest first) in pages of page_size from page 0 on; topics without items keep
    an empty page."""
    of_day = topics.filter(F.col("digest_date") == day)
    used = assignments.filter(F.col("digest_date") == day).select("item_id", "topic_id")
    named = sources.select(F.col("id").alias("source_id"), "display_name")
    rows = used.join(items.withColumnRenamed("id", "item_id"), "item_id").join(named, "source_id", "left")
    rows = rows.select("topic_id", "item_id", titled(F.col("title"), "(untitled)").alias("title"), "url", F.coalesce("display_name", "source_id").alias("source"), "published_at")
    order = [F.col("topic_id"), F.col("published_at").desc_nulls_last(), F.col("item_id")]
    rows = numbered(ranged(rows, order, "topic-items"), order, "nth", ["topic_id"]).withColumn("page", F.expr(f"nth div {page_size}"))
    listed = rows.groupBy("topic_id", "page").agg(F.array_sort(F.collect_list(F.struct("nth", "item_id", "title", "url", "source"))).alias("entries"))
    out = of_day.withColumnRenamed("id", "topic_id").join(listed, "topic_id", "left")
    entries = F.transform(F.coalesce("entries", F.array().cast(listed.schema["entries"].dataType)), lambda e: e.dropFields("nth"))
    return out.select("topic_id", "name", "summary", F.coalesce("page", F.lit(0).cast("long")).alias("page"), entries.alias("items")).orderBy("topic_id", "page")


def events_on(items: DataFrame, metadata: DataFrame, pushes: DataFrame, digests: DataFrame, day: Column) -> DataFrame:
    """Events published, fetched or pushed in a digest on a day (UTC dates)."""
    pushed = pushes.join(digests.select(F.col("id").alias("digest_id"), "digest_date"), "digest_id", "left").select(F.col("item_id").alias("id"), F.col("digest_date").alias("pushed_on"))
    rows = items.filter(F.col("kind") == "event").join(metadata.withColumnRenamed("item_id", "id"), "id", "left").join(pushed, "id", "left")
    hit = (F.to_date("published_at") == day) | (F.to_date("fetched_at") == day) | (F.col("pushed_on") == day)
    return rows.filter(hit).orderBy(*newest())


def calendar_synced_on(ledger: DataFrame, items: DataFrame, metadata: DataFrame, day: Column) -> DataFrame:
    rows = ledger.filter(F.to_date("synced_at") == day).join(items.withColumnRenamed("id", "item_id"), "item_id")
    return rows.join(metadata, "item_id", "left").orderBy(F.col("synced_at").desc(), "item_id")


def calendar_pending(items: DataFrame, metadata: DataFrame, ledger: DataFrame, day: Column) -> DataFrame:
    return unsynced_calendar(items, metadata, ledger, day).select("id", "title", "event_date", "location")


def ledger_or_empty(spark: SparkSession, name: str, schema: str) -> tuple[DataFrame, bool]:
    """The table, or an empty one with the schema, and whether it exists."""
    exists = spark.catalog.tableExists(name)
    return (spark.table(name) if exists else spark.createDataFrame([], schema)), exists


def recent_dates(digests: DataFrame, topics: DataFrame, limit: int = 14) -> DataFrame:
    return digests.select("digest_date").union(topics.select("digest_date")).distinct().orderBy(F.col("digest_date").desc()).limit(limit)


def dashboard(tables: dict[str, DataFrame], day: Column) -> dict[str, DataFrame]:
    """All reads of one day, and the days before and after that have something."""
    t = tables
    days = t["digests"].select("digest_date").union(t["topics"].select("digest_date")).distinct()
    near = days.agg(
        F.max(F.when(F.col("digest_date") < day, F.col("digest_date"))).alias("previous_date"),
        F.min(F.when(F.col("digest_date") > day, F.col("digest_date"))).alias("next_date"),
        F.coalesce(F.max((F.col("digest_date") == day).cast("int")), F.lit(0)).cast("boolean").alias("has_data"),
    )
    return {
        "digests": digests_on(t["digests"], day),
        "topics": topics_on(t["topics"], t["assignments"], t["items"], t["sources"], day),
        "events": events_on(t["items"], t["metadata"], t["pushes"], t["digests"], day),
        "synced": calendar_synced_on(t["ledger"], t["items"], t["metadata"], day),
        "pending": calendar_pending(t["items"], t["metadata"], t["ledger"], day),
        "dates": recent_dates(t["digests"], t["topics"]),
        "near": near,
    }


def refill_candidates(items: DataFrame, metadata: DataFrame, limit: int | None = None) -> DataFrame:
    """Events that have metadata but neither a registration link nor a contact."""
    rows = items.filter(F.col("kind") == "event").join(metadata.withColumnRenamed("item_id", "id"), "id")
    rows = rows.filter(F.col("registration_url").isNull() & F.col("registration_contact").isNull()).orderBy(F.col("fetched_at").desc(), "id")
    return rows.limit(limit) if limit else rows


def browse(items: DataFrame, source: str | None = None, kind: str | None = None, since: Column | None = None, text: str | None = None) -> DataFrame:
    """Items by source, kind, fetch time and a piece of title or content."""
    rows = items
    if source is not None:
        rows = rows.filter(F.col("source_id") == source)
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if since is not None:
        rows = rows.filter(F.col("fetched_at") >= since)
    if text:
        rows = rows.filter(F.coalesce(F.contains(F.lower("title"), F.lit(text.lower())) | F.contains(F.lower("content"), F.lit(text.lower())), F.lit(False)))
    return rows


def source_board(sources: DataFrame, items: DataFrame) -> DataFrame:
    """Sources with item count, health and last success."""
    n = items.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n_items"))
    return sources.join(n, "id", "left").select("id", "display_name", F.coalesce("n_items", F.lit(0)).alias("n_items"), "health_score", "last_success_at")


def override_kinds(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """items with the kinds that overrides (id, kind) set by hand; classified_at becomes null."""
    o = overrides.select("id", F.col("kind").alias("_kind")).dropDuplicates(["id"])
    rows = items.join(o, "id", "left")
    set_ = F.col("_kind").isNotNull()
    return rows.withColumns({"classified_at": F.when(~set_, F.col("classified_at")), "kind": F.coalesce("_kind", "kind")}).select(*items.columns)
