"""Digests, cards and archive rows as ordered aggregations, and the outcomes that come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import RICH_TEXT, titled
from feedloom.operators.prefix import numbered, ranged, running_totals

#: Wording of the rendered texts.
DAILY, RADAR, PLACEHOLDER = "📰 AI 资讯日报 · ", "📡 AI 事件雷达 · ", "[日期待定] "
BANNER = "⚠️ 日期未提取，请查看原文确认"
PER_TOPIC, MAX_CHARS = 4, 2500
#: Events of one card.
PER_CARD = 1000


def render_daily(topics: DataFrame, items: DataFrame, max_chars: int = MAX_CHARS, per_topic: int = PER_TOPIC) -> DataFrame:
    """digest_date, content_md. topics: digest_date, pos, name, summary, item_ids; items: item_id, title, url, source,
    published_at.

    A topic shows the first per_topic ids, unknown ones left out; topics without a line are skipped. Topics are shown
    until the first that would overflow, but one always is. Days without any topic to show have no row. Lengths are added up
    in two levels, so a day of many topics is dealt over tasks; what is shown of it is short.
    """
    ids = topics.select("digest_date", "pos", "name", "summary", F.posexplode(F.slice("item_ids", 1, per_topic)).alias("at", "item_id"))
    day = F.date_format("published_at", "MM-dd")
    line = F.concat_ws(" · ", F.concat(F.lit("- ["), titled(F.col("title")), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")")), F.concat(F.lit("`"), "source", F.lit("`")), day)
    lines = ids.join(items, "item_id").select("digest_date", "pos", "name", "summary", "at", line.alias("line"))
    chunks = lines.groupBy("digest_date", "pos", "name", "summary").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    head = F.concat(F.lit("**"), "name", F.lit("**"), F.when(F.coalesce("summary", F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" — "), "summary")))
    chunks = chunks.select("digest_date", "pos", F.concat_ws("\n", head, F.array_join("l.line", "\n")).alias("chunk"))
    order = [F.col("digest_date"), F.col("pos")]
    before = {"run": F.length("chunk") + 2, "nth": F.lit(1)}
    title = F.concat(F.lit(DAILY), F.col("digest_date").cast("string"))
    dealt = running_totals(ranged(chunks, order, "chunks"), order, before, ["digest_date"]).withColumn("title", title)
    shown = dealt.filter((F.col("run") + F.length("chunk") + F.length("title") + 4 <= max_chars) | (F.col("nth") == 0))
    whole = shown.groupBy("digest_date", "title").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk"))).alias("c"))
    return whole.select("digest_date", F.concat("title", F.lit("\n\n"), F.array_join("c.chunk", "\n\n")).alias("content_md"))


def suffix(attempt: Column) -> Column:
    return F.when(attempt > 1, F.concat(F.lit(" #"), attempt.cast("string"))).otherwise(F.lit(""))


def card(title: Column, template: str, md: Column) -> Column:
    """A chat card as JSON."""
    header = F.struct(F.struct(F.lit("plain_text").alias("tag"), title.alias("content")).alias("title"), F.lit(template).alias("template"))
    body = F.struct(F.struct(F.lit(True).alias("wide_screen_mode")).alias("config"), header.alias("header"), F.array(F.struct(F.lit("markdown").alias("tag"), md.alias("content"))).alias("elements"))
    return F.to_json(F.struct(F.lit("interactive").alias("msg_type"), body.alias("card")))


def event_line() -> Column:
    """One bullet of an event; parts that are missing are left out."""
    some = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    register = F.coalesce(F.concat(F.lit("[报名]("), some("registration_url"), F.lit(")")), F.concat(F.lit("📩 "), some("registration_contact")))
    parts = [
        F.concat(F.lit("🕒 "), F.date_format("published_at", "MM-dd")),
        F.concat(F.lit("[**"), titled(F.col("title")), F.lit("**]("), F.col("url"), F.lit(")")),
        F.concat(F.lit("📆 "), some("event_date")),
        F.concat(F.lit("⏰ 截止 "), some("registration_deadline")),
        F.concat(F.lit("📍 "), some("location")),
        register,
    ]
    return F.concat(F.lit("- "), F.concat_ws(" · ", *parts))


def render_event_batch(events: DataFrame, per_card: int = PER_CARD) -> DataFrame:
    """digest_date, n_events, md, payload, attempt, card of events (digest_date, attempt, pos, title, url, ...); no events, no row. A day of
    more than per_card events has a card for each per_card of them, in order from 0."""
    rows = events.select("digest_date", "attempt", "pos", event_line().alias("line"))
    order = [F.col("digest_date"), F.col("attempt"), F.col("pos"), F.col("line")]
    rows = numbered(ranged(rows, order, "events"), order, "nth", ["digest_date", "attempt"]).withColumn("card", F.expr(f"nth div {per_card}"))
    listed = rows.groupBy("digest_date", "attempt", "card").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    n = F.size("l")
    title = F.concat(F.lit(RADAR), F.col("digest_date").cast("string"), suffix(F.col("attempt")), F.lit(" · "), n.cast("string"), F.lit(" 个新事件"))
    md = F.array_join("l.line", "\n")
    return listed.select("digest_date", n.cast("long").alias("n_events"), md.alias("md"), card(title, "blue", md).alias("payload"), "attempt", "card")


def event_days(cards: DataFrame) -> DataFrame:
    """digest_date, attempt, n_events, md of whole days, from the cards of render_event_batch: one text a day, its cards in order."""
    days = cards.groupBy("digest_date", "attempt").agg(F.sum("n_events").alias("n_events"), F.array_sort(F.collect_list(F.struct("card", "md"))).alias("c"))
    return days.select("digest_date", "attempt", "n_events", F.array_join("c.md", "\n").alias("md"))


def render_daily_card(digests: DataFrame) -> DataFrame:
    """digest_date, payload of digests (digest_date, attempt, content_md); blank ones have no row."""
    title = F.concat(F.lit(DAILY), F.col("digest_date").cast("string"), suffix(F.col("attempt")))
    return digests.filter(F.trim("content_md") != "").select("digest_date", card(title, "green", F.col("content_md")).alias("payload"))


def _rich(col: Column) -> Column:
    piece = F.struct(F.lit("text").alias("type"), F.struct(F.substring(col, 1, RICH_TEXT).alias("content")).alias("text"))
    none = F.array().cast("array<struct<type:string,text:struct<content:string>>>")
    return F.struct(F.when(F.coalesce(col, F.lit("")) == "", none).otherwise(F.array(piece)).alias("rich_text"))


def archive_payload(items: DataFrame, database_id: str) -> DataFrame:
    """item_id, payload. A blank url is null, a blank text an empty list, a blank kind left out."""
    title = F.struct(F.array(F.struct(F.lit("text").alias("type"), F.struct(F.substring(F.coalesce("title", F.lit("")), 1, RICH_TEXT).alias("content")).alias("text"))).alias("title"))
    properties = [
        title.alias("Title"),
        F.struct(F.nullif("url", F.lit("")).alias("url")).alias("url"),
        *[_rich(F.col(c)).alias(c) for c in ("source", "summary", "topic")],
        F.struct(F.struct(F.col("digest_date").cast("string").alias("start")).alias("date")).alias("digest_date"),
    ]
    kind = F.struct(F.struct(F.col("kind").alias("name")).alias("select")).alias("kind")
    parent = F.struct(F.lit(database_id).alias("database_id")).alias("parent")
    options = {"ignoreNullFields": "false"}
    bare = F.to_json(F.struct(parent, F.struct(*properties).alias("properties")), options)
    full = F.to_json(F.struct(parent, F.struct(*properties, kind).alias("properties")), options)
    return items.select("item_id", F.when(F.coalesce("kind", F.lit("")) == "", bare).otherwise(full).alias("payload"))


def calendar_title() -> Column:
    return F.when(F.col("is_placeholder_date"), F.concat(F.lit(PLACEHOLDER), "title")).otherwise(F.col("title"))


def calendar_description() -> Column:
    """Lines of a pending event; a blank line before the source if there is any fact."""
    some = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    facts = F.filter(
        F.array(
            F.concat(F.lit("报名截止: "), some("registration_deadline")),
            F.coalesce(F.concat(F.lit("报名链接: "), some("registration_url")), F.concat(F.lit("报名方式: "), some("registration_contact"))),
            F.concat(F.lit("地点: "), some("location")),
        ),
        lambda x: x.isNotNull(),
    )
    lines = F.concat(
        F.when(F.col("is_placeholder_date"), F.array(F.lit(BANNER), F.lit(""))).otherwise(F.array().cast("array<string>")),
        facts,
        F.when(F.size(facts) > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
        F.when(some("url").isNotNull(), F.array(F.concat(F.lit("原文: "), F.col("url")))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_join(lines, "\n")


def calendar_payload(pending: DataFrame) -> DataFrame:
    """item_id, payload of all-day events; they end on their start date."""
    day = F.struct(F.col("event_date").cast("string").alias("date"))
    fixed = {"visibility": "default", "attendee_ability": "none", "free_busy_status": "free"}
    body = F.struct(calendar_title().alias("summary"), calendar_description().alias("description"), day.alias("start_time"), day.alias("end_time"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    return pending.select("item_id", F.to_json(body).alias("payload"))


def replay_queue(queue: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The retry queue (item_id, ts, error, item, last_retry_ts) after outcomes (item_id, ok, error): delivered rows go,
    failed ones carry the new error, rows without an item or an outcome stay."""
    rows = queue.join(outcomes.select("item_id", F.col("ok").alias("_ok"), F.col("error").alias("_error")), "item_id", "left")
    failed = F.coalesce(~F.col("_ok"), F.lit(False))
    rows = rows.filter(F.col("_ok").isNull() | ~F.col("_ok"))
    return rows.withColumns({"error": F.when(failed, F.col("_error")).otherwise(F.col("error")), "last_retry_ts": F.when(failed, now).otherwise(F.col("last_retry_ts"))}).select(*queue.columns)


def retry_rows(outcomes: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """Queue rows of failed archive outcomes."""
    failed = outcomes.filter(~F.col("ok")).join(items, "item_id")
    return failed.select("item_id", now.alias("ts"), "error", F.struct(*[F.col(c) for c in items.columns]).alias("item"), F.lit(None).cast("timestamp").alias("last_retry_ts"))


def write_markdown(digests: DataFrame, path: str) -> None:
    """One text file a date; other dates' files stay."""
    out = digests.select(F.col("content_md").alias("value"), F.col("digest_date").cast("string").alias("digest_date"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("digest_date").text(path)


def archive_targets(assignments: DataFrame, items: DataFrame, topics: DataFrame, digest_date: Column) -> DataFrame:
    """Assigned items of a day as archive rows."""
    used = assignments.filter(F.col("digest_date") == digest_date)
    named = topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic"), "summary")
    rows = used.join(named, "topic_id").join(items.select(F.col("id").alias("item_id"), "title", "kind", "url", F.col("source_id").alias("source")), "item_id")
    return rows.select("item_id", "title", "kind", "url", "source", "summary", "topic", "digest_date")


def delivery_gate(found: DataFrame, quiet: Column) -> DataFrame:
    """The rows to deliver now: none in quiet hours, they wait for the next run."""
    return found.filter(~quiet)


def delivered(found: DataFrame, outcomes: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows whose delivery succeeded: only these reach a ledger."""
    return found.join(outcomes.filter("ok").select(key), key, "left_semi")


def summarize_sync(results: DataFrame) -> DataFrame:
    """total, synced, dry_run, failed of results (status)."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "ok").alias("synced"),
        F.count_if(F.col("status") == "dry_run").alias("dry_run"),
        F.count_if(F.col("status") == "error").alias("failed"),
    )


def fetch_summary(rows: DataFrame) -> DataFrame:
    """source_id, n_fetched, n_new of rows (source_id, is_new)."""
    return rows.groupBy("source_id").agg(F.count("*").alias("n_fetched"), F.count_if("is_new").alias("n_new"))


def items_per_source(items: DataFrame) -> DataFrame:
    return items.groupBy("source_id").agg(F.count("*").alias("n_items"))


def archive_summary(outcomes: DataFrame) -> DataFrame:
    """succeeded, failed, queued: a failure is queued where its queue row was written."""
    return outcomes.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(~F.col("ok") & F.col("queued")).alias("queued"))


def digest_counters(candidates: DataFrame, survivors: DataFrame, topics: DataFrame, archived: DataFrame) -> DataFrame:
    """One row: candidates, after_dedup, topics, assigned, archived, failed."""
    parts = [
        candidates.agg(F.count("*").alias("candidates")),
        survivors.agg(F.count("*").alias("after_dedup")),
        topics.agg(F.count("*").alias("topics"), F.coalesce(F.sum(F.size("item_ids")), F.lit(0)).alias("assigned")),
        archived.agg(F.count_if("ok").alias("archived"), F.count_if(~F.col("ok")).alias("failed")),
    ]
    out = parts[0].withColumn("_", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_", F.lit(1)), "_")
    return out.drop("_")
