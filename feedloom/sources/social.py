"""Social search payloads (JSON-RPC envelopes) and note details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.sources.aggregator import number_at, text_at
from feedloom.sources.registry import first_in_run

NOTE_URL = "https://www.xiaohongshu.com/explore/"
_ENVELOPE = "result struct<content:array<struct<type:string,text:string>>,isError:boolean>"


def envelope_text(payload: Column) -> Column:
    """The first text block of an envelope; null without one."""
    content = F.from_json(payload, _ENVELOPE)["result"]["content"]
    return F.get(F.filter(content, lambda x: (x["type"] == "text") & x["text"].isNotNull()), F.lit(0))["text"]


def social_entries(payload: Column, max_per_keyword: int = 10) -> Column:
    """The first entries of feeds of a search payload; null without a text block or a list."""
    feeds = F.slice(F.try_variant_get(F.try_parse_json(envelope_text(payload)), "$.feeds", "array<variant>"), 1, max_per_keyword)
    filled = lambda f, path: F.nullif(text_at(f, path), F.lit(""))
    return F.transform(
        feeds,
        lambda f: F.struct(
            filled(f, "$.id").alias("feed_id"),
            F.concat(F.lit(NOTE_URL), filled(f, "$.id"), F.lit("?xsec_token="), filled(f, "$.xsecToken")).alias("url"),
            F.coalesce(filled(f, "$.noteCard.displayTitle"), filled(f, "$.noteCard.title"), F.lit("")).alias("title"),
            text_at(f, "$.noteCard.desc").alias("content"),
            text_at(f, "$.noteCard.user.nickname").alias("author"),
            F.timestamp_millis(number_at(f, "$.noteCard.createTime").cast("bigint")).alias("published_at"),
        ),
    )


def social_error(payload: Column, entries: Column) -> Column:
    """Text that is no JSON fails."""
    text = envelope_text(payload)
    return F.when(text.isNotNull() & F.try_parse_json(text).isNull(), F.lit("text is no JSON"))


def parse_social_search(payloads: DataFrame, max_per_keyword: int = 10) -> DataFrame:
    """Items of search payloads (source_id, keyword, keyword_pos, payload): per keyword the first entries of feeds, those
    with id and token; no text block or no list gives none."""
    rows = payloads.select("source_id", "keyword", "keyword_pos", F.posexplode(social_entries(F.col("payload"), max_per_keyword)).alias("pos", "f"))
    return rows.select("source_id", "keyword", "keyword_pos", "pos", "f.*").filter(F.col("url").isNotNull())


def search_failures(payloads: DataFrame) -> DataFrame:
    """source_id, keyword, failed: text that is no JSON is a failure of its keyword."""
    return payloads.select("source_id", "keyword", social_error(F.col("payload"), F.lit(None)).isNotNull().alias("failed"))


def first_of_url(items: DataFrame) -> DataFrame:
    """One row of each URL in a run: the first by keyword, then position."""
    return first_in_run(items, "url", [F.col("keyword_pos"), F.col("pos")])


def extract_note_detail(payload: Column) -> Column:
    """struct<title, content> of the first place that has content: the root, then under feed, data and note the key
    itself and its note, noteCard and feed, each perhaps wrapping noteCard. Null for errors and without content."""
    places = [""] + [f".{k}{s}" for k in ("feed", "data", "note") for s in ("", ".note", ".noteCard", ".feed")]

    def found(v: Column) -> Column:
        def first(*paths: str) -> Column:
            return F.coalesce(*[F.nullif(F.trim(text_at(v, f"${p}")), F.lit("")) for p in paths])

        ways = []
        for at in [at for place in places for at in (f"{place}.noteCard", place)]:
            content = first(f"{at}.desc", f"{at}.content")
            title = first(f"{at}.title", f"{at}.displayTitle")
            ways.append(F.when(content.isNotNull(), F.struct(title.alias("title"), content.alias("content"))))
        return F.coalesce(*ways)

    error = F.coalesce(F.from_json(payload, _ENVELOPE)["result"]["isError"], F.lit(False))
    # a lambda's variable, so that the text is parsed once for all places
    return F.when(~error, F.get(F.transform(F.array(F.try_parse_json(envelope_text(payload))), found), F.lit(0)))


def enrich_with_detail(items: DataFrame, cache: DataFrame, enrich_detail: bool = True) -> DataFrame:
    """items (feed_id, content, ...) with the cached content where there is some; else the preview stays."""
    if not enrich_detail:
        return items
    full = cache.select("feed_id", F.nullif("content", F.lit("")).alias("_full"))
    return items.join(full, "feed_id", "left").withColumn("content", F.coalesce("_full", "content")).select(*items.columns)
