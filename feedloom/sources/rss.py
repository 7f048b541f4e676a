"""RSS and Atom payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.dates import parse_feed_time
from feedloom.functions.text import strip_html

_ITEM = "array<struct<title:string,link:string,description:string,author:string,`dc:creator`:string,pubDate:string,`dc:date`:string,updated:string,`content:encoded`:string>>"
_RSS = f"channel struct<item:{_ITEM}>, item {_ITEM}"  # RSS 1.0 has its items beside the channel
_TEXT = "struct<_VALUE:string,_type:string>"
_ATOM = f"entry array<struct<title:{_TEXT},link:array<struct<_href:string,_rel:string>>,summary:{_TEXT},content:array<{_TEXT}>,author:struct<name:string>,published:string,updated:string>>"


#: A feed has one of these roots.
_SHAPE = r"(?s)^\s*(<\?xml.*?\?>)?\s*(<!--.*?-->\s*)*<(rss|feed|rdf:RDF)[\s>].*</(rss|feed|rdf:RDF)>\s*$"
_RAW = "array<struct<url:string,title:string,content:string,author:string,time:string>>"


def rss_entries(payload: Column, max_items: int = 50) -> Column:
    """The first max_items items or entries of a payload, in order, as they stand in it."""
    # the feed as a lambda's variable, so that the payload is parsed once, in both shapes
    feed = F.from_xml(payload, f"struct<{_RSS}, {_ATOM}>")
    return F.get(F.transform(F.array(feed), lambda f: _feed_entries(f, max_items)), F.lit(0))


def _feed_entries(feed: Column, max_items: int) -> Column:
    none = F.array().cast(_ITEM)
    items = F.transform(
        F.concat(F.coalesce(feed["channel"]["item"], none), F.coalesce(feed["item"], none)),
        lambda i: F.struct(
            i["link"].alias("url"),
            i["title"].alias("title"),
            F.coalesce(i["content:encoded"], i["description"]).alias("content"),
            F.coalesce(i["author"], i["dc:creator"]).alias("author"),
            F.coalesce(i["pubDate"], i["dc:date"], i["updated"]).alias("time"),
        ),
    )
    alternate = lambda link: F.coalesce(link["_rel"], F.lit("alternate")) == "alternate"
    entries = F.transform(
        feed["entry"],
        lambda i: F.struct(
            F.coalesce(F.get(F.filter(i["link"], alternate), F.lit(0))["_href"], F.get(i["link"], F.lit(0))["_href"]).alias("url"),
            i["title"]["_VALUE"].alias("title"),
            F.coalesce(F.get(i["content"], F.lit(0))["_VALUE"], i["summary"]["_VALUE"]).alias("content"),
            i["author"]["name"].alias("author"),
            F.coalesce(i["published"], i["updated"]).alias("time"),
        ),
    )
    return F.slice(F.concat(items.cast(_RAW), F.coalesce(entries.cast(_RAW), F.array().cast(_RAW))), 1, max_items)


def rss_error(payload: Column, entries: Column) -> Column:
    """A payload fails only if it has no entries and is malformed (no feed root)."""
    return F.when((F.coalesce(F.size(entries), F.lit(0)) <= 0) & ~F.coalesce(payload.rlike(_SHAPE), F.lit(False)), F.lit("malformed feed without entries"))


def finish_rss(rows: DataFrame) -> DataFrame:
    """Entries (url, title, content, author, time) as items: content and title without HTML, missing url and title ''."""
    return rows.withColumns(
        {
            "url": F.coalesce("url", F.lit("")),
            "title": F.coalesce(strip_html(F.col("title")), F.lit("")),
            "content": strip_html(F.col("content")),
            "published_at": parse_feed_time(F.col("time")),
        }
    ).drop("time")


def parse_rss(payloads: DataFrame, max_items: int = 50) -> DataFrame:
    """The first max_items items or entries of each payload (source_id, payload), in order, with pos.

    Content is the full content, else the summary or description, without HTML. Missing url and title are ''.
    """
    rows = payloads.select("source_id", F.posexplode(rss_entries(F.col("payload"), max_items)).alias("pos", "i"))
    return finish_rss(rows.select("source_id", "pos", "i.*"))


def rss_outcomes(payloads: DataFrame, items: DataFrame) -> DataFrame:
    """source_id, ok, n_items: a source fails only if it gave no entries and its payload is malformed (no feed root)."""
    n = items.groupBy("source_id").agg(F.count("*").alias("n_items"))
    shape = F.col("payload").rlike(_SHAPE)
    good = payloads.groupBy("source_id").agg(F.min(F.coalesce(shape, F.lit(False)).cast("int")).alias("well_formed"))
    rows = good.join(n, "source_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    return rows.select("source_id", ((F.col("n_items") > 0) | (F.col("well_formed") == 1)).alias("ok"), "n_items")
