"""Feed tables derived from the supplied ones by arithmetic on their ids, so that every query grows with its input.

Each view has a DuckDB twin in ORACLE, a prefix of common table expressions for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = "2024-01-20"


def today():
    return F.lit(TODAY).cast("date")


class Views:
    """The derived tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def items(self) -> DataFrame:
        d = self.table("documents")
        n = F.col("doc_id")
        key = F.when(n % 10 == 9, n - 1).when(n % 40 == 25, n - 20).otherwise(n)
        kind = F.element_at(F.array(*[F.lit(k) for k in ("event", "news", "tool", "other", "unclassified")]), (n % 5 + 1).cast("int"))
        fetched = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-01 00:00:00").cast("timestamp")) + n)
        return d.select(
            n.alias("id"),
            F.col("source").alias("source_id"),
            F.concat(F.lit("https://feed.example.com/p/"), key.cast("string")).alias("url"),
            F.concat(F.lit("https://feed.example.com/p/"), key.cast("string"), F.when(n % 2 == 0, F.lit("?utm_source=f")).otherwise(F.lit("/"))).alias("raw_url"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("content"),
            F.lit(None).cast("string").alias("author"),
            F.when(n % 13 != 0, F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + n * 420)).alias("published_at"),
            fetched.alias("fetched_at"),
            kind.alias("kind"),
            F.when(n % 5 != 4, fetched).alias("classified_at"),
            F.lit(None).cast("timestamp").alias("notion_archived_at"),
        )

    @property
    def stories(self) -> DataFrame:
        return self.items.select("id", "title", F.col("url").alias("canonical_url"), "published_at", F.length("content").alias("content_len"), "source_id")

    def _ids(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("n"))

    @property
    def metadata(self) -> DataFrame:
        n, base = F.col("n"), F.lit("2024-01-01").cast("date")
        day = F.date_add(base, (n % 60).cast("int"))
        return self._ids().filter("n % 5 = 0 and n % 3 <> 1").select(
            n.alias("item_id"),
            F.when(n % 7 != 0, day).alias("event_date"),
            F.when(n % 2 == 0, F.date_sub(day, 2)).alias("registration_deadline"),
            F.when(n % 4 != 0, F.concat(F.lit("Hall "), (n % 9).cast("string"))).alias("location"),
            F.when(n % 6 == 0, F.concat(F.lit("https://sign.example.com/"), n.cast("string"))).alias("registration_url"),
            F.when(n % 10 == 5, F.concat(F.lit("desk "), n.cast("string"))).alias("registration_contact"),
            F.lit(None).cast("timestamp").alias("extracted_at"),
        )

    @property
    def pushes(self) -> DataFrame:
        n = F.col("n")
        return self._ids().filter("n % 20 = 0").select(n.alias("item_id"), F.lit(None).cast("timestamp").alias("pushed_at"), F.concat(F.lit("d"), (F.floor(n / 20) % 30).cast("string")).alias("digest_id"))

    @property
    def digests(self) -> DataFrame:
        n = F.col("n")
        day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 30).cast("int"))
        one = self._ids().groupBy((n % 30).alias("n")).agg(F.count("*").alias("size"))
        return one.select(
            F.concat(F.lit("d"), n.cast("string")).alias("id"),
            day.alias("digest_date"),
            F.when(n % 2 == 0, F.lit("event_batch")).otherwise(F.lit("daily_digest")).alias("kind"),
            F.concat(F.lit("digest of "), F.col("size").cast("string")).alias("content_md"),
            F.lit(None).cast("timestamp").alias("pushed_at"),
            F.lit(None).cast("timestamp").alias("archived_at"),
            (n % 3).cast("int").alias("push_attempts"),
            F.lit(0).alias("archive_attempts"),
        )

    @property
    def topics(self) -> DataFrame:
        n = F.col("n")
        one = self._ids().groupBy((n % 120).alias("n")).agg(F.count("*").alias("size"))
        return one.select(
            F.concat(F.lit("t"), n.cast("string")).alias("id"),
            F.concat(F.lit("Topic "), n.cast("string")).alias("name"),
            F.when(n % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("about "), F.col("size").cast("string"))).alias("summary"),
            F.date_add(F.lit("2024-01-01").cast("date"), (n % 24).cast("int")).alias("digest_date"),
            F.lit(None).cast("timestamp").alias("created_at"),
        )

    @property
    def assignments(self) -> DataFrame:
        n = F.col("n")
        return self._ids().filter("n % 5 in (1, 2) and n % 4 <> 0").select(
            n.alias("item_id"), F.concat(F.lit("t"), (n % 120).cast("string")).alias("topic_id"), F.date_add(F.lit("2024-01-01").cast("date"), (n % 24).cast("int")).alias("digest_date")
        )

    @property
    def ledger(self) -> DataFrame:
        n = F.col("n")
        at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-18 00:00:00").cast("timestamp")) + (F.floor(n / 25) % 5) * 43200)
        return self._ids().filter("n % 25 = 0").select(n.alias("item_id"), F.lit("cal").alias("calendar_id"), F.concat(F.lit("e"), n.cast("string")).alias("external_event_id"), at.alias("synced_at"))

    @property
    def sources(self) -> DataFrame:
        one = self.table("documents").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
        return one.select("id", F.when(F.col("id") == "src3", F.lit(None)).otherwise(F.concat(F.lit("Feed "), "id")).alias("display_name"), F.lit("rss").alias("fetcher_type"), F.lit("{}").alias("config_json"), F.lit(True).alias("enabled"), F.lit(1.0).alias("health_score"), F.lit(None).cast("timestamp").alias("last_success_at"), F.lit(None).cast("string").alias("last_error"))

    @property
    def outcomes(self) -> DataFrame:
        e = self.table("events")
        return e.select((F.col("user_id") % 20).cast("string").alias("source_id"), "ts", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", F.lit("error")).alias("error"))

    @property
    def label_answers(self) -> DataFrame:
        """Raw model texts: fenced, bare, unknown kinds, no JSON, with and without metadata."""
        n = F.col("n")
        meta = F.concat(F.lit('{"event_date": "2024-'), F.lpad((n % 14).cast("string"), 2, "0"), F.lit('-10", "registration_deadline": " 2024-02-01 ", "location": " Hall '), (n % 7).cast("string"), F.lit('", "registration_url": "", "registration_contact": '), (n % 5).cast("string"), F.lit("}"))
        kind = F.element_at(F.array(*[F.lit(k) for k in ("event", "News", "spam", "event", "tool")]), (n % 5 + 1).cast("int"))
        body = F.concat(F.lit('{"kind": "'), kind, F.lit('", "event_metadata": '), F.when(n % 3 == 0, F.lit("null")).otherwise(meta), F.lit("}"))
        raw = F.when(n % 11 == 0, F.lit("not json")).when(n % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
        return self._ids().select(n.alias("id"), raw.alias("raw"))

    @property
    def aggregator_payloads(self) -> DataFrame:
        """Twenty documents a payload, positions as in doc_id."""
        d = self.table("documents").select("doc_id", "source", (F.floor(F.col("doc_id") / 20)).alias("g"))
        n = F.col("doc_id")
        title = F.when(n % 9 == 4, F.lit("5")).when(n % 9 == 5, F.lit('""')).otherwise(F.concat(F.lit('"title '), n.cast("string"), F.lit('"')))
        date = F.when(n % 4 == 0, F.concat(F.lit(', "extra": {"date": '), (F.lit(1700000000000) + n * 1000).cast("string"), F.lit("}"))).when(n % 4 == 1, F.lit(', "extra": {"date": "2024-02-03T04:05:06+08:00"}')).when(n % 4 == 2, F.lit(', "extra": {"date": "soon"}, "pubDate": "2024-02-03 12:00:00"')).otherwise(F.lit(""))
        entry = F.concat(F.lit('{"id": "'), n.cast("string"), F.lit('", "title": '), title, F.lit(', "url": "https://n.example.com/'), n.cast("string"), F.lit('"'), date, F.lit("}"))
        listed = d.select("g", n, entry.alias("entry")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))).alias("l"))
        return listed.select(F.col("g").cast("string").alias("source_id"), F.concat(F.lit('{"items": ['), F.array_join("l.entry", ", "), F.lit("]}")).alias("payload"))

    @property
    def search_payloads(self) -> DataFrame:
        """Each conversation as a search envelope: a feed for each turn."""
        c = self.table("conversations")
        token = F.when(F.col("turn") % 4 == 3, F.lit("")).otherwise(F.lit("tok"))
        feed = F.struct(
            F.concat(F.lit("f"), F.col("conv_id") % 50, F.lit("-"), F.col("turn")).alias("id"),
            token.alias("xsecToken"),
            F.struct(F.when(F.col("turn") % 2 == 0, F.col("text")).alias("displayTitle"), F.lit("plain").alias("title"), F.col("text").alias("desc"), F.struct(F.col("role").alias("nickname")).alias("user"), (F.lit(1700000000000) + F.col("conv_id") * 1000).alias("createTime")).alias("noteCard"),
        )
        listed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", feed.alias("f")))).alias("l"))
        inner = F.to_json(F.struct(F.col("l.f").alias("feeds")))
        outer = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("text").alias("type"), inner.alias("text"))).alias("content")).alias("result")))
        return listed.select(F.lit("social").alias("source_id"), F.col("conv_id").cast("string").alias("keyword"), F.col("conv_id").alias("keyword_pos"), outer.alias("payload"))

    @property
    def rss_payloads(self) -> DataFrame:
        """Twenty documents a feed."""
        d = self.table("documents")
        esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
        item = F.concat(F.lit("<item><title>"), esc(F.substring_index("text", "\n", 1)), F.lit("</title><link>https://r.example.com/"), F.col("doc_id").cast("string"), F.lit("</link><description><![CDATA[<p>"), F.replace("text", F.lit("]]>"), F.lit("")), F.lit("</p>]]></description><pubDate>Mon, "), day, F.lit(" Jan 2024 08:00:00 +0800</pubDate></item>"))
        listed = d.select(F.floor(F.col("doc_id") / 20).alias("g"), "doc_id", item.alias("item")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("l"))
        return listed.select(F.col("g").cast("string").alias("source_id"), F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>t</title>'), F.array_join("l.item", ""), F.lit("</channel></rss>")).alias("payload"))

    @property
    def card_pages(self) -> DataFrame:
        """Ten documents a page of event cards."""
        n = F.col("doc_id")
        when = F.concat(F.lpad((n % 12 + 1).cast("string"), 2, "0"), F.lit("/"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit(" 周六 09:00"))
        place = F.element_at(F.array(F.lit("广东深圳"), F.lit("上海"), F.lit("线上活动")), (n % 3 + 1).cast("int"))
        href = F.concat(F.lit("/event/"), (n % 7 + F.floor(n / 10) * 10).cast("string"), F.lit("?x="), n.cast("string"))
        title = F.concat(F.when(n % 9 == 0, F.lit("招生 ")).otherwise(F.lit("AI ")), n.cast("string"))
        html = F.concat(F.lit('<div class="search-tab-content-item-mesh"><a href="'), href, F.lit('"><img src="i"></a><a href="'), href, F.lit('">'), title, F.lit("</a><div>"), when, F.lit(" "), place, F.lit('</div><a href="/org/1"><img></a><a href="/org/1">Org '), (n % 5).cast("string"), F.lit(" 粉丝 12</a></div>"))
        d = self.table("documents").select(F.floor(n / 10).alias("g"), "doc_id", html.alias("h"))
        listed = d.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("doc_id", "h"))).alias("l"))
        return listed.select(F.lit("cards").alias("source_id"), F.col("g").alias("page_pos"), F.concat(F.lit("<html><body>"), F.array_join("l.h", ""), F.lit("</body></html>")).alias("payload"))


#: DuckDB twins of the views.
ORACLE = """
items AS (
  SELECT doc_id AS id, source AS source_id, 'https://feed.example.com/p/' || CAST(CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 WHEN doc_id % 40 = 25 THEN doc_id - 20 ELSE doc_id END AS VARCHAR) AS url,
    split_part(text, chr(10), 1) AS title, text AS content,
    CASE WHEN doc_id % 13 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes(7 * doc_id) END AS published_at,
    TIMESTAMP '2024-03-01' + to_seconds(doc_id) AS fetched_at,
    CASE doc_id % 5 WHEN 0 THEN 'event' WHEN 1 THEN 'news' WHEN 2 THEN 'tool' WHEN 3 THEN 'other' ELSE 'unclassified' END AS kind,
    CASE WHEN doc_id % 5 <> 4 THEN TIMESTAMP '2024-03-01' + to_seconds(doc_id) END AS classified_at
  FROM documents
), metadata AS (
  SELECT doc_id AS item_id, CASE WHEN doc_id % 7 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 60 AS INT) END AS event_date,
    CASE WHEN doc_id % 2 = 0 THEN DATE '2024-01-01' + CAST(doc_id % 60 AS INT) - 2 END AS registration_deadline,
    CASE WHEN doc_id % 4 <> 0 THEN 'Hall ' || CAST(doc_id % 9 AS VARCHAR) END AS location,
    CASE WHEN doc_id % 6 = 0 THEN 'https://sign.example.com/' || CAST(doc_id AS VARCHAR) END AS registration_url,
    CASE WHEN doc_id % 10 = 5 THEN 'desk ' || CAST(doc_id AS VARCHAR) END AS registration_contact
  FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 <> 1
), pushes AS (
  SELECT doc_id AS item_id, 'd' || CAST((doc_id // 20) % 30 AS VARCHAR) AS digest_id FROM documents WHERE doc_id % 20 = 0
), digests AS (
  SELECT 'd' || CAST(n AS VARCHAR) AS id, DATE '2024-01-01' + CAST(n AS INT) AS digest_date, CASE WHEN n % 2 = 0 THEN 'event_batch' ELSE 'daily_digest' END AS kind,
    'digest of ' || CAST(size AS VARCHAR) AS content_md, CAST(n % 3 AS INT) AS push_attempts
  FROM (SELECT doc_id % 30 AS n, count(*) AS size FROM documents GROUP BY 1)
), topics AS (
  SELECT 't' || CAST(n AS VARCHAR) AS id, 'Topic ' || CAST(n AS VARCHAR) AS name, CASE WHEN n % 3 = 0 THEN '' ELSE 'about ' || CAST(size AS VARCHAR) END AS summary,
    DATE '2024-01-01' + CAST(n % 24 AS INT) AS digest_date
  FROM (SELECT doc_id % 120 AS n, count(*) AS size FROM documents GROUP BY 1)
), assignments AS (
  SELECT doc_id AS item_id, 't' || CAST(doc_id % 120 AS VARCHAR) AS topic_id, DATE '2024-01-01' + CAST(doc_id % 24 AS INT) AS digest_date
  FROM documents WHERE doc_id % 5 IN (1, 2) AND doc_id % 4 <> 0
), ledger AS (
  SELECT doc_id AS item_id, TIMESTAMP '2024-01-18' + to_seconds(((doc_id // 25) % 5) * 43200) AS synced_at FROM documents WHERE doc_id % 25 = 0
), sources AS (
  SELECT DISTINCT source AS id, CASE WHEN source <> 'src3' THEN 'Feed ' || source END AS display_name FROM documents
)"""
