"""Event cards in HTML search pages: Python only takes the page apart, all rules are Column expressions."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.dates import parse_relative_date
from feedloom.sources.isolated import entries_or_error
from feedloom.sources.registry import first_in_run

#: Noise words in titles.
EXCLUDE = [
    "相亲", "单身", "交友", "脱单", "移民", "身份", "海外身份", "拿身份", "资产", "理财", "投资课", "财富管理",
    "MBA", "EMBA", "招生", "考研", "K12", "幼小衔接",
]
#: Places, in the order in which they are tried.
PLACES = [
    "广东深圳", "上海", "北京", "广州", "深圳", "杭州", "成都", "南京", "武汉", "苏州", "西安",
    "重庆", "天津", "长沙", "青岛", "大连", "宁波", "无锡", "郑州", "福州", "厦门", "济南",
    "沈阳", "哈尔滨", "长春", "合肥", "南昌", "昆明", "贵阳", "石家庄", "太原", "兰州",
    "乌鲁木齐", "银川", "西宁", "呼和浩特", "拉萨", "海口", "香港", "澳门", "台北",
    "线上", "全国", "线上活动",
]
CARD = "search-tab-content-item-mesh"


class _Cards(HTMLParser):
    """Cards of one page: text and anchors (href, text) of each."""

    def __init__(self) -> None:
        super().__init__()
        self.cards: list[tuple[list[str], list[list]]] = []
        self.depth = 0
        self.anchor: list | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        if not self.depth and tag == "div" and CARD in (named.get("class") or "").split():
            self.cards.append(([], []))
            self.depth = 1
        elif self.depth and tag == "div":
            self.depth += 1
        if self.depth and tag == "a":
            self.anchor = [named.get("href") or "", []]
            self.cards[-1][1].append(self.anchor)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.anchor = None
        if self.depth and tag == "div":
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.depth and (text := data.strip()):
            self.cards[-1][0].append(text)
            if self.anchor is not None:
                self.anchor[1].append(text)


#: What page_cards gives for each card.
CARDS = "array<struct<full_text:string,anchors:array<struct<href:string,text:string>>>>"


def page_cards(html: str) -> list[dict]:
    """full_text and anchors of each card of a page."""
    parser = _Cards()
    parser.feed(html)
    return [{"full_text": " ".join(texts), "anchors": [{"href": h, "text": "".join(t)} for h, t in anchors]} for texts, anchors in parser.cards]


def raw_cards(pages: DataFrame) -> DataFrame:
    """source_id, page_pos, pos, full_text, anchors of each card in pages (source_id, page_pos, payload). A page that cannot be
    taken apart has no cards; sources.isolated reports it."""
    cards = F.posexplode(entries_or_error(page_cards, CARDS)(F.col("payload"))["entries"]).alias("pos", "i")
    return pages.select("source_id", F.col("page_pos").cast("long").alias("page_pos"), cards).select("source_id", "page_pos", F.col("pos").cast("long").alias("pos"), "i.*")


def extract_event_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/event/(\d+)", 1), F.lit(""))


def extract_location(text: Column) -> Column:
    """The leftmost place, of places that start there the first of the list."""
    return F.nullif(F.regexp_extract(text, "(" + "|".join(PLACES) + ")", 1), F.lit(""))


def extract_organizer(texts: Column) -> Column:
    """The shortest of the texts without their trailing statistics, the first of equals."""
    bare = F.transform(texts, lambda t, i: F.struct(F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)\s*粉丝\s+.*$", ""), r"(?s)\s*活动\s+\d.*$", "")).alias("t"), i.alias("i")))
    some = F.filter(bare, lambda x: x["t"] != "")
    return F.get(F.array_sort(F.transform(some, lambda x: F.struct(F.length(x["t"]).alias("n"), x["i"].alias("i"), x["t"].alias("t")))), F.lit(0))["t"]


def excluded(title: Column, words: list[str] | None = None) -> Column:
    """Whether the title has a noise word (case matters)."""
    return F.exists(F.array(*[F.lit(w) for w in (EXCLUDE if words is None else words)]).cast("array<string>"), lambda k: F.contains(title, k))


def wanted(title: Column, words: list[str]) -> Column:
    """Whether the title has any keyword (case does not matter); no keywords want all."""
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda k: F.contains(F.lower(title), k)) if words else F.lit(True)


def parse_event_cards(
    pages: DataFrame, today: Column, keywords: list[str] | None = None, exclude: list[str] | None = None, base_url: str = "https://www.huodongxing.com/", max_items: int = 20
) -> DataFrame:
    """Items of event cards: per page the first max_items that are accepted, one of each event."""
    return finish_cards(raw_cards(pages), today, keywords, exclude, base_url, max_items)


def finish_cards(
    cards: DataFrame, today: Column, keywords: list[str] | None = None, exclude: list[str] | None = None, base_url: str = "https://www.huodongxing.com/", max_items: int = 20
) -> DataFrame:
    """Cards (source_id, page_pos, pos, full_text, anchors) as items."""
    href = F.get(F.filter("anchors", lambda a: a["href"].rlike(r"^/event/\d+")), F.lit(0))["href"]
    cards = cards.withColumn("path", F.substring_index(href, "?", 1)).filter(F.col("path").isNotNull())
    same = F.filter("anchors", lambda a: (F.substring_index(a["href"], "?", 1) == F.col("path")) & (a["text"] != ""))
    orgs = F.transform(F.filter("anchors", lambda a: a["href"].rlike(r"^/org/\d+")), lambda a: a["text"])
    when = parse_relative_date(F.col("full_text"), today)
    rows = cards.withColumns({"title": F.get(same, F.lit(0))["text"], "organizer": extract_organizer(orgs), "location": extract_location(F.col("full_text")), "when": when})
    rows = rows.filter(F.col("title").isNotNull() & ~excluded(F.col("title"), exclude) & wanted(F.col("title"), keywords or []))
    rows = rows.withColumns({"url": F.concat(F.lit(base_url.rstrip("/")), "path"), "event_id": extract_event_id(F.col("path"))})
    start, end = F.col("when.start").cast("string"), F.col("when.end").cast("string")
    time = F.when(end.isNotNull() & (end != start), F.concat(F.lit("📅 时间: "), start, F.lit(" ~ "), end)).otherwise(F.concat(F.lit("📅 时间: "), start))
    lines = [time, F.concat(F.lit("⏰ 原始时间表达: "), "when.raw"), F.concat(F.lit("📍 地点: "), "location"), F.concat(F.lit("👤 主办方: "), "organizer")]
    rows = rows.withColumn("content", F.nullif(F.concat_ws("\n", *lines), F.lit("")))
    one = first_in_run(rows.withColumn("key", F.struct("source_id", "page_pos", "event_id")), "key", [F.col("pos")])
    kept = one.withColumn("nth", F.row_number().over(Window.partitionBy("source_id", "page_pos").orderBy("pos"))).filter(F.col("nth") <= max_items)
    noon = F.col("when.start").cast("timestamp") + F.expr("interval 12 hours")
    return kept.select("source_id", "page_pos", "pos", "url", "title", "content", F.col("organizer").alias("author"), noon.alias("published_at"))
