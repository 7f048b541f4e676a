"""A payload that breaks its parser fails alone."""

from pyspark.sql import functions as F

from feedloom.sources import aggregator, cards, isolated, rss, social

FEED = '<rss version="2.0"><channel><item><title>A &amp; b</title><link>https://a.example.com/1</link></item><item><title>two</title></item></channel></rss>'
CARD = '<div class="search-tab-content-item-mesh"><a href="/event/7?x=1">AI day</a> 02/03 上海</div>'
SOURCES = "id string, fetcher_type string, enabled boolean"
PAYLOADS = "source_id string, keyword string, keyword_pos long, page_pos long, payload string"


def parsers():
    def pages(html):
        if "boom" in html:
            raise RuntimeError("first line\nsecond line")
        return cards.page_cards(html)

    return {
        "rss": isolated.PayloadParser.of_columns(rss.rss_entries, rss.rss_error, rss.finish_rss),
        "agg": isolated.PayloadParser.of_columns(aggregator.aggregator_entries, aggregator.aggregator_error, aggregator.finish_aggregator),
        "social": isolated.PayloadParser.of_columns(social.social_entries, social.social_error, lambda rows: rows.filter("url is not null")),
        "cards": isolated.PayloadParser.of_python(pages, cards.CARDS, lambda rows: cards.finish_cards(rows, F.lit("2024-01-20").cast("date"))),
    }


def parsed(spark, payloads, sources):
    rows = [(s, "k", 0, p, text) for s, p, text in payloads]
    return isolated.parse_isolated(spark.createDataFrame(rows, PAYLOADS), spark.createDataFrame(sources, SOURCES), parsers(), ("keyword", "keyword_pos", "page_pos"))


def test_each_payload_by_itself(spark):
    social_text = '{"result": {"content": [{"type": "text", "text": "{\\"feeds\\": [{\\"id\\": \\"f\\", \\"xsecToken\\": \\"t\\", \\"noteCard\\": {\\"title\\": \\"n\\"}}]}"}]}}'
    payloads = [
        ("r", 0, FEED), ("r", 1, "<rss><channel><item>"), ("r2", 0, None), ("r3", 0, "<rss><channel></channel></rss>"),
        ("a", 0, '{"items": [{"url": "u", "title": "t"}, 5, {"url": "", "title": "t"}]}'), ("a", 1, "[]"), ("a2", 0, "no json"),
        ("s", 0, social_text), ("s", 1, '{"result": {"content": [{"type": "text", "text": "oops"}]}}'), ("s", 2, "{}"),
        ("c", 0, CARD), ("c", 1, "boom"), ("c2", 0, "boom"), ("c3", 0, None), ("off", 0, FEED), ("odd", 0, FEED), ("none", 0, FEED), ("missing", 0, FEED),
    ]
    kinds = {"r": "rss", "a": "agg", "s": "social", "c": "cards", "odd": "gopher", "off": "rss"}
    sources = [(s, kinds.get(s, kinds.get(s[0])) if s != "none" else None, s != "off") for s in {p[0] for p in payloads} - {"missing"}]
    out = parsed(spark, payloads, sources)
    assert sorted((r.source_id, r.url, r.title) for r in out.items.collect()) == [
        ("a", "u", "t"), ("c", "https://www.huodongxing.com/event/7", "AI day"), ("r", "", "two"), ("r", "https://a.example.com/1", "A & b"),
        ("s", "https://www.xiaohongshu.com/explore/f?xsec_token=t", "n"),
    ]
    malformed, boom = "malformed feed without entries", "RuntimeError: first line"
    assert sorted((r.source_id, r.fetcher_type, r.error, r.payload) for r in out.dead_letters.collect() if r.fetcher_type) == [
        ("a", "agg", "no items list", "[]"), ("a2", "agg", "no items list", "no json"), ("c", "cards", boom, "boom"), ("c2", "cards", boom, "boom"),
        ("odd", "gopher", "unknown fetcher type: gopher", FEED), ("r", "rss", malformed, "<rss><channel><item>"), ("r2", "rss", malformed, None),
        ("s", "social", "text is no JSON", '{"result": {"content": [{"type": "text", "text": "oops"}]}}'),
    ]
    outcomes = {r.source_id: (r.ok, r.n_payloads, r.n_failed, r.n_items, r.error) for r in out.outcomes.collect()}
    assert outcomes == {
        "a": (True, 2, 1, 3, "no items list"), "a2": (False, 1, 1, 0, "no items list"), "c": (True, 2, 1, 1, boom), "c2": (False, 1, 1, 0, boom), "c3": (True, 1, 0, 0, None),
        "none": (False, 1, 1, 0, "unknown fetcher type: null"), "odd": (False, 1, 1, 0, "unknown fetcher type: gopher"), "r": (True, 2, 1, 2, malformed),
        "r2": (False, 1, 1, 0, malformed), "r3": (True, 1, 0, 0, None), "s": (True, 3, 1, 1, "text is no JSON"),
    }


def test_nothing(spark):
    out = parsed(spark, [], [])
    assert out.items.count() == out.dead_letters.count() == out.outcomes.count() == 0


def test_one_scan_without_a_shuffle_by_source(spark, monkeypatch):
    """All types are taken from one scan, and payloads do not meet by their source, of which there are few."""
    plans = []

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(isolated, "materialize", written)
    monkeypatch.setattr(isolated, "ITEM", ["source_id", "x"])
    one = isolated.PayloadParser.of_columns(lambda p: F.array(F.struct(p.alias("x"))), lambda p, e: F.when(p == "bad", F.lit("no")), lambda rows: rows)
    payloads = spark.range(60).select((F.col("id") % 3).cast("string").alias("source_id"), F.when(F.col("id") % 10 == 0, F.lit("bad")).otherwise(F.lit("good")).alias("payload"))
    sources = spark.range(3).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("id") % 2).alias("fetcher_type"), F.lit(True).alias("enabled"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = isolated.parse_isolated(payloads, sources, {"t0": one, "t1": one})
        assert len(plans) == 1 and "hashpartitioning(source_id" not in plans[0] and "BroadcastHashJoin" in plans[0]
        assert sorted((r.source_id, r.ok, r.n_payloads, r.n_failed, r.n_items) for r in got.outcomes.collect()) == [(str(i), True, 20, 2, 18) for i in range(3)]
        assert got.items.count() == 54 and got.dead_letters.count() == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
