"""Parsers on the payload shapes, and streams against their batch forms."""

import datetime as dt
import json

from pyspark.sql import functions as F

from feedloom.operators import state
from feedloom.plans.snapshots import compact, read_snapshot
from feedloom.sources import aggregator, cards, registry, retry_queue, rss, social
from feedloom.streaming import jobs


def payload(spark, text, **more):
    data = {"source_id": "s", "payload": text, **more}
    return spark.createDataFrame([tuple(data.values())], list(data))


def test_rss(spark):
    feed = """<?xml version="1.0"?><rss version="2.0"><channel><item><title>A &amp; B</title><link>u1</link><description><![CDATA[<style>x</style><p>Hi</p>]]></description>
    <pubDate>Mon, 01 Jan 2024 08:00:00 +0800</pubDate></item><item><title>C</title></item></channel></rss>"""
    got = rss.parse_rss(payload(spark, feed)).orderBy("pos").collect()
    assert [(r.title, r.url, r.content) for r in got] == [("A & B", "u1", "Hi"), ("C", "", None)] and got[0].published_at == dt.datetime(2024, 1, 1)
    assert rss.parse_rss(payload(spark, feed), 1).count() == 1
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="l"/><summary>s</summary><updated>2024-01-01T00:00:00Z</updated></entry></feed>'
    assert [(r.title, r.url, r.content) for r in rss.parse_rss(payload(spark, atom)).collect()] == [("T", "l", "s")]
    rdf = '<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>c</title></channel><item><title>R</title><link>l1</link><dc:date>2024-01-02T03:04:05Z</dc:date></item><item><title>S</title><link>l2</link></item></rdf:RDF>'
    got = rss.parse_rss(payload(spark, rdf)).orderBy("pos").collect()
    assert [(r.title, r.url, r.published_at) for r in got] == [("R", "l1", dt.datetime(2024, 1, 2, 3, 4, 5)), ("S", "l2", None)]
    bad = payload(spark, "<rss><channel>")
    assert rss.rss_outcomes(bad, rss.parse_rss(bad)).first().ok is False


def test_aggregator(spark):
    items = [{"id": 1, "title": "t", "url": "u", "extra": {"date": 1700000000000}}, {"title": "", "url": "v"}, {"title": 5, "url": "w"}, "junk", {"title": "x", "url": "y", "extra": {"date": "bad"}, "pubDate": "2024-01-01 12:00:00"}]
    got = aggregator.parse_aggregator(payload(spark, json.dumps({"items": items}))).orderBy("pos").collect()
    assert [(r.url, r.published_at) for r in got] == [("u", dt.datetime(2023, 11, 14, 22, 13, 20)), ("y", dt.datetime(2024, 1, 1, 4))]
    assert aggregator.parse_aggregator(payload(spark, json.dumps({"items": items})), 2).count() == 1
    assert aggregator.aggregator_outcomes(payload(spark, '{"x": 1}')).first().ok is False


def envelope(inner, **more):
    return json.dumps({"result": {"content": [{"type": "image"}, {"type": "text", "text": inner if isinstance(inner, str) else json.dumps(inner)}], **more}})


def test_social(spark):
    feeds = {"feeds": [{"id": "f", "xsecToken": "k", "noteCard": {"title": "T", "desc": "d", "user": {"nickname": "n"}, "createTime": 1700000000000}}, {"id": "g"}]}
    df = payload(spark, envelope(feeds), keyword="q", keyword_pos=0)
    got = social.parse_social_search(df).collect()
    assert [(r.feed_id, r.title, r.author) for r in got] == [("f", "T", "n")]
    assert social.search_failures(payload(spark, envelope("nope"), keyword="q", keyword_pos=0)).first().failed
    cache = spark.createDataFrame([("f", "full")], "feed_id string, content string")
    assert social.enrich_with_detail(social.parse_social_search(df), cache).first().content == "full"
    detail = lambda t: spark.createDataFrame([(t,)], "p string").select(social.extract_note_detail(F.col("p")).alias("d")).first()["d"]
    assert detail(envelope({"feed": {"noteCard": {"title": "a", "desc": " b "}}})).asDict() == {"title": "a", "content": "b"}
    assert detail(envelope({"data": {"note": {"displayTitle": "a", "content": "c"}}})).asDict() == {"title": "a", "content": "c"}
    assert detail(envelope({"desc": "x"}, isError=True)) is None


def test_cards(spark):
    card = '<div class="search-tab-content-item-mesh"><a href="/event/{0}?q=1"><img></a><a href="/event/{0}">{1}</a><div>下周四 广东深圳</div><a href="/org/9"><i></i></a><a href="/org/9">Org 粉丝 12</a></div>'
    page = "<body>" + card.format(1, "AI 大会") + card.format(1, "AI again") + card.format(2, "AI 招生") + card.format(3, "Other") + "</body>"
    got = cards.parse_event_cards(payload(spark, page, page_pos=0), F.lit(dt.date(2026, 5, 7)), ["ai"]).collect()
    assert [(r.url, r.title, r.author) for r in got] == [("https://www.huodongxing.com/event/1", "AI 大会", "Org")]
    assert got[0].published_at == dt.datetime(2026, 5, 14, 12) and got[0].content.splitlines()[0] == "📅 时间: 2026-05-14" and "📍 地点: 广东深圳" in got[0].content


def test_registry(spark):
    config = spark.createDataFrame([("a", None, "rss", "{}", None), ("b", "B", "odd", "{}", True), ("c", "C", "rss", "{}", False)], "id string, display_name string, fetcher_type string, config string, enabled boolean")
    sources = registry.load_sources(config)
    sent = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "source_id string, payload string")
    items, failures = registry.route_payloads(sent, sources, {"rss": lambda df: df.select("source_id")})
    assert [r.source_id for r in items.collect()] == ["a"] and [r.source_id for r in failures.collect()] == ["b"]

    def throws(df):
        raise ValueError("no such feed")

    everyone = sources.withColumn("enabled", F.lit(True)).withColumn("fetcher_type", F.when(F.col("id") == "c", "bad").otherwise(F.col("fetcher_type")))
    items, failures = registry.route_payloads(sent, everyone, {"rss": lambda df: df.select("source_id"), "bad": throws})
    assert [r.source_id for r in items.collect()] == ["a"]
    assert sorted((r.source_id, r.error) for r in failures.collect()) == [("b", "unknown fetcher type: odd"), ("c", "ValueError: no such feed")]


def test_retry_queue(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.json").write_text('{"error": "e", "item": {"item_id": "1"}}\nnot json\n\n{"error": "f"}\n')
    assert retry_queue.read_queue(spark, str(tmp_path / "q")).count() == 2


ITEM = "id string, source_id string, url string, title string, content string, fetched_at timestamp"


def test_ingest_stream(spark, tmp_path):
    landing, table = tmp_path / "in", str(tmp_path / "items")
    landing.mkdir()
    row = lambda i: json.dumps({"id": i, "source_id": "s", "url": f"u{i}", "title": "t", "content": "c", "fetched_at": "2024-01-01T00:00:00Z"})
    (landing / "1.json").write_text(row("a") + "\n" + row("a") + "\n" + row("b"))
    for _ in range(2):
        jobs.ingest(jobs.file_stream(spark, str(landing), ITEM), lambda df: df, table, str(tmp_path / "cp"), ITEM).awaitTermination()
        (landing / "2.json").write_text(row("b") + "\n" + row("c"))
    assert sorted(r.id for r in read_snapshot(spark, table, ITEM).collect()) == ["a", "b", "c"]


def test_health_stream(spark, tmp_path):
    schema = "source_id string, ts timestamp, id long, ok boolean, error string"
    data = [("s", f"2024-01-0{d}T00:00:00Z", d, d % 2 == 0, None) for d in range(1, 6)]
    path = tmp_path / "h"
    path.mkdir()
    names = ["source_id", "ts", "id", "ok", "error"]
    (path / "1.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in data))
    q = jobs.health_stream(jobs.file_stream(spark, str(path), schema)).writeStream.format("memory").queryName("health").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = state.health_scores(spark.read.schema(schema).json(str(path))).first().health_score
    assert abs(spark.table("health").first().health_score - batch) < 1e-12


LEDGER = "item_id string, pushed_at timestamp"


def test_delivery_retries_and_defers(spark, tmp_path):
    """Failures and quiet hours leave rows pending; a replay after a lost commit sends nothing twice."""
    landing, ledger, cp = tmp_path / "in", str(tmp_path / "ledger"), tmp_path / "cp"
    landing.mkdir()
    (landing / "1.json").write_text('{"item_id": "tick"}')
    pending = lambda: spark.createDataFrame([("a",), ("b",)], "item_id string")
    sent, told = [], []

    def deliver(failing):
        def run(df):
            ids = [r.item_id for r in df.collect()]
            sent.extend(ids)
            return spark.createDataFrame([(i, i not in failing) for i in ids], "item_id string, ok boolean")

        return run

    def tick(failing, quiet=None):
        stream = jobs.file_stream(spark, str(landing), "item_id string")
        jobs.deliver_stream(stream, pending, deliver(failing), ledger, str(cp), LEDGER, quiet, told.append).awaitTermination()

    tick({"b"})
    assert sorted(sent) == ["a", "b"] and told == [{"found": 2, "pushed": 1, "skipped_quiet": False}]
    for f in (cp / "commits").iterdir():  # the batch counts as not done, so it runs again
        f.unlink()
    tick({"b"})
    assert sorted(sent) == ["a", "b", "b"]
    (landing / "2.json").write_text('{"item_id": "tick"}')
    tick(set(), F.lit(True))
    assert told[-1] == {"found": 1, "pushed": 0, "skipped_quiet": True} and sorted(sent) == ["a", "b", "b"]
    assert jobs.deliver_pending(spark, pending, deliver(set()), ledger, LEDGER) == {"found": 1, "pushed": 1, "skipped_quiet": False}
    assert sorted(sent) == ["a", "b", "b", "b"] and sorted(r.item_id for r in read_snapshot(spark, ledger, LEDGER).collect()) == ["a", "b"]
    assert jobs.deliver_pending(spark, pending, deliver(set()), ledger, LEDGER)["found"] == 0


def test_labels_are_asked_again(spark, tmp_path):
    table, schema = str(tmp_path / "labels"), "id string, kind string"
    pending = lambda: spark.createDataFrame([("a",), ("b",)], "id string")
    label = lambda bad: lambda df: df.filter(F.col("id") != bad).withColumn("kind", F.lit("news"))
    jobs.label_pending(spark, pending, label("b"), table, schema)
    assert [r.id for r in read_snapshot(spark, table, schema).collect()] == ["a"]
    jobs.label_pending(spark, pending, label("none"), table, schema, 1)
    assert sorted(r.id for r in read_snapshot(spark, table, schema).collect()) == ["a", "b"]
    assert compact(spark, table, schema) and sorted(r.id for r in read_snapshot(spark, table, schema).collect()) == ["a", "b"]
    jobs.label_pending(spark, lambda: spark.createDataFrame([("c",)], "id string"), label("none"), table, schema, 2)
    assert sorted(r.id for r in read_snapshot(spark, table, schema).collect()) == ["a", "b", "c"]
