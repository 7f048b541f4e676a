"""Rendering, labels, topics and gates on their fixed cases."""

import datetime as dt
import json

from pyspark.sql import functions as F

from feedloom.operators import labels, queues, render

DAY = dt.date(2026, 5, 7)
TOPICS = "digest_date date, pos int, name string, summary string, item_ids array<string>"


def items(spark, n):
    return spark.createDataFrame([(f"i{k}", f"title {k}", f"https://x/{k}", "src", dt.datetime(2026, 5, 6)) for k in range(n)], "item_id string, title string, url string, source string, published_at timestamp")


def test_daily(spark):
    topics = [(DAY, 0, "A", "sum", [f"i{k}" for k in range(6)]), (DAY, 1, "B", "", ["nope"]), (DAY, 2, "C", None, ["nope", "i1"])]
    md = render.render_daily(spark.createDataFrame(topics, TOPICS), items(spark, 9)).first().content_md
    assert md.count("\n- [") == 5 and "**A** — sum" in md and "**B**" not in md and md.startswith("📰 AI 资讯日报 · 2026-05-07\n\n") and "· 05-06" in md
    long = [(DAY, k, "T" * 300, "", ["i0"]) for k in range(3)]
    one = render.render_daily(spark.createDataFrame(long, TOPICS), items(spark, 1), 500).first().content_md
    assert one.count("**T") == 1
    over = render.render_daily(spark.createDataFrame(long, TOPICS), items(spark, 1), 10).first().content_md
    assert over.count("**T") == 1
    assert render.render_daily(spark.createDataFrame([], TOPICS), items(spark, 1)).count() == 0


def test_archive(spark):
    data = [("a", "t" * 3000, "news", "", "s", "", "top", DAY), ("b", "t", "", "u", "s", "x", "", DAY)]
    df = spark.createDataFrame(data, "item_id string, title string, kind string, url string, source string, summary string, topic string, digest_date date")
    got = {r.item_id: json.loads(r.payload)["properties"] for r in render.archive_payload(df, "db").collect()}
    assert got["a"]["url"] == {"url": None} and got["a"]["summary"] == {"rich_text": []} and len(got["a"]["Title"]["title"][0]["text"]["content"]) == 2000
    assert got["a"]["kind"] == {"select": {"name": "news"}} and "kind" not in got["b"]


def test_event_batch(spark):
    cols = "digest_date date, attempt int, pos int, title string, url string, published_at timestamp, event_date date, registration_deadline date, location string, registration_url string, registration_contact string"
    df = spark.createDataFrame([(DAY, 2, 0, None, "u", None, DAY, None, "", "", "wx 1"), (DAY, 2, 1, "T", "v", None, None, None, None, "r", "c")], cols)
    got = render.render_event_batch(df).first()
    assert got.md == "- [**(无标题)**](u) · 📆 2026-05-07 · 📩 wx 1\n- [**T**](v) · [报名](r)"
    assert json.loads(got.payload)["card"]["header"]["title"]["content"].endswith("2026-05-07 #2 · 2 个新事件")


def label(spark, raw):
    return spark.createDataFrame([(raw,)], "raw string").select(labels.parse_label(F.col("raw")).alias("x")).first()["x"]


def test_labels(spark):
    got = label(spark, '```json\n{"kind": "EVENT", "event_metadata": {"event_date": "soon", "registration_deadline": "2026-05-01", "location": 5}}\n```')
    assert got.kind == "event" and got.metadata.event_date is None and got.metadata.registration_deadline == dt.date(2026, 5, 1) and got.metadata.location is None
    assert label(spark, '{"kind": "spam"}').kind == "other" and label(spark, "nope").ok is False and label(spark, '{"kind": "news", "event_metadata": {}}').metadata is None


def test_score_isolates_failures(spark):
    def model(prompt):
        if "bad" in prompt:
            raise ValueError
        return prompt.upper()

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, prompt string")
    assert {r.id: r.raw for r in labels.score(df, model, 2).collect()} == {1: "OK", 2: None}


def test_topics(spark):
    raw = '[{"name": "A", "summary": 5, "item_ids": ["x", "zz", 7]}, 3, {"name": " ", "item_ids": ["x"]}, {"name": "B", "item_ids": "x"}, {"name": "C", "item_ids": ["zz"]}]'
    answers = spark.createDataFrame([(DAY, raw), (DAY, '{"no": "list"}')], "digest_date date, raw string")
    sent = spark.createDataFrame([(DAY, "x")], "digest_date date, item_id string")
    got = labels.parse_topics(answers, sent).collect()
    assert [(r.pos, r.name, r.summary, r.item_ids) for r in got] == [(0, "A", "", ["x"])]
    prompt = labels.build_topic_prompt(spark.createDataFrame([(DAY, 1, "b", "t", "c"), (DAY, 0, "a", None, None)], "digest_date date, pos int, id string, title string, content string")).first().prompt
    assert prompt.endswith("a/(无标题)/\nb/t/c")


def test_queue_order(spark):
    t = dt.datetime(2026, 1, 1)
    data = [(k, "event", p, t) for k, p in (("old", t), ("new", t + dt.timedelta(2)), ("mid", t + dt.timedelta(1)), ("none", None))]
    items_ = spark.createDataFrame(data, "id string, kind string, published_at timestamp, fetched_at timestamp")
    meta = spark.createDataFrame([("old", dt.date(2026, 5, 6)), ("mid", DAY)], "item_id string, event_date date")
    pushes = spark.createDataFrame([], "item_id string")
    assert [r.id for r in queues.unpushed_events(items_, meta, pushes).collect()] == ["new", "mid", "old", "none"]
    assert [r.id for r in queues.unpushed_events(items_, meta, pushes, F.lit(DAY)).collect()] == ["new", "mid", "none"]


def test_replay(spark):
    queue = spark.createDataFrame([("a", "e", None), ("b", "e", None), (None, "e", None)], "item_id string, error string, last_retry_ts timestamp")
    outcomes = spark.createDataFrame([("a", True, None), ("b", False, "again")], "item_id string, ok boolean, error string")
    got = render.replay_queue(queue, outcomes, F.lit(dt.datetime(2026, 1, 1)))
    assert sorted((str(r.item_id), r.error, r.last_retry_ts is not None) for r in got.collect()) == [("None", "e", False), ("b", "again", True)]
