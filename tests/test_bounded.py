"""Hot keys: stars, sources, days and topics that hold most rows are dealt over tasks, with the same results."""

import datetime as dt
import random

from pyspark.sql import functions as F

from feedloom.operators import components, queues, render, state
from feedloom.operators.prefix import numbered, ranged, running_totals

T0 = dt.datetime(2026, 1, 1)


def test_running_totals(spark):
    r = random.Random(1)
    data = [(r.choice(["hot", "hot", "a", None]), r.randint(0, 99), i, r.choice([1, 2, None])) for i in range(500)]
    order = [F.col("g").asc_nulls_last(), F.col("t"), F.col("i")]
    rows = ranged(spark.createDataFrame(data, "g string, t long, i long, n long").repartition(5), order)
    got = {x.i: (x.before, x.whole, x.nth) for x in numbered(running_totals(running_totals(rows, order, {"before": F.col("n")}, ["g"]), order, {"whole": F.col("n")}), order, "nth", ["g"]).collect()}
    placed = sorted(data, key=lambda d: (d[0] is None, d[0] or "", d[1], d[2]))
    total, seen, want = 0, {}, {}
    for g, _, i, n in placed:
        before, nth = seen.get(g, (0, 0))
        want[i] = (before, total, nth)
        seen[g] = (before + (n or 0), nth + 1)
        total += n or 0
    assert got == want
    assert numbered(ranged(spark.createDataFrame([], "g string, t long, i long, n long"), order), order).count() == 0


def test_hot_star(spark):
    r = random.Random(2)
    edges = [(i, 0) for i in range(1, 700)] + [(i, 5000) for i in range(300, 900)] + [(r.randint(1000, 1300), r.randint(1000, 1300)) for _ in range(200)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = sorted(map(tuple, components.connected_components(df).collect()))
    assert sorted(map(tuple, components.connected_components(df, star=50).collect())) == want
    both = df.union(df.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    plain = sorted(map(tuple, components._with_least(both, None).select("a", "b", "m").collect()))
    dealt = components._with_least(both, 50)
    assert sorted(map(tuple, dealt.select("a", "b", "m").collect())) == plain
    # the keys on which rows meet: no node's neighbours are on one key
    star = both.filter("a = 0").withColumn("part", F.pmod(F.xxhash64("b"), F.lit(14))).groupBy("part").count().agg(F.max("count")).first()[0]
    assert star < 100


def test_one_source_in_one_minute(spark):
    r = random.Random(3)
    data = [("hot" if i % 10 else "cold", T0 + dt.timedelta(seconds=r.randint(0, 59)), i, r.random() < 0.7) for i in range(3000)]
    got = {x.source_id: x.health_score for x in state.health_scores(spark.createDataFrame(data, "source_id string, ts timestamp, id long, ok boolean")).collect()}
    for source in ("hot", "cold"):
        score = 1.0
        for _, _, _, ok in sorted((d for d in data if d[0] == source), key=lambda d: (d[1], d[2])):
            score = 0.3 * ok + 0.7 * score
        assert abs(got[source] - score) < 1e-12


def test_pages_of_a_topic(spark):
    day = dt.date(2026, 1, 1)
    items = spark.range(25).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), "id").alias("title"), F.lit("u").alias("url"), F.lit("s").alias("source_id"), F.when(F.col("id") != 7, F.timestamp_seconds(F.col("id"))).alias("published_at"))
    topics = spark.createDataFrame([("a", "A", "", day), ("b", "B", "", day), ("c", "C", "", dt.date(2026, 1, 2))], "id string, name string, summary string, digest_date date")
    used = items.select(F.col("id").alias("item_id"), F.lit("a").alias("topic_id"), F.lit(day).alias("digest_date"))
    sources = spark.createDataFrame([("s", None)], "id string, display_name string")
    got = queues.topics_on(topics, used, items, sources, F.lit(day), page_size=10).collect()
    assert [(r.topic_id, r.page, len(r["items"])) for r in got] == [("a", 0, 10), ("a", 1, 10), ("a", 2, 5), ("b", 0, 0)]
    assert [i.item_id for r in got for i in r["items"]] == [str(i) for i in range(24, -1, -1) if i != 7] + ["7"]


def test_cards_of_a_day(spark):
    none = F.lit(None).cast("string")
    events = spark.range(25).select(F.lit("2026-01-01").alias("digest_date"), F.lit(1).alias("attempt"), F.col("id").alias("pos"), F.concat(F.lit("e"), "id").alias("title"), F.lit("u").alias("url"),
        F.lit(None).cast("timestamp").alias("published_at"), *[none.alias(c) for c in ("event_date", "registration_deadline", "location", "registration_url", "registration_contact")])
    got = sorted(render.render_event_batch(events, per_card=10).collect(), key=lambda r: int(r.md.split("**")[1][1:]))
    assert [r.n_events for r in got] == [10, 10, 5]
    assert [line.split("**")[1] for r in got for line in r.md.split("\n")] == [f"e{i}" for i in range(25)]
    day = render.event_days(render.render_event_batch(events.repartition(5), per_card=2)).collect()
    assert [r.n_events for r in day] == [25]
    assert [line.split("**")[1] for line in day[0].md.split("\n")] == [f"e{i}" for i in range(25)]


def test_ledger_reads_the_dates_asked_for(spark, tmp_path):
    rows = spark.range(300).select("id", F.lit("t").alias("topic_id"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("digest_date")).withColumnRenamed("id", "item_id")
    path = str(tmp_path / "used")
    queues.write_assignments(rows.filter("item_id < 150"), path)
    queues.write_assignments(rows.filter("item_id >= 150"), path)
    ledger = queues.read_assignments(spark, path)
    assert sorted(map(tuple, ledger.collect())) == sorted(map(tuple, rows.collect()))
    items = spark.range(300).select("id", F.lit("news").alias("kind"), F.current_timestamp().alias("classified_at"), F.current_timestamp().alias("published_at"), F.current_timestamp().alias("fetched_at"))
    out = queues.eligible_for_digest(items, ledger, F.lit("2026-01-25").cast("date"), 1000)
    assert {r.id % 30 for r in out.collect()} == set(range(24))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(digest_date" in plan and "digest_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
