"""Keyed state: merges, ledgers, health, schema evolution."""

import datetime as dt

from pyspark.sql import functions as F

from feedloom.operators import state
from feedloom.schemas import DIGESTS, ITEMS


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def pairs(spark, data):
    return spark.createDataFrame(data, "k string, v string")


def test_merge_modes(spark):
    old, new = pairs(spark, [("a", "1"), ("b", "2")]), pairs(spark, [("b", "9"), ("c", "3"), (None, "x")])
    assert rows(state.merge_keyed(old, new, ["k"], "first_wins"), "k", "v") == [("a", "1"), ("b", "2"), ("c", "3")]
    assert rows(state.merge_keyed(old, new, ["k"], "replace"), "k", "v") == [("a", "1"), ("b", "9"), ("c", "3")]
    assert rows(state.merge_keyed(old, new, ["k"], "set_cols", ["v"]), "k", "v") == [("a", "1"), ("b", "9"), ("c", "3")]
    for mode in ("first_wins", "replace"):
        once = state.merge_keyed(old, new, ["k"], mode)
        assert rows(state.merge_keyed(once, new, ["k"], mode), "k", "v") == rows(once, "k", "v")


def test_health(spark):
    t = dt.datetime(2024, 1, 1)
    data = [("s", t, 1, False, "e1"), ("s", t, 2, False, "e2"), ("u", t, 3, True, None)]
    out = spark.createDataFrame(data, "source_id string, ts timestamp, id long, ok boolean, error string")
    got = dict(rows(state.health_scores(out), "source_id", "health_score"))
    assert abs(got["s"] - 0.49) < 1e-12 and got["u"] == 1.0
    src = spark.createDataFrame([("s", 1.0, None, None), ("z", 0.5, None, "old")], "id string, health_score double, last_success_at timestamp, last_error string")
    assert rows(state.update_health(src, out).withColumn("health_score", F.round("health_score", 6)), "id", "health_score", "last_error") == [("s", 0.49, "e2"), ("z", 0.5, "old")]
    ordered = [("s", t + dt.timedelta(hours=h), h, h % 3 > 0, None) for h in range(50)]
    want = 1.0
    for r in ordered:
        want = 0.3 * r[3] + 0.7 * want
    got = state.health_scores(spark.createDataFrame(ordered, out.schema)).first().health_score
    assert abs(got - want) < 1e-12


def test_insert_if_new(spark):
    t = dt.datetime(2024, 1, 1)

    def item(i, url, at=t):
        return (i, "s", url, None, f"t{i}", None, None, None, at, None, None, None)

    target = spark.createDataFrame([item("a", "u1")], ITEMS)
    batch = spark.createDataFrame([item("a", "u9"), item("b", "u1"), item("c", "u2"), item("c", "u2"), item("d", "")], ITEMS)
    assert rows(state.insert_items_if_new(target, batch), "id") == [("c",)]
    later = dt.datetime(2024, 1, 2)
    same = spark.createDataFrame([item("e", "u5", later), item("f", "u5"), item("g", "u6"), item("g", "u7", later)], ITEMS)
    assert rows(state.insert_items_if_new(target, same), "id", "url") == [("f", "u5"), ("g", "u6")]


def test_digests(spark):
    day = dt.date(2024, 1, 1)
    old = spark.createDataFrame([("x", day, "daily_digest", "old", None, None, None, 0)], DIGESTS)
    up = spark.createDataFrame([("y", day, "daily_digest", "new", None, None, 0, 0), ("z", day, "event_batch", "ev", None, None, 0, 0)], DIGESTS)
    out = state.upsert_digests(old, up)
    assert rows(out, "id", "content_md") == [("x", "new"), ("z", "ev")]
    now = F.lit(dt.datetime(2024, 1, 2))
    pushed = state.mark_pushed(state.mark_pushed(out, out.filter("id = 'x'"), now), out.filter("id = 'x'"), now)
    assert rows(pushed, "id", "push_attempts") == [("x", 2), ("z", 0)]
    keys = spark.createDataFrame([(day, "daily_digest"), (day, "none")], "digest_date date, kind string")
    assert rows(state.push_attempts(keys, pushed), "kind", "push_attempts") == [("daily_digest", 2), ("none", 0)]


def test_evolve_and_orphans(spark):
    df = spark.createDataFrame([(1,)], "id int")
    new = {"kind": F.lit("unclassified")}
    once = state.evolve_schema(df, new)
    assert rows(once, "id", "kind") == [(1, "unclassified")]
    assert state.evolve_schema(once, new).columns == once.columns
    kids = spark.createDataFrame([(1,), (2,), (None,)], "item int")
    assert rows(state.orphans(kids, df, "item"), "item") == [(2,)]
