"""Retries, quiet hours and expiry by timers, with nothing arriving."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from feedloom.streaming import timers

ARRIVAL = "item_id string, body string"


def ms(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize(
    ("hours", "now", "want"),
    [
        ((23, 7), ms(2026, 1, 1, 16, 30), ms(2026, 1, 1, 23)),  # 00:30 there
        ((23, 7), ms(2026, 1, 1, 15), ms(2026, 1, 1, 23)),  # 23:00, quiet begins
        ((23, 7), ms(2026, 1, 1, 23), None),  # 07:00, it has ended
        ((9, 12), ms(2026, 1, 1, 2), ms(2026, 1, 1, 4)),
        ((9, 12), ms(2026, 1, 1, 4), None),
        ((5, 5), ms(2026, 1, 1, 21), ms(2026, 1, 2, 21)),  # always quiet
    ],
)
def test_quiet_hours(hours, now, want):
    assert timers.quiet_hours(*hours)(now) == want


def wait(query, until, seconds=90):
    stop = time.time() + seconds
    while time.time() < stop and query.isActive and not until():
        time.sleep(0.5)
    if query.exception():
        raise query.exception()
    assert until()


def run(spark, tmp_path, items, work, **kw):
    landing = str(tmp_path / "in")
    spark.createDataFrame(items, ARRIVAL).coalesce(1).write.mode("append").json(landing)
    stream = spark.readStream.schema(ARRIVAL).json(landing)
    return timers.work_stream(spark, stream, work, str(tmp_path / "w"), every="200 milliseconds", rows_per_bucket=4, **kw)


def test_failed_rows_come_back(spark, tmp_path):
    sent = str(tmp_path / "sent")

    def work(due):
        due.withColumn("at", F.current_timestamp()).write.mode("append").parquet(sent)
        return due.select("item_id", ((F.col("item_id") != "b") | (F.col("attempt") >= 3)).alias("ok"))

    items = [(x, x) for x in "abcdefg"] + [("a", "twice"), (None, "no id")]
    q = run(spark, tmp_path, items, work, pause=dt.timedelta(milliseconds=300))
    try:
        wait(q, lambda: timers.finished(spark, str(tmp_path / "w")).count() == 7)
    finally:
        q.stop()
    ledger = {r.item_id: r.attempt for r in timers.finished(spark, str(tmp_path / "w")).collect()}
    assert ledger == {x: 3 if x == "b" else 1 for x in "abcdefg"}
    tried = spark.read.parquet(sent).groupBy("item_id").count().collect()
    assert {r.item_id: r["count"] for r in tried} == {x: 3 if x == "b" else 1 for x in "abcdefg"}
    # a new run of the query over the same folder has nothing left to do, also for an id that comes again
    q = run(spark, tmp_path, [("a", "again"), ("h", "new")], work, pause=dt.timedelta(milliseconds=300))
    try:
        wait(q, lambda: timers.finished(spark, str(tmp_path / "w")).count() == 8)
    finally:
        q.stop()
    assert spark.read.parquet(sent).filter("item_id = 'a'").count() == 1


def test_quiet_rows_go_out_afterwards(spark, tmp_path):
    begun = time.time() * 1000
    until = int(begun + 12000)
    sent = str(tmp_path / "sent")

    def work(due):
        due.withColumn("at", F.unix_millis(F.current_timestamp())).write.mode("append").parquet(sent)
        return due.select("item_id", F.lit(True).alias("ok"))

    q = run(spark, tmp_path, [("a", None), ("b", "x")], work, quiet=lambda now: until if now < until else None)
    try:
        wait(q, lambda: timers.finished(spark, str(tmp_path / "w")).count() == 2)
    finally:
        q.stop()
    got = spark.read.parquet(sent).collect()
    assert len(got) == 2 and all(r.attempt == 1 and r["at"] >= until for r in got)


def test_what_never_works_expires(spark, tmp_path):
    sent = str(tmp_path / "sent")

    def work(due):
        due.write.mode("append").parquet(sent)
        return due.select("item_id", F.lit(False).alias("ok"))

    begun = time.time()
    q = run(spark, tmp_path, [("a", "x")], work, pause=dt.timedelta(milliseconds=200), keep=dt.timedelta(seconds=12))
    tried = lambda: spark.read.schema(timers.DUE).parquet(sent).count() if os.path.isdir(sent) else 0
    try:
        wait(q, lambda: tried() >= 2)
        time.sleep(max(0, begun + 30 - time.time()))
        n = tried()
        time.sleep(8)
        assert q.isActive and tried() == n
    finally:
        q.stop()
    assert timers.finished(spark, str(tmp_path / "w")).count() == 0


def test_waiting_ends_only_without_progress():
    """Work that takes longer than the limit goes on as long as some of it gets done."""
    from types import SimpleNamespace

    import pytest

    from feedloom.plans.stream_catalog import _wait

    query, done = SimpleNamespace(isActive=True, exception=lambda: None), iter(range(100))
    _wait(query, lambda: next(done), 5, seconds=0.5)
    with pytest.raises(TimeoutError):
        _wait(query, lambda: 3, 5, seconds=0.5)
    query.isActive = False
    with pytest.raises(RuntimeError):
        _wait(query, lambda: 3, 5)
