"""Work that comes back by itself: keyed state of what is pending, with timers for retries and for the end of quiet hours.

Each id that has arrived is held until it is done. It is given out at once, or when quiet hours end; if no outcome says that it is
done it is given out again after a pause that doubles, without anything having to arrive; after `keep` its state expires. Outcomes come back as a second input of
the same stream, so that what is pending is one keyed state, not a table that each tick reads.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from feedloom.plans.key_index import KeyIndex
from feedloom.plans.persist import materialize

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
#: What goes in: an arrival has its body, an outcome says that an id is done.
EVENT = "item_id string, done boolean, body string"
DUE = "item_id string, body string, attempt int"
LEDGER = "item_id string, attempt int"
DOUBLINGS = 8


def quiet_hours(start: int, end: int, offset_hours: float = 8.0) -> Callable[[int], int | None]:
    """A function of an instant (ms): the end of the quiet hours that hold it, else null. Hours are those of a clock
    offset_hours before UTC, from start up to end, over midnight if end is not after start."""

    def until(now: int) -> int | None:
        local = dt.datetime.fromtimestamp(now / 1000, dt.timezone(dt.timedelta(hours=offset_hours)))
        held = start <= local.hour < end if start < end else local.hour >= start or local.hour < end
        if not held:
            return None
        stop = local.replace(hour=end, minute=0, second=0, microsecond=0)
        return int((stop if stop > local else stop + dt.timedelta(days=1)).timestamp() * 1000)

    return until


class _Pending(StatefulProcessor):
    def __init__(self, pause_ms: int, keep_ms: int, quiet: Callable[[int], int | None] | None):
        self.pause_ms, self.keep_ms, self.quiet = pause_ms, keep_ms, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pending", "body string, attempt int, begun bigint, timer bigint", ttlDurationMs=self.keep_ms)

    def _give_out(self, key: str, body: str | None, attempt: int, begun: int, now: int) -> Iterator[Row]:
        """The row, unless it is quiet or its time is over; and a timer for the next time."""
        later = self.quiet(now) if self.quiet else None
        if later is None:
            attempt += 1
            later = now + self.pause_ms * 2 ** min(attempt - 1, DOUBLINGS)
            yield Row(item_id=key, body=body, attempt=attempt)
        if now >= begun + self.keep_ms:
            self.state.clear()
            return
        timer = max(later, now + 1)
        self.state.update((body, attempt, begun, timer))
        self.handle.registerTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802,N803
        done, body, came = False, None, False
        for row in rows:
            if row["done"]:
                done = True
            elif not came:
                came, body = True, row["body"]
        held = self.state.get()
        if done:
            if held is not None:
                self.state.clear()
                self.handle.deleteTimer(held[3])
        elif came and held is None:
            now = timerValues.getCurrentProcessingTimeInMs()
            yield from self._give_out(key[0], body, 0, now, now)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802,N803
        held = self.state.get()
        if held is not None:
            body, attempt, begun, _ = held
            yield from self._give_out(key[0], body, attempt, begun, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def due_items(events: DataFrame, pause: dt.timedelta, keep: dt.timedelta, quiet: Callable[[int], int | None] | None = None) -> DataFrame:
    """The rows (item_id, body, attempt) that are due, from a stream of EVENT rows. An id that is pending and arrives again is
    one; an id that is done and arrives again is new. Null ids are left out. Needs the RocksDB state store."""
    ms = lambda d: int(d.total_seconds() * 1000)
    keyed = events.filter(F.col("item_id").isNotNull()).groupBy("item_id")
    return keyed.transformWithState(_Pending(ms(pause), ms(keep), quiet), outputStructType=DUE, outputMode="Append", timeMode="ProcessingTime")


def work_stream(
    spark: SparkSession,
    arrivals: DataFrame,
    work: Callable[[DataFrame], DataFrame],
    path: str,
    pause: dt.timedelta = dt.timedelta(minutes=10),
    keep: dt.timedelta = dt.timedelta(days=7),
    quiet: Callable[[int], int | None] | None = None,
    every: str = "30 seconds",
    rows_per_bucket: int = 1_000_000,
) -> StreamingQuery:
    """Arrivals (item_id, body) -> work (rows due -> item_id, ok) until ok, for labelling as for delivery.

    The ledger (a KeyIndex of LEDGER rows under path/ledger) has the ids that are done, with the attempt that did it. A row that is due but
    in the ledger is not worked on again: an outcome that has not come back yet, and a batch that is run again, send nothing twice; what
    was done when a batch was lost before its ledger was written may be done twice. The query ticks without arrivals, until it is stopped.
    """
    ledger = KeyIndex(spark, f"{path}/ledger", LEDGER, rows_per_bucket)
    outcomes = f"{path}/outcomes"
    spark.createDataFrame([], EVENT).write.mode("append").json(outcomes)
    back = spark.readStream.schema(EVENT).json(outcomes)
    came = arrivals.select(F.col("item_id").cast("string").alias("item_id"), F.lit(False).alias("done"), F.col("body").cast("string").alias("body"))
    before = spark.conf.get(STORE, None)

    def batch(df: DataFrame, number: int) -> None:
        due = materialize(df, "due")
        if due.isEmpty():
            return
        known = ledger.lookup(due.select("item_id"))
        new = due.join(known.select("item_id"), "item_id", "left_anti")
        got = work(new.dropDuplicates(["item_id"])).select("item_id", F.coalesce("ok", F.lit(False)).alias("ok"))
        done = materialize(got.filter("ok").join(due.groupBy("item_id").agg(F.max("attempt").alias("attempt")), "item_id").select("item_id", "attempt"), "done")
        label = f"{number}-{uuid.uuid4().hex[:8]}"
        ledger.tidy(label)
        ledger.append(done, label)
        again = known.select("item_id").union(done.select("item_id"))
        again.select("item_id", F.lit(True).alias("done"), F.lit(None).cast("string").alias("body")).write.mode("append").json(outcomes)

    spark.conf.set(STORE, ROCKS)
    try:
        rows = due_items(came.unionByName(back), pause, keep, quiet)
        return rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(processingTime=every).start()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of a work_stream: item_id, attempt. Of an id that two runs recorded, the earlier attempt."""
    return KeyIndex(spark, f"{path}/ledger", LEDGER).rows().groupBy("item_id").agg(F.min("attempt").alias("attempt"))
