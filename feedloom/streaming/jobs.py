"""Structured Streaming forms of the polled jobs; each micro-batch uses the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from feedloom.operators.state import insert_items_if_new
from feedloom.plans.persist import materialize
from feedloom.plans.snapshots import append_batch, read_snapshot


def ingest(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Payload stream -> parser -> insert-if-new into the item table at `table`. A batch that is run again appends
    nothing twice: its rows are compared with all that is there, its own first run included."""

    def batch(df: DataFrame, batch_id: int) -> None:
        append_batch(insert_items_if_new(read_snapshot(df.sparkSession, table, schema), parse(df)), table, batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_within(stream: DataFrame, keys: list[str], time: str, delay: str = "2 days") -> DataFrame:
    """The first row of each key within a watermark: bounded state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


class _Health(StatefulProcessor):
    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", "score double, last_success timestamp, last_error string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        score, success, error = self.state.get() if self.state.exists() else (1.0, None, None)
        for row in pd.concat(list(rows)).sort_values(["ts", "id"]).itertuples():
            score = self.alpha * float(row.ok) + (1 - self.alpha) * score
            success, error = (row.ts, None) if row.ok else (success, row.error)
        self.state.update((score, success, error))
        yield pd.DataFrame({"source_id": [key[0]], "health_score": [score], "last_success_at": [success], "last_error": [error]})

    def close(self) -> None:
        pass


def health_stream(outcomes: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Running health per source of a stream (source_id, ts, id, ok, error). Within a micro-batch rows are folded in the
    order (ts, id); later ones when they arrive. Needs the RocksDB state store."""
    schema = "source_id string, health_score double, last_success_at timestamp, last_error string"
    return outcomes.groupBy("source_id").transformWithStateInPandas(_Health(alpha), outputStructType=schema, outputMode="Update", timeMode="None")


def label_pending(spark: SparkSession, pending: Callable[[], DataFrame], label: Callable[[DataFrame], DataFrame], table: str, schema: str, tick: int = 0) -> None:
    """One tick: items of pending() (id, ...) that the label table lacks -> label (a row (id, kind, ...) for each that got
    one) -> appended. Items whose label failed are asked again at the next tick; of several labels the latest appended
    counts as well as any, as an item that has one is not asked again."""
    known = read_snapshot(spark, table, schema)
    got = label(pending().join(known.select("id"), "id", "left_anti"))
    append_batch(got.dropDuplicates(["id"]).select(*known.columns), table, tick)


def label_stream(stream: DataFrame, pending: Callable[[], DataFrame], label: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, schema: str) -> StreamingQuery:
    """label_pending at each arrival: what arrived is not what is labelled, but all that is pending then."""

    def batch(df: DataFrame, batch_id: int) -> None:
        label_pending(df.sparkSession, pending, label, table, schema, batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deliver_pending(
    spark: SparkSession, pending: Callable[[], DataFrame], deliver: Callable[[DataFrame], DataFrame], ledger: str, schema: str, quiet: Column | None = None, tick: int = 0
) -> dict[str, int | bool]:
    """One tick: rows of pending() (item_id, ...) that the ledger lacks -> deliver (item_id, ok) -> the ledger gets the
    successful ones. Gives found, pushed, skipped_quiet.

    What failed, and all that is found in quiet hours, is pending at the next tick again. A tick that is run again sends
    only what its first run did not record; what was sent when a run was lost before recording may be sent twice.
    """
    known = read_snapshot(spark, ledger, schema)
    fresh = pending().dropDuplicates(["item_id"]).join(known.select("item_id"), "item_id", "left_anti")
    if quiet is not None and spark.range(1).select(quiet).first()[0]:
        return {"found": fresh.count(), "pushed": 0, "skipped_quiet": True}
    # deliver runs once: later reads are of what it gave
    outcomes = materialize(deliver(fresh).select("item_id", F.coalesce("ok", F.lit(False)).alias("ok")), "outcomes")
    sent = outcomes.filter("ok").select("item_id")
    append_batch(sent.withColumns({c: F.lit(None).cast(known.schema[c].dataType) for c in known.columns if c != "item_id"}).select(*known.columns), ledger, tick)
    counts = outcomes.agg(F.count("*"), F.count_if("ok")).first()
    return {"found": counts[0], "pushed": counts[1], "skipped_quiet": False}


def deliver_stream(
    stream: DataFrame,
    pending: Callable[[], DataFrame],
    deliver: Callable[[DataFrame], DataFrame],
    ledger: str,
    checkpoint: str,
    schema: str,
    quiet: Column | None = None,
    told: Callable[[dict[str, int | bool]], None] | None = None,
) -> StreamingQuery:
    """deliver_pending at each arrival; told gets what each tick gave."""

    def batch(df: DataFrame, batch_id: int) -> None:
        got = deliver_pending(df.sparkSession, pending, deliver, ledger, schema, quiet, batch_id)
        if told is not None:
            told(got)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed payload files as a stream."""
    return spark.readStream.schema(schema).json(path)
