"""Insert-if-new of a stream through an index of keys: a batch reads the keys that its own may equal, not the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.state import first_of_batch
from feedloom.plans.key_index import KeyIndex
from feedloom.plans.persist import materialize

KEY = "key string"


def id_key() -> Column:
    return F.concat(F.lit("id:"), F.col("id").cast("string"))


def url_key() -> Column:
    """source_id and url; the source's length keeps apart what they are together."""
    source = F.col("source_id").cast("string")
    return F.concat(F.lit("url:"), F.length(source).cast("string"), F.lit(":"), source, F.lit("|"), F.col("url"))


def insert_by_index(batch: DataFrame, index: KeyIndex, table: str, number: int) -> DataFrame:
    """The rows of state.insert_items_if_new for a table whose keys are in index: written as a batch folder of the table, their
    keys to the index. The same number again replaces both, so a batch that was lost half-way leaves nothing twice and nothing out."""
    index.tidy(number)
    rows = materialize(batch.filter("url <> ''").withColumns({"_id": id_key(), "_url": url_key()}), "batch")
    keys = rows.select(F.explode(F.array("_id", "_url")).alias("key")).filter("key is not null")
    known = materialize(index.lookup(keys, number), "known")
    new = rows.join(known.withColumnRenamed("key", "_id"), "_id", "left_anti").join(known.withColumnRenamed("key", "_url"), "_url", "left_anti")
    made = materialize(first_of_batch(new.select(*batch.columns)), "new")
    made.write.mode("overwrite").parquet(f"{table}/batch-{number:08d}-keyed")
    index.append(made.select(F.explode(F.array(id_key(), url_key())).alias("key")).filter("key is not null"), number)
    return made


def ingest_by_index(spark: SparkSession, stream: DataFrame, parse: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, rows_per_bucket: int = 1_000_000) -> StreamingQuery:
    """Payload stream -> parser -> insert_by_index into the item table at `table` (read_snapshot reads it), its index beside it."""
    index = KeyIndex(spark, f"{table}-keys", KEY, rows_per_bucket)

    def batch(df: DataFrame, batch_id: int) -> None:
        insert_by_index(parse(df), index, table, batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
