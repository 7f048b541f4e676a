"""The retry queue as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "ts timestamp, error string, item struct<item_id:string,title:string,kind:string,url:string,source:string,summary:string,topic:string,digest_date:string>, last_retry_ts timestamp"


def read_queue(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Queue rows; lines that are no JSON are dropped, blank ones skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_queue(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
