"""Running totals over a global order, in two levels: inside ranges of the order, then over the ranges' totals.

No task holds more than one range of rows, and the second level has one row for each range and group, so a group (or the
whole table) of any size is numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.plans.persist import materialize

PART = "_part"


def ranged(df: DataFrame, order: list[Column], name: str = "ranged") -> DataFrame:
    """df dealt out by ranges of order, with the range in PART, written once: ranges have gapless places in the order
    only as long as they are not computed anew. Rows equal in order share a range."""
    return materialize(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), name)


def running_totals(rows: DataFrame, order: list[Column], totals: dict[str, Column], within: list[str] | None = None) -> DataFrame:
    """rows (from ranged, in the same order) with, for each name, the total of a long Column over the rows before it
    among those of the same `within` columns. Null values count 0; null group values are a group."""
    groups = within or []
    parts = rows.groupBy(PART, *groups).agg(*[F.sum(v).alias(n) for n, v in totals.items()])
    before = Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(PART).alias("_at"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]]
    starts = parts.select(*keys, *[F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long").alias(f"_s_{n}") for n in totals])
    same = F.col(PART) == F.col("_at")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    own = Window.partitionBy(PART, *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({f"_i_{n}": F.coalesce(F.sum(v).over(own), F.lit(0)) for n, v in totals.items()})
    out = inside.join(starts, same)
    return out.select(*rows.columns, *[(F.col(f"_s_{n}") + F.col(f"_i_{n}")).cast("long").alias(n) for n in totals])


def numbered(rows: DataFrame, order: list[Column], name: str = "nth", within: list[str] | None = None) -> DataFrame:
    """rows (from ranged) with their place from 0 in the order, or in the order within groups."""
    return running_totals(rows, order, {name: F.lit(1)}, within)
