"""Sharding along a Hilbert curve.

Metadata dimensions (language, source, size, id) are quantised in their order, at approximate quantiles, to `bits` bits each; their cell's place on a Hilbert
curve orders the rows, and the order is cut into shards of counts at most one apart, so that each shard's files cover
a compact region of every dimension and a filter on any of them prunes files.

The order is global but nothing is sorted globally: the curve has a fixed number of cells, so their counts and offsets
are a table of bounded size; inside a cell, rows are spread over SALTS groups, ranked by text checksum and id in each,
so a cell that holds a third of all rows is still ranked by many tasks.
"""

from __future__ import annotations

from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.plans.persist import materialize

BITS, SALTS = 3, 64
#: Bytes of a category behind what all values share that order it, and the accuracy of quantiles.
PREFIX, ACCURACY = 6, 10000


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of each point (row) of axes, by the transpose of Gray-coded axes (Skilling 2004)."""
    x = axes.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def number(col: Column, shared: int) -> Column:
    """A category as a number in the order of its bytes, of which all values share the first ones."""
    data = F.substring(F.coalesce(col.cast("string"), F.lit("")).cast("binary"), shared + 1, PREFIX)
    return F.conv(F.rpad(F.hex(data), 2 * PREFIX, "0"), 16, 10).cast("long")


def quantised(col: Column, cuts: list) -> Column:
    """How many of the cuts a number has reached; null is in the first cell."""
    return F.coalesce(sum([(col >= F.lit(c)).cast("int") for c in cuts], F.lit(0)), F.lit(0))


def hilbert_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source"), bits: int = BITS, salts: int = SALTS
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, cell (place on the curve), rank (in the whole order), shard, slot.

    Shard s holds the ranks from ceil(s*n/shards) on, so counts are at most one apart and slots have no gaps. Size is
    the text's UTF-8 bytes (null: none) plus 1. Nulls are quantised to fixed cells; equal texts of one salt stand side by
    side; rows equal in all that orders them are ranked in any order. An empty table gives an empty result.
    """
    @F.pandas_udf("int")
    def place(axes: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(axes.to_numpy(), bits).astype("int32"))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    names = [F.col(c).cast("string") for c in categories]
    ends = docs.agg(*[f(n) for n in names for f in (F.min, F.max)]).first() if categories else []
    shared = [len(commonprefix([(x or "").encode() for x in ends[2 * i : 2 * i + 2]])) for i in range(len(names))]
    size = F.octet_length(text).cast("long") + 1
    measures = [*map(number, names, shared), size, F.col(id_col).cast("long")]
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = docs.agg(*[F.percentile_approx(m, steps, ACCURACY) for m in measures]).first()
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        *[quantised(m, found or []).alias(f"axis_{i}") for i, (m, found) in enumerate(zip(measures, cuts, strict=True))],
    )
    axes = [c for c in rows.columns if c.startswith("axis_")]
    placed = rows.withColumn("cell", place(F.struct(*axes))).select(
        "doc_id", "size", "text_crc32", "cell", F.pmod(F.xxhash64("text_crc32", F.floor(F.col("doc_id") / 16)), F.lit(salts)).cast("int").alias("salt")
    )
    placed = materialize(placed, "placed")
    groups = placed.groupBy("cell", "salt").agg(F.count("*").alias("n"))
    cells = groups.groupBy("cell").agg(F.sum("n").alias("n"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_at"), F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    within = Window.partitionBy("cell").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.withColumn("salt_at", F.coalesce(F.sum("n").over(within), F.lit(0))).join(cells, "cell").select("cell", "salt", (F.col("cell_at") + F.col("salt_at")).alias("at"), "total")
    own = Window.partitionBy("cell", "salt").orderBy("text_crc32", "size", F.col("doc_id").asc_nulls_last())
    ranked = placed.withColumn("nth", F.row_number().over(own)).join(offsets, ["cell", "salt"]).withColumn("rank", F.col("at") + F.col("nth") - 1)
    shard = F.expr(f"(rank * {shards}) div total").cast("int")
    return ranked.select("doc_id", "size", "text_crc32", "cell", "rank", shard.alias("shard"), "total").select(
        "doc_id", "size", "text_crc32", "cell", "rank", "shard", (F.col("rank") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).alias("slot")
    )
