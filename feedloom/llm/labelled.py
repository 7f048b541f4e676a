"""A bounded sample of labelled documents to learn from, and the folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.plans.persist import materialize

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is a multiple of FOLDS; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """(text, label) of up to per_class[c] rows of label c outside the held-out fold, in the order of a hash of the id;
    and the log of how much likelier label 1 is among all labelled rows than in the sample.

    Ids that are null, unlabelled or labelled both ways are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    one = [known.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class[c]) for c in (0, 1)]
    chosen = F.broadcast(one[0].unionByName(one[1]))  # at most sum(per_class) rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    shift = math.log((n1 + 1) / (n0 + 1)) - math.log((min(n1, per_class[1]) + 1) / (min(n0, per_class[0]) + 1))
    return materialize(texts.join(chosen, "id").select("text", "label"), "labelled"), shift
