"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.plans.persist import materialize


#: Neighbours of one node that meet in one task.
STAR = 1_000_000
#: Rows of a list of hot nodes that is sent to all tasks (16 bytes each).
SENT = 100_000


def _with_least(both: DataFrame, star: int | None) -> DataFrame:
    """both (a, b) with m, the least of a and its neighbours. With star, a node of more neighbours than `star` is dealt over sub-centres
    by its neighbours' hashes; there are few of them, at most 2 * edges / star, so their list is sent to all tasks only where that is a short one."""
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if star is None:
        return both.join(least.select("a", F.least("a", "m").alias("m")), "a")
    least = materialize(least.select("a", F.least("a", "m").alias("m"), F.ceil(F.col("n") / star).cast("int").alias("parts")), "least")
    hot = least.filter("parts > 1").select("a", "parts")
    n = hot.count()
    if not n:
        return both.join(least.drop("parts"), "a")
    dealt = both.join(F.broadcast(hot) if n <= SENT else hot, "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    return dealt.join(least.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), ["a", "part"]).drop("part")


def _rounds(edges: DataFrame, star: int | None) -> DataFrame:
    """One large-star and one small-star step over edges (a > b): neighbours move to the least node they know of."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _with_least(both, star).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.filter("a <> b").distinct()
    small = _with_least(large, star).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.greatest("b", "m")).alias("a"), F.col("m").alias("b"))
    return small.distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", star: int = STAR) -> DataFrame:
    """(node, component) for every node of edges; component is the component's least node.

    Alternating large-star and small-star steps; each step is written to shared storage, so lineage stays short and
    lost executors cost one step. Nodes keep only a pointer down, so no neighbourhood is ever gathered in one place, and
    the neighbours of one node are dealt over tasks of at most about `star` each.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    current, before = materialize(pairs, "edges"), None
    while True:
        print_ = current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if before == tuple(print_):
            break
        before = tuple(print_)
        if not before[0]:
            break
        current = materialize(_rounds(current, star if before[0] > star else None), "edges")  # no star has more leaves than edges
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
