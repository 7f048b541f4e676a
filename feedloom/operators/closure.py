"""Connected components kept over batches of edges: a batch touches only the components that its edges meet.

Two keyed tables hold the state: the component of each node as it was when the node came, and where a component has moved. A batch looks up its own nodes,
follows the moves of their components, closes its edges over what it found, and appends new nodes and new moves; no member of a component is rewritten,
however large the component is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.components import connected_components
from feedloom.plans.key_index import KeyIndex
from feedloom.plans.persist import materialize


class ComponentStore:
    """Components of nodes of a SQL type under path, each named by its least node."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string", rows_per_bucket: int = 1_000_000):
        self.nodes = KeyIndex(spark, f"{path}/nodes", f"node {kind}, component {kind}", rows_per_bucket)
        self.moves = KeyIndex(spark, f"{path}/moves", f"component {kind}, root {kind}, batch bigint", rows_per_bucket)

    def _roots(self, components: DataFrame, batch: int | None) -> DataFrame:
        """component, root for distinct components: moves are followed until none is left, the latest of a component counts.
        Those that took part in a batch point to its root at once afterwards, so paths stay short."""
        at = components.select("component", F.col("component").alias("root"))
        while True:
            asked = at.select(F.col("root").alias("component"))
            found = self.moves.lookup(asked, batch).groupBy("component").agg(F.max_by("root", "batch").alias("to"))
            found = materialize(found, "moves")
            if found.isEmpty():
                return at
            at = materialize(at.join(found.withColumnRenamed("component", "root"), "root", "left").select("component", F.coalesce("to", "root").alias("root")), "roots")

    def merge(self, edges: DataFrame, batch: int, a: str = "a", b: str = "b") -> DataFrame:
        """Add the edges as this batch. Gives node, component for the batch's own nodes. Edges with a null end are left out; one from a node to
        itself adds the node. The same batch number again stands in place of its first run."""
        self.nodes.tidy(batch)
        self.moves.tidy(batch)
        pairs = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).na.drop().distinct(), "batch-edges")
        own = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        known = materialize(self.nodes.lookup(own, batch), "known")
        roots = self._roots(known.select("component").distinct(), batch)
        stands = materialize(own.join(known, "node", "left").join(roots, "component", "left").select("node", "component", F.coalesce("root", "node").alias("at")), "stands")
        ends = pairs.join(stands.select(F.col("node").alias("a"), F.col("at").alias("at_a")), "a").join(stands.select(F.col("node").alias("b"), F.col("at").alias("at_b")), "b")
        closed = materialize(connected_components(ends.select(F.col("at_a").alias("a"), F.col("at_b").alias("b"))).distinct(), "closed")
        now = stands.join(closed.select(F.col("node").alias("at"), F.col("component").alias("found")), "at", "left")
        now = materialize(now.select("node", "component", "at", F.coalesce("found", "at").alias("root")), "now")
        moved = now.filter("component is not null").select("component", "root").union(now.filter("component is not null").select("at", "root"))
        moved = moved.filter("component <> root").distinct().withColumn("batch", F.lit(batch).cast("bigint"))
        self.moves.append(moved, batch)
        self.nodes.append(now.filter("component is null").select("node", F.col("root").alias("component")), batch)
        return now.select("node", F.col("root").alias("component"))

    def members(self) -> DataFrame:
        """node, component of all nodes."""
        nodes = self.nodes.rows()
        roots = self._roots(nodes.select("component").distinct(), None)
        return nodes.join(roots, "component").select("node", F.col("root").alias("component"))
