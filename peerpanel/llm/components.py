"""Connected components of a graph of 64-bit vertices, by rounds of joins.

Each round is the large-star and small-star pair: every vertex links its larger neighbours,
then its smaller ones, to the smallest vertex it sees.  The edges become stars around the
smallest vertex of each component.  A round's edges are written to the shared checkpoint
folder, so neither the driver nor any task holds links or components of the whole graph.
The smallest neighbour is found by an aggregate before the join, so a vertex with very many
links is not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large-star over both directions of the edges, or small-star towards smaller vertices."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.where("b < a")  # (vertex, neighbour)
    least = materialise(seen.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
    linked = seen.where("b > a") if large else seen
    # every linked neighbour, and for small-star the vertex itself, goes to the smallest
    out = linked.join(least.withColumnRenamed("a", "v"), F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("m").alias("b")))
    return materialise(out.where("a <> b").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, root): the smallest vertex of its component, for every vertex of ``edges`` (a, b).

    Loops and repeated edges do no harm; no edges give no rows."""
    now = materialise(edges.where("a <> b").distinct())
    mark = None
    while True:
        now = _star(_star(now, large=True), large=False)
        # the edges are stars with the smallest vertex in the middle when a round changes nothing
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("root")).union(now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
