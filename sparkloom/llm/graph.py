"""Connected components of a distributed table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node in the edges (a, b), which are of type long.

    In a round every node takes its smallest neighbour's label, then that label's own, so chains shrink to a third or less; edges are then
    contracted to those between different labels, and the next round works on what is left. A round is two jobs on written tables. Hubs are aggregated
    before the shuffle, and each edge is joined twice in the round that it lives to see.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("near")), "near")
        up = near.select(F.col("node").alias("near"), F.col("near").alias("component"))
        labels = cut(near.join(up, "near").select("node", "component"), "labels")
        discard(near)
        if found is None:
            found = labels
        else:
            moved = labels.select(F.col("node").alias("component"), F.col("component").alias("moved"))
            before = found
            found = cut(before.join(moved, "component", "left").select("node", F.coalesce("moved", "component").alias("component")), "components")
            discard(before)
        a, b = (labels.select(F.col("node").alias(x), F.col("component").alias(f"to_{x}")) for x in "ab")
        left = edges.where("a <> b").join(a, "a").join(b, "b").where("to_a <> to_b")
        before = edges
        edges = cut(left.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        discard(before, *([labels] if labels is not found else []))
        if edges.isEmpty():
            return found
