"""Connected components by contraction, in rounds of joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, workspace) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its smallest node.

    In each round every node hooks onto its smallest neighbour if that is smaller, chains of hooks are halved, and
    edges are drawn anew between what is left, without repetitions. Only counts reach the driver. Edges of a hub are
    pre-aggregated before they are shuffled.
    """
    edges = workspace.table(edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = edges.select("a").union(edges.select("b")).distinct()
    names = workspace.table(both.select(F.col("a").alias("node"), F.col("a").alias("component")), "names")
    while edges.take(1):
        # Every b has a smaller neighbour; an a hooks nowhere unless it is some b itself.
        hooks = workspace.table(edges.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("p")), "hooks")
        for _ in range(3):
            up = hooks.select(F.col("x").alias("p"), F.col("p").alias("_up"))
            hooks = hooks.join(up, "p", "left").select("x", F.coalesce("_up", "p").alias("p"))
        hooks = workspace.table(hooks, "halved")
        names = workspace.table(names.join(hooks, names.component == hooks.x, "left").select(
            "node", F.coalesce("p", "component").alias("component")), "names")
        left, right = (hooks.select(F.col("x").alias(c), F.col("p").alias(f"_{c}")) for c in "ab")
        moved = edges.join(left, "a", "left").join(right, "b", "left").select(
            F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b")
        edges = workspace.table(moved.select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return names
