"""Connected components by contraction, with joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b): component is the smallest node reachable.

    Each round, nodes move to their smallest neighbour's smallest neighbour, edges follow, and
    those that have become loops go; the moves of all rounds are then composed. Loops and repeated
    edges may come in; rows with a null end are ignored; no edges give no rows.
    """
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    first = left = materialize(edges.where("a <> b").select(lo, hi).distinct(), "components-edges")
    moves: list[DataFrame] = []
    while left.limit(1).count():
        hook = materialize(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "components-hook")
        jump = hook.alias("h").join(hook.select(F.col("node").alias("at"), F.col("root").alias("next")), F.col("root") == F.col("at"), "left")
        move = materialize(jump.select("h.node", F.coalesce("next", "root").alias("root")), "components-move")
        discard(hook)
        moves.append(move)
        to = lambda df, c: df.join(move.select(F.col("node").alias("at"), F.col("root").alias("next")), F.col(c) == F.col("at"), "left").withColumn(c, F.coalesce("next", c)).drop("at", "next")  # noqa: E731, B023
        moved = to(to(left, "lo"), "hi").where("lo <> hi")
        before, left = left, materialize(moved.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct(), "components-edges")
        if before is not first:
            discard(before)
    nodes = first.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().withColumn("component", F.col("node"))
    for move in moves:
        step = move.select(F.col("node").alias("at"), F.col("root").alias("next"))
        nodes = nodes.join(step, F.col("component") == F.col("at"), "left").select("node", F.coalesce("next", "component").alias("component"))
    return nodes
