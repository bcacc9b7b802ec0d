"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewire.session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node id) for every node that has an edge.

    Minimum labels spread along edges; after each round labels jump to their label's label, so chains close
    in logarithmic rounds.  Every round is written to the checkpoint folder.  Self-edges count, repeated
    edges and null ends do not matter; an empty table gives an empty result.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut_lineage(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("seen")), "v").groupBy("u").agg(F.min("seen").alias("least"))
        spread = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = cut_lineage(spread.join(jump, F.col("label") == F.col("at")).select("node", "old", F.least("label", "further").alias("label")))
        changed = moved.where("label <> old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            break
    return labels.select("node", F.col("label").alias("component"))
