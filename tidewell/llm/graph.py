"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import gathered, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Each step takes the smallest label of the neighbours and then the label of
    that label, so the number of steps is logarithmic in a path and two or three
    for stars. Steps are written tables; the driver sees one count a step. Sums
    over a node are combined before they are shuffled; joins have one row a node
    on one side, so a node with very many edges can be split."""
    both = materialize(
        gathered(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).where("x <> y").distinct()), "edges"
    )
    labels = materialize(gathered(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("component"))), "labels")
    while True:
        heard = both.join(labels, both.x == labels.node).groupBy(F.col("y").alias("node")).agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("near"))
        of = labels.select(F.col("node").alias("near"), F.col("component").alias("beyond"))
        step = materialize(gathered(nearer.join(of, "near").select("node", "old", F.least("near", "beyond").alias("component"))), "labels")
        labels = step.select("node", "component")
        if step.where("old <> component").limit(1).count() == 0:
            return labels
