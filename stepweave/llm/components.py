"""Connected components by repeated contraction; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.shared import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component: the smallest node reachable) for the nodes of edges (a, b), of long ids.

    In a round each node points to its smallest neighbour, pointers are followed four times as
    far, and the edges are renamed; the graph left shrinks until no edge joins two names. Each
    round is written out, so a lost executor costs one round. Self loops keep their nodes; a
    table without edges gives no rows.
    """
    left = materialize(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    labels = None
    while True:
        both = left.select("a", "b").union(left.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to"))
        parent = materialize(parent, "parents")
        far = parent
        for _ in range(2):
            far = far.alias("f").join(far.alias("g"), F.col("f.to") == F.col("g.node")).select("f.node", F.col("g.to").alias("to"))
        far = materialize(far, "pointers")
        if labels is None:
            new = far.select("node", F.col("to").alias("component"))
        else:
            new = labels.join(far.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        new = materialize(new, "labels")
        ends = far.select(F.col("node").alias("a"), F.col("to").alias("ta")), far.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = left.join(ends[0], "a").join(ends[1], "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        moved = materialize(moved, "edges")
        release(left, parent, far, *([labels] if labels is not None else []))
        left, labels = moved, new
        if left.isEmpty():
            release(left)
            return labels
