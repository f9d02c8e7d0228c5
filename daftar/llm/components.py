"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.scratch import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an edge; component is its smallest node.

    Each round hooks every component to the smallest one beside it, shortens the
    chains of hooks to their roots, and contracts the edges, until none is left
    between components.  All steps are joins and minima by key: a node with very many
    edges is a key with many rows, which partial minima and split joins take apart.
    Beside any edge the larger of its components is hooked, so every round leaves fewer of them and the
    rounds end, however long a chain is.  An empty table of edges gives an empty table; null ends and loops are no
    edges; repeated edges count once.
    """
    scratch = Scratch(edges.sparkSession, "components")
    one_way = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a != b")
    both = one_way.union(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    left = scratch.write(both)
    labels = scratch.write(left.groupBy(F.col("a").alias("node")).agg(F.first("a").alias("component")))
    while not left.isEmpty():
        hooks = scratch.write(left.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("root")))
        while True:
            up = hooks.select(F.col("a").alias("root"), F.col("root").alias("upper"))
            shorter = scratch.write(hooks.join(up, "root").select("a", F.col("upper").alias("root"), (F.col("upper") != F.col("root")).alias("moved")))
            moved = not shorter.where("moved").isEmpty()
            scratch.drop(hooks)
            hooks = shorter.select("a", "root")
            hooks._daftar_path = shorter._daftar_path
            if not moved:
                break
        to = hooks.select(F.col("a").alias("component"), "root")
        new_labels = scratch.write(
            labels.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        )
        from_a, from_b = hooks.select("a", F.col("root").alias("ra")), hooks.select(F.col("a").alias("b"), F.col("root").alias("rb"))
        new_left = scratch.write(
            left.join(from_a, "a").join(from_b, "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        )
        scratch.drop(left, labels, hooks)
        left, labels = new_left, new_labels
    scratch.drop(left)
    return labels
