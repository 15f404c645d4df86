"""Connected components of a graph given as edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

JUMPS = 3


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node it is connected to.

    In each round every label hooks onto the smallest label next to it, chains of hooks are
    shortened by joining the hooks with themselves, and the edges are contracted to the edges
    between labels that are left. Labels of well-connected nodes are counted before the shuffle
    and no neighbour list is ever collected. Ends when no edge is left; an empty graph gives no
    rows.
    """
    edges = staged(edges.filter("a <> b").distinct(), "edges")
    labels = staged(
        edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        .withColumn("label", F.col("node")),
        "labels",
    )
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("b"))
        hooks = hooks.select(F.col("a").alias("from"), F.least("a", "b").alias("to"))
        hooks = staged(hooks, "hooks")
        for _ in range(JUMPS):
            onward = hooks.select(F.col("from").alias("to"), F.col("to").alias("next"))
            hooks = staged(hooks.join(onward, "to").select("from", F.col("next").alias("to")), "hooks")
        labels = staged(_mapped(labels, "label", hooks), "labels")
        edges = _mapped(_mapped(edges, "a", hooks), "b", hooks)
        edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = staged(edges.distinct(), "edges")
    return labels


def _mapped(rows: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    joined = rows.join(hooks, rows[column] == hooks["from"], "left")
    return joined.withColumn(column, F.coalesce("to", column)).drop("from", "to")
