"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtrail.llm.tables import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for the nodes of ``edges`` (``u, v``); the label is one node of the component.

    Every node moves to its smallest neighbour, edges are renamed and those within one
    node vanish; the graph shrinks by a factor each time, also around a node that has
    most of the edges, as minima are combined before the shuffle.
    """
    labels = None
    left = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not left.isEmpty():
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moves = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("to")), "moves")
        if labels is None:
            labels = moves.select(F.col("u").alias("node"), F.col("to").alias("label"))
        else:
            labels = stage(
                labels.join(moves.withColumnRenamed("u", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")),
                "labels",
            )
        renamed = left.join(moves, "u").select(F.col("to").alias("a"), "v").join(moves.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        left = stage(renamed.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if labels is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels
