"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toposim.llm.common import materialize


def connected(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); component is the
    least id reachable.

    Each round points every node at its least neighbour, follows that
    pointer once more, and contracts the links to the targets; a round's
    tables are written to the shared folder.  It ends when no link is left.
    """
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    comp = None
    while True:
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("n")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("n")))
        up = both.groupBy("id").agg(F.min("n").alias("n")).select("id", F.least("id", "n").alias("to"))
        hop = up.select(F.col("id").alias("to"), F.col("to").alias("far"))
        step = materialize(up.join(hop, "to").select("id", F.least("to", "far").alias("to")), "step")
        if comp is None:
            comp = step.select("id", F.col("to").alias("component"))
        else:
            moved = step.withColumnRenamed("id", "component")
            comp = comp.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        comp = materialize(comp, "component")
        a = edges.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        edges = a.join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        edges = materialize(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if not edges.limit(1).count():
            return comp
