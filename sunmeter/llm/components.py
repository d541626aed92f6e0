"""Connected components of links that Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmeter.llm.common import fresh_key, settled


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node that links lead to; both long.

    Each round points every node to its smallest neighbour, or where that one
    points, and carries the links over to where their ends point; links inside one
    node go.  What is left is a smaller graph, so rounds grow with the logarithm of
    the longest path.  Rounds end when no link is left; then each round's pointers
    are followed through those of the rounds after it.  Nothing but one row is
    brought to the driver, and every round's tables are stored, so a lost executor
    repeats a part of one round only.  Links may repeat and may join a node to
    itself; those with a null end are ignored; no links give no rows.
    """
    ends = links.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"))
    edges = settled(_tidy(ends.dropna()), "links")
    rounds = []
    while not edges.isEmpty():
        rounds.append(settled(_pointers(edges), "pointers"))
        edges = settled(_tidy(_follow(_follow(edges, "a", rounds[-1]), "b", rounds[-1])), "links")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds.pop()
    while rounds:
        labels = settled(_follow(rounds.pop(), "to", labels), "labels")
    return labels.select("node", F.col("to").alias("component"))


def _tidy(edges: DataFrame) -> DataFrame:
    """Each link once, from the smaller to the larger end."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return edges.filter("a <> b").select(low.alias("a"), high.alias("b")).distinct()


def _pointers(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself, then where that points; paths lead downwards."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
    nearest = smallest.select("node", F.least("node", "to").alias("to"))
    return _follow(nearest, "to", nearest)


def _follow(rows: DataFrame, column: str, pointers: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by where it points; without a pointer it stays."""
    steps = pointers.select(fresh_key("node").alias("step"), F.col("to").alias("stepped"))
    joined = rows.join(steps, fresh_key(column) == F.col("step"), "left")
    return joined.withColumn(column, F.coalesce("stepped", column)).select(*rows.columns)
