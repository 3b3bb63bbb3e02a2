"""Connected components of a link table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigipanel.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its least node.

    Each round every node hooks to its least neighbour, chains of hooks are shortened, and
    links are renamed to the nodes' new names; links inside one name vanish.  The link table
    shrinks from round to round, only table sizes reach the driver, and each round is stored.
    Minima combine before the shuffle; a hub's links are an ordinary skewed join, which
    adaptive execution splits.  No links give an empty table; repeated links and loops do no harm.
    """
    edges = materialise(links.select("a", "b").where("a <> b").distinct())
    names = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")))
        jump = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
        for _ in range(2):
            hooks = hooks.join(jump, "to").select("node", F.col("next").alias("to"))
        hooks = materialise(hooks)
        names = hooks.select("node", F.col("to").alias("component")) if names is None else renamed(names, hooks)
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(hooks.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("to", end)
        edges = materialise(ends.where("a <> b").distinct())
    if names is None:
        return links.selectExpr("a node", "b component").limit(0)
    return names


def renamed(names: DataFrame, hooks: DataFrame) -> DataFrame:
    """Components after one more round; those that did not move keep their name."""
    moved = hooks.where("node <> to").withColumnRenamed("node", "component")
    return materialise(
        names.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    )
