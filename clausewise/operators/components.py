"""Classes of linked things, found by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.operators.durable import durable


def connected(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, class) for every node of the links (a, b): two nodes have one class if a chain of links joins them.

    A class goes by its smallest node.  Each round hands the smallest label to neighbours and then to
    the label's own label, so chains shorten by half and more; lineage is cut each round.  Self-links and repeated links
    change nothing; no links give no rows.  Raises if `most_rounds` do not suffice.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = durable(both)
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        step = labels.join(near, "node", "left").select("node", "class", F.least("class", "near").alias("new"))
        jump = step.join(labels.select(F.col("node").alias("new"), F.col("class").alias("further")), "new", "left")
        after = durable(jump.select("node", "class", F.least("new", F.coalesce("further", "new")).alias("new")))
        labels = after.select("node", F.col("new").alias("class"))
        if after.where("class <> new").isEmpty():
            return labels
    raise RuntimeError("the links form a longer chain than expected")


def descendants(roots: DataFrame, edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(root, node, depth): all that the edges (parent, child) reach from the nodes (root, node), with their distance; the roots have depth 0.

    One join for each level; lineage is cut each time. A node that several ways lead to stands as often as in the recursion. Raises if
    `most_rounds` do not suffice, as in a circle.
    """
    level = durable(roots.select("root", "node", F.lit(0).alias("depth")))
    found = level
    for depth in range(1, most_rounds + 1):
        below = level.join(edges, level["node"] == edges["parent"]).select("root", F.col("child").alias("node"), F.lit(depth).alias("depth"))
        level = durable(below)
        if level.isEmpty():
            return found
        found = found.unionByName(level)
    raise RuntimeError("the hierarchy is deeper than expected, or goes in a circle")
