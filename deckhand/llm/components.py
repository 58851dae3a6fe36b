"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, and is written to the shared folder. The minima are written
before they are joined, so that both sides of a join are plain shuffles, of which Spark splits a part that
one node fills: neither the driver nor a task ever holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckhand.llm import common


def large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to the least of it and its neighbours."""
    both = edges.union(edges.selectExpr("b AS a", "a AS b"))
    least = common.written(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m"), "least")
    out = common.written(both.join(least, "a").where("b > a").selectExpr("m AS a", "b").where("a <> b"), "edges")
    common.dropped(least)
    return out


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them; edges go from smaller to larger."""
    least = common.written(edges.groupBy("b").agg(F.min("a").alias("m")), "least")
    moved = edges.join(least, "b").selectExpr("m AS a", "a AS b").where("a <> b")
    out = common.written(moved.union(least.selectExpr("m AS a", "b")).distinct(), "edges")
    common.dropped(least)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every larger node has one smaller one, which is no larger node itself."""
    ends = edges.selectExpr("a AS node", "0 AS upper").union(edges.selectExpr("b AS node", "1 AS upper"))
    return ends.groupBy("node").agg(F.sum("upper").alias("n"), F.min("upper").alias("least")).where("n > 1 OR (n = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b); root is the component's least node.

    Loops, repeated edges and either direction are fine; no edges give no rows.
    """
    edges = edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()
    current = common.written(edges, "edges")
    if current.isEmpty():
        return current.selectExpr("b AS node", "a AS root")
    while not _settled(current):
        large = large_star(current)
        small = small_star(large)
        common.dropped(current, large)
        current = small
    return current.selectExpr("b AS node", "a AS root").union(current.selectExpr("a AS node", "a AS root").distinct())


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components of which some are linked anew: node, root, as components() gives them for all links together.

    Only the components that links (a, b) join are worked on, so late links cost little.
    """
    ends = rooted(rooted(links.select("a", "b"), roots, "a", "p"), roots, "b", "q")
    between = common.written(components(common.written(ends.selectExpr("p AS a", "q AS b"), "ends")), "merged")
    moved = between.selectExpr("node AS root", "root AS above")
    old = roots.join(moved, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    # A node that had no links was its own root, and isn't in the old table.
    new = between.join(roots.select("node"), "node", "left_anti")
    return common.written(old.union(new), "roots")


def rooted(rows: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    """Adds a node's root; a node without links is its own."""
    return rows.join(roots.select(F.col("node").alias(node), F.col("root").alias("_root")), node, "left").withColumn(root, F.coalesce("_root", node)).drop("_root")
