"""Connected components of a distributed edge list, by alternating large-star and
small-star steps (Kiveris et al., 2014).

Only links between different nodes are kept; each step is two aggregations with
map-side combine and one join, so a node of very high degree is split by the
partial aggregates and by skew-join handling, and no neighbour list is ever
gathered. Lineage is cut by ``checkpoint()`` once per round. Labels converge in
a number of rounds logarithmic in the node count; every label is the smallest
node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over undirected edges (a, b), a != b.

    large: link every larger neighbour of a node to the smallest node around it;
    small: link the node and its smaller neighbours to the smallest of them.
    """
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    j = both.join(low, "a")
    if large:
        out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component = smallest node reachable.

    Nulls and self-links are ignored; repeated and reversed links count once; no
    edges give no rows. Nodes without links are not listed: they are their own
    component.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    for _ in range(max_rounds):
        e2 = _star(_star(e, True), False).checkpoint()
        # a fixed point is a forest of stars: every node has one link, to a node that has none upward
        moved = e2.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if not moved:
            moved = e2.alias("x").join(e2.alias("y"), F.col("x.b") == F.col("y.a")).limit(1).count()
        e = e2
        if not moved:
            break
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
