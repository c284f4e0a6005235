"""Connected components by contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the smallest id reachable.

    Each round contracts the graph: every node points to its smallest neighbour if
    that is smaller than itself, pointers are followed twice, and edges between
    different roots stay. At least half of the nodes that still have edges lose
    their root in a round, so rounds grow as the logarithm of a component's size.
    Null ends are ignored; an empty table gives no rows. Nothing is gathered on
    the driver but whether edges are left.
    """
    both = edges.select("a", "b").where("a is not null and b is not null")
    nodes = written(both.select(F.col("a").alias("id")).union(both.select("b")).distinct().select("id", F.col("id").alias("component")), "nodes")
    live = written(both.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not live.isEmpty():
        # b > a, so the smallest smaller neighbour of a node is the least a among its edges.
        up = written(live.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")), "parents")
        step = lambda n: up.select(F.col("v").alias(f"p{n}"), F.col("p").alias(f"p{n + 1}"))
        follow = up.select("v", F.col("p").alias("p1")).join(step(1), "p1", "left").join(step(2), "p2", "left")
        roots = written(follow.select(F.col("v").alias("component"), F.coalesce("p3", "p2", "p1").alias("root")), "roots")
        newer = written(nodes.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "nodes")
        side = lambda c: roots.select(F.col("component").alias(c), F.col("root").alias(f"{c}_root"))
        moved = live.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"))
        left = written(moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        for old in (nodes, live, up, roots):
            dropped(old)
        nodes, live = newer, left
    return nodes


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (id, component) after more links (a, b) between its ids: only their
    components are contracted, not all earlier links again."""
    side = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_root"))
    between = links.join(side("a"), "a").join(side("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    roots = components(between.distinct()).select(F.col("id").alias("component"), F.col("component").alias("root"))
    return written(found.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "components")
