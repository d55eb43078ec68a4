"""Connected components of a link table by alternating star steps, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


#: Nodes in at least HUB edges are hubs; in large tables in so many that at most HUBS nodes are.
HUB, HUBS = 256, 1 << 18
#: Edges that a task takes: how many tasks there are follows the table's size, not the number of shuffle partitions.
SHARE = 1 << 17


def _with_least(edges: DataFrame, hub: int, parts: int) -> DataFrame:
    """The edges with the smallest v of each u, as m. Hubs' edges stay where they are and meet their few minima by broadcast.
    hub 0: the table is so small that every node is one."""
    if not hub:
        return edges.join(F.broadcast(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)), "u").select("u", "v", "m")
    least = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    hubs = F.broadcast(least.where(F.col("n") >= hub).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") < hub).select("u", "m"), "u")
    return edges.join(hubs, "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def _large_star(edges: DataFrame, hub: int, parts: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, hub, parts).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v")


def _small_star(edges: DataFrame, hub: int, parts: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down, hub, parts)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).union(found.select("u", F.col("m").alias("v"))).where("u != v")


def components(links: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """(id, component) for every node that has a link; component is the smallest node of its component.

    Links may repeat, point either way or be loops; rows with a null end are ignored. No list of neighbours is ever
    built: each step is a grouped minimum (with partial aggregation, so a hub costs one row a task) and a join, in which
    hubs' minima are broadcast (at most HUBS rows, which in a small table are all nodes).
    Every round is checkpointed in the shared folder. An empty table of links gives an empty result.
    """
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u != v").distinct()
    edges, before = checkpointed(edges), None
    n = edges.count()  # no step makes more edges than it is given
    hub, parts = 0 if 2 * n <= HUBS else max(HUB, 2 * n // HUBS), n // SHARE + 1
    edges = edges.coalesce(parts)
    for _ in range(rounds):
        edges = checkpointed(_large_star(edges, hub, parts).distinct().coalesce(parts))
        edges = checkpointed(_small_star(edges, hub, parts).distinct().coalesce(parts))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct().coalesce(parts))
