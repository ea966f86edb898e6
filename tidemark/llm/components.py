"""Connected components over an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

#: Edges in a partition between two rounds, and the least number of partitions: many nearly empty ones cost files and tasks.
PART_ROWS, PARTS = 100_000, 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (u, v) with u > v.

    Large: all larger neighbours of a node are linked to its smallest
    neighbour. Small: a node and its smaller neighbours are linked to the
    smallest of them. Connectivity stays, the graph gets flatter.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # As many rows as edges; repeated ones go in the small step that follows.
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes; every
    step is cut by a checkpoint. Hubs are aggregated before they are joined.
    """
    flat = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = _print(flat)
    for _ in range(rounds):
        flat = cut(_star(_star(flat, True), False).coalesce(max(PARTS, before[0] // PART_ROWS)))
        now = _print(flat)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    # Every node now hangs directly on the smallest of its component.
    return flat.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(flat.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def roots(parents: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for parents (a, b), where every a stands once and b < a: the end of the path from a.

    Each step replaces all parents by their parents, so a path of n steps
    takes log2(n) of them; what has no parent is its own root and gets no row.
    """
    at = cut(parents.select("a", "b"))
    for _ in range(rounds):
        up = at.select(F.col("a").alias("p"), F.col("b").alias("g"))
        at = cut(at.join(up, F.col("b") == F.col("p"), "left").select("a", F.coalesce("g", "b").alias("b"), F.col("g").isNotNull().alias("moved")))
        if not at.agg(F.max("moved")).first()[0]:
            return at.select(F.col("a").alias("node"), F.col("b").alias("component"))
        at = at.select("a", "b")
    raise RuntimeError("paths did not end")
