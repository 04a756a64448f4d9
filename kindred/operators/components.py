"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations and joins over the edges alone; nothing is gathered on the driver but a count
and a checksum. A vertex with very many edges is pre-aggregated for its minimum and its edges are joined, so
that adaptive execution can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred.session import cut, release


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: (u, v), each vertex u with its neighbours v. Large: neighbours above u move to the least one; small: u and the lower ones do."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = pairs.join(least, "u")
    if large:
        moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u <> v").distinct()
    own = least.select("u", F.col("m").alias("v"))
    moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(own).where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every vertex of an undirected edge table; root is the least vertex of its component. Vertices without edges do not appear."""
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide, last = _star(both, True), now
        now = cut(_star(wide, False))
        release(last)
        was, mark = mark, _mark(now)
        if was == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
