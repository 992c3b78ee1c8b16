"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.workspace import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node.

    ``component`` is the smallest node reachable. Null ends and self loops are
    ignored. No neighbour list is ever collected: each star step is an
    aggregate joined back, so a hub with any number of neighbours is spread
    over tasks by the skew-join rule. Rounds grow with the logarithm of the
    longest path; every round is written to the shared folder. A graph that
    has not converged after ``max_rounds`` raises instead of returning labels
    that are not final.
    """
    now = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where("u != v")
        .distinct()
    )
    now = materialize(now, "cc")
    # A star forest (every u once, no centre that is itself a u) is the fixed point.
    print_of = None
    for _ in range(max_rounds):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == print_of or not seen[0]:
            break
        print_of = seen
        step = _large_star(now).distinct()
        now = materialize(_small_star(step).distinct(), "cc")
    else:
        raise RuntimeError("connected_components did not converge")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
