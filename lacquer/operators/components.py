"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import forget_staged, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node among itself and its neighbours. Edges come with a > b.

    So an edge's larger end goes to the smallest neighbour of its smaller end, or stays there if that end
    has none that is smaller; a root is nobody's larger end and is only looked for.
    """
    least = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    return edges.join(least, edges.b == least.n, "left").select("a", F.coalesce("m", "b").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. Edges come with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the smallest node of its component.

    Every round is staged in the shared folder, and the one before it deleted. The rounds end when two of them give the same edges,
    which is compared by the count and an order-free sum of hashes.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        now, before = stage(_small_star(_large_star(now)).distinct(), "stars"), now
        forget_staged(before)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
