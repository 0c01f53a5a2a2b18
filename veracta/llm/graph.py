"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, materialise


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of itself and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """``node, class`` for every end of the edges ``a, b``; ``class`` is the least node that it is connected to.

    It ends when a round changes nothing. Each round's edges are written, and no
    more than the edges' number ever stand; nothing is collected but a checksum.
    """
    edges = edges.select("a", "b").where("a != b")
    before = None  # nothing is forgotten that this function didn't write
    for _ in range(most):
        past, edges = edges, materialise(_small(_large(edges)), "stars")
        if before is not None:
            forget(past)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("class"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct())
