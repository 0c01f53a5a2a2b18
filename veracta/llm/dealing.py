"""Pairs within groups of any size, dealt out as pairs of blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def across_blocks(members: DataFrame, rows: DataFrame, join: Callable[[pa.Table], pa.Table], most: int, weight: int) -> DataFrame:
    """Links ``a, b`` among ``members(leader, rep, class, n)`` of each leader that join classes.

    Members of a leader's largest class aren't compared with each other. All others are, and with those, in pairs of
    blocks of some ``most`` members, or of ``weight`` in ``n``; a member stands in as many pairs of blocks as there are
    blocks of others. ``join`` gets the members of one pair of blocks with what ``rows`` has of each: those of ``side``
    0 are for comparison with those of side 1, or with each other where ``own`` is true. It returns links that join
    all classes which any link between them joins.
    """
    parts = members.groupBy("leader", "class").agg(F.count("*").alias("part"), F.sum("n").alias("held"))
    top = parts.groupBy("leader").agg(
        F.max(F.struct("part", "class", "held")).alias("top"), F.count("*").alias("classes"), F.sum("part").alias("part"), F.sum("held").alias("held")
    )

    def blocks(count: Column, held: Column) -> Column:
        return F.greatest(F.ceil(count / F.lit(most)), F.ceil(held / F.lit(weight))).cast("int")

    top = top.where("classes > 1").select(
        "leader",
        F.col("top.class").alias("main"),
        blocks(F.col("part") - F.col("top.part"), F.col("held") - F.col("top.held")).alias("others"),
        blocks(F.col("top.part"), F.col("top.held")).alias("mains"),
    )
    dealt = members.join(top, "leader").withColumn("out", F.col("class") != F.col("main"))
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("out"), F.col("others")).otherwise(F.col("mains"))).cast("int")
    dealt = dealt.withColumn("mine", mine)
    # x: a block of others; y: one of others (kind 0), or of the largest class (kind 1)
    among = "transform(sequence(0, others - 1), k -> struct(0 as kind, least(mine, k) as x, greatest(mine, k) as y, if(mine > k, 1, 0) as side, mine = k as own))"
    across = "transform(sequence(0, mains - 1), k -> struct(1 as kind, mine as x, k as y, 0 as side, false as own))"
    main = "transform(sequence(0, others - 1), k -> struct(1 as kind, k as x, mine as y, 1 as side, false as own))"
    dealt = dealt.withColumn("at", F.expr(f"if(out, concat({among}, {across}), {main})")).select("leader", "rep", "class", "at")
    held = [c for c in rows.columns if c != "rep"]
    dealt = dealt.join(rows, "rep").select("leader", "rep", "class", *held, F.explode("at").alias("at"))
    return dealt.select("leader", "at.*", "rep", "class", *held).groupBy("leader", "kind", "x", "y").applyInArrow(join, "a long, b long")
