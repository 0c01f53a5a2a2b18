"""Mixing sources to target weights, in DataFrame operations only.

Texts of a source stand end to end, in an order dealt by hash; that stream is
cut into blocks of a fixed number of words. Each output shard draws how many of
its slots each source gets, from a multinomial with the targets' shares: every
slot falls on the line of all shares by hash, and is counted. So a source's
taken words are near its target within the draw's own spread, some
sqrt(slots of the source) blocks. A source's slots are numbered through all
shards and mapped to its blocks by a pseudorandom permutation of the blocks'
indices, a new one each time round; slots and blocks are then joined by that
index. No source goes round more than ``most`` times.

Size is the number of words; a null text has 0 words. Sources weigh by rank,
null last. Targets share the total size by weight; no target is above ``most``
times its source's size, and the excess goes to the others by weight. Repeated
rows are separate documents, told apart by their place in the stream. A source
or table without words takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import forget, materialise

WEIGHTS, BLOCK, MOST, SHARD_SLOTS, MOST_SHARDS, LANES, CELLS = (5, 2, 1), 32, 3, 256, 4096, 1024, 1024
#: Primes above a number of blocks have no factor in common with it, so that steps of one visit every block once. Fixed values.
NEAR = (2_147_483_647, 2_147_483_629, 2_147_483_587, 2_147_483_579, 2_147_483_563, 2_147_483_549, 2_147_483_543, 2_147_483_497)
FAR = (1 << 61) - 1
_WORDS = r"[^\x20\x09-\x0D]+"


def _unit(*what) -> Column:
    """A number in [0, 1) by hash of ``what``."""
    return F.shiftrightunsigned(F.xxhash64(*what), 11) / F.lit(float(1 << 53))


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, lane, tie``: a document's words, and where in its source's stream it goes."""
    size = F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("long")
    tie = F.xxhash64("doc_id", "text")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.pmod(tie, F.lit(LANES)).alias("lane"), tie.alias("tie"))


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, weight, target``: one row for each source; the table is as small as there are sources."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int")))
    # sources in the order in which they fill up as all targets rise together
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.lit(most) * F.coalesce(F.sum("source_size").over(upto), F.lit(0))
    free = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    by = by.withColumn("level", left / free).withColumn("open", F.lit(most) * F.col("source_size") >= F.col("level") * F.col("weight"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("level").alias("level")))).over(whole)["level"]
    by = by.withColumn("common", level)
    target = F.least(F.coalesce(F.col("common") * F.col("weight"), F.lit(0.0)), (F.lit(most) * F.col("source_size")).cast("double"))
    return by.select("source", "source_size", "weight", target.alias("target"))


def counts(plan: DataFrame, total: float, seed: int) -> DataFrame:
    """``shard, k, n``: each shard's multinomial draw over ``plan(k, want, upto)``, whose stretches end at ``upto``.

    A slot's place on the line is found by a join on one of ``CELLS`` equal parts of it.
    """
    n = round(total)
    shards = min(MOST_SHARDS, max(1, -(-n // SHARD_SLOTS)))
    first = (F.col("upto") - F.col("want")) / F.lit(total or 1.0)
    line = plan.withColumn("a", first).withColumn("b", F.lead("a", 1, 2.0).over(Window.orderBy("k")))
    cell = F.sequence(F.floor(F.col("a") * CELLS).cast("int"), F.least(F.floor(F.col("b") * CELLS), F.lit(CELLS - 1)).cast("int"))
    line = line.where(F.col("a") < 1).select("k", "a", "b", F.explode(cell).alias("cell"))
    spark = plan.sparkSession
    point = spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, n >> 21)).select((F.col("id") % shards).alias("shard"), _unit(F.lit(seed), F.lit("draw"), "id").alias("at"))
    point = point.withColumn("cell", F.floor(F.col("at") * CELLS).cast("int"))
    return point.join(line, "cell").where("at >= a and at < b").groupBy("shard", "k").agg(F.count("*").alias("n"))


def slots(goal: DataFrame, seed: int, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """``source, index, uses``: how often each block is drawn."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    plan = goal.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    # the last block is short, so a source's slots count by its blocks' mean length
    plan = plan.withColumn("want", F.col("target") * F.col("blocks") / F.col("source_size"))
    plan = plan.withColumn("k", F.row_number().over(order)).withColumn("upto", F.sum("want").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = plan.agg(F.sum("want")).first()[0] or 0.0
    drawn = counts(plan.select("k", "want", "upto"), total, seed)
    shard = drawn.join(plan.select("k", "source", "blocks"), "k")
    past = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shard = shard.withColumn("first", F.coalesce(F.sum("n").over(past), F.lit(0)))
    # a source's slots, dealt out by number so that a large source isn't one task's work
    chunk = 1 << 16
    each = shard.where("n > 0").select("source", "blocks", F.explode(F.expr(f"transform(sequence(0L, (n - 1) div {chunk}), x -> struct(first + x * {chunk} as a, least(first + n, first + (x + 1) * {chunk}) - 1 as b))")).alias("r"))
    each = each.repartition("source", "r").select("source", "blocks", F.explode(F.sequence("r.a", "r.b")).alias("slot"))
    each = each.where(F.col("slot") < F.lit(most) * F.col("blocks"))
    turn, place, n = F.expr("slot div blocks"), F.col("slot") % F.col("blocks"), F.col("blocks")
    draw = F.xxhash64(F.lit(seed), "source", turn)
    shift = F.pmod(draw, n)
    prime = F.element_at(F.array(*(F.lit(p) for p in NEAR)), (F.pmod(F.xxhash64(draw), F.lit(len(NEAR))) + 1).cast("int")).cast("long")
    near = (place * (prime % n) + shift) % n  # fits a long while there are fewer blocks than the least prime
    wide = lambda c: c.cast("decimal(19,0)")
    far = ((wide(place) * wide(F.lit(FAR) % n) + wide(shift)) % wide(n)).cast("long")
    index = F.when(n < min(NEAR), near).otherwise(far)
    return each.select("source", index.alias("index")).groupBy("source", "index").agg(F.count("*").alias("uses"))


def mixed(docs: DataFrame, weights=WEIGHTS, seed: int = 20_24, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``source, tie`` for each row of ``docs``."""
    sized = materialise(sizes(docs), "sizes")
    goal = materialise(targets(sized, weights, most), "targets")
    uses = materialise(slots(goal, seed, block, most), "uses")
    # where each document begins: within its lane, and where its lane begins
    lane = Window.partitionBy("source", "lane").orderBy("tie", "doc_id", "size")
    placed = sized.withColumn("place", F.row_number().over(lane)).withColumn("before", F.coalesce(F.sum("size").over(lane.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lanes = sized.groupBy("source", "lane").agg(F.sum("size").alias("n"))
    lanes = lanes.select(F.col("source").alias("s2"), F.col("lane").alias("l2"), F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = placed.join(lanes, F.col("source").eqNullSafe(F.col("s2")) & (F.col("lane") == F.col("l2"))).withColumn("begin", F.col("base") + F.col("before"))
    placed = materialise(placed.select("doc_id", "source", "size", "lane", "tie", "place", "begin"), "streams")
    # a document's share of each block that it reaches into
    reach = placed.where("size > 0").select("source", "lane", "place", "begin", "size", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")).alias("index"))
    part = F.least(F.col("begin") + F.col("size"), (F.col("index") + 1) * block) - F.greatest(F.col("begin"), F.col("index") * block)
    reach = reach.select("source", "lane", "place", "index", part.alias("part"))
    uses = uses.select(F.col("source").alias("s2"), F.col("index").alias("i2"), "uses")
    took = reach.join(uses, F.col("source").eqNullSafe(F.col("s2")) & (F.col("index") == F.col("i2"))).groupBy("source", "lane", "place").agg(F.sum(F.col("part") * F.col("uses")).alias("taken"))
    took = materialise(took, "took").select(F.col("source").alias("s2"), F.col("lane").alias("l2"), F.col("place").alias("p2"), "taken")
    forget(uses)
    same = F.col("source").eqNullSafe(F.col("s2")) & (F.col("lane") == F.col("l2")) & (F.col("place") == F.col("p2"))
    goal = goal.select(F.col("source").alias("s3"), "source_size", "target")
    out = placed.join(took, same, "left").join(goal, F.col("source").eqNullSafe(F.col("s3")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "tie")


def resampled(docs: DataFrame, seed: int = 20_24, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: whole copies, and one more by a draw on what remains."""
    took = mixed(docs, seed=seed, **options).where("size > 0").groupBy("doc_id", "tie").agg((F.sum("taken") / F.sum("size")).alias("_times"))
    took = took.withColumnRenamed("doc_id", "_id")
    rows = docs.withColumn("_tie", F.xxhash64("doc_id", "text"))
    times = (F.floor("_times") + F.when(_unit(F.lit(seed), F.lit("keep"), "_tie") < F.col("_times") - F.floor("_times"), 1).otherwise(0)).cast("int")
    copies = rows.join(took, (F.col("_tie") == F.col("tie")) & F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("_n", times).where("_n > 0")
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)
