"""Chat formatting by cumulative-snapshot collapse; DataFrame operations only.

Chat logs often hold a conversation once per turn, each snapshot a prefix of the next. Every
conversation gets a rolling hash of each of its prefixes: the exclusive or, turn by turn, of
a 128-bit hash of (position, role, text). A conversation whose whole hash is a proper
prefix's of another is anti-joined away; of equal conversations the one with the least id
stays. What is left is rendered with role marks, in segments of a bounded number of turns.

No conversation has to fit into a task. Turns are range-partitioned by (conversation, turn);
positions and hashes are running sums inside a partition, and what the partitions before
hold of the conversation (one row for each partition it spans) is added. Prefixes are made
distinct, combined before the shuffle, ahead of the anti-join, so a first turn that a third
of all conversations share is one row there. Texts are shuffled once, for rendering.

Inputs: rows that are equal in conv_id, turn, role and text count once. Turns are ordered by
turn (nulls first), then role, then a hash of the text. A null role is rendered as "unknown",
a null text as empty; as parts of a hash null and empty differ. Rows with a null conv_id form
one conversation. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litlode.llm.common import cut

#: Turns of a rendered segment.
SEGMENT_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _hash(seed: int, *columns: Column) -> Column:
    """xxhash64 skips nulls, so each column comes with whether it is null."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (c.isNull(), c)])


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, t1, t2, position, p1, p2): each distinct turn, its hash (t1, t2), its place from 1, and the hash of the prefix that it ends."""
    role, text = F.col("role"), F.col("text")
    turns = conversations.select("conv_id", "turn", "role", _hash(1, role, text).alias("t1"), _hash(2, text, role).alias("t2")).distinct()
    order = ["turn", "role", "t1", "t2"]
    dealt = cut(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", "conv_id").orderBy(*order)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("conv_id", "part").count().withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "before")
    placed = dealt.join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    placed = placed.withColumn("position", F.row_number().over(inside) + F.col("before"))
    placed = cut(placed.select("conv_id", *order, "part", "position", F.xxhash64(F.lit(3), "position", "t1", "t2").alias("h1"), F.xxhash64(F.lit(4), "position", "t2", "t1").alias("h2")))
    whole = placed.groupBy("conv_id", "part").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    carried = whole.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), *[F.coalesce(F.bit_xor(f"x{k}").over(earlier), F.lit(0)).alias(f"c{k}") for k in (1, 2)])
    joined = placed.join(carried, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return joined.select("conv_id", *order, "position", *[F.bit_xor(f"h{k}").over(inside).bitwiseXOR(F.col(f"c{k}")).alias(f"p{k}") for k in (1, 2)])


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are a proper prefix of no other."""
    ends = prefixes.groupBy("conv_id").agg(F.max("position").alias("n_turns"), F.max_by(F.struct("p1", "p2"), "position").alias("h"))
    whole = ends.select("conv_id", "n_turns", F.col("h.p1").alias("p1"), F.col("h.p2").alias("p2"))
    alike = whole.groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    longer = prefixes.join(ends.select(F.col("conv_id").alias("c"), "n_turns"), F.col("conv_id").eqNullSafe(F.col("c"))).filter("position < n_turns")
    proper = longer.select(F.col("position").alias("n_turns"), "p1", "p2").distinct()
    return alike.join(proper, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns", "n_copies")


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """(conv_id, segment, n_turns, n_copies, text): the maximal conversations, rendered in segments."""
    prefixes = cut(turn_prefixes(conversations))
    kept = cut(maximal(prefixes))
    places = prefixes.join(kept.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "t1", "t2", "position", "n_turns", "n_copies")
    role, text = F.col("role"), F.col("text")
    lines = conversations.select("conv_id", "turn", "role", "text", _hash(1, role, text).alias("k1"), _hash(2, text, role).alias("k2"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))
    line = F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))
    rows = lines.join(places, same).select("conv_id", F.floor((F.col("position") - 1) / SEGMENT_TURNS).alias("segment"), "n_turns", "n_copies", F.struct(F.col("position").alias("at"), line.alias("line")).alias("turn"))
    told = rows.groupBy("conv_id", "segment", "n_turns", "n_copies").agg(F.array_sort(F.collect_set("turn")).alias("turns"))
    return told.select("conv_id", F.col("segment").cast("long").alias("segment"), F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join("turns.line", "").alias("text"))
