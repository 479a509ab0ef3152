"""Decisions: which of them hold, and the ends of chains of replaced ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import cut


def chain_resolve(edges: DataFrame) -> DataFrame:
    """The end of each id's chain of (from_id, to_id) edges and the edges to it, by pointer jumping.

    Ids on cycles, and those that lead to one only, have neither.  After a round each open pointer has made twice the
    steps; a longer chain holds one that ends in this round, so once a round ends none, what is open is on cycles.
    """
    ids = edges.select(F.col("from_id").alias("at")).distinct().withColumn("_on", F.lit(True))
    step = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("at"), F.lit(1).cast("long").alias("hops"))
    now = cut(step.join(ids, "at", "left").select("id", "at", "hops", F.coalesce("_on", F.lit(False)).alias("open")))
    fresh = True
    while fresh:
        ahead = now.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("open").alias("_open"))
        moved = now.where("open").join(ahead, now["at"] == ahead["_id"]).select("id", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_open").alias("open"))
        fresh = bool((moved := cut(moved)).where(~F.col("open")).limit(1).count())
        now = cut(now.where(~F.col("open")).unionByName(moved).groupBy("id", "at", "open").agg(F.max("hops").alias("hops")))
    ended = ~F.col("open")
    return now.groupBy("id").agg(F.max(F.when(ended, F.col("at"))).alias("resolved"), F.max(F.when(ended, F.col("hops"))).cast("int").alias("hops"))


def effective(decisions: DataFrame) -> DataFrame:
    """Decisions that hold, of (n, action, target): a decision falls if an odd number of its revokes hold themselves.

    A revoke acts on an earlier decision only; one that names a missing decision is left out.  So revokes make trees, and a
    decision holds if it and all revokes below it, at whatever depth, are odd in number: counted by pointer jumping.
    """
    known = decisions.select(F.col("n").alias("target")).distinct().withColumn("_known", F.lit(True))
    judged = decisions.join(known, "target", "left").select(*decisions.columns, ((F.col("action") == "REVOKE") & F.col("_known").isNull()).alias("_missing"))
    up = F.when((F.col("action") == "REVOKE") & ~F.col("_missing") & (F.col("target") < F.col("n")), F.col("target"))
    trees = cut(judged.select("n", up.alias("up"), F.lit(1).cast("long").alias("odd")))
    while trees.where(F.col("up").isNotNull()).limit(1).count():
        below = trees.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("n")).agg(F.sum("odd").alias("_below"))
        above = trees.select(F.col("n").alias("up"), F.col("up").alias("_up"))
        trees = cut(trees.join(below, "n", "left").join(above, "up", "left").select("n", F.col("_up").alias("up"), ((F.col("odd") + F.coalesce("_below", F.lit(0))) % 2).alias("odd")))
    return judged.where(~F.col("_missing")).drop("_missing").join(trees.where(F.col("odd") == 1), "n", "left_semi")
