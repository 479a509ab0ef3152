"""Mixing sources to target weights by a low-discrepancy schedule of blocks that are equal within a source.

Each source's documents are shuffled (by a hash of id and source) into one stream of words, and the stream is cut into
blocks of a size that its own target sets, so that small sources have many blocks too.  A schedule of slots is laid over the
whole mix, as many as all sources need blocks: slot i takes the point frac(i * golden ratio), in 32-bit integer steps, and the
source in whose part of the cumulative needs the point falls.  A slot's rank among its source's slots names the block that
fills it, round and round the source's stream, at most ``max_epochs`` times.  So any stretch of the schedule has nearly the
target shares.  Slots that a source doesn't need are left out, the few that it misses follow after the last slot, and its last
block is cut where its target is reached: the words taken of a source are its target, rounded.

Targets: sources in order of code points (null last) have weights 1, 2, 3, repeating; together they get all
words; a source stops at ``max_epochs`` times its own size, and the excess is shared again by weight.

A hot source is never one task's work: streams are offset by two-level prefix sums (hash buckets within sources) and slots are
ranked by counts of fixed ranges of slots.  The table of sources is stored, numbered in its order and given its targets by
distributed sums, whatever its length; only one row of sums for each round of sharing and one for each of its partitions come to the
driver.  It is broadcast while it has at most ``BROADCAST_SOURCES`` rows; beyond, the joins with it shuffle.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own; repeated
rows are separate documents; an empty table gives no rows; a rerun gives the same result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm.common import annotate, cut

#: Sources of a table that may be broadcast.
BROADCAST_SOURCES = 100_000
MAX_EPOCHS = 3
#: A block has at most so many words, and a source so many blocks if its target has as many words.
BLOCK_WORDS, SLOTS = 8192, 1000
#: Rows in a bucket of the two-level prefix sums, and slots in a range.
BUCKET_ROWS, RANGE_SLOTS = 20_000, 100_000
#: 2**32 divided by the golden ratio, made odd.
STEP = 2654435769


def sizes(column: pa.Array) -> list[pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    out = [np.diff(K.runs(K.SOLID[data], offsets)[2]) for _, _, data, offsets in K.chunks(column)]
    return [pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())]


def targets(source_sizes: dict[str | None, int], max_epochs: int = MAX_EPOCHS) -> dict[str | None, float]:
    """Words that the mix should take of each source."""
    names = sorted((s for s in source_sizes if s is not None)) + [None] * (None in source_sizes)
    weight = {s: 1.0 + i % 3 for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(source_sizes.values())), list(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > max_epochs * source_sizes[s]]
        if not full:
            return out | {s: share * weight[s] for s in open_}
        for s in full:
            out[s] = float(max_epochs * source_sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _ordered(sources: DataFrame, value: str) -> tuple[DataFrame, int]:
    """The stored table (part, i) with ``before``, the sum of ``value`` in all rows before, and the whole sum; one number a partition comes to the driver."""
    sums, total, bases = {r["part"]: r["n"] for r in sources.groupBy("part").agg(F.sum(value).alias("n")).collect()}, 0, []
    for part in sorted(sums):
        bases.append((part, total))
        total += sums[part]
    held = sources.sparkSession.createDataFrame(bases, "part int, _base bigint")
    inside = Window.partitionBy("part").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each partition of the sources, so it is small.
    return sources.join(F.broadcast(held), "part").withColumn("before", F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_base"), total


def _plan(sized: DataFrame, max_epochs: int) -> tuple[DataFrame, int]:
    """The sources with their targets, parts of the point range, words in a block, blocks, slots and words of the last epoch; slots.

    ``targets`` says the same of a table in memory: a source is full if the share of one unit of weight would give it more than its
    stop, and shares only grow, so each round sums what full sources take and what weight is left, until no more are full.
    """
    totals = sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.lit(1).cast("long").alias("one"))
    # Numbered in order: by partition of the sort, and by place inside.
    placed = totals.orderBy(F.asc_nulls_last("_source")).withColumn("_id", F.monotonically_increasing_id())
    sources = cut(placed.select("_source", "source_size", "one", F.shiftright("_id", 33).cast("int").alias("part"), "_id").withColumn("i", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"))
    sources, n = _ordered(sources, "one")
    sources = cut(sources.withColumn("weight", 1 + F.col("before") % 3).drop("before", "one"))
    stop = max_epochs * F.col("source_size")
    whole = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    left, share = float(whole), None
    while n:
        open_ = F.lit(True) if share is None else ~(F.lit(share) * F.col("weight") > stop)
        got = sources.agg(F.coalesce(F.sum(F.when(open_, F.col("weight"))), F.lit(0)).alias("weight"), F.coalesce(F.sum(F.when(~open_, stop)), F.lit(0)).alias("full")).first()
        new = (left - got["full"]) / got["weight"] if got["weight"] else math.inf
        if new == share or not got["weight"]:
            share = new
            break
        share = new
    want = F.when(F.lit(share or 0.0) * F.col("weight") > stop, stop.cast("double")).otherwise(F.lit(share or 0.0) * F.col("weight"))
    sources = sources.withColumn("target", want)
    take = F.least(F.round("target").cast("long"), stop)
    sources = sources.withColumn("_take", take).withColumn("words", F.greatest(F.lit(1).cast("long"), F.least(F.lit(BLOCK_WORDS).cast("long"), F.floor(F.col("_take") / SLOTS))))
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.col("words"))).withColumn("rest", F.col("_take") % F.greatest(F.lit(1).cast("long"), F.col("source_size")))
    epochs = F.floor(F.col("_take") / F.greatest(F.lit(1).cast("long"), F.col("source_size")))
    sources = cut(sources.withColumn("need", epochs * F.col("blocks") + F.ceil(F.col("rest") / F.col("words"))))
    sources, slots = _ordered(sources, "need")
    # Parts of the point range in whole numbers: decimals hold 2**32 times any count of slots.
    point = lambda at: F.floor((at.cast("decimal(38,0)") * F.lit(2**32).cast("decimal(12,0)")) / F.lit(max(1, slots)).cast("decimal(20,0)")).cast("long")
    return cut(sources.select("_source", "source_size", "target", point(F.col("before")).alias("low"), point(F.col("before") + F.col("need")).alias("high"), "words", "blocks", "need", F.col("before").alias("first"), "rest")), slots


def _small(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def _streams(sized: DataFrame, order: list[Column], buckets: int) -> DataFrame:
    """Each document's first word's place in its source's shuffled stream."""
    dealt = sized.withColumn("_mix", F.xxhash64(*order, F.lit("mix"))).withColumn("_bucket", F.shiftrightunsigned("_mix", 1) % buckets)
    totals = dealt.groupBy("_source", "_bucket").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "_base")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_mix", *order, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(totals, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("_at", F.col("_base") + F.col("_in")).drop("_s", "_b", "_base", "_in", "_mix", "_bucket")


def schedule(spark: SparkSession, sources: DataFrame, slots: int) -> DataFrame:
    """The mix: slot, source, the block and epoch that fill it, and the place in the stream where a source's last block is cut."""
    point = (F.col("id") % 2**31 * F.lit(STEP)) % 2**32
    tasks = max(1, math.ceil(slots / RANGE_SLOTS))
    drawn = spark.range(0, slots, 1, tasks).select("id", point.alias("point"), F.floor(F.col("id") / RANGE_SLOTS).alias("part"))
    # One equality (a band of points, of which there are as many as sources) turns the range condition into a hash join.
    bits = max(10, min(31, sources.count().bit_length()))
    low, high = F.shiftright("low", 32 - bits), F.shiftright(F.col("high") - 1, 32 - bits)
    parts = sources.where((F.col("source_size") > 0) & (F.col("high") > F.col("low"))).withColumn("band", F.explode(F.sequence(low, F.least(high, F.lit(2**bits - 1).cast("long")))))
    # A source has a part for each band that it reaches into: at most as many as there are bands and sources.
    parts = F.broadcast(parts) if sources.count() <= BROADCAST_SOURCES else parts
    drawn = drawn.withColumn("band", F.shiftright("point", 32 - bits)).join(parts, "band").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    counts = drawn.groupBy("_source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_source").alias("_s"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"), "n")
    ranked = drawn.withColumn("_in", F.row_number().over(Window.partitionBy("_source", "part").orderBy("id")) - 1)
    ranked = ranked.join(counts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
    held = ["_source", "rank", "blocks", "need", "rest"]
    ranked = ranked.withColumn("rank", F.col("_base") + F.col("_in")).where(F.col("rank") < F.col("need")).select(F.col("id").alias("slot"), *held)
    # The schedule's counts are off by a few slots a source; what is missing comes after its end.
    drawn_n = counts.groupBy("_s").agg(F.sum("n").alias("_have"))
    short = sources.join(drawn_n, F.col("_source").eqNullSafe(F.col("_s")), "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    short = short.where(F.col("_have") < F.col("need")).withColumn("rank", F.explode(F.sequence("_have", F.col("need") - 1)))
    ranked = ranked.unionByName(short.select((slots + F.col("first") + F.col("rank")).alias("slot"), *held))
    until = F.when((F.col("rank") == F.col("need") - 1) & (F.col("rest") > 0), F.col("rest"))
    return ranked.select("slot", "_source", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), until.alias("until"))


def pieces(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document's parts by block of its source's stream; a document without words has one part without a block."""
    words = _small(sources.select(F.col("_source").alias("_s"), F.col("words").alias("_w")))
    placed = placed.join(words, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    first, last = F.floor(F.col("_at") / F.col("_w")), F.floor((F.col("_at") + F.col("size") - 1) / F.col("_w"))
    out = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    start, stop = F.greatest(F.lit(0), F.col("block") * F.col("_w") - F.col("_at")), F.least(F.col("size"), (F.col("block") + 1) * F.col("_w") - F.col("_at"))
    return out.withColumn("start", start).withColumn("stop", stop).drop("_w")


def _prepare(docs: DataFrame, keep: list[str], text: str, source: str) -> DataFrame:
    named = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(source).cast("string").alias("_source"), F.col(text).alias("_t"))
    return annotate(named, sizes, "size bigint", [*keep, "_source"], "_t")


def mix(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source", max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """The mix as (slots, taken).

    ``slots``: slot, epoch, source, document id and the words start..stop of it that stand there, in slot order by place.
    ``taken``: every document with size, source_size, target, the words that the mix takes of it, repeats counted, and the
    slot of the mix where it stands first (null if it takes none).  ``write_mix`` lays the slots out in order.
    """
    spark, keep = docs.sparkSession, list(dict.fromkeys([id_col, *(keep or [])]))
    keep = [c for c in keep if c not in ("size", "source_size", "target", "taken", "mix_source", "first_slot")]
    # Texts are read and their words counted once; from here on only sizes move.
    sized = cut(_prepare(docs, keep, text, source))
    sources, slots = _plan(sized, max_epochs)
    buckets = max(1, math.ceil(sized.count() / BUCKET_ROWS))
    placed = _streams(sized, [F.col(id_col), F.col("_source")], buckets)
    plan, parts = schedule(spark, sources, slots), pieces(placed, sources)
    filled = parts.where(F.col("block").isNotNull()).join(plan, (parts["block"] == plan["block"]) & parts["_source"].eqNullSafe(plan["_source"]))
    filled = filled.withColumn("stop", F.least("stop", F.col("until") - F.col("_at"))).where(F.col("start") < F.col("stop"))
    filled = filled.select("slot", "epoch", parts["_source"].alias("source"), id_col, "start", "stop", F.col("_at").alias("stream_at"))
    uses = plan.groupBy("_source", "block").agg(F.count("*").alias("_uses"), F.max("until").alias("_until"), F.min("slot").alias("_slot")).select(F.col("_source").alias("_s"), F.col("block").alias("_b"), "_uses", "_until", "_slot")
    used = parts.join(uses, parts["_source"].eqNullSafe(F.col("_s")) & (parts["block"] == F.col("_b")), "left")
    # Of a source's last block, one use may be cut.
    cut_off = F.least(F.col("stop") - F.col("start"), F.greatest(F.lit(0), F.col("_at") + F.col("stop") - F.col("_until")))
    words = (F.col("stop") - F.col("start")) * F.col("_uses") - F.when(F.col("_until").isNull(), 0).otherwise(cut_off)
    taken = used.groupBy(*keep, "_source", "size", "_at").agg(F.sum(F.coalesce(words, F.lit(0))).cast("long").alias("taken"), F.min(F.when(words > 0, F.col("_slot"))).alias("first_slot"), F.sum(F.when(F.col("size") == 0, 1).otherwise(0)).alias("_empty"))
    # Documents without words share a place in the stream, so equal ones were grouped; they come back one by one.
    taken = taken.withColumn("_again", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1).cast("long"), F.col("_empty")))))
    shares = _small(sources.select(F.col("_source").alias("_s"), "source_size", "target"))
    taken = taken.join(shares, F.col("_source").eqNullSafe(F.col("_s")), "left")
    return filled, taken.select(*keep, "size", "source_size", "target", "taken", F.col("_source").alias("mix_source"), "first_slot")


def write_mix(slots: DataFrame, docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> None:
    """Write the mix as Parquet in slot order: slot, epoch, source, document id and the words that stand there, joined by spaces.

    ``id_col`` has to name each document apart.  Only the documents that the mix takes are joined; the order is one range sort.
    """
    words = F.split(F.regexp_replace(F.col("_text"), "^[\\x20\\x09-\\x0D]+", ""), "[\\x20\\x09-\\x0D]+")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    filled = slots.withColumnRenamed(id_col, "_id").join(texts, "_id").withColumn("words", F.concat_ws(" ", F.slice(words, F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))))
    laid = filled.select("slot", "epoch", "source", F.col("_id").alias(id_col), "start", "stop", "stream_at", "words")
    laid.repartitionByRange("slot").sortWithinPartitions("slot", "stream_at").write.parquet(path)
