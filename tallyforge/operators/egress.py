"""Units for other books: posting rows, what is projected already and what has to change, and the export of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import clean, stem
from tallyforge.session import cut

#: Kinds of posting rows.
OPENING, INCOME, EXPENSE, TRANSFER = 1, 2, 3, 4


def projected(units: DataFrame, rows: DataFrame, transfers: DataFrame) -> DataFrame:
    """Units with the paying and receiving account and the text; of a transfer, the leg below zero pays.  Its day and text are its first leg's."""
    leg = lambda n: rows.select(F.col("external_id").alias(f"{n}_leg"), F.col("account_ref").alias(f"_{n}a"), F.col("amount").alias(f"_{n}m"), F.col("raw_description").alias(f"_{n}t"), F.col("n").alias(f"_{n}n"))
    moves = transfers.select(F.col("transfer_id").alias("unit_id"), "from_leg", "to_leg", "clearing").join(leg("from"), "from_leg", "left").join(leg("to"), "to_leg", "left")
    swap = F.col("clearing").isNull() & (F.col("_fromm") > 0) & (F.col("_tom") < 0)
    a, b = F.coalesce("_froma", "clearing"), F.coalesce("_toa", "clearing")
    moves = moves.select("unit_id", F.when(swap, b).otherwise(a).alias("pays"), F.when(swap, a).otherwise(b).alias("gets"), F.coalesce("_fromt", "_tot").alias("text"), F.greatest("_fromn", "_ton").alias("n"), F.array_join(F.array_sort(F.array("from_leg", "to_leg")), ",").alias("legs"))
    single = rows.select(F.col("external_id").alias("unit_id"), F.col("account_ref").alias("pays"), F.lit(None).cast("string").alias("gets"), F.col("raw_description").alias("text"), "n", F.lit("").alias("legs"))
    named = units.select("unit_id", "kind", "date", "amount", "currency", "category")
    return named.where(F.col("kind") == "TRANSFER").join(moves, "unit_id").unionByName(named.where(F.col("kind") != "TRANSFER").join(single, "unit_id"))


def postings(units: DataFrame, openings: DataFrame, zone: str, first_day: str, most: int = 255) -> DataFrame:
    """Rows to post: openings that aren't zero, then units: transfers, income and expenses; single rows of nothing are left out.

    A row stands at noon of its day in the zone, in seconds and with that day's offset in minutes.
    """
    opened = openings.where(F.col("opening") != 0).select(F.lit(OPENING).alias("type"), F.lit(None).cast("string").alias("category"), F.col("account_ref").alias("account"), F.lit(None).cast("string").alias("to_account"), F.col("opening").alias("amount"), F.lit(first_day).cast("date").alias("date"), F.lit("opening").alias("comment"))
    moves = F.col("kind") == "TRANSFER"
    comment = F.substring(F.concat(stem(F.coalesce("text", F.lit(""))), F.lit(" — "), clean(F.coalesce("text", F.lit("")))), 1, most)
    posted = units.where(moves | (F.col("amount") != 0)).select(F.when(moves, TRANSFER).when(F.col("amount") < 0, EXPENSE).otherwise(INCOME).alias("type"), "category", F.col("pays").alias("account"), F.when(moves, F.col("gets")).alias("to_account"), F.abs("amount").alias("amount"), "date", comment.alias("comment"))
    noon = F.date_add("date", 0).cast("timestamp_ntz") + F.expr("interval 12 hours")
    utc = F.to_utc_timestamp(noon.cast("timestamp"), zone)
    return opened.unionByName(posted).withColumn("at", F.unix_timestamp(utc)).withColumn("offset", ((F.unix_timestamp(noon.cast("timestamp")) - F.unix_timestamp(utc)) / 60).cast("int"))


def movements(units: DataFrame) -> DataFrame:
    """What each account's units move it by: transfers take from the payer and give to the receiver, others are signed."""
    moves = F.col("kind") == "TRANSFER"
    sides = units.select(F.explode(F.array(F.struct(F.col("pays").alias("account_ref"), F.when(moves, -F.abs("amount")).otherwise(F.col("amount")).alias("amount"), "date"), F.struct(F.when(moves, F.col("gets")).alias("account_ref"), F.abs("amount").alias("amount"), "date"))).alias("s")).select("s.*")
    return sides.where(F.col("account_ref").isNotNull())


def verify(units: DataFrame, openings: DataFrame, balances: DataFrame) -> DataFrame:
    """Accounts whose balance elsewhere isn't their opening and all movements, or that are missing there."""
    moved = movements(units).groupBy("account_ref").agg(F.sum("amount").alias("_moved"))
    want = moved.join(openings, "account_ref", "full").select("account_ref", (F.coalesce("opening", F.lit(0)) + F.coalesce("_moved", F.lit(0))).alias("expected"))
    return want.join(balances.select("account_ref", F.col("balance").alias("found")), "account_ref", "left").where(~F.col("expected").eqNullSafe(F.col("found")))


def posting(units: DataFrame) -> DataFrame:
    """Units as postings: withdrawal, deposit or transfer, with source, destination, amount as text, and tags."""
    moves, out = F.col("kind") == "TRANSFER", F.col("amount") < 0
    name = stem(F.col("text"))
    other = F.when(F.trim(name) == "", "(unknown)").otherwise(name)
    cents = F.abs("amount")
    return units.select("unit_id", F.when(moves, "transfer").when(out, "withdrawal").otherwise("deposit").alias("type"), F.when(moves | out, F.col("pays")).otherwise(other).alias("source"), F.when(moves, F.col("gets")).when(out, other).otherwise(F.col("pays")).alias("destination"), F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")).alias("amount"), F.concat(F.lit("category:"), F.col("category")).alias("tag"))


def plan(units: DataFrame, state: DataFrame, groups: DataFrame, resolved: DataFrame) -> DataFrame:
    """What brings the projection up to the units, by unit: create, retag, update, unchanged, rekey, gone, foreign or orphan.

    ``state`` (unit_id, category, hash, group_id) is what was projected, ``groups`` (group_id, ours, legs) what is there, ``resolved``
    (id, current_id) where replaced ids went.  An orphan whose group is gone is dropped; one whose unit has a new name (its id was
    replaced, or its legs make another transfer) is rekeyed if that unit isn't projected yet, unless its group is no longer ours.
    """
    joined = cut(units.select("unit_id", F.col("category").alias("_c"), F.col("hash").alias("_h")).join(state, "unit_id", "full"))
    known = joined.where(F.col("_h").isNotNull())
    here = known.select("unit_id", F.when(F.col("group_id").isNull(), "create").when(F.col("_c") != F.col("category"), "retag").when(F.col("_h") != F.col("hash"), "update").otherwise("unchanged").alias("plan"))
    orphans = joined.where(F.col("_h").isNull()).select("unit_id", "group_id").join(groups, "group_id", "left").join(resolved.select(F.col("id").alias("unit_id"), "current_id"), "unit_id", "left")
    moves = F.col("unit_id").startswith("TRF-")
    # Each leg that was replaced goes by its present id; the set of both names the transfer that they make now.
    legs = orphans.where(moves & (F.coalesce("legs", F.lit("")) != "")).select("unit_id", F.explode(F.split("legs", ",")).alias("id")).join(resolved, "id", "left").groupBy("unit_id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("current_id", "id"))), ",").alias("legs"))
    by_legs = legs.join(units.where(F.col("kind") == "TRANSFER").select(F.col("unit_id").alias("_next"), "legs"), "legs").select("unit_id", F.col("_next").alias("successor"))
    by_id = orphans.where(~moves & (F.col("current_id") != F.col("unit_id"))).join(units.where(F.col("kind") != "TRANSFER").select(F.col("unit_id").alias("current_id")), "current_id", "left_semi").select("unit_id", F.col("current_id").alias("successor"))
    fresh = here.where(F.col("plan") == "create").select(F.col("unit_id").alias("successor"), F.lit(True).alias("_new"))
    after = orphans.join(by_legs.unionByName(by_id), "unit_id", "left").join(fresh, "successor", "left")
    can = F.coalesce("_new", F.lit(False))
    judged = after.select("unit_id", "successor", F.when(F.col("ours").isNull(), "gone").when(can & ~F.col("ours"), "foreign").when(can, "rekey").otherwise("orphan").alias("plan"))
    taken = judged.where(F.col("plan") == "rekey").select(F.col("successor").alias("unit_id"))
    return here.join(taken, "unit_id", "left_anti").unionByName(judged.select("unit_id", "plan"))


def findings(units: DataFrame, state: DataFrame, groups: DataFrame, resolved: DataFrame) -> DataFrame:
    """What is amiss in the projection, as (unit_id, finding): ORPHAN, MISSING, UNTAGGED, TAMPERED, DRIFT, BEHIND, HAND_SPLIT.

    ``groups`` has group_id, external_id, ours, splits, legs, hash (of what is there) and total; ``state`` the hash that was written.
    """
    rows = state.join(units.select("unit_id", "kind", F.col("legs").alias("_legs"), F.col("hash").alias("_now"), F.abs("amount").alias("_total")), "unit_id", "left").join(groups.withColumnRenamed("hash", "_seen"), "group_id", "left")
    legs = rows.where(F.coalesce("legs", F.lit("")) != "").select("unit_id", F.explode(F.split("legs", ",")).alias("id")).join(resolved, "id", "left").groupBy("unit_id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("current_id", "id"))), ",").alias("_then"))
    rows = rows.join(legs, "unit_id", "left")
    there, ours, one = F.col("external_id").isNotNull(), F.coalesce("ours", F.lit(False)), F.col("splits") == 1
    held = F.col("kind").isNotNull() & there & ours
    tests = [
        ("ORPHAN", F.col("kind").isNull()), ("MISSING", F.col("kind").isNotNull() & ~there), ("UNTAGGED", F.col("kind").isNotNull() & there & ~ours),
        ("TAMPERED", held & ((F.col("external_id") != F.col("unit_id")) | ((F.col("kind") == "TRANSFER") & F.col("_then").isNotNull() & (F.col("_then") != F.col("_legs"))))),
        ("DRIFT", held & one & (F.col("_seen") != F.col("hash"))), ("BEHIND", held & one & (F.col("_seen") == F.col("hash")) & (F.col("_now") != F.col("hash"))), ("HAND_SPLIT", held & ~one & (F.col("total") != F.col("_total"))),
    ]
    return rows.select("unit_id", F.explode(F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests]), lambda x: x.isNotNull())).alias("finding"))


def export(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """The twelve columns of an export; ``write`` puts them into files."""
    own = rows.join(F.broadcast(accounts.select(F.col("ref").alias("account_ref"), "currency")), "account_ref", "left")
    col: dict[str, Column] = {"account": F.col("account_ref"), "amount_cents": F.col("amount"), "balance_cents": F.col("balance")}
    return own.select(*[col.get(c, F.col(c)).alias(c) for c in ("n", "date", "account", "currency", "amount_cents", "balance_cents", "category", "origin", "leg", "transfer_id", "external_id", "raw_description")])


def write(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Write an export as csv (with a header), json or parquet, in the order of n: one range sort, no single file."""
    laid = rows.repartitionByRange("n").sortWithinPartitions("n")
    getattr(laid.write.option("header", True) if kind == "csv" else laid.write, kind)(path)
