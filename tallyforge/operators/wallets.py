"""Counted wallets, differences between two derivations, price steps and merchants that stayed away."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.ledger import categorised, stemmed

_KEY = "account_ref"


def _segments(rows: DataFrame) -> DataFrame:
    """Rows with the number of counts (``snap``) up to them and what they move; a count moves nothing."""
    so_far = Window.partitionBy(_KEY).orderBy("date", "n").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_seg", F.count("snap").over(so_far)).withColumn("_moved", F.when(F.col("snap").isNull(), F.col("amount")).otherwise(F.lit(0)))


def wallet_balance(rows: DataFrame) -> DataFrame:
    """Running balances of (account_ref, date, n, amount, snap): a count sets the balance, rows before the first count it back.

    Accounts never counted begin at zero.
    """
    whole = Window.partitionBy(_KEY).orderBy("date", "n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    part = Window.partitionBy(_KEY, "_seg")
    by_row = part.orderBy("date", "n").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum("_moved").over(by_row)
    after = F.first("snap").over(by_row) + running
    before = F.first("snap", ignorenulls=True).over(whole) - (F.sum("_moved").over(part) - running)
    balance = F.when(F.col("_seg") > 0, after).otherwise(F.coalesce(before, running))
    return _segments(rows).select(_KEY, "n", "date", balance.alias("balance"))


def declared_reconcile(rows: DataFrame) -> DataFrame:
    """Each account's counts, and the sum of what rows between two counts leave unexplained."""
    spans = _segments(rows).where(F.col("_seg") > 0).groupBy(_KEY, "_seg").agg(F.max("snap").alias("_snap"), F.sum("_moved").alias("_sum"))
    after = F.lead("_snap").over(Window.partitionBy(_KEY).orderBy("_seg"))
    return spans.withColumn("_gap", after - F.col("_snap") - F.col("_sum")).groupBy(_KEY).agg(F.count("*").alias("counts"), F.coalesce(F.sum("_gap"), F.lit(0)).alias("gap"))


def reflow_diff(rows: DataFrame, before: list, after: list) -> DataFrame:
    """Rows whose category differs between two rule lists, by pair of categories; one pass, as both see the same rows."""
    both = categorised(categorised(rows, before).withColumnRenamed("category", "before"), after).withColumnRenamed("category", "after")
    return both.where(F.col("before") != F.col("after")).groupBy("before", "after").agg(F.count("*").alias("facts"), F.sum("amount").alias("net"))


def price_steps(rows: DataFrame, least: int = 50, share: float = 0.05) -> DataFrame:
    """Days on which a stem's amount moves by ``least`` or by a ``share`` of the one before."""
    days = stemmed(rows).groupBy("stem", "date").agg(F.sum("amount").alias("amount"))
    moved = days.withColumn("before", F.lag("amount").over(Window.partitionBy("stem").orderBy("date")))
    change = F.abs(F.abs("amount") - F.abs("before"))
    return moved.where((change >= least) | (change >= share * F.abs("before"))).select("stem", "date", "before", "amount")


def recurring_missing(rows: DataFrame, previous: str, cycle: str, least: int = 3) -> DataFrame:
    """Stems of ``least`` months before the cycle that are in the previous month but not in the cycle (yyyy-MM)."""
    months = stemmed(rows.where(F.col("date") < F.add_months(F.lit(f"{cycle}-01").cast("date"), 1))).select("stem", F.date_format("date", "yyyy-MM").alias("_m")).distinct()
    got = months.groupBy("stem").agg(F.count_if(F.col("_m") < cycle).alias("months"), F.bool_or(F.col("_m") == previous).alias("_was"), F.bool_or(F.col("_m") == cycle).alias("_is"))
    return got.where((F.col("months") >= least) & F.col("_was") & ~F.col("_is")).select("stem", "months")


def projection_plan(units: DataFrame, external: DataFrame) -> DataFrame:
    """What brings the external rows (unit_id, hash) up to the units: create, update, unchanged or orphan."""
    joined = units.select("unit_id", F.col("hash").alias("_u")).join(external.select("unit_id", F.col("hash").alias("_e")), "unit_id", "full")
    plan = F.when(F.col("_e").isNull(), "create").when(F.col("_u").isNull(), "orphan").when(F.col("_u") == F.col("_e"), "unchanged").otherwise("update")
    return joined.select("unit_id", plan.alias("plan"))
