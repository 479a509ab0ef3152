"""Balance chains: whether an account's rows join up, where they fork, what leaving one out would mend, and where accounts began."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ends(rows: DataFrame) -> DataFrame:
    """Every balance before and after a row, and how many rows begin less how many end with it."""
    before = rows.select("account_ref", (F.col("balance") - F.col("amount")).alias("v"), F.lit(1).alias("s"))
    return before.unionByName(rows.select("account_ref", F.col("balance").alias("v"), F.lit(-1).alias("s"))).groupBy("account_ref", "v").agg(F.sum("s").alias("s"))


def reconcile(rows: DataFrame, accounts: DataFrame, transfers: DataFrame, closed: DataFrame) -> DataFrame:
    """Status, opening, closing, sum and gap of every account with rows, and of clearing accounts.

    A statement account reconciles if one balance begins and one ends its rows; a closed one ends on its closing.  A declared one is measured
    between its counts (rows of amount 0), with the movements of its transfers.  A clearing account opens at its closing and all that left it.
    """
    kinds = F.broadcast(accounts.select(F.col("ref").alias("account_ref"), "source", F.col("closing").alias("_end")))
    posted = rows.where(F.col("role") != "noop").join(kinds, "account_ref")
    real = rows.select("external_id", "date", "n", "amount")
    moved = transfers.where(F.col("clearing").isNotNull()).withColumn("external_id", F.when(F.col("clearing") == F.col("from_leg"), F.col("to_leg")).otherwise(F.col("from_leg"))).join(real, "external_id").select(F.col("clearing").alias("account_ref"), "date", "n", (-F.col("amount")).alias("amount"))
    shut = F.broadcast(closed.where(F.col("reason").isNull()).select("account_ref", F.col("closing").alias("_closing"), "adjustment"))
    statement = posted.where(F.col("source") == "statement")
    up = F.col("s") > 0
    ends = _ends(statement).groupBy("account_ref").agg(F.sum(F.greatest("s", F.lit(0))).alias("_o"), F.sum(F.greatest(-F.col("s"), F.lit(0))).alias("_c"), F.max(F.when(up, F.col("v"))).alias("_open"), F.max(F.when(F.col("s") < 0, F.col("v"))).alias("_close"))
    sums = statement.groupBy("account_ref").agg(F.sum("amount").alias("sum"), F.min_by(F.col("balance") - F.col("amount"), F.struct("date", "n")).alias("_first"))
    one = (F.col("_o") == 1) & (F.col("_c") == 1)
    is_shut = F.col("_closing").isNotNull()
    whole = ends.join(sums, "account_ref").join(shut, "account_ref", "left")
    opening = F.when(is_shut, F.when(F.col("_o") == 1, F.col("_open")).otherwise(F.col("_first"))).when(one, F.col("_open")).otherwise(0)
    closing = F.when(is_shut, F.col("_closing")).when(one, F.col("_close")).otherwise(0)
    out = whole.select("account_ref", F.when(is_shut, "closed").when(one, "reconciled").otherwise("broken").alias("status"), opening.alias("opening"), closing.alias("closing"), (F.col("sum") + F.coalesce("adjustment", F.lit(0))).alias("sum"), F.lit(0).cast("bigint").alias("gap"))
    own = posted.where(F.col("source") == "declared")
    points = own.select("account_ref", "date", "n", F.lit(0).alias("o"), "amount", F.when(F.col("amount") == 0, F.col("balance")).alias("snap"))
    points = points.unionByName(moved.join(kinds.where(F.col("source") == "declared").select("account_ref"), "account_ref", "left_semi").withColumn("o", F.lit(1)).withColumn("snap", F.lit(None).cast("bigint")))
    # A span is the movements up to a count; the last, open one anchors nothing.
    after = Window.partitionBy("account_ref").orderBy("date", "n", "o").rowsBetween(Window.unboundedPreceding, -1)
    spans = points.withColumn("_seg", F.count("snap").over(after)).groupBy("account_ref", "_seg").agg(F.max("snap").alias("snap"), F.sum("amount").alias("moved"))
    order = Window.partitionBy("account_ref").orderBy("_seg")
    spans = spans.where(F.col("snap").isNotNull()).withColumn("_before", F.lag("snap").over(order))
    wallets = spans.groupBy("account_ref").agg(F.min_by(F.col("snap") - F.col("moved"), "_seg").alias("opening"), F.max_by("snap", "_seg").alias("closing"), F.coalesce(F.sum(F.col("snap") - F.col("_before") - F.col("moved")), F.lit(0)).alias("gap"))
    wallets = own.groupBy("account_ref").agg(F.sum("amount").alias("sum")).join(wallets, "account_ref", "left").select("account_ref", F.lit("declared").alias("status"), F.coalesce("opening", F.lit(0)).alias("opening"), F.coalesce("closing", F.lit(0)).alias("closing"), "sum", F.coalesce("gap", F.lit(0)).alias("gap"))
    left = moved.groupBy("account_ref").agg(F.sum("amount").alias("_moved"))
    clearing = accounts.where(F.col("source") == "clearing").select(F.col("ref").alias("account_ref"), F.col("closing").alias("_end")).join(left, "account_ref", "left")
    clearing = clearing.select("account_ref", F.lit("clearing").alias("status"), (F.col("_end") - F.coalesce("_moved", F.lit(0))).alias("opening"), F.col("_end").alias("closing"), F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("gap"))
    return out.unionByName(wallets).unionByName(clearing)


def forks(rows: DataFrame) -> DataFrame:
    """Balances that two rows or more begin (opening) or end (closing) with, and the ids of those rows."""
    both = rows.select("account_ref", F.lit("OPENING").alias("side"), (F.col("balance") - F.col("amount")).alias("value"), "external_id").unionByName(rows.select("account_ref", F.lit("CLOSING").alias("side"), F.col("balance").alias("value"), "external_id"))
    return both.groupBy("account_ref", "side", "value").agg(F.array_sort(F.collect_list("external_id")).alias("ids")).where(F.size("ids") > 1)


def preview(rows: DataFrame) -> DataFrame:
    """For each row of a fork, how many balances would begin and end its account's chain without it.

    Leaving a row out changes two counts only, so each is read off the account's counts; nothing is reconciled anew.
    """
    net = _ends(rows)
    total = net.groupBy("account_ref").agg(F.sum(F.greatest("s", F.lit(0))).alias("_o"), F.sum(F.greatest(-F.col("s"), F.lit(0))).alias("_c"))
    members = forks(rows).select(F.explode("ids").alias("external_id")).distinct()
    some = rows.join(members, "external_id", "left_semi").select("external_id", "account_ref", "amount", (F.col("balance") - F.col("amount")).alias("_v1"), F.col("balance").alias("_v2"))
    got = some.join(net.select("account_ref", F.col("v").alias("_v1"), F.col("s").alias("_s1")), ["account_ref", "_v1"]).join(net.select("account_ref", F.col("v").alias("_v2"), F.col("s").alias("_s2")), ["account_ref", "_v2"]).join(total, "account_ref")
    plus = lambda x: F.greatest(x, F.lit(0))
    s1, s2, still = F.col("_s1"), F.col("_s2"), F.col("amount") == 0
    opens = F.col("_o") + F.when(still, 0).otherwise(plus(s1 - 1) - plus(s1) + plus(s2 + 1) - plus(s2))
    closes = F.col("_c") + F.when(still, 0).otherwise(plus(1 - s1) - plus(-s1) + plus(-s2 - 1) - plus(-s2))
    return got.select("external_id", "account_ref", opens.cast("bigint").alias("openings"), closes.cast("bigint").alias("closings"))


def openings(rows: DataFrame, accounts: DataFrame, transfers: DataFrame, closed: DataFrame) -> DataFrame:
    """Each account's latest balance and its opening, from the last row back and from the first row on, and what the two differ by."""
    kinds = F.broadcast(accounts.select(F.col("ref").alias("account_ref"), "source", F.col("closing").alias("_end")))
    own = rows.join(kinds, "account_ref")
    shut = F.broadcast(closed.where(F.col("reason").isNull()).select("account_ref", F.col("closing").alias("_closing"), "adjustment"))
    order = F.struct("date", "n")
    statement = own.where(F.col("source") == "statement").groupBy("account_ref").agg(F.sum("amount").alias("_s"), F.max_by("balance", order).alias("_last"), F.min_by(F.col("balance") - F.col("amount"), order).alias("forward")).join(shut, "account_ref", "left")
    latest = F.coalesce("_closing", "_last")
    statement = statement.select("account_ref", latest.alias("latest"), (latest - F.col("_s") - F.coalesce("adjustment", F.lit(0))).alias("backward"), "forward")
    line = Window.partitionBy("account_ref").orderBy("date", "n").rowsBetween(Window.unboundedPreceding, 0)
    count = F.col("amount") == 0
    wallet = own.where(F.col("source") == "declared").withColumn("_seen", F.count_if(count).over(line))
    wallet = wallet.groupBy("account_ref").agg(F.sum(F.when(F.col("_seen") == 0, F.col("amount"))).alias("_before"), F.sum(F.when(F.col("_seen") > 0, F.col("amount"))).alias("_after"), F.min_by(F.when(count, F.col("balance")), F.when(count, order)).alias("_first"), F.max_by(F.when(count, F.col("balance")), F.when(count, order)).alias("_last"))
    opening = F.coalesce(F.col("_first") - F.coalesce("_before", F.lit(0)), F.lit(0))
    wallet = wallet.select("account_ref", F.coalesce("_last", F.lit(0)).alias("latest"), opening.alias("backward"), opening.alias("forward"), F.when(F.col("_first").isNotNull(), F.col("_last") - opening - F.coalesce("_after", F.lit(0))).otherwise(0).alias("gap"))
    real = rows.select("external_id", "amount")
    moved = transfers.where(F.col("clearing").isNotNull()).withColumn("external_id", F.when(F.col("clearing") == F.col("from_leg"), F.col("to_leg")).otherwise(F.col("from_leg"))).join(real, "external_id").groupBy(F.col("clearing").alias("account_ref")).agg(F.sum("amount").alias("_real"))
    clearing = accounts.where(F.col("source") == "clearing").select(F.col("ref").alias("account_ref"), F.col("closing").alias("latest")).join(moved, "account_ref", "left")
    start = F.col("latest") + F.coalesce("_real", F.lit(0))
    clearing = clearing.select("account_ref", "latest", start.alias("backward"), start.alias("forward"), F.lit(0).cast("bigint").alias("gap"))
    return statement.withColumn("gap", F.col("backward") - F.col("forward")).unionByName(wallet).unionByName(clearing)
