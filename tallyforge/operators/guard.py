"""Whose statement a file is: the evidence that an account's current facts give, and the verdict on the account chosen for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PAIR = ["file_id", "account_ref"]


def _openings(files: DataFrame) -> DataFrame:
    """A file's opening balance: the one balance before a row that no row ends with; none or several mean no opening."""
    known = files.where(F.col("balance").isNotNull())
    before = known.select("file_id", (F.col("balance") - F.coalesce("amount", F.lit(0))).alias("balance")).distinct()
    free = before.join(known.select("file_id", "balance"), ["file_id", "balance"], "left_anti")
    return free.groupBy("file_id").agg(F.count("*").alias("_n"), F.min("balance").alias("balance")).where((F.col("_n") == 1) & (F.col("balance") != 0)).drop("_n")


def evidence(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Of each file and each account that it meets: rows that agree, whether it opens where the account stood, days that contradict.

    ``files`` has (file_id, date, amount, balance), ``facts`` (account_ref, date, amount, balance).  Zero balances prove nothing.
    All joins have keys: on whole rows, on the day, and on the opening balance.
    """
    keyed = files.withColumn("amount", F.coalesce("amount", F.lit(0)))
    met = keyed.join(facts.select("account_ref", "date", "amount", "balance").distinct(), ["date", "amount", "balance"])
    overlap = met.groupBy(*_PAIR).agg(F.count(F.when(F.col("balance") != 0, 1)).alias("overlap_rows"))
    days = files.select("file_id", "date").distinct().join(facts.select("account_ref", "date").distinct(), "date")
    odd = days.join(met.select(*_PAIR, "date"), [*_PAIR, "date"], "left_anti").groupBy(*_PAIR).agg(F.min("date").alias("contradict_from"), F.max("date").alias("contradict_to"))
    # A fact's day is the account's newest at a file's start if the account's next day is after that start.
    dated = facts.select("account_ref", "date").distinct().withColumn("_next", F.lead("date").over(Window.partitionBy("account_ref").orderBy("date")))
    starts = files.groupBy("file_id").agg(F.min("date").alias("_start")).join(_openings(files), "file_id")
    stood = facts.select("account_ref", "date", "balance").distinct().join(dated, ["account_ref", "date"]).join(starts, "balance")
    stood = stood.where((F.col("date") <= F.col("_start")) & (F.col("_next").isNull() | (F.col("_next") > F.col("_start")))).select(*_PAIR).distinct().withColumn("connects", F.lit(True))
    all_ = overlap.join(odd, _PAIR, "full").join(stood, _PAIR, "full")
    return all_.select(*_PAIR, F.coalesce("overlap_rows", F.lit(0)).alias("overlap_rows"), F.coalesce("connects", F.lit(False)).alias("connects"), "contradict_from", "contradict_to")


def verdicts(files: DataFrame, facts: DataFrame, chosen: DataFrame) -> DataFrame:
    """FITS, ELSEWHERE (one other account fits), NEW (no facts yet), CONTRADICTS or UNPROVEN for each (file_id, chosen).

    Accounts that fit, other than the chosen one, are listed with the verdict UNPROVEN, and named by ELSEWHERE.
    """
    found = evidence(files, facts).join(chosen, "file_id")
    own, fits = F.col("account_ref") == F.col("chosen"), (F.col("overlap_rows") > 0) | F.col("connects")
    by_file = found.groupBy("file_id").agg(
        F.coalesce(F.bool_or(own & fits), F.lit(False)).alias("_own"),
        F.coalesce(F.bool_or(own & F.col("contradict_from").isNotNull()), F.lit(False)).alias("_odd"),
        F.array_sort(F.collect_set(F.when(~own & fits, F.col("account_ref")))).alias("_others"),
    )
    known = facts.select(F.col("account_ref").alias("chosen")).distinct().withColumn("_known", F.lit(True))
    all_ = chosen.join(by_file, "file_id", "left").join(known, "chosen", "left")
    others = F.coalesce("_others", F.array().cast("array<string>"))
    verdict = F.when(F.col("_own"), "FITS").when(F.size(others) == 1, "ELSEWHERE").when(F.col("_known").isNull(), "NEW").when(F.col("_odd"), "CONTRADICTS").otherwise("UNPROVEN")
    listed = F.when(F.col("verdict").isin("ELSEWHERE", "UNPROVEN"), F.array_join(others, ",")).otherwise("")
    return all_.withColumn("verdict", verdict).select("file_id", "chosen", "verdict", listed.alias("others"))
