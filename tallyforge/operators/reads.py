"""Reads over the ledger: filtered pages, fingerprints, one-off prices and loans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SORTS = ("date", "amount", "account_ref", "category", "raw_description")
#: Months after which a loan that isn't repaid is given up.
MOST_MONTHS = 720


def ledger_filter(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that meet every wanted thing: account, category, leg, role, direction (in, out), start, end, text, least and most (absolute cents), review.

    ``text`` is looked for in any case of A-Z; ``%`` and ``_`` in it stand for any text and any character.  ``review`` is the table of
    review items: rows that are the subject of any.
    """
    size, upper, lower = F.abs("amount"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.translate("raw_description", upper, lower)
    under = wanted.pop("review", None)
    if under is not None:
        rows = rows.join(under.select(F.col("subject").alias("external_id")), "external_id", "left_semi")
    tests = {
        "account": lambda v: F.col("account_ref") == v,
        "category": lambda v: F.col("category") == v,
        "direction": lambda v: F.col("amount") < 0 if v == "out" else F.col("amount") > 0,
        "start": lambda v: F.col("date") >= F.lit(v).cast("date"),
        "end": lambda v: F.col("date") <= F.lit(v).cast("date"),
        "leg": lambda v: F.col("leg") == v,
        "role": lambda v: F.col("role") == v,
        "text": lambda v: low.like(f"%{v.lower()}%"),
        "least": lambda v: size >= v,
        "most": lambda v: size <= v,
    }
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(tests[name](value))
    return rows


def ledger_page(rows: DataFrame, sort: str = "date", ascending: bool = False, limit: int = 100, offset: int = 0, key: str = "n", **wanted) -> DataFrame:
    """One page of the filtered rows; ties go by the key, ascending.  A page has 1 to 1000 rows."""
    if sort not in SORTS:
        raise ValueError(f"can't sort by {sort}")
    by = F.col(sort).asc() if ascending else F.col(sort).desc()
    return ledger_filter(rows, **wanted).orderBy(by, key).offset(max(0, offset)).limit(min(1000, max(1, limit)))


def scans(rows: DataFrame) -> DataFrame:
    """Count and net of the scans of the current rows: transactions, rows that aren't postings, and synthetic legs."""
    kind = F.when(F.col("synthetic"), "synthetic").when(F.col("role") == "noop", "noops").otherwise("transactions")
    return rows.groupBy(kind.alias("scan")).agg(F.count("*").alias("rows"), F.sum("amount").alias("net"))


def fingerprint(rows: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Count and sum of row hashes by group, which any order and partitioning of the rows leave alike."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    part = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(by).agg(F.count("*").alias("rows"), F.sum(part).cast("string").alias("fingerprint"))


def one_offs(days: DataFrame, factor: float = 2.0, back: float = 0.10) -> DataFrame:
    """Days of (stem, date, amount) whose amount leaves the one before by the factor while the one after comes back to it."""
    order = Window.partitionBy("stem").orderBy("date")
    now, before, after = F.abs("amount"), F.abs(F.lag("amount").over(order)), F.abs(F.lead("amount").over(order))
    leaves = (now >= factor * before) | (now * factor <= before)
    return days.withColumn("_one", (before != 0) & leaves & (F.abs(after - before) <= back * before)).where("_one").drop("_one")


def amortise(loans: DataFrame) -> DataFrame:
    """``loans`` with the months until (loan, offset, rate, payment, extra) is repaid down to its offset, and the interest of that time.

    Interest is monthly, on what exceeds the offset; months is null if payments never exceed it (stalled), and at most ``MOST_MONTHS``.
    """
    rate, monthly = F.col("rate") / 100 / 12, F.col("payment") + F.col("extra")
    none = F.lit(0.0)

    def step(s: Column, _: Column) -> Column:
        interest = (s["left"] - F.col("offset")) * rate
        runs = ~s["stalled"] & (s["left"] > F.col("offset") + 0.01) & (monthly > 0)
        pays = runs & (monthly > interest)
        return F.struct(
            F.when(pays, s["left"] - (monthly - interest)).otherwise(s["left"]).alias("left"),
            F.when(pays, s["paid"] + interest).otherwise(s["paid"]).alias("paid"),
            F.when(pays, s["months"] + 1).otherwise(s["months"]).alias("months"),
            (s["stalled"] | (runs & (monthly <= interest))).alias("stalled"),
        )

    first = F.struct(F.col("loan").cast("double").alias("left"), none.alias("paid"), F.lit(0).alias("months"), F.lit(False).alias("stalled"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_MONTHS)), first, step)
    return loans.withColumn("_end", end).select(*loans.columns, F.when(~F.col("_end.stalled"), F.col("_end.months")).alias("months"), F.col("_end.paid").alias("interest"), F.col("_end.stalled").alias("stalled"))
