"""Relational operators over facts: rules, totals, reconciliation, anomalies, recurring series, pending settlement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import clean, stem

#: (category, condition tree), tried in order; the first that holds gives the category.
RULES = [
    ("groceries", {"all": [{"match": "merchant 1[0-9] "}, {"direction": "out"}]}),
    ("salary", {"all": [{"match": "urgent"}, {"direction": "in"}, {"amountRange": [10000, 40000]}]}),
    ("transport", {"any": [{"match": "merchant [2-3] "}, {"match": "merchant 2[0-4] "}]}),
    ("small", {"all": [{"amountRange": [0, 5000]}, {"not": {"match": "high"}}]}),
    ("savings", {"accounts": ["acct-3", "acct-6", "acct-9"]}),
]


#: Names that derivation gives, which no rule may.
RESERVED = ("TRANSFER", "UNCATEGORIZED")


def checked(categories: list[str], rules: list[tuple[str, dict]]) -> list[tuple[str, dict]]:
    """The rules, if categories are declared once each and none is reserved, and every rule names one of them and has a condition."""
    for i, name in enumerate(categories):
        if not name or not name.strip():
            raise ValueError("a declared category is blank")
        if name in RESERVED:
            raise ValueError(f"{name} is reserved and can't be declared")
        if name in categories[:i]:
            raise ValueError(f"{name} is declared twice")
    for i, (category, tree) in enumerate(rules, 1):
        if category in RESERVED or category not in categories:
            raise ValueError(f"rule {i}: {category} is {'reserved' if category in RESERVED else 'not declared'}")
        if not tree:
            raise ValueError(f"rule {i}: an empty condition")
    return rules


def condition(tree: dict) -> Column:
    """A condition tree as a column; several keys in one node must all hold.

    ``match`` is looked for in the cleaned text, ``matchRaw`` in the text as it is; amounts are absolute, their bounds inclusive.
    """
    parts = []
    for key, value in tree.items():
        if key in ("all", "any"):
            if not value:
                raise ValueError(f"{key} needs a condition")
            inner = [condition(t) for t in value]
            parts.append(reduce(lambda a, b: a & b if key == "all" else a | b, inner))
        elif key == "not":
            parts.append(~condition(value))
        elif key == "match":
            parts.append(clean(F.col("raw_description")).rlike(f"(?iu){value}"))
        elif key == "matchRaw":
            parts.append(F.col("raw_description").rlike(f"(?iu){value}"))
        elif key == "direction":
            if value not in ("in", "out"):
                raise ValueError(f"direction {value}")
            parts.append(F.col("amount") > 0 if value == "in" else F.col("amount") < 0)
        elif key == "accounts":
            parts.append(F.col("account_ref").isin(*value))
        elif key == "amountRange":
            least, most = value
            if least is not None and most is not None and least > most:
                raise ValueError(f"amounts from {least} to {most}")
            size = F.abs("amount")
            parts.append((F.lit(True) if least is None else size >= least) & (F.lit(True) if most is None else size <= most))
        elif key == "externalId":
            parts.append(F.col("external_id").isin(*([value] if isinstance(value, str) else value)))
        else:
            raise ValueError(f"unknown condition {key}")
    if not parts:
        raise ValueError("an empty condition")
    return reduce(lambda a, b: a & b, parts)


def categorised(facts: DataFrame, rules: list = RULES) -> DataFrame:
    chain = F
    for category, tree in rules:
        chain = chain.when(condition(tree), category)
    return facts.withColumn("category", chain.otherwise("UNCATEGORIZED"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key's newest row."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_r", rank).where(F.col("_r") == 1).drop("_r")


def dedup_outcomes(rows: DataFrame) -> DataFrame:
    """Appended (a new id), Duplicate (the whole observation, but for where it came from, seen before) or Flagged (a known id, observed anew), in order of n."""
    seen = Window.partitionBy("external_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("external_id", "account_ref", "date", "amount", "raw_description", "receipt", "occ", "balance", "observation").orderBy("n")
    outcome = F.when(F.row_number().over(same) > 1, "Duplicate").when(F.count("*").over(seen) > 0, "Flagged").otherwise("Appended")
    return rows.withColumn("outcome", outcome)


def statement_reconcile(rows: DataFrame) -> DataFrame:
    """Balances before and after rows as signed multisets: exactly one surplus on each side means that the statement joins up."""
    ends = rows.select("account_ref", (F.col("balance") - F.col("amount")).alias("v"), F.lit(1).alias("s")).unionByName(rows.select("account_ref", F.col("balance").alias("v"), F.lit(-1).alias("s")))
    net = ends.groupBy("account_ref", "v").agg(F.sum("s").alias("s"))
    sums = net.groupBy("account_ref").agg(F.sum(F.greatest("s", F.lit(0))).cast("bigint").alias("openings"), F.sum(F.greatest(-F.col("s"), F.lit(0))).cast("bigint").alias("closings"))
    return sums.withColumn("reconciled", (F.col("openings") == 1) & (F.col("closings") == 1))


def openings(rows: DataFrame) -> DataFrame:
    """Opening balances from the first row forward and from the last row back."""
    order = F.struct("date", "n")
    got = rows.groupBy("account_ref").agg(F.min_by(F.col("balance") - F.col("amount"), order).alias("forward"), F.max_by("balance", order).alias("_last"), F.sum("amount").alias("_sum"))
    return got.select("account_ref", F.col("forward").cast("bigint").alias("forward"), (F.col("_last") - F.col("_sum")).cast("bigint").alias("backward"))


def chain_breaks(rows: DataFrame) -> DataFrame:
    before = F.lag("balance").over(Window.partitionBy("account_ref").orderBy("date", "n"))
    return rows.withColumn("expected", before + F.col("amount")).where(F.col("expected") != F.col("balance")).select("account_ref", "n", "date", F.col("expected").cast("bigint").alias("expected"), F.col("balance").cast("bigint").alias("balance"))


def stemmed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("stem", stem(F.col("raw_description")))


def amount_outliers(rows: DataFrame, sample: int = 8) -> DataFrame:
    """Rows above their stem's nearest-rank 99th percentile of absolute amounts."""
    by_stem = stemmed(rows).withColumn("_a", F.abs("amount"))
    limits = by_stem.groupBy("stem").agg(F.count("*").alias("_n"), F.expr("cast(percentile_disc(0.99) within group (order by _a) as bigint)").alias("p99")).where(F.col("_n") >= sample)
    return by_stem.join(limits, "stem").where(F.col("_a") > F.col("p99")).select("n", "stem", "amount", "p99")


def duplicate_looking(rows: DataFrame, days: int = 3) -> DataFrame:
    """Rows of one stem and amount, whatever their accounts, that follow each other within so many days."""
    order = Window.partitionBy("stem", "amount").orderBy("date", "n")
    gap = F.datediff("date", F.lag("date").over(order))
    return stemmed(rows).where(F.col("stem") != "").withColumn("gap", gap).where(F.col("gap") <= days).select("n", "account_ref", "stem", "amount", "gap")


def new_stems(rows: DataFrame, start: str, end: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("stem").orderBy("date", "n"))
    return stemmed(rows).withColumn("_r", first).where((F.col("_r") == 1) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("stem", "n", "date", "amount")


def silent_accounts(rows: DataFrame, as_of: str) -> DataFrame:
    """Accounts silent for over twice the upper median of their last ten gaps between dates."""
    dates = rows.select("account_ref", "date").distinct()
    by_date = Window.partitionBy("account_ref").orderBy("date")
    gaps = dates.withColumn("gap", F.datediff("date", F.lag("date").over(by_date))).withColumn("_r", F.row_number().over(Window.partitionBy("account_ref").orderBy(F.desc("date"))))
    got = gaps.groupBy("account_ref").agg(F.max("date").alias("last"), F.count("*").alias("dates"), F.sort_array(F.collect_list(F.when(F.col("_r") <= 10, F.col("gap")))).alias("_g"))
    middle = F.element_at("_g", F.floor(F.size("_g") / 2).cast("int") + 1)
    days = F.datediff(F.lit(as_of).cast("date"), "last")
    return got.where(F.col("dates") >= 4).select("account_ref", "last", middle.alias("median_gap"), days.alias("days")).where(F.col("days") > 2 * F.col("median_gap"))


def dup_clusters(rows: DataFrame, tolerance: int = 0) -> DataFrame:
    """Rows of one account, day, stem and sign whose sorted amounts follow each other within the tolerance."""
    keys = ["account_ref", "date", "stem", "negative"]
    order = Window.partitionBy(*keys).orderBy("amount", "n")
    marked = stemmed(rows).withColumn("negative", F.col("amount") < 0)
    apart = F.coalesce(F.col("amount") - F.lag("amount").over(order) > tolerance, F.lit(True))
    islands = marked.withColumn("_i", F.sum(apart.cast("int")).over(order))
    return islands.groupBy(*keys, "_i").agg(F.count("*").alias("rows"), F.min("n").alias("first_n")).where(F.col("rows") > 1).drop("_i")


def occurrence_calendar(commitments: DataFrame, as_of: str, ahead: int = 92) -> DataFrame:
    """Due dates of (commitment_id, anchor, months, amount) from the anchor to ``ahead`` days after ``as_of``; months count from the anchor, so short ones clamp."""
    end = F.date_add(F.lit(as_of).cast("date"), ahead)
    periods = F.floor(F.months_between(end, "anchor") / F.col("months")).cast("int")
    slots = commitments.where(F.col("anchor") <= end).withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), periods + 1))))
    due = F.add_months("anchor", F.col("k") * F.col("months"))
    return slots.withColumn("due", due).where(F.col("due") <= end).select("commitment_id", "k", "due", "amount")


def cash_month(rows: DataFrame) -> DataFrame:
    month = F.date_format("date", "yyyy-MM")
    return rows.groupBy("account_ref", month.alias("month")).agg(F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0)).alias("money_in"), F.sum(F.when(F.col("amount") < 0, F.col("amount")).otherwise(0)).alias("money_out"), F.sum("amount").alias("net"), F.count("*").alias("rows"))


def coverage(rows: DataFrame) -> DataFrame:
    """Each account's months from the first to the last date of all, and whether they hold facts, lie before, after, or are holes."""
    month = F.trunc("date", "month")
    spans = rows.groupBy("account_ref").agg(F.min(month).alias("_a"), F.max(month).alias("_b"))
    whole = spans.agg(F.min("_a").alias("_x"), F.max("_b").alias("_y"))
    counts = rows.groupBy("account_ref", month.alias("month")).agg(F.count("*").alias("facts"))
    # One row of bounds meets every account.
    calendar = spans.join(F.broadcast(whole)).withColumn("month", F.explode(F.expr("sequence(_x, _y, interval 1 month)")))
    state = F.when(F.col("month") < F.col("_a"), "before").when(F.col("month") > F.col("_b"), "after").when(F.col("facts").isNull(), "hole").otherwise("facts")
    return calendar.join(counts, ["account_ref", "month"], "left").select("account_ref", "month", F.coalesce("facts", F.lit(0)).cast("bigint").alias("facts"), state.alias("state"))
