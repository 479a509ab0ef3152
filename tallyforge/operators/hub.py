"""Reads over the derived tables: enriched rows, review, ingests, coverage, expectations, the cash-flow walk and its sheet.

Configuration tables (accounts, loans, groups) are as long as their files and are broadcast; everything else joins by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import periods
from tallyforge.functions.text import clean, stem

OPEN, PAID = ("due", "awaiting"), ("occurred", "settled", "partial")


def ledger_enriched(txn: DataFrame, review: DataFrame, note: DataFrame, commitment_fact: DataFrame, commitment: DataFrame) -> DataFrame:
    """Rows with whether they are under review, their newest note, their commitment and the account of their transfer's other leg."""
    subjects = review.select(F.col("subject").alias("external_id")).distinct().withColumn("has_review", F.lit(True))
    newest = note.groupBy("external_id").agg(F.max_by("text", "decision_n").alias("latest_note"))
    names = commitment.select("commitment_id", F.col("name").alias("commitment_name"))
    legs = Window.partitionBy("transfer_id").orderBy("external_id")
    # The other leg of smallest id: the first of all, or for that one the next.  A transfer has a few legs, so windows are small.
    paired = txn.where(F.col("transfer_id").isNotNull()).select("external_id", F.when(F.row_number().over(legs) == 1, F.lead("account_ref").over(legs)).otherwise(F.first("account_ref").over(legs)).alias("counterpart_account"))
    out = txn.join(subjects, "external_id", "left").join(newest, "external_id", "left").join(commitment_fact.select("external_id", "commitment_id"), "external_id", "left")
    return out.join(names, "commitment_id", "left").join(paired, "external_id", "left").withColumn("has_review", F.coalesce("has_review", F.lit(False)))


def review_enriched(review: DataFrame, facts: DataFrame, kind: str | None = None, account: str | None = None) -> DataFrame:
    """Review items with the newest fact of their subject; a balance break's account is its subject."""
    newest = facts.groupBy(F.col("external_id").alias("subject")).agg(F.max_by(F.struct("raw_description", "date", "account_ref", "amount"), "n").alias("f"))
    out = review if kind is None else review.where(F.col("kind") == kind)
    out = out.join(newest, "subject", "left").select("subject", "kind", "detail", clean(F.col("f.raw_description")).alias("description"), F.col("f.date").alias("date"), F.coalesce("f.account_ref", F.when(F.col("kind") == "BALANCE_BREAK", F.col("subject"))).alias("account_ref"), F.col("f.amount").alias("amount"))
    return out if account is None else out.where(F.col("account_ref") == account)


def ingest_batches(marker: DataFrame) -> DataFrame:
    """Batches: the start markers, each with its complete marker if that has come."""
    ends = marker.where(F.col("phase") == "complete").select("batch", F.col("n").alias("n_end"), F.col("appended").alias("_a"), F.col("status").alias("_s"), F.col("at_ms").alias("completed_ms"))
    starts = marker.where(F.col("phase") == "start").select("batch", "file", "account_ref", F.col("n").alias("n_start"), F.col("at_ms").alias("started_ms"))
    return starts.join(ends, "batch", "left").select("batch", "file", "account_ref", "n_start", "n_end", F.col("_a").alias("appended"), F.col("_s").alias("status"), "started_ms", "completed_ms")


def newest_batches(batches: DataFrame, txn: DataFrame, today: str, limit: int = 50, since_n: int | None = None) -> DataFrame:
    """The newest batches with their account's frontier, or all that completed after ``since_n``."""
    front = txn.where(F.col("date") <= F.lit(today).cast("date")).groupBy("account_ref").agg(F.max("date").alias("frontier"))
    out = batches.join(front, "account_ref", "left")
    return out.where(F.col("n_end") > since_n) if since_n is not None else out.orderBy(F.desc("n_start")).limit(limit)


def last_imports(batches: DataFrame) -> DataFrame:
    kept = batches.where(F.col("status").isNull() | (F.col("status") != "guard_refused"))
    return kept.groupBy("account_ref").agg(F.max_by(F.struct("file", "status", "started_ms"), F.struct("started_ms", "n_start")).alias("b")).select("account_ref", "b.*")


def with_files(txn: DataFrame, batches: DataFrame, width: int = 1024) -> DataFrame:
    """Rows with the file of the batch whose markers they lie between (both exclusive); null if there is none.

    A batch is dealt to every stretch of ``width`` numbers that it reaches, so the join is on account and stretch.
    """
    stretch = lambda c: F.floor(c / width)
    spans = batches.where(F.col("n_end").isNotNull()).withColumn("_s", F.explode(F.sequence(stretch(F.col("n_start")), stretch(F.col("n_end"))))).select("account_ref", "_s", "file", "n_start", "n_end")
    return txn.withColumn("_s", stretch(F.col("n"))).alias("t").join(spans.alias("b"), (F.col("t.account_ref") == F.col("b.account_ref")) & (F.col("t._s") == F.col("b._s")) & (F.col("t.n") > F.col("b.n_start")) & (F.col("t.n") < F.col("b.n_end")), "left").select("t.*", "b.file").drop("_s")


def coverage(accounts: DataFrame, txn: DataFrame, batches: DataFrame, start: str, end: str, grain: str = "week") -> DataFrame:
    """For every account and bucket from start to end: its rows and files, and none, before, after, facts or hole."""
    unit, key = ("week", periods.week_key) if grain == "week" else ("month", lambda d: F.date_format(d, "yyyy-MM"))
    day = lambda x: F.lit(x).cast("date")
    totals = txn.groupBy("account_ref").agg(key(F.min("date")).alias("_first"), key(F.max("date")).alias("_last"))
    inside = with_files(txn.where(F.col("date").between(day(start), day(end))), batches).groupBy("account_ref", key(F.col("date")).alias("bucket")).agg(F.count("*").alias("_n"), F.array_join(F.array_sort(F.collect_set("file")), ",").alias("_files"))
    calendar = accounts.select(F.col("ref").alias("account_ref")).withColumn("_d", F.explode(F.sequence(F.trunc(day(start), unit), day(end), F.expr(f"interval 1 {unit}")))).withColumn("bucket", key(F.col("_d")))
    n = F.coalesce("_n", F.lit(0)).cast("bigint")
    state = F.when(F.col("_first").isNull(), "none").when(F.col("bucket") < F.col("_first"), "before").when(F.col("bucket") > F.col("_last"), "after").when(n > 0, "facts").otherwise("hole")
    return calendar.join(F.broadcast(totals), "account_ref", "left").join(inside, ["account_ref", "bucket"], "left").select("account_ref", "bucket", n.alias("rows"), state.alias("state"), F.coalesce("_files", F.lit("")).alias("files"))


def expected(occurrence: DataFrame, commitment: DataFrame, start: str, end: str) -> DataFrame:
    """Totals by direction of the occurrences due in the window, each at what moved or else at its current price."""
    rows = occurrence.where(F.col("due_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).join(commitment, "commitment_id")
    return rows.groupBy("direction").agg(F.count("*").alias("occurrences"), F.sum(F.abs(F.coalesce("amount", "current_amount", F.lit(0)))).alias("committed"))


def arrears(occurrence: DataFrame, commitment: DataFrame) -> DataFrame:
    """Holes, oldest first, with the running total of what they should have cost.

    One running total over all holes: by day first, then inside a day, so no task sees more than a day's holes and one row a day.
    """
    holes = occurrence.where(F.col("status") == "missed").join(commitment, "commitment_id").select("commitment_id", "due_date", F.abs(F.coalesce("current_amount", F.lit(0))).alias("expected"))
    days = holes.groupBy("due_date").agg(F.sum("expected").alias("_day"))
    before = days.withColumn("_before", F.coalesce(F.sum("_day").over(Window.orderBy("due_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_day")
    inside = Window.partitionBy("due_date").orderBy("commitment_id").rowsBetween(Window.unboundedPreceding, 0)
    return holes.join(F.broadcast(before), "due_date").withColumn("running", F.col("_before") + F.sum("expected").over(inside)).drop("_before")


def manual_to_pay(occurrence: DataFrame, commitment: DataFrame, today: str, lead: int = 5, back: int = 30) -> DataFrame:
    """Occurrences to be paid by hand: upcoming within the commitment's lead time, or overdue for at most ``back`` days."""
    now, days = F.lit(today).cast("date"), F.coalesce("remind_days", F.lit(lead))
    rows = occurrence.join(commitment.where((F.col("origin") == "declared") & F.col("retired_n").isNull() & (F.col("payment") == "manual")), "commitment_id")
    upcoming = (F.col("status") == "due") & (F.col("due_date") >= now) & (F.col("due_date") <= F.date_add(now, days))
    overdue = F.col("status").isin("due", "missed", "awaiting") & (F.col("due_date") >= F.date_sub(now, back)) & (F.col("due_date") < now)
    return rows.where(upcoming | overdue).select("commitment_id", "due_date", "status", days.alias("remind_days"), F.when(F.col("due_date") < now, "overdue").otherwise("upcoming").alias("bucket"))


def due_in(occurrence: DataFrame, commitment: DataFrame, start: Column, end: Column) -> DataFrame:
    """How many occurrences of declared commitments are due between two days."""
    return occurrence.where((F.col("status") == "due") & (F.col("due_date") >= start) & (F.col("due_date") <= end)).join(commitment.where(F.col("origin") == "declared"), "commitment_id", "left_semi").agg(F.count("*").alias("due"))


def stale_accounts(accounts: DataFrame, txn: DataFrame, today: str) -> DataFrame:
    """Accounts whose newest row is older than the days after which their statement should be fetched."""
    front = txn.where(~F.col("synthetic") & (F.col("date") <= F.lit(today).cast("date"))).groupBy("account_ref").agg(F.max("date").alias("frontier"))
    days = F.datediff(F.lit(today).cast("date"), "frontier")
    got = front.join(F.broadcast(accounts.where(F.col("fetch_days") > 0)), F.col("ref") == F.col("account_ref"))
    return got.where(days > F.col("fetch_days")).select("account_ref", "frontier", days.alias("days"), "fetch_days")


def stale_acks(acks: DataFrame, txn: DataFrame, version: str) -> DataFrame:
    """Acknowledged rows that moved since, are gone, or were hashed by another version."""
    hashes = txn.select("external_id", F.col("state_hash").alias("_now"))
    moved = (F.col("hash_version") != version) | ~F.col("state_hash").eqNullSafe(F.col("_now")) | F.col("_now").isNull()
    return acks.join(hashes, "external_id", "left").withColumn("stale", moved).drop("_now")


def since(n: int, marker_ms: int, user: str, facts: DataFrame, batches: DataFrame, review: DataFrame, occurrence: DataFrame, txn: DataFrame, decisions: DataFrame) -> DataFrame:
    """What came after line ``n``: one row for each count, as (what, key, number)."""
    day = F.to_date(F.timestamp_millis(F.lit(marker_ms)))
    row = lambda df, what, key=F.lit(""): df.groupBy(F.lit(what).alias("what"), key.alias("key")).agg(F.count("*").alias("number"))
    turned = occurrence.join(txn.select(F.col("external_id").alias("matched_id"), F.col("n").alias("_n")), "matched_id", "left").where(((F.col("status") == "occurred") & (F.col("_n") > n)) | ((F.col("status") == "missed") & (F.col("window_end") > day)))
    others = decisions.where((F.col("n") > n) & (F.col("user_id").isNull() | (F.col("user_id") != user)))
    parts = [row(facts.where(F.col("n") > n), "facts", F.col("account_ref")), row(batches.where(F.col("n_end") > n), "batches"), row(review.where(F.col("opened_ms") > marker_ms), "items"), row(turned, "occurrences", F.col("status")), row(others, "decisions", F.coalesce("user_id", F.lit("")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def activity(commitment_id: str, candidate_key: str | None, direction: str, ended: str | None, rule: str, txn: DataFrame, commitment_fact: DataFrame, exclusion: DataFrame) -> DataFrame:
    """A candidate's rows by its stem; a declared commitment's bound rows, and those it excludes though its rule still takes them."""
    rows = txn.where(~F.col("synthetic"))
    if candidate_key is not None:
        return rows.where((F.col("role") != "noop") & (stem(F.col("raw_description")) == candidate_key)).select("external_id", "date", "amount", F.lit(None).cast("string").alias("matched_by"), F.lit(False).alias("excluded"))
    bound = txn.join(commitment_fact.where(F.col("commitment_id") == commitment_id), "external_id").select("external_id", "date", "amount", "matched_by", F.lit(False).alias("excluded"))
    sign = F.col("amount") > 0 if direction == "in" else F.col("amount") < 0
    life = F.lit(True) if ended is None else F.col("date") <= F.lit(ended).cast("date")
    out = txn.join(exclusion.where(F.col("commitment_id") == commitment_id), "external_id", "left_semi").where(sign & life & clean(F.col("raw_description")).rlike(f"(?iu){rule}"))
    return bound.unionByName(out.select("external_id", "date", "amount", F.lit("rule").alias("matched_by"), F.lit(True).alias("excluded")))


def transfer_only(commitment_fact: DataFrame, txn: DataFrame) -> DataFrame:
    """Commitments and whether all rows that they claim are transfers."""
    return commitment_fact.join(txn.select("external_id", "transfer_id"), "external_id").groupBy("commitment_id").agg(F.bool_and(F.col("transfer_id").isNotNull()).alias("transfer_only"))


def _category(c: Column) -> Column:
    return F.when(c.isNull() | (F.trim(c) == ""), "UNCATEGORIZED").otherwise(c)


def walk_lines(month: str, txn: DataFrame, occurrence: DataFrame, commitment: DataFrame, commitment_fact: DataFrame, accounts: DataFrame, cash_month: DataFrame, loans: list[str], repayments: list[str], interest: list[str]) -> DataFrame:
    """The month's figures as lines (figure, key, amount), from one pass over its rows and one over its occurrences.

    Rows are classed by whether their accounts are liquid, a declared loan or neither; occurrences by what has become of them.
    """
    first = F.lit(f"{month}-01").cast("date")
    within = lambda c: c.between(first, F.last_day(first))
    liquid = F.broadcast(accounts.select(F.col("ref").alias("account_ref"), "liquid"))
    both = Window.partitionBy("transfer_id").orderBy("external_id")
    other = F.when(F.row_number().over(both) == 1, F.lead("account_ref").over(both)).otherwise(F.first("account_ref").over(both))
    # Other legs may lie in another month, so they are found among all transfers, whose windows are a few rows each.
    others = txn.where(F.col("transfer_id").isNotNull()).select("external_id", other.alias("_other"))
    attached = occurrence.where(F.col("matched_id").isNotNull()).select(F.col("matched_id").alias("external_id"), F.lit(True).alias("_attached"))
    rows = txn.where(~F.col("synthetic") & within(F.col("date"))).join(commitment_fact.select("external_id", "commitment_id"), "external_id", "left").join(others, "external_id", "left").join(attached, "external_id", "left")
    rows = rows.join(liquid, "account_ref", "left").join(liquid.select(F.col("account_ref").alias("_other"), F.col("liquid").alias("_to")), "_other", "left")
    own, to = F.coalesce("liquid", F.lit(False)), F.coalesce("_to", F.lit(False))
    loan, met = F.col("account_ref").isin(*loans), F.coalesce("_attached", F.lit(False))
    move = F.col("transfer_id").isNotNull() & F.col("_other").isNotNull()
    held = ~move & ~met & (F.col("leg") == "HELD")
    flows = ~move & ~held & (own | loan)
    out_, amount, cat = F.col("amount") < 0, F.col("amount"), _category(F.col("category"))
    line = lambda when, figure, key, value: F.when(when, F.struct(F.lit(figure).alias("figure"), key.alias("key"), value.alias("amount")))
    none = F.lit("")
    lines = F.array(
        line(move & own & ~to & F.col("_other").isin(*loans), "repayments", F.col("_other"), -amount),
        line(move & own & ~to & ~F.col("_other").isin(*loans), "set_aside", F.col("_other"), -amount),
        line(held, "unpaired", none, F.abs(amount)),
        line(flows & loan, "charges", F.col("account_ref"), -amount),
        line(flows & loan & out_, "loan_spend", cat, -amount),
        line(flows & loan & ~out_, "loan_income", cat, amount),
        line(flows & ~met & out_, "spend", cat, -amount),
        line(flows & ~met & out_, "uncommitted", none, -amount),
        line(flows & ~met & ~out_, "income", cat, amount),
    )
    from_rows = rows.where(F.col("role") != "noop").select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("l")).select("l.*")
    # A paid occurrence has the category of the first row, by id, that its commitment claims in the month.
    claimed = rows.where(F.col("commitment_id").isNotNull() & F.col("category").isNotNull()).groupBy("commitment_id").agg(F.min_by("category", "external_id").alias("_cat"))
    when = F.when(F.col("status").isin(*PAID), F.coalesce("matched_date", "due_date")).otherwise(F.col("due_date"))
    due = occurrence.where(within(when)).join(commitment.select("commitment_id", "direction", "current_amount"), "commitment_id").join(claimed, "commitment_id", "left").join(transfer_only(commitment_fact, txn), "commitment_id", "left")
    in_, cid = F.col("direction") == "in", F.col("commitment_id")
    moved, owed = F.abs(F.coalesce("amount", F.lit(0))).cast("bigint"), F.abs(F.coalesce("current_amount", F.lit(0))).cast("bigint")
    repays, counted = cid.isin(*repayments), ~cid.isin(*repayments) & ~F.coalesce("transfer_only", F.lit(False))
    paid, open_, kind = F.col("status").isin(*PAID), F.col("status").isin(*OPEN), _category(F.col("_cat"))
    lines = F.array(
        line(repays & open_ & ~in_, "repayment_due", none, owed),
        line(counted & paid & F.col("matched_id").isNull(), "settled_without_fact", none, F.when(in_, moved).otherwise(-moved)),
        line(counted & paid & in_, "income", kind, moved),
        line(counted & paid & ~in_, "spend", kind, moved),
        line(counted & paid & ~in_, "committed_paid", none, moved),
        line(counted & open_ & in_, "income_due", none, owed),
        line(counted & open_ & ~in_ & cid.isin(*interest), "interest_due", none, owed),
        line(counted & open_ & ~in_ & ~cid.isin(*interest), "committed_due", none, owed),
        line(counted & (F.col("status") == "missed") & ~in_, "missed", none, owed),
    )
    from_due = due.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("l")).select("l.*")
    net = txn.where((F.col("role") != "noop") & within(F.col("date"))).join(liquid.where("liquid"), "account_ref", "left_semi").select(F.lit("liquid_net").alias("figure"), none.alias("key"), "amount")
    cash = cash_month.where(F.col("month") == month).join(liquid.where("liquid"), "account_ref", "left_semi").select(F.lit("unrecorded").alias("figure"), none.alias("key"), F.col("unrecorded").alias("amount"))
    return from_rows.unionByName(from_due).unionByName(net).unionByName(cash).groupBy("figure", "key").agg(F.sum("amount").cast("bigint").alias("amount"))


def headroom(lines: DataFrame) -> DataFrame:
    """One row: what came in and is due, less what went out, is due, and was never recorded."""
    total = lambda figure: F.coalesce(F.sum(F.when(F.col("figure") == figure, F.col("amount"))), F.lit(0)).cast("bigint")
    got = lines.agg(*[total(f).alias(f) for f in ("income", "income_due", "committed_paid", "uncommitted", "committed_due", "interest_due", "unrecorded", "missed", "unpaired", "settled_without_fact", "liquid_net", "repayment_due")])
    left = F.col("income") + F.col("income_due") - F.col("committed_paid") - F.col("uncommitted") - F.col("committed_due") - F.col("interest_due") - F.col("unrecorded")
    return got.withColumn("left", left)


def map_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, amount) of a less b by key, without keys that come to nothing."""
    both = a.select("key", "amount").unionByName(b.select("key", (-F.col("amount")).alias("amount")))
    return both.groupBy("key").agg(F.sum("amount").cast("bigint").alias("amount")).where(F.col("amount") != 0)


def sheet(lines: DataFrame, groups: DataFrame, cash: bool, exclude: list[str]) -> DataFrame:
    """The month's slices of money out, as (slice, part, amount, slice_amount): groups and their categories without the excluded ones,
    and in the cash view the loans' payments and what was set aside; then what is due and what was never recorded.  Zeros are left out.
    """
    of = lambda figure: lines.where(F.col("figure") == figure)
    spend = map_difference(of("spend"), of("loan_spend")) if cash else of("spend").select("key", "amount").where(F.col("amount") != 0)
    named = spend.join(F.broadcast(groups.select(F.col("category").alias("key"), "group")), "key", "left").withColumn("group", F.when(F.col("group").isNull() | (F.trim("group") == ""), "Expense").otherwise(F.col("group")))
    parts = named.where(~F.col("key").isin(*exclude) & ~F.col("group").isin(*exclude)).select(F.col("group").alias("slice"), F.col("key").alias("part"), "amount")
    if cash:
        charges, repaid = of("charges").withColumn("amount", F.col("amount")), of("repayments")
        principal = repaid.select("amount").unionByName(charges.select(-F.col("amount")).toDF("amount"))
        parts = parts.unionByName(charges.groupBy().agg(F.sum("amount").alias("amount")).select(F.lit("Mortgage").alias("slice"), F.lit("Interest & fees").alias("part"), "amount"))
        parts = parts.unionByName(principal.groupBy().agg(F.sum("amount").alias("amount")).select(F.lit("Mortgage").alias("slice"), F.lit("Principal").alias("part"), "amount"))
        parts = parts.unionByName(of("set_aside").select(F.lit("Set aside").alias("slice"), F.col("key").alias("part"), "amount"))
    due = lines.where(F.col("figure").isin("committed_due", "repayment_due" if cash else "interest_due"))
    for name, rows in (("Due", due), ("Unrecorded", of("unrecorded"))):
        parts = parts.unionByName(rows.groupBy().agg(F.sum("amount").alias("amount")).select(F.lit(name).alias("slice"), F.lit("").alias("part"), "amount"))
    whole = Window.partitionBy("slice")
    return parts.where(F.coalesce("amount", F.lit(0)) != 0).withColumn("slice_amount", F.sum("amount").over(whole)).where(F.col("slice_amount") != 0).select("slice", "part", F.col("amount").cast("bigint").alias("amount"), F.col("slice_amount").cast("bigint").alias("slice_amount"))


def eyeball_buckets(txn: DataFrame, start: str, end: str, grain: str) -> DataFrame:
    """Total of unpaired rows, and each account's closing balance, by day, week or month."""
    day = F.col("date")
    key = {"week": periods.week_key(day), "month": F.date_format(day, "yyyy-MM")}.get(grain, day.cast("string"))
    rows = txn.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).withColumn("bucket", key)
    ends = rows.groupBy("bucket", "account_ref").agg(F.max_by("balance", F.struct("date", "n")).alias("_close"), F.sum(F.when(F.coalesce("leg", F.lit("")) != "MATCHED", F.col("amount")).otherwise(0)).alias("_t"), F.min("date").alias("_a"), F.max("date").alias("_b"))
    return ends.groupBy("bucket").agg(F.sum("_t").cast("bigint").alias("total"), F.min("_a").alias("first"), F.max("_b").alias("last"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "account_ref", F.col("_close").cast("string")))), ",").alias("closing"))
