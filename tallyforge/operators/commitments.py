"""Commitments: what people declare, which rows each takes, when it is due and what came of that, and series that nobody declared.

Declarations are made by people, so there are few beside facts; their rules meet the distinct texts of rows, not the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.identity import candidate_id
from tallyforge.functions.periods import days_of, per_year, step, tolerance
from tallyforge.functions.text import clean, foreign_amount, stem
from tallyforge.session import cut

#: Months of past occurrences, days ahead, most days of a window on either side; rows of a trailing median.
PAST_MONTHS, HORIZON, WINDOW_MOST, TRAILING = 12, 92, 7, 12
LEAST_REGULAR, LEAST_STEP, STEP_SHARE = 0.70, 50, 0.05


def is_step(before: Column, now: Column) -> Column:
    """Whether a price moved: by ``LEAST_STEP`` cents or by a share; from nothing, everything is a move."""
    change = F.abs(F.abs(now) - F.abs(before))
    return (change >= LEAST_STEP) | (change >= F.abs(before) * STEP_SHARE)


def change_pct(before: Column, now: Column) -> Column:
    """The move in percent of the price before; null from nothing."""
    return F.when(before != 0, 100.0 * (F.abs(now) - F.abs(before)) / F.abs(before))


def compiles(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows with whether their pattern is a regular expression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for p in batch.column(0).to_pylist():
                try:
                    re.compile(p or "")
                    good.append(True)
                except re.error:
                    good.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good, pa.bool_())], names=["_p", "_good"])

    judged = rows.select(F.col(pattern).alias("_p")).distinct().mapInArrow(run, "_p string, _good boolean")
    return rows.join(judged, F.col(pattern).eqNullSafe(F.col("_p")), "left").drop("_p")


#: What tells one decision from another; its number alone may be that of another one too.
_DECISION = ("n", "action", "commitment_id")


def fold(said: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """What holds after all decisions (n, action, commitment_id, id, ...): commitments, pins, exclusions, settles, and those without effect.

    A declaration replaces the one before it and revives a commitment that was ended; one whose rule is no regular expression has no effect.
    Ends, exclusions, notes and settles need an earlier declaration, pins one that isn't ended at that time.  A pin or exclusion that
    names an unknown id has no effect on any.
    """
    said = cut(compiles(said, "match"))
    own = Window.partitionBy("commitment_id").orderBy("n").rangeBetween(Window.unboundedPreceding, -1)
    good = (F.col("action") == "DECLARE") & F.col("_good")
    known = F.coalesce(F.max(F.when(good, 1)).over(own), F.lit(0)) == 1
    state = F.last(F.when(good | (F.col("action") == "RETIRE"), F.col("action")), ignorenulls=True).over(own)
    judged = said.where(F.col("commitment_id").isNotNull()).withColumn("_known", known).withColumn("_live", known & (F.coalesce(state, F.lit("")) == "DECLARE"))
    judged = cut(judged.unionByName(said.where(F.col("commitment_id").isNull()).withColumn("_known", F.lit(True)).withColumn("_live", F.lit(True))).join(ids.select("id", "current_id"), "id", "left"))
    # A decision has a row for each id that it names.
    judged = judged.withColumn("_some", F.bool_or(F.when(F.col("id").isNotNull(), F.col("current_id").isNull())).over(Window.partitionBy(*_DECISION)))
    action = F.col("action")
    fails = F.when(action == "DECLARE", ~F.col("_good")).when(action == "PIN", ~F.col("_live") | F.col("_some")).when(action == "EXCLUDE", ~F.col("_known") | F.col("_some")).when(action.isin("INCLUDE", "UNPIN"), ~F.col("_known") | F.col("current_id").isNull()).otherwise(~F.col("_known"))
    judged = cut(judged.withColumn("fails", fails))
    works = judged.where(~F.col("fails"))
    fields = ["n", "direction", "cadence", "amount_kind", "match", "account", "amount", "day"]
    declared = works.where(action == "DECLARE").groupBy("commitment_id").agg(F.max_by(F.struct(*fields), "n").alias("d")).select("commitment_id", "d.*")
    ended = works.where(action == "RETIRE").groupBy("commitment_id").agg(F.max("n").alias("_rn"), F.max_by("day", "n").alias("_end"))
    signed = F.when(F.col("direction") == "out", -F.abs("amount")).otherwise(F.abs("amount"))
    gone = F.col("_rn") > F.col("n")
    commitments = declared.join(ended, "commitment_id", "left").select("commitment_id", F.col("n").alias("declared_n"), "direction", "cadence", "amount_kind", "match", F.when(F.trim("account") != "", F.col("account")).alias("account"), signed.alias("expected"), F.col("day").alias("anchor"), F.when(gone, F.col("_rn")).alias("retired_n"), F.when(gone, F.col("_end")).alias("ended_at"))
    last = lambda actions, keys: works.where(action.isin(*actions)).groupBy(*keys).agg(F.max_by(F.struct("action", "n", "commitment_id"), "n").alias("d"))
    pins = last(["PIN", "UNPIN"], [F.col("current_id").alias("external_id")]).where(F.col("d.action") == "PIN").select("external_id", F.col("d.commitment_id").alias("commitment_id"))
    exclusions = last(["EXCLUDE", "INCLUDE"], ["commitment_id", F.col("current_id").alias("external_id")]).where(F.col("d.action") == "EXCLUDE").select("commitment_id", "external_id", F.col("d.n").alias("decision_n"))
    settles = works.where(action == "SETTLE").groupBy("commitment_id", F.col("day").alias("due_date")).agg(F.max("n").alias("settle_n"))
    return {"commitments": cut(commitments), "pins": cut(pins), "exclusions": cut(exclusions), "settles": cut(settles), "without_effect": judged.where("fails").select(*_DECISION).distinct().select(F.col("n").alias("decision_n"), "action")}


def claims(state: dict[str, DataFrame], rows: DataFrame, as_of: str) -> DataFrame:
    """(external_id, commitment_id, matched_by) of the rows up to ``as_of`` that a commitment takes: the one that a person pinned, or else the
    last declared whose rule, sign and life admit the row.  Pairs that a person excluded are never taken.
    """
    tracked = state["commitments"].where((F.col("cadence") == "irregular") | F.col("anchor").isNotNull())
    facts = cut(rows.where((F.col("role") != "noop") & (F.col("date") <= F.lit(as_of).cast("date"))).select("external_id", "n", "account_ref", "date", "amount", clean(F.col("raw_description")).alias("_t")))
    admits = (F.col("amount") != 0) & ((F.col("direction") == "out") == (F.col("amount") < 0)) & (F.col("ended_at").isNull() | (F.col("date") <= F.col("ended_at")))
    faces = tracked.select("commitment_id", "declared_n", "direction", "ended_at")
    pinned = facts.join(state["pins"], "external_id").join(F.broadcast(faces), "commitment_id").where(admits).join(state["exclusions"], ["commitment_id", "external_id"], "left_anti")
    pinned = pinned.select("external_id", "commitment_id", F.lit("pin").alias("matched_by"))
    # Rules are as many as people wrote; they meet each distinct text once.
    rules = F.broadcast(tracked.select("commitment_id", "match", "account"))
    texts = facts.select("_t").distinct().join(rules, F.expr("_t rlike concat('(?iu)', match)")).select("_t", "commitment_id", "account")
    fit = facts.join(texts, "_t").where(F.col("account").isNull() | (F.col("account") == F.col("account_ref"))).join(F.broadcast(faces), "commitment_id").where(admits)
    fit = fit.join(state["exclusions"], ["commitment_id", "external_id"], "left_anti").join(pinned.select("external_id"), "external_id", "left_anti")
    best = fit.groupBy("external_id").agg(F.min_by("commitment_id", F.struct(-F.col("declared_n"), F.col("commitment_id"))).alias("commitment_id"))
    return pinned.unionByName(best.select("external_id", "commitment_id", F.lit("rule").alias("matched_by")))


def schedule(commitments: DataFrame, as_of: str) -> DataFrame:
    """Due dates of regular commitments with their windows, from a year back (or the anchor) to the horizon (or their end)."""
    now, days = F.lit(as_of).cast("date"), days_of(F.col("cadence"))
    regular = commitments.where((F.col("cadence") != "irregular") & F.col("anchor").isNotNull())
    horizon = F.date_add(now, HORIZON)
    most = F.greatest(F.lit(0), F.ceil(F.datediff(horizon, "anchor") / (days - 2)).cast("int") + 1)
    slots = regular.where(F.col("anchor") <= horizon).withColumn("k", F.explode(F.sequence(F.lit(0), most))).withColumn("due_date", step(F.col("anchor"), F.col("cadence"), F.col("k")))
    start = F.greatest("anchor", F.add_months(now, -PAST_MONTHS))
    slots = slots.where((F.col("due_date") >= start) & (F.col("due_date") <= horizon) & (F.col("ended_at").isNull() | (F.col("due_date") <= F.col("ended_at"))))
    offset = F.least(F.floor(days / 2), F.lit(WINDOW_MOST)).cast("int")
    slots = slots.withColumn("window_start", F.date_sub("due_date", offset)).withColumn("window_end", F.date_add("due_date", offset))
    return slots.select("commitment_id", "due_date", "window_start", "window_end", F.when(F.col("window_end") < now, "missed").otherwise("due").alias("status"), "expected")


_FACE = ("matched_id", "matched_date", "matched_by")


def _landed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: what moved, and the first row's id, date and way."""
    first = F.min(F.struct("date", "n", "external_id", "matched_by"))
    got = rows.groupBy(*keys).agg(F.sum("amount").alias("amount"), first.alias("f"))
    return got.select(*keys, "amount", F.col("f.external_id").alias("matched_id"), F.col("f.date").alias("matched_date"), F.col("f.matched_by").alias("matched_by"))


def occurrences(state: dict[str, DataFrame], claimed: DataFrame, rows: DataFrame, as_of: str) -> DataFrame:
    """Every occurrence: scheduled ones with what landed in their windows (the earliest due, where windows meet), settled, missed, awaited
    or due; rows that land in no window, by their day; and the days of irregular commitments.

    Rows before a commitment's first window are history and land nowhere.  A missed window that the statements of the commitment's
    accounts haven't passed yet is awaited: accounts that its rule names, or else those of its rows.
    """
    commitments = state["commitments"]
    slots = cut(schedule(commitments, as_of))
    facts = cut(claimed.join(rows.select("external_id", "n", "date", "amount", "account_ref"), "external_id"))
    span = slots.groupBy("commitment_id").agg(F.min("window_start").alias("_from"))
    kinds = F.broadcast(commitments.select("commitment_id", "cadence"))
    inside = facts.join(span, "commitment_id").where(F.col("date") >= F.col("_from"))
    days = slots.select("commitment_id", "due_date", F.explode(F.sequence("window_start", "window_end", F.expr("interval 1 day"))).alias("date")).groupBy("commitment_id", "date").agg(F.min("due_date").alias("due_date"))
    placed = cut(inside.join(days, ["commitment_id", "date"], "left"))
    hits = _landed(placed.where(F.col("due_date").isNotNull()), ["commitment_id", "due_date"])
    off = _landed(placed.where(F.col("due_date").isNull()).drop("due_date").withColumn("due_date", F.col("date")), ["commitment_id", "due_date"])
    loose = _landed(facts.join(kinds, "commitment_id").where(F.col("cadence") == "irregular").withColumn("due_date", F.col("date")), ["commitment_id", "due_date"])
    front = rows.where(F.col("date") <= F.lit(as_of).cast("date")).groupBy("account_ref").agg(F.max("date").alias("_front"))
    named = commitments.where(F.col("account").isNotNull()).select("commitment_id", F.col("account").alias("account_ref"))
    seen = facts.join(F.broadcast(named.select("commitment_id")), "commitment_id", "left_anti").select("commitment_id", "account_ref").distinct()
    reach = named.unionByName(seen).join(front, "account_ref").groupBy("commitment_id").agg(F.max("_front").alias("_front"))
    full = slots.join(hits, ["commitment_id", "due_date"], "left").join(state["settles"], ["commitment_id", "due_date"], "left").join(reach, "commitment_id", "left")
    met, settled = F.col("matched_id").isNotNull(), F.col("settle_n").isNotNull()
    status = F.when(met, "occurred").when(settled, "settled").when((F.col("status") == "missed") & (F.col("window_end") >= F.col("_front")), "awaiting").otherwise(F.col("status"))
    none = lambda t: F.lit(None).cast(t)
    scheduled = full.select("commitment_id", "due_date", status.alias("status"), "window_start", "window_end", *_FACE, F.lit(False).alias("off_schedule"), F.when(~met, F.col("settle_n")).alias("settle_n"), F.when(met, F.col("amount")).when(settled, F.col("expected")).alias("amount"))
    single = lambda df, is_off: df.select("commitment_id", "due_date", F.lit("occurred").alias("status"), none("date").alias("window_start"), none("date").alias("window_end"), *_FACE, F.lit(is_off).alias("off_schedule"), none("bigint").alias("settle_n"), "amount")
    return scheduled.unionByName(single(off, True)).unionByName(single(loose, False))


def occurrence_hash(rows: DataFrame) -> DataFrame:
    """Rows with the hash of their identity and outcome; a null prints as ``null``."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("commitment_id", "due_date", "status", "matched_id", "matched_date", "amount", "settle_n", "off_schedule")]
    return rows.withColumn("state_hash", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *texts), 256)))


def arrears(found: DataFrame, commitments: DataFrame, as_of: str) -> DataFrame:
    """Of each commitment the missed windows, what they should have brought, and whether the last window that closed is one of them."""
    rows = found.where(F.col("window_end").isNotNull()).join(F.broadcast(commitments.select("commitment_id", "expected")), "commitment_id")
    missed, closed = F.col("status") == "missed", F.col("window_end") < F.lit(as_of).cast("date")
    got = rows.groupBy("commitment_id").agg(F.count_if(missed).alias("count"), F.coalesce(F.sum(F.when(missed, F.coalesce("expected", F.lit(0)))), F.lit(0)).cast("bigint").alias("amount"), F.max_by(F.when(closed, F.col("status")), F.when(closed, F.col("due_date"))).alias("_last"))
    return got.select("commitment_id", "count", "amount", F.coalesce(F.col("_last") == "missed", F.lit(False)).alias("lapsed"))


def dormant(found: DataFrame, commitments: DataFrame, rows: DataFrame, as_of: str) -> DataFrame:
    """Commitments that nothing came of for over a cadence and its tolerance: (commitment_id, since, frontier).

    Silence is measured from the last matched or settled occurrence to the newest row of the accounts that it matched in (or its rule names).
    """
    regular = commitments.where(F.col("retired_n").isNull() & (F.col("cadence") != "irregular"))
    front = rows.where(F.col("date") <= F.lit(as_of).cast("date")).groupBy("account_ref").agg(F.max("date").alias("_front"))
    last = found.where(F.col("matched_id").isNotNull() | (F.col("status") == "settled")).groupBy("commitment_id").agg(F.max("due_date").alias("since"))
    own = found.where(F.col("matched_id").isNotNull()).join(rows.select(F.col("external_id").alias("matched_id"), "account_ref"), "matched_id").select("commitment_id", "account_ref").distinct()
    named = commitments.where(F.col("account").isNotNull()).join(own, "commitment_id", "left_anti").select("commitment_id", F.col("account").alias("account_ref"))
    newest = own.unionByName(named).join(front, "account_ref").groupBy("commitment_id").agg(F.max("_front").alias("frontier"))
    days = days_of(F.col("cadence"))
    got = regular.join(last, "commitment_id").join(newest, "commitment_id")
    return got.where(F.datediff("frontier", "since") > days + tolerance(days)).select("commitment_id", "since", "frontier")


def _median(amounts: Column) -> Column:
    """The middle amount; of an even count the mean of the two, halves up."""
    sorted_, n = F.array_sort(amounts), F.size(amounts)
    low, high = F.element_at(sorted_, F.greatest(F.lit(1), F.floor(n / 2).cast("int"))), F.element_at(sorted_, F.greatest(F.lit(1), F.floor(n / 2).cast("int") + 1))
    return F.when(n == 0, F.lit(0).cast("bigint")).when(n % 2 == 1, F.element_at(sorted_, F.greatest(F.lit(1), F.floor(n / 2).cast("int") + 1))).otherwise(F.floor((low + high) / 2.0 + 0.5).cast("bigint"))


def _pairs(xs: Column, f) -> Column:
    """``f(one, next)`` of each two neighbours of an array."""
    n = F.size(xs)
    return F.when(n < 2, F.array().cast("array<string>")) if f is None else F.zip_with(F.slice(xs, 1, F.greatest(F.lit(0), n - 1)), F.slice(xs, 2, F.greatest(F.lit(0), n - 1)), f)


def faces(found: DataFrame, state: dict[str, DataFrame], behind: DataFrame, silent: DataFrame, as_of: str) -> DataFrame:
    """A declared commitment's row: status, cost, prices and their moves, what it comes to in a year, and how regular it was."""
    now = F.lit(as_of).cast("date")
    seen = found.where(F.col("matched_id").isNotNull()).groupBy("commitment_id").agg(F.array_sort(F.collect_list(F.struct("due_date", "off_schedule", "matched_date", "amount", F.col("window_start").isNotNull().alias("w")))).alias("o"))
    rows = state["commitments"].join(seen, "commitment_id", "left").join(behind.withColumnRenamed("amount", "_behind").withColumnRenamed("count", "arrears"), "commitment_id", "left").join(silent.select("commitment_id", F.lit(True).alias("_silent")), "commitment_id", "left")
    o = F.coalesce("o", F.expr("cast(array() as array<struct<due_date:date,off_schedule:boolean,matched_date:date,amount:bigint,w:boolean>>)"))
    rows = rows.withColumn("o", o).withColumn("_n", F.size("o"))
    moves = F.filter(_pairs(F.col("o"), lambda a, b: F.struct(b["matched_date"].alias("date"), a["amount"].alias("before"), b["amount"].alias("now"), is_step(a["amount"], b["amount"]).alias("step"))), lambda x: x["step"])
    rows = rows.withColumn("_moves", moves).withColumn("_last", F.when(F.size("_moves") > 0, F.element_at("_moves", -1)))
    none = F.col("_n") == 0
    current = F.when(none, F.col("expected")).otherwise(F.when(~none, F.element_at("o", -1)["amount"]))
    windowed = F.transform(F.filter("o", lambda x: x["w"]), lambda x: x["due_date"])
    days = days_of(F.col("cadence"))
    near = F.filter(_pairs(windowed, lambda a, b: F.datediff(b, a)), lambda g: F.abs(g - days) <= tolerance(days))
    trailing = F.transform(F.slice("o", F.greatest(F.lit(1), F.col("_n") - TRAILING + 1), F.lit(TRAILING)), lambda x: x["amount"])
    year = F.aggregate(F.filter("o", lambda x: (x["due_date"] >= F.add_months(now, -12)) & (x["due_date"] <= now)), F.lit(0).cast("bigint"), lambda t, x: t + x["amount"])
    yearly = F.when(F.col("cadence") == "irregular", year).otherwise(per_year(F.col("cadence")) * F.when((F.col("amount_kind") == "variable") & ~none, _median(trailing)).otherwise(F.col("_current")))
    return rows.withColumn("_current", current).select(
        "commitment_id", F.when(F.col("retired_n").isNotNull(), "ended").when(F.col("_silent"), "dormant").otherwise("active").alias("status"),
        F.when(none, F.col("anchor")).otherwise(F.when(~none, F.element_at("o", 1)["due_date"])).alias("first_date"), F.when(none, F.col("anchor")).otherwise(F.when(~none, F.element_at("o", -1)["due_date"])).alias("last_date"),
        F.col("_current").alias("current_amount"), F.col("_last.before").alias("previous_amount"), F.round(change_pct(F.col("_last.before"), F.col("_last.now")), 6).alias("change_pct"), F.col("_last.date").alias("change_date"),
        F.aggregate("o", F.lit(0).cast("bigint"), lambda t, x: t + x["amount"]).alias("cost"), yearly.cast("bigint").alias("annualised"), F.col("_n").cast("bigint").alias("occurrences"),
        F.when((F.col("cadence") != "irregular") & (F.size(windowed) >= 2), F.round(F.size(near) / (F.size(windowed) - 1), 6)).alias("regularity"),
        F.coalesce("arrears", F.lit(0)).cast("bigint").alias("arrears"), F.coalesce("_behind", F.lit(0)).alias("arrears_amount"),
    )


def detect(rows: DataFrame, as_of: str) -> DataFrame:
    """Recurring series among rows (account_ref, date, n, amount, raw_description), by stem.

    A stem's rows are netted by day, in the foreign price if every row names one.  The side that moved more gives the sign; days of the other are
    refunds, which take back the newest charges first.  Three days or more, whose median gap is near a cadence that most gaps keep, are a
    series; it is active, dormant or ended by how long it is silent, against the newest rows of its accounts.  A stem has one array of days,
    so what it holds is bounded by the calendar, however many rows it has.
    """
    near_now = rows.where(F.col("date") <= F.lit(as_of).cast("date")).groupBy("account_ref").agg(F.max("date").alias("_front"))
    named = rows.withColumn("stem", stem(F.col("raw_description"))).where(F.col("stem") != "").withColumn("_fcy", foreign_amount(F.col("raw_description")))
    days = named.groupBy("stem", "date", "account_ref").agg(F.sum("amount").alias("_aud"), F.sum(F.when(F.col("amount") < 0, -F.col("_fcy")).otherwise(F.col("_fcy"))).alias("_for"), F.bool_and(F.col("_fcy").isNotNull()).alias("_all"))
    days = days.join(F.broadcast(near_now), "account_ref", "left").groupBy("stem", "date").agg(F.sum("_aud").alias("_aud"), F.sum("_for").alias("_for"), F.bool_and("_all").alias("_all"), F.max("_front").alias("_front"))
    series = days.groupBy("stem").agg(F.bool_and("_all").alias("_all"), F.max("_front").alias("frontier"), F.array_sort(F.collect_list(F.struct("date", "_aud", "_for"))).alias("d"))
    net = F.transform("d", lambda x: F.struct(x["date"].alias("date"), F.when(F.col("_all"), x["_for"]).otherwise(x["_aud"]).alias("amount")))
    total = lambda keep: F.aggregate(F.filter("net", keep), F.lit(0).cast("bigint"), lambda t, x: t + x["amount"])
    # Stored between steps: each is used many times by the next, and would be computed anew for each use.
    series = cut(series.select("stem", "frontier", net.alias("net")))
    series = series.withColumn("sign", F.when(F.abs(total(lambda x: x["amount"] < 0)) >= total(lambda x: x["amount"] > 0), -1).otherwise(1))
    charges, refunds = F.filter("net", lambda x: x["amount"] * F.col("sign") > 0), F.filter("net", lambda x: x["amount"] * F.col("sign") < 0)
    nothing = F.expr("cast(array() as array<struct<date:date,amount:bigint>>)")

    def take_back(held: Column, refund: Column) -> Column:
        def one(s: Column, o: Column) -> Column:
            took = F.when(o["date"] <= refund["date"], F.least(s["left"], F.abs(o["amount"]))).otherwise(F.lit(0).cast("bigint"))
            return F.struct((s["left"] - took).alias("left"), F.concat(F.array(F.struct(o["date"].alias("date"), (o["amount"] - F.col("sign") * took).alias("amount"))), s["out"]).alias("out"))

        return F.aggregate(F.reverse(held), F.struct(F.abs(refund["amount"]).alias("left"), nothing.alias("out")), one, lambda s: s["out"])

    series = cut(series.withColumn("_c", charges).withColumn("_r", refunds).drop("net"))
    series = series.withColumn("o", F.when(F.size("_r") == 0, F.col("_c")).otherwise(F.filter(F.aggregate("_r", F.col("_c"), take_back), lambda x: x["amount"] != 0))).select("stem", "frontier", "sign", "o")
    series = cut(series).where(F.size("o") >= 3)
    gaps = F.array_sort(_pairs(F.col("o"), lambda a, b: F.datediff(b["date"], a["date"])))
    series = cut(series.withColumn("_g", gaps))
    n = F.size("_g")
    middle = (F.element_at("_g", F.ceil(n / 2).cast("int")) + F.element_at("_g", F.floor(n / 2).cast("int") + 1)) / 2.0
    series = series.withColumn("median_gap", middle)
    names = ("weekly", "fortnightly", "monthly", "bimonthly", "quarterly", "semiannual", "annual")
    best = F.array_min(F.array(*[F.struct(F.abs(F.col("median_gap") - days_of(F.lit(c))).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(names)]))
    series = cut(series.withColumn("_b", best)).withColumn("cadence", F.col("_b.c")).withColumn("days", days_of(F.col("cadence"))).where(F.col("_b.d") <= tolerance(F.col("days")))
    kept = F.filter("_g", lambda g: F.abs(g - F.col("days")) <= tolerance(F.col("days")))
    series = series.withColumn("regularity", F.size(kept) / F.size("_g")).where(F.col("regularity") >= LEAST_REGULAR)
    moved = _pairs(F.col("o"), lambda a, b: F.struct(b["date"].alias("date"), a["amount"].alias("before"), b["amount"].alias("now"), is_step(a["amount"], b["amount"]).alias("step")))
    # The price that a run began with; a change from it that no single step explains makes the series variable.
    first = F.struct(F.element_at("o", 1)["amount"].alias("anchor"), F.lit(False).alias("variable"))
    run = F.aggregate("_m", first, lambda s, m: F.struct(F.when(m["step"], m["now"]).otherwise(s["anchor"]).alias("anchor"), (s["variable"] | (~m["step"] & is_step(s["anchor"], m["now"]))).alias("variable")))
    series = cut(series.withColumn("_m", moved))
    series = cut(series.withColumn("variable", run["variable"]).withColumn("_s", F.filter("_m", lambda m: m["step"])).withColumn("_z", F.transform("o", lambda x: F.abs(x["amount"]))).drop("_m"))
    series = series.withColumn("_last", F.when(F.size("_s") > 0, F.element_at("_s", -1)))
    around = F.zip_with(F.zip_with(F.slice("_z", 1, F.size("_z") - 2), F.slice("_z", 2, F.size("_z") - 2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice("_z", 3, F.size("_z") - 2), lambda x, c: F.struct(x["a"].alias("a"), x["b"].alias("b"), c.alias("c")))
    one_off = F.filter(around, lambda x: (x["a"] != 0) & ((x["b"] >= 2.0 * x["a"]) | (x["b"] * 2.0 <= x["a"])) & (F.abs(x["c"] - x["a"]) <= 0.10 * x["a"]))
    trailing = F.transform(F.slice("o", F.greatest(F.lit(1), F.size("o") - TRAILING + 1), F.lit(TRAILING)), lambda x: x["amount"])
    last = F.element_at("o", -1)
    silent = F.datediff("frontier", last["date"])
    status = F.when(F.col("frontier").isNull(), "active").when(silent > 2 * F.col("days"), "ended").when(silent > F.col("days") + tolerance(F.col("days")), "dormant").otherwise("active")
    return series.select(
        candidate_id(F.col("stem")).alias("candidate_id"), "stem", F.when(F.col("sign") < 0, "out").otherwise("in").alias("direction"), "cadence", F.when(F.col("variable"), "variable").otherwise("fixed").alias("amount_kind"), status.alias("status"),
        F.element_at("o", 1)["date"].alias("first_date"), last["date"].alias("last_date"), last["amount"].alias("current_amount"), F.col("_last.before").alias("previous_amount"), F.col("_last.date").alias("change_date"), F.round(change_pct(F.col("_last.before"), F.col("_last.now")), 6).alias("change_pct"),
        F.aggregate("o", F.lit(0).cast("bigint"), lambda t, x: t + x["amount"]).alias("cost"), (per_year(F.col("cadence")) * F.when(F.col("variable"), _median(trailing)).otherwise(last["amount"])).cast("bigint").alias("annualised"),
        F.size("o").cast("bigint").alias("occurrences"), F.size(one_off).cast("bigint").alias("one_offs"), F.size("_s").cast("bigint").alias("steps"), F.round("regularity", 6).alias("regularity"),
    )


def open_candidates(found: DataFrame, ignored: DataFrame, named: DataFrame, rules: DataFrame, rows: DataFrame) -> DataFrame:
    """Series that nobody ignored (stem), no declaration names (stem), and no commitment's rules (commitment_id, match, account) take whole."""
    left = found.join(ignored.select("stem").unionByName(named.select("stem")), "stem", "left_anti")
    texts = rows.withColumn("stem", stem(F.col("raw_description"))).join(left.select("stem"), "stem", "left_semi").select("stem", clean(F.col("raw_description")).alias("_t"), "account_ref").distinct()
    hits = texts.join(F.broadcast(rules), F.expr("_t rlike concat('(?iu)', match) and (account is null or account = account_ref)")).select("stem", "commitment_id", "_t", "account_ref").distinct()
    whole = texts.groupBy("stem").agg(F.count("*").alias("_n"))
    covered = hits.groupBy("stem", "commitment_id").agg(F.count("*").alias("_n")).join(whole, ["stem", "_n"]).select("stem")
    return left.join(covered, "stem", "left_anti")
