"""Transfer matching: each leg, in order of date and number, looks for its one counterpart on a ladder of tiers.

Legs of equal amount and currency in two accounts are candidates for each other if their signs differ and they lie within the window:

* T1: the same receipt (not blank).  One candidate is taken; several hold the leg.
* T2: the same day.  T3: another day of the window.  One candidate is taken if the leg is its only one too; otherwise the leg is held.
  Only without any candidate does a leg go on to the next tier.

A held leg stays in the pool, so that a later leg may still take it.  A leg whose text names a clearing account goes to that account when
its turn comes.  A leg's fate hangs on the legs before it, so one amount's legs are walked in order; but never further than two windows
ahead, so what a task holds is bounded by the legs of that many days, and counts by day, sign and account make each step's work
independent of how many legs have the amount.  Gaps longer than the window part independent walks, which are dealt to tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from datetime import date, timedelta
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.identity import transfer_id
from tallyforge.session import find_package

WINDOW_DAYS = 4
#: What happened to a leg: taken with another at a tier, gone to its clearing account, or held with several candidates.
CLEARING, HELD = "CLEARING", "HELD"


class _Pool:
    """Open legs near the walk: by day, sign and account, and by receipt."""

    def __init__(self) -> None:
        self.days: dict[date, tuple[dict, dict]] = {}
        self.receipts: dict[str, dict[int, dict]] = {}

    def add(self, leg: dict) -> None:
        self.days.setdefault(leg["date"], ({}, {}))[leg["amount"] > 0].setdefault(leg["account_ref"], {})[leg["n"]] = leg
        if leg["receipt"]:
            self.receipts.setdefault(leg["receipt"], {})[leg["n"]] = leg

    def remove(self, leg: dict) -> None:
        side = self.days[leg["date"]][leg["amount"] > 0]
        own = side[leg["account_ref"]]
        if own.pop(leg["n"], None) is not None and not own:
            del side[leg["account_ref"]]
        if leg["receipt"]:
            self.receipts.get(leg["receipt"], {}).pop(leg["n"], None)

    def forget(self, before: date) -> None:
        for day in [d for d in self.days if d < before]:
            for side in self.days.pop(day):
                for own in side.values():
                    for leg in own.values():
                        if leg["receipt"]:
                            self.receipts.get(leg["receipt"], {}).pop(leg["n"], None)

    def on(self, leg: dict, days: Iterable[date]) -> Iterator[dict]:
        """Open legs of the other sign in other accounts on these days."""
        for day in days:
            if day in self.days:
                for account, own in self.days[day][leg["amount"] < 0].items():
                    if account != leg["account_ref"]:
                        yield from own.values()

    def sharing(self, leg: dict, window: int) -> list[dict]:
        """Open legs of the leg's receipt that could be its counterpart."""
        if not leg["receipt"]:
            return []
        return [b for b in self.receipts.get(leg["receipt"], {}).values() if b["account_ref"] != leg["account_ref"] and (b["amount"] > 0) != (leg["amount"] > 0) and abs((b["date"] - leg["date"]).days) <= window]


def settle_legs(legs: Iterable[dict], window: int = WINDOW_DAYS) -> Iterator[tuple[dict, dict | None, str, str | None, list[dict]]]:
    """(leg, other, fate, tier, candidates) of one amount's and currency's legs, which come in date and number order."""
    pool, ahead, source, taken = _Pool(), deque(), iter(legs), set()
    near = [timedelta(days=k) for k in range(-window, window + 1) if k]
    coming = next(source, None)
    while coming is not None or ahead:
        if not ahead:
            ahead.append(coming)
            pool.add(coming)
            coming = next(source, None)
        leg = ahead[0]
        while coming is not None and coming["date"] <= leg["date"] + timedelta(days=2 * window):
            ahead.append(coming)
            pool.add(coming)
            coming = next(source, None)
        ahead.popleft()
        if leg["n"] in taken:
            taken.discard(leg["n"])
            continue
        pool.forget(leg["date"] - timedelta(days=2 * window))
        if leg["clearing"] is not None:
            pool.remove(leg)
            yield leg, None, CLEARING, None, []
            continue
        for tier in ("T1", "T2", "T3"):
            days = lambda x, t=tier: [x["date"]] if t == "T2" else [x["date"] + k for k in near]
            if tier == "T1":
                found = pool.sharing(leg, window)
                mutual = len(found) == 1
            else:
                some = pool.on(leg, days(leg))
                found = [x for x, _ in zip(some, range(2), strict=False)]
                if len(found) > 1:
                    found = list(pool.on(leg, days(leg)))
                mutual = len(found) == 1 and sum(1 for _ in zip(pool.on(found[0], days(found[0])), range(2), strict=False)) == 1
            if mutual:
                pool.remove(leg)
                pool.remove(found[0])
                # A leg before this one that was held is past; one to come is skipped at its turn.
                if (found[0]["date"], found[0]["n"]) > (leg["date"], leg["n"]):
                    taken.add(found[0]["n"])
                yield leg, found[0], tier, tier, []
                break
            if found:
                yield leg, None, HELD, tier, found
                break


_OUT = "n bigint, other_n bigint, from_id string, to_id string, fate string, tier string, receipt string, other_receipt string, at date, candidates string"


def walk(facts: DataFrame, window: int = WINDOW_DAYS) -> DataFrame:
    """Fates of the legs that are not simply held: pairs, legs gone to a clearing account, legs held with several candidates.

    ``facts`` has n, external_id, account_ref, date, amount, receipt, currency and clearing (the account that the leg's text names, or null).
    """
    find_package(facts.sparkSession)
    by_amount = Window.partitionBy("_a", "currency").orderBy("date", "n")
    legs = facts.withColumn("_a", F.abs("amount")).withColumn("receipt", F.when(F.trim("receipt") != "", F.col("receipt")))
    gap = F.datediff("date", F.lag("date").over(by_amount)) > window
    # A zero has no sign, so it is nobody's counterpart; only its clearing account could take it.
    legs = legs.where((F.col("amount") != 0) | F.col("clearing").isNotNull()).withColumn("_g", F.sum(F.when(gap, 1).otherwise(0)).over(by_amount))
    legs = legs.select("n", "external_id", "account_ref", "date", "amount", "receipt", "clearing", "_a", "currency", "_g")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.date32(), pa.string())
    names = [f.split()[0] for f in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        out: list[tuple] = []
        for _, group in groupby(rows, key=lambda r: (r["_a"], r["currency"], r["_g"])):
            for leg, other, fate, tier, found in settle_legs(group, window):
                ids = ",".join(sorted(x["external_id"] for x in found)) if found else None
                out.append((leg["n"], other and other["n"], leg["external_id"], other["external_id"] if other else leg["clearing"], fate, tier, leg["receipt"], other and other["receipt"], leg["date"], ids))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)
                    out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    # Walks stand whole and sorted in their partition, and are read one after the other.
    return legs.repartition("_a", "currency", "_g").sortWithinPartitions("_a", "currency", "_g", "date", "n").mapInArrow(run, _OUT)


def named(pairs: DataFrame, order: list[Column | str]) -> DataFrame:
    """``pairs`` (from_id, to_id, receipt, other_receipt) with transfer ids: the first, by ``order``, that wants a receipt's id has it.

    Later ones take the hash of their legs; two of the same hash are a broken invariant, which raises.
    """
    same = F.when(F.col("receipt") == F.col("other_receipt"), F.col("receipt"))
    wanted, hashed = transfer_id(F.col("from_id"), F.col("to_id"), same), transfer_id(F.col("from_id"), F.col("to_id"))
    first = F.row_number().over(Window.partitionBy("_w").orderBy(*order)) == 1
    out = pairs.withColumn("_w", wanted).withColumn("transfer_id", F.when(first, F.col("_w")).otherwise(hashed))
    twice = F.count("*").over(Window.partitionBy("transfer_id")) > 1
    return out.withColumn("transfer_id", F.when(twice, F.raise_error(F.concat(F.lit("two transfers are called "), F.col("transfer_id")))).otherwise(F.col("transfer_id"))).drop("_w")


def match(facts: DataFrame, window: int = WINDOW_DAYS) -> DataFrame:
    """Pairs of legs with their tier and transfer id."""
    pairs = walk(facts, window).where(F.col("other_n").isNotNull())
    return named(pairs, ["at", "n"]).select(F.col("n").alias("from_n"), F.col("other_n").alias("to_n"), "tier", "transfer_id")
