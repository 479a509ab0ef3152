"""What a file says when it is read again, beside what it said: rows that stay, that have a new id, that are new, and that are gone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import tokens
from tallyforge.session import cut, find_package


def _shifts(before: list[dict], after: list[dict]) -> Iterator[tuple[str, str]]:
    """(new id, old id) of one account, day and amount: each new row, in order, takes the first free old row of its text, or else of a like text."""
    taken: set[str] = set()
    for x in after:
        free = [p for p in before if p["id"] not in taken]
        same = next((p for p in free if p["text"] == x["text"]), None)
        words = set(x["words"])
        like = same or next((p for p in free if words and p["words"] and 2 * len(words & set(p["words"])) >= min(len(words), len(p["words"]))), None)
        if like is not None:
            taken.add(like["id"])
            yield x["id"], like["id"]


def diff(facts: DataFrame, closed: DataFrame, candidates: DataFrame) -> DataFrame:
    """(kind, external_id, old_id): MATCHED, SHIFTED (the same row under a new id), NEW or MISSING.

    ``facts`` are the file's current rows (external_id, account_ref, date, amount, raw_description), ``closed`` ids (external_id) that were replaced or retired,
    ``candidates`` the rows that it has now, with the ids that they would get, and n.  Rows of one account, day and amount are compared
    among themselves only; of those, the ones without a match by id.
    """
    find_package(facts.sparkSession)
    keys = ["account_ref", "date", "amount"]
    before, candidates = cut(facts.join(closed.select("external_id"), "external_id", "left_anti")), cut(candidates)
    same = cut(candidates.select("external_id").join(before.select("external_id"), "external_id", "left_semi").distinct())
    face = lambda df, place: df.join(same, "external_id", "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(place.alias("o"), F.col("external_id").alias("id"), F.col("raw_description").alias("text"), tokens(F.col("raw_description")).alias("words")))).alias("r"))
    groups = face(before, F.col("external_id")).withColumnRenamed("r", "before").join(face(candidates, F.col("n")).withColumnRenamed("r", "after"), keys).select("before", "after")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pair for b, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for pair in _shifts(b, a)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["external_id", "old_id"])

    moved = cut(groups.mapInArrow(run, "external_id string, old_id string"))
    row = lambda df, kind, old: df.select(F.lit(kind).alias("kind"), "external_id", old.alias("old_id"))
    none = F.lit(None).cast("string")
    fresh = candidates.select("external_id").join(same, "external_id", "left_anti").join(moved.select("external_id"), "external_id", "left_anti")
    gone = before.select("external_id").join(same, "external_id", "left_anti").join(moved.select(F.col("old_id").alias("external_id")), "external_id", "left_anti")
    return row(same, "MATCHED", F.col("external_id")).unionByName(row(moved, "SHIFTED", F.col("old_id"))).unionByName(row(fresh, "NEW", none)).unionByName(row(gone, "MISSING", F.col("external_id")))
