"""Stable identities: hashes over the canonical text of what they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _short(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def natural_key(account: Column, date: Column, receipt: Column) -> Column:
    return _short(F.lit("nk"), account, date.cast("string"), receipt)


def content_hash(account: Column, date: Column, amount: Column, raw: Column, occ: Column) -> Column:
    return _short(F.lit("ch"), account, date.cast("string"), amount.cast("string"), raw, occ.cast("string"))


def transfer_id(a: Column, b: Column, receipt: Column | None = None) -> Column:
    by_legs = F.concat(F.lit("TRF-"), _short(F.lit("tr"), F.least(a, b), F.greatest(a, b)))
    return by_legs if receipt is None else F.when(receipt.isNotNull(), F.concat(F.lit("TRF-"), receipt)).otherwise(by_legs)


def candidate_id(stem: Column) -> Column:
    return F.concat(F.lit("cand|"), _short(F.lit("cand"), stem))


def state_hash(*fields: Column) -> Column:
    """Nulls count as empty texts, so that every field keeps its place."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *[_text(f) for f in fields]), 256))


def mint(rows: DataFrame) -> DataFrame:
    """``rows`` (account_ref, date, amount, raw_description, receipt, n) with external_id and occ.

    A receipt names its row if all rows of its account and day say the same under it; other rows are named by their content
    and their running number among the rows of equal content.
    """
    receipt = Window.partitionBy("account_ref", "date", "receipt")
    # Equal content has equal smallest and largest hashes, so no set is gathered for a receipt.
    content = F.sha2(F.concat_ws("|", F.col("amount").cast("string"), F.col("raw_description")), 256)
    marked = rows.withColumn("_c", content)
    marked = marked.withColumn("_nk", F.col("receipt").isNotNull() & (F.min("_c").over(receipt) == F.max("_c").over(receipt)))
    order = Window.partitionBy("account_ref", "date", "amount", "raw_description", "_nk").orderBy("n")
    occ = F.when(F.col("_nk"), 0).otherwise(F.row_number().over(order) - 1)
    named = marked.withColumn("occ", occ)
    key = F.when(F.col("_nk"), natural_key(F.col("account_ref"), F.col("date"), F.col("receipt"))).otherwise(content_hash(F.col("account_ref"), F.col("date"), F.col("amount"), F.col("raw_description"), F.col("occ")))
    return named.withColumn("external_id", key).drop("_c", "_nk")
