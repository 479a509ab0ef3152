"""Descriptions of transactions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a description's merchant ends, and words of payment networks.
TAIL = " - Visa Purchase| - Receipt| {3,}"
PAYMENT_NOISE = ("VISA", "EFTPOS", "POS", "AUTHORISATION", "AUTHORIZATION", "DEBIT", "CREDIT", "PURCHASE", "CARD", "PAYMENT", "RECEIPT", "WITHDRAWAL", "DEPOSIT", "TRANSACTION")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Stripped, with runs of white space made one space."""
    return F.regexp_replace(strip(text), r"\s+", " ")


def stem(text: Column) -> Column:
    """The merchant part in upper case; empty for null."""
    head = F.element_at(F.split(strip(F.coalesce(text, F.lit(""))), TAIL, 2), 1)
    return F.upper(clean(head))


def tokens(text: Column) -> Column:
    """Distinct words of a stem: three letters or more, without payment words."""
    words = F.split(F.regexp_replace(stem(text), "[^A-Z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: w.rlike("^[A-Z]{3,}$") & ~w.isin(*PAYMENT_NOISE)))


def similar(a: Column, b: Column, least: float) -> Column:
    """Overlap coefficient of two token arrays at or above ``least``; false if either is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return (smaller > 0) & (F.size(F.array_intersect(a, b)) >= least * smaller)


def cents(text: Column) -> Column:
    """Exact cents of a decimal text with optional thousands commas; null if it isn't one of at most two decimals."""
    value = F.expr("null").cast("decimal(20,4)") if text is None else F.regexp_replace(strip(text), ",", "").try_cast("decimal(20,4)")
    return F.when((value * 100) == F.floor(value * 100), (value * 100).cast("bigint"))


def foreign_amount(text: Column) -> Column:
    """Minor units of a foreign currency amount in the text; null if there is none."""
    value = F.regexp_extract(text, r"Foreign Currency Amount:\s*[A-Z]{3}\s*(-?\d+(\.\d+)?)", 1)
    return F.when(value != "", F.round(value.try_cast("decimal(20,6)") * 100, 0).cast("bigint"))


def drift(shipped: Column, base: Column, current: Column) -> Column:
    """How a configuration file stands to what was shipped and to what it was before: null is a file that isn't there."""
    out = F.when(shipped.isNull(), "unknown").when(current.eqNullSafe(shipped), "same").when(base.isNull(), "unknown")
    return out.when(current.eqNullSafe(base), "repo-newer").when(shipped == base, "edited-here").otherwise("both-changed")


def risky(regex: Column) -> Column:
    """Whether a regular expression may run away: a repeated group that repeats inside, or repeated ``.*`` side by side."""
    nested = regex.rlike(r"\([^)]*[*+][^)]*\)[*+]|\([^)]*\{\d*,?\d*\}[^)]*\)[*+]")
    return F.coalesce(nested | regex.rlike(r"(\.\*){2,}|(\.\+){2,}"), F.lit(False))


def restatement(a: Column, b: Column, least: float) -> Column:
    """Whether two texts name one thing in other words: their stems differ and their words overlap."""
    return (stem(a) != stem(b)) & similar(tokens(a), tokens(b), least)
