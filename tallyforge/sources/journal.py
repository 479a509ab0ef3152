"""The journal: one JSON object a line, numbered without gaps.  Scans, replays up to the first bad line, evidence, and cursors of feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEAD = "n bigint, kind string, v int, at_ms bigint, account_ref string, external_id string, action string, target bigint"
KINDS = ("fact", "decision", "ingest")


def scan(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """Lines of plain or gz files from number ``since`` on, with their raw text.

    Lines of unknown kinds are left out; a line that is no object, or of a known kind in a later version, raises.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", HEAD, {"mode": "PERMISSIVE"}).alias("j"))
    broken = F.col("j.n").isNull() | F.col("j.kind").isNull()
    later = F.col("j.kind").isin(*KINDS) & (F.coalesce("j.v", F.lit(1)) > 1)
    checked = F.when(broken | later, F.raise_error(F.concat(F.lit("unreadable journal line: "), F.substring("value", 1, 80)))).otherwise(F.col("j.n"))
    return lines.where(broken | F.col("j.kind").isin(*KINDS)).withColumn("_n", checked).where(F.col("_n") >= since).select("j.*", F.col("value").alias("raw"))


def replay(lines: DataFrame, head: int, accounts: DataFrame, known: DataFrame) -> DataFrame:
    """Offered lines (place, raw), from the head on, each with its verdict: landed, the first bad one's reason, or behind it.

    A line has to be an object of a known kind, its number the next, a fact's account known, and a revoke's target a decision before it.
    The numbers must follow each other, so each line's own is known from its place; only the first bad place crosses tasks.
    """
    rows = lines.withColumn("j", F.from_json("raw", HEAD)).withColumn("_want", F.lit(head) + 1 + F.col("place"))
    rows = rows.join(F.broadcast(accounts.select(F.col("ref").alias("_acct"), F.lit(True).alias("_known"))), F.col("j.account_ref") == F.col("_acct"), "left")
    before = rows.where(F.col("j.kind") == "decision").select(F.col("j.n").alias("_t"), F.col("place").alias("_tp")).unionByName(known.select(F.col("n").alias("_t"), F.lit(-1).cast("bigint").alias("_tp"))).groupBy("_t").agg(F.min("_tp").alias("_tp"))
    rows = rows.join(before, F.col("j.target") == F.col("_t"), "left")
    reason = F.when(F.col("j.n").isNull(), "unparseable").when(~F.coalesce(F.col("j.kind").isin(*KINDS), F.lit(False)), "unknown kind").when(F.col("j.n") != F.col("_want"), "breaks contiguity")
    reason = reason.when((F.col("j.kind") == "fact") & F.col("_known").isNull(), "unknown account").when((F.col("j.kind") == "fact") & (F.trim(F.coalesce("j.external_id", F.lit(""))) == ""), "no id")
    reason = reason.when((F.col("j.action") == "REVOKE") & (F.col("_tp").isNull() | (F.col("_tp") >= F.col("place"))), "unknown decision")
    judged = rows.withColumn("reason", reason)
    first = judged.where(F.col("reason").isNotNull()).agg(F.min("place").alias("_first"))
    cut = F.coalesce("_first", F.lit(2**62))
    # One row, the first bad place, meets every line.
    out = judged.join(F.broadcast(first))
    return out.select("place", F.col("j.n").alias("n"), F.when(F.col("place") < cut, "landed").when(F.col("place") == cut, F.col("reason")).otherwise("behind").alias("verdict"))


def verify_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Blobs that are named by their hash: (file, name, ok)."""
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return blobs.select(F.col("path").alias("file"), name.alias("name"), (F.sha2("content", 256) == name).alias("ok"))


def run_feed(read: Callable[[str | None], tuple[DataFrame, str]], cursor: str | None, land: Callable[[DataFrame], None]) -> str | None:
    """Pull a feed's next page and land it by whole days of an account; the new cursor, which counts only once all has landed."""
    page, after = read(cursor)
    if not page.limit(1).count():
        return cursor
    land(page.repartition("account_ref", "date").sortWithinPartitions("account_ref", "date"))
    return after


def day_batches(drafts: DataFrame) -> DataFrame:
    """Rows with the number of their (account, day) batch, in order of its first row: a batch is whole, so its ids can be minted."""
    first = drafts.groupBy("account_ref", "date").agg(F.min("n").alias("_f"), F.count("*").alias("batch_rows"))
    numbered = first.withColumn("batch", F.row_number().over(Window.partitionBy("account_ref").orderBy("_f")) - 1).drop("_f")
    return drafts.join(numbered, ["account_ref", "date"])
