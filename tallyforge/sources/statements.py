"""Bank statement files as rows (file, line, date, amount, balance, raw_description, receipt), amounts in cents.

A file with any bad row is rejected whole: ``accepted`` leaves it out and ``rejected`` names it with its bad lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import cents, clean, strip

ING = "date string, description string, credit string, debit string, balance string"
BW = "bsb string, number string, date string, description string, cheque string, debit string, credit string, balance string, kind string"
CBA = "date string, amount string, description string, balance string"


def _read(spark: SparkSession, path: str, schema: str, header: bool) -> DataFrame:
    fields = spark.read.csv(path, schema=schema + ", _bad string", header=header, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=not header)
    # A quoted file is read by one task, in order, so the numbers follow its lines.
    return fields.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))


def _day(text: Column) -> Column:
    """A strict dd/MM/yyyy date, or null."""
    return F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(text, F.lit("dd/MM/yyyy"))).cast("date")


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def ing_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headed files of date, description, credit, debit (at most 0) and balance; the receipt is in the description."""
    rows = _read(spark, path, ING, True)
    credit, debit = [F.when(_blank(F.col(c)), F.lit(0)).otherwise(cents(F.col(c))) for c in ("credit", "debit")]
    receipt = F.regexp_extract("description", r"Receipt (No )?(\d+)", 2)
    out = rows.select("file", "line", _day(F.col("date")).alias("date"), (credit + debit).cast("bigint").alias("amount"), cents(F.col("balance")).alias("balance"), F.col("description").alias("raw_description"), F.when(receipt != "", receipt).alias("receipt"), "_bad", (debit <= 0).alias("_sign"))
    return _judged(out, F.col("_sign"))


def cba_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headless files of date, signed amount, description and balance; no receipts."""
    rows = _read(spark, path, CBA, False)
    out = rows.select("file", "line", _day(F.col("date")).alias("date"), cents(F.col("amount")).alias("amount"), cents(F.col("balance")).alias("balance"), F.col("description").alias("raw_description"), F.lit(None).cast("string").alias("receipt"), "_bad")
    return _judged(out, F.lit(True))


def bw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headed files of nine columns; debits are all positive or all negative in one file, and a file that mixes them is rejected.

    Each row has a debit or a credit, and the debit's sign is its file's; a narration that begins with AUTHORISATION ONLY is pending.
    """
    rows = _read(spark, path, BW, False)
    first = Window.partitionBy("file")
    rows = rows.withColumn("_head", F.col("line") == F.min("line").over(first))
    names = F.concat_ws(",", *[F.col(c) for c in ("bsb", "number", "date", "description", "debit", "credit", "balance", "kind")])
    headed = F.max(F.col("_head") & (names == "BSB Number,Account Number,Transaction Date,Narration,Debit,Credit,Balance,Transaction Type") & F.col("cheque").isin("Cheque", "Cheque Number")).over(first)
    body = rows.withColumn("_named", headed).where(~F.col("_head"))
    debit, credit = F.coalesce("debit", F.lit("")), F.coalesce("credit", F.lit(""))
    below = F.max(debit.startswith("-")).over(first)
    above = F.max((debit != "") & ~debit.startswith("0") & ~debit.startswith("-")).over(first)
    body = body.withColumn("_below", below).withColumn("_mixed", below & above)
    one = _blank(F.col("debit")) != _blank(F.col("credit"))
    d, c = cents(F.col("debit")), cents(F.col("credit"))
    sound = one & (_blank(F.col("debit")) | (d.isNotNull() & F.when(F.col("_below"), d <= 0).otherwise(d >= 0))) & (_blank(F.col("credit")) | (c.isNotNull() & (c >= 0)))
    amount = F.coalesce(c, F.lit(0)) + F.when(F.col("_below"), F.coalesce(d, F.lit(0))).otherwise(-F.coalesce(d, F.lit(0)))
    pending = F.upper(F.regexp_replace("description", r"^\s+", "")).startswith("AUTHORISATION ONLY")
    out = body.select("file", "line", _day(F.col("date")).alias("date"), F.when(sound, amount).cast("bigint").alias("amount"), cents(F.col("balance")).alias("balance"), F.col("description").alias("raw_description"), F.lit(None).cast("string").alias("receipt"), F.when(pending, "pending").otherwise("posted").alias("observation"), "_bad", (F.col("_named") & ~F.col("_mixed")).alias("_sign"))
    return _judged(out, F.col("_sign"))


def cba_text(spark: SparkSession, path: str) -> DataFrame:
    """Texts taken from statements: rows stand between a table's heading and a footer, and other lines there go on with the row above."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n", -1)).alias("line", "_raw"))
    lines = files.withColumn("_t", strip(F.col("_raw"))).where(F.col("_t") != "")
    mark = F.when(F.col("_t").rlike(r"^Date\s+Transaction details"), "table").when(F.col("_t").rlike(r"^(Created \d{2}/\d{2}/\d{2}|Any pending transactions)"), "foot")
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    inside = lines.withColumn("_mark", mark).withColumn("_in", F.last("_mark", ignorenulls=True).over(order)).where((F.col("_in") == "table") & F.col("_mark").isNull())
    row = r"^(\d{2} [A-Za-z]{3} \d{4})\s+(.+?)\s+(-?\$[\d,]+\.\d{2})\s+(-?\$[\d,]+\.\d{2})$"
    inside = inside.withColumn("_is", F.col("_t").rlike(row)).withColumn("_row", F.sum(F.col("_is").cast("int")).over(order)).where(F.col("_row") > 0)
    part = lambda i: F.regexp_extract("_t", row, i)
    money = lambda i: cents(F.regexp_replace(part(i), "[$,]", ""))
    said = F.when(F.col("_is"), part(2)).otherwise(F.col("_t"))
    each = inside.select("file", "_row", "line", "_is", said.alias("_said"), F.when(F.col("_is"), F.struct(F.try_to_timestamp(part(1), F.lit("dd MMM yyyy")).cast("date").alias("date"), money(3).alias("amount"), money(4).alias("balance"))).alias("_v"))
    whole = each.groupBy("file", "_row").agg(F.min("line").alias("line"), F.max_by("_v", F.col("_is")).alias("v"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "_said"))), lambda x: x["_said"]), " ").alias("_text"))
    out = whole.select("file", "line", F.col("v.date").alias("date"), F.col("v.amount").alias("amount"), F.col("v.balance").alias("balance"), clean(F.col("_text")).alias("raw_description"), F.lit(None).cast("string").alias("receipt"), F.lit(None).cast("string").alias("_bad"))
    return _judged(out, F.lit(True))


#: Readers by the name of their format; texts of statements have no mark of their own that a csv could have.
READERS = {"ing-csv": ing_csv, "cba-csv": cba_csv, "bw-csv": bw_csv, "cba-text": cba_text}


def detect(spark: SparkSession, path: str) -> DataFrame:
    """(file, format) for each format whose reader finds rows in the file and no bad one; none or several leave the choice to a person."""
    found = [accepted(read(spark, path)).select("file").distinct().withColumn("format", F.lit(name)) for name, read in READERS.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _judged(rows: DataFrame, also: Column) -> DataFrame:
    good = F.col("_bad").isNull() & F.col("date").isNotNull() & F.col("amount").isNotNull() & F.col("balance").isNotNull() & F.coalesce(also, F.lit(False))
    return rows.withColumn("good", good).drop("_bad", "_sign")


def accepted(rows: DataFrame) -> DataFrame:
    whole = F.min("good").over(Window.partitionBy("file"))
    return rows.withColumn("_whole", whole).where("_whole").drop("_whole", "good")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("good")).groupBy("file").agg(F.count("*").alias("bad_rows"), F.min("line").alias("first_bad"))
