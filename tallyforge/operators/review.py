"""What a person should look at: look-alike rows, restatements, rows that a source changed, legs without a counterpart, and what was dismissed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import clean, stem, tokens
from tallyforge.session import cut, find_package


def dup_clusters(rows: DataFrame, tolerance: int = 0) -> DataFrame:
    """(subject, members): unpaired rows of one account, day, stem and sign whose sorted amounts follow each other within the tolerance."""
    keys = ["account_ref", "date", "stem", "negative"]
    order = Window.partitionBy(*keys).orderBy("amount", "n")
    free = rows.where(F.col("leg") != "MATCHED").withColumn("stem", stem(F.col("raw_description"))).withColumn("negative", F.col("amount") < 0)
    apart = F.coalesce(F.col("amount") - F.lag("amount").over(order) > tolerance, F.lit(True))
    islands = free.withColumn("_i", F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return _clusters(islands.groupBy(*keys, "_i"))


def _clusters(grouped) -> DataFrame:
    got = grouped.agg(F.array_sort(F.collect_set("external_id")).alias("members")).where(F.size("members") > 1)
    return got.select(F.element_at("members", 1).alias("subject"), "members")


def restatement_clusters(rows: DataFrame, overlap: float = 0.5) -> DataFrame:
    """(subject, members): unpaired rows of one account, day and amount whose differing stems are similar, by chains of such likeness.

    Stems are compared, not rows: a stem that is like another takes all its rows along, one that is like none leaves them out.
    """
    find_package(rows.sparkSession)
    keys = ["account_ref", "date", "amount"]
    free = cut(rows.where(F.col("leg") != "MATCHED").select("external_id", *keys, stem(F.col("raw_description")).alias("stem"), tokens(F.col("raw_description")).alias("words")))
    groups = free.groupBy(*keys, "stem").agg(F.first("words").alias("words")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("stem", "words"))).alias("s")).where(F.size("s") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, stems in enumerate(batch.column(3).to_pylist()):
                above = list(range(len(stems)))
                linked = set()

                def top(x: int, above: list[int] = above) -> int:
                    while above[x] != x:
                        above[x] = x = above[above[x]]
                    return x

                # Only stems that share a word can be alike.
                by_word: dict[str, list[int]] = {}
                sets = [set(s["words"]) for s in stems]
                for x, words in enumerate(sets):
                    near = {y for w in words for y in by_word.get(w, ())}
                    for y in near:
                        if len(words & sets[y]) >= overlap * min(len(words), len(sets[y])):
                            above[max(top(x), top(y))] = min(top(x), top(y))
                            linked |= {x, y}
                    for w in words:
                        by_word.setdefault(w, []).append(x)
                out += [(i, stems[x]["stem"], top(x)) for x in sorted(linked)]
            at = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int32())], names=[*keys, "stem", "_c"])

    found = groups.mapInArrow(run, "account_ref string, date date, amount bigint, stem string, _c int")
    return _clusters(free.join(found, [*keys, "stem"]).groupBy(*keys, "_c"))


def re_observations(current: DataFrame, facts: DataFrame) -> DataFrame:
    """(subject, kind, detail) of current ids that were posted more than once with other words or amounts, or only another balance."""
    posted = facts.where(F.col("observation") == "posted").join(current.select("external_id"), "external_id", "left_semi")
    got = posted.groupBy("external_id").agg(F.count("*").alias("_n"), F.countDistinct("amount", "raw_description").alias("_c"), F.countDistinct("balance").alias("_b"), F.array_sort(F.collect_list(F.struct("n", "amount", clean(F.col("raw_description")).alias("t"), "balance"))).alias("o"))
    kind = F.when(F.col("_c") > 1, "RESTATEMENT").when(F.col("_b") > 1, "POTENTIAL_DUP")
    said = F.transform("o", lambda x: F.concat(F.lit("n"), x["n"].cast("string"), F.lit(" "), x["amount"].cast("string"), F.when(F.col("_c") > 1, F.concat(F.lit(" "), x["t"])).otherwise(F.concat(F.lit(" bal "), x["balance"].cast("string")))))
    text = F.concat(F.lit("re-observed: "), F.array_join(said, "  /  "))
    clipped = F.when(F.length(text) <= 140, text).otherwise(F.concat(F.substring(text, 1, 139), F.lit("…")))
    return got.where((F.col("_n") > 1) & kind.isNotNull()).select(F.col("external_id").alias("subject"), kind.alias("kind"), clipped.alias("detail"))


def items(current: DataFrame, facts: DataFrame, waiting: DataFrame, broken: DataFrame, ambiguous: DataFrame, candidates: DataFrame, silent: DataFrame, behind: DataFrame, without_effect: DataFrame, as_of: str, hold: int = 30, tolerance: int = 0) -> DataFrame:
    """One row for each (subject, kind) of the eleven kinds.

    ``waiting`` are pending rows (external_id, state, candidates), ``broken`` accounts (account_ref), ``ambiguous`` held legs with candidates
    (external_id), ``candidates`` series (stem, status), ``silent`` and ``behind`` commitments (commitment_id; count), ``without_effect``
    decisions (decision_n).  A cluster and a changed observation of one id and kind are one item.
    """
    row = lambda df, kind, subject: df.select(F.col(subject).cast("string").alias("subject"), F.lit(kind).alias("kind"))
    now = F.lit(as_of).cast("date")
    parts = [
        row(dup_clusters(current, tolerance), "POTENTIAL_DUP", "subject"), row(restatement_clusters(current), "RESTATEMENT", "subject"), re_observations(current, facts).select("subject", "kind"),
        row(current.where((F.col("leg") == "HELD") & (F.datediff(now, "date") > hold)), "UNMATCHED_LEG", "external_id"), row(ambiguous, "AMBIGUOUS_TRANSFER", "external_id"),
        row(waiting.where(F.col("candidates").isNotNull()), "AMBIGUOUS_SETTLEMENT", "external_id"), row(waiting.where(F.col("state") == "STALE"), "STALE_PENDING", "external_id"), row(broken, "BALANCE_BREAK", "account_ref"),
        row(candidates.where(F.col("status") != "ended"), "SUSPECTED_RECURRING", "stem"), row(silent, "DORMANT_COMMITMENT", "commitment_id"), row(behind.where(F.col("count") > 0), "COMMITMENT_ARREARS", "commitment_id"), row(without_effect, "INEFFECTIVE_DECISION", "decision_n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def undismissed(found: DataFrame, decisions: DataFrame, ids: DataFrame, newest: DataFrame) -> DataFrame:
    """Items without those that a person dismissed after their subject's newest fact; decisions without effect can't be dismissed.

    ``newest`` has (subject, kind, n): the newest fact of each subject, by kind; a null kind holds for every kind.
    """
    said = decisions.where(F.col("action") == "DISMISS").join(ids.select(F.col("id").alias("id1"), "current_id"), "id1", "left")
    own = F.col("ref").isin("BALANCE_BREAK", "SUSPECTED_RECURRING", "DORMANT_COMMITMENT", "COMMITMENT_ARREARS")
    last = said.select(F.when(own, F.col("id1")).otherwise(F.col("current_id")).alias("subject"), F.col("ref").alias("kind"), "n").where(F.col("subject").isNotNull()).groupBy("subject", "kind").agg(F.max("n").alias("_d"))
    facts = newest.groupBy("subject").agg(F.max("n").alias("_n"))
    judged = found.join(last, ["subject", "kind"], "left").join(facts, "subject", "left")
    return judged.where((F.col("kind") == "INEFFECTIVE_DECISION") | F.col("_d").isNull() | (F.col("_d") <= F.coalesce("_n", F.lit(0)))).drop("_d", "_n")


def rule_stats(rows: DataFrame, rules: list[tuple[str, object]]) -> DataFrame:
    """For each rule (category, column), in order: rows that it takes, their stems and total, rows that it would take if an earlier one
    didn't, and the first of those.  One pass: every row has the array of rules that fit it."""
    fits = F.array(*[F.when(c, F.lit(i + 1)) for i, (_, c) in enumerate(rules)])
    hit = rows.withColumn("_f", F.filter(fits, lambda x: x.isNotNull())).where(F.size("_f") > 0).withColumn("stem", stem(F.col("raw_description")))
    each = hit.select("stem", "amount", F.element_at("_f", 1).alias("_w"), F.explode("_f").alias("rule"))
    won = F.col("rule") == F.col("_w")
    return each.groupBy("rule").agg(F.count_if(won).alias("hits"), F.countDistinct(F.when(won, F.col("stem"))).alias("merchants"), F.coalesce(F.sum(F.when(won, F.col("amount"))), F.lit(0)).alias("total"), F.count_if(~won).alias("shadowed"), F.min(F.when(~won, F.col("_w"))).alias("shadowed_by"))


def trend(rows: DataFrame) -> DataFrame:
    """Rows by month and by what gave their category."""
    of = lambda o: F.count_if(F.col("origin") == o)
    return rows.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(of("RULE").alias("rule"), of("PIN").alias("pin"), of("NONE").alias("none"))


def suggestions(rows: DataFrame) -> DataFrame:
    """Stems without a category: rows, total, days and accounts, most rows first by those who read it."""
    free = rows.where(F.col("origin") == "NONE").withColumn("stem", stem(F.col("raw_description")))
    return free.groupBy("stem").agg(F.count("*").alias("rows"), F.sum("amount").alias("total"), F.min("date").alias("first"), F.max("date").alias("last"), F.array_join(F.array_sort(F.collect_set("account_ref")), ",").alias("accounts"))
