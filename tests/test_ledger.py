"""Identities, texts, the transfer ladder and the queries' SQL."""

import datetime as dt
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import identity, text
from tallyforge.operators import decisions, guard, ladder, reads
from tallyforge.plans import registry
from tallyforge.sources import statements

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_golden_identities(spark):
    day = F.lit("2026-09-01").cast("date")
    assert one(spark, identity.natural_key(F.lit("ing-savings"), day, F.lit("770001"))) == "c40ada46e45b99cf"
    assert one(spark, identity.content_hash(F.lit("ing-savings"), day, F.lit(-1000), F.lit("COLES 1234"), F.lit(0))) == "3a8c9062ed44fb64"
    assert one(spark, identity.transfer_id(F.lit("3a8c9062ed44fb64"), F.lit("b308d7332363a3c2"))) == "TRF-251d8227515c5ac9"


@pytest.mark.parametrize(("raw", "want"), [("  Coffee  Cart - Visa Purchase - x", "COFFEE CART"), ("Shop   Sydney", "SHOP"), (None, ""), ("a  b", "A B")])
def test_stem(spark, raw, want):
    assert one(spark, text.stem(F.lit(raw).cast("string"))) == want


def test_cents(spark):
    assert [one(spark, text.cents(F.lit(x))) for x in ("1,234.50", " -3 ", "1.005", "x")] == [123450, -300, None, None]


def leg(n, account, day, amount, receipt=None, clearing=None):
    return {"n": n, "external_id": f"x{n}", "account_ref": account, "date": dt.date(2026, 1, 1) + dt.timedelta(days=day), "amount": amount, "receipt": receipt, "clearing": clearing}


def fates(legs):
    return [(a["n"], b and b["n"], fate, sorted(x["n"] for x in found)) for a, b, fate, _, found in ladder.settle_legs(legs)]


def test_ladder_is_per_leg_not_per_tier():
    # The first leg takes the later one at T3 before that one's own day is ever looked at.
    legs = [leg(1, "a", 1, -5), leg(2, "b", 3, 5), leg(3, "a", 3, -5)]
    assert fates(legs) == [(1, 2, "T3", [])]
    assert fates(legs[:2]) == [(1, 2, "T3", [])]
    assert fates([leg(1, "a", 1, -5, "r"), leg(3, "c", 1, 5), leg(2, "b", 2, 5, "r")])[0] == (1, 2, "T1", [])


def test_two_candidates_hold_a_leg():
    same_day = [leg(1, "a", 1, -5), leg(2, "b", 1, 5), leg(3, "c", 1, 5)]
    assert fates(same_day) == [(1, None, "HELD", [2, 3]), (2, None, "HELD", [1]), (3, None, "HELD", [1])]
    receipts = [leg(1, "a", 1, -5, "r"), leg(2, "b", 1, 5, "r"), leg(3, "c", 2, 5, "r"), leg(4, "d", 1, 5)]
    assert fates(receipts)[0] == (1, None, "HELD", [2, 3])
    assert fates([leg(1, "a", 1, -5, " "), leg(2, "b", 6, 5, " ")]) == []
    assert fates([leg(1, "a", 1, -5, None, "clr"), leg(2, "b", 1, 5)]) == [(1, None, "CLEARING", [])]


def brute_fates(legs, window=4):
    """The ladder as it is written: every leg against all open ones."""
    open_, out = {x["n"] for x in legs}, []
    meets = lambda a, b: a["n"] != b["n"] and b["n"] in open_ and a["account_ref"] != b["account_ref"] and a["amount"] * b["amount"] < 0
    gap = lambda a, b: abs((a["date"] - b["date"]).days)
    tiers = (("T1", lambda a, b: a["receipt"] and a["receipt"] == b["receipt"] and gap(a, b) <= window), ("T2", lambda a, b: gap(a, b) == 0), ("T3", lambda a, b: 0 < gap(a, b) <= window))
    for a in legs:
        if a["n"] not in open_:
            continue
        if a["clearing"]:
            open_.discard(a["n"])
            out.append((a["n"], None, "CLEARING", []))
            continue
        for tier, fits in tiers:
            found = [b for b in legs if meets(a, b) and fits(a, b)]
            back = tier == "T1" or (found and len([c for c in legs if meets(found[0], c) and fits(found[0], c)]) == 1)
            if len(found) == 1 and back:
                open_ -= {a["n"], found[0]["n"]}
                out.append((a["n"], found[0]["n"], tier, []))
                break
            if found:
                out.append((a["n"], None, "HELD", sorted(b["n"] for b in found)))
                break
    return out


def test_ladder_against_brute_force():
    r = random.Random(12)
    for _ in range(400):
        legs = [leg(0, r.choice("abcd"), r.randint(0, 30), r.choice([-5, 5]), r.choice([None, None, "r", "s"]), r.choice([None] * 9 + ["clr"])) for _ in range(r.randint(1, 40))]
        legs.sort(key=lambda x: x["date"])
        legs = [{**x, "n": i, "external_id": f"x{i}"} for i, x in enumerate(legs)]
        assert fates(legs) == brute_fates(legs)


def test_ladder_walks_a_common_amount_in_time():
    # One amount, no gap between days, and two legs a day that only each other could take.
    legs = [leg(2 * i + j, "ab"[j], 5 * i, -5 if j else 5) for i in range(20_000) for j in (0, 1)]
    began = time.time()
    assert sum(fate == "T2" for _, _, fate, _, _ in ladder.settle_legs(legs)) == 20_000
    assert time.time() - began < 20


def test_two_transfers_of_one_receipt(spark):
    rows = [(1, "x1", "a", dt.date(2026, 1, 1), -5, "r"), (2, "x2", "b", dt.date(2026, 1, 1), 5, "r"), (3, "x3", "a", dt.date(2026, 3, 1), -5, "r"), (4, "x4", "b", dt.date(2026, 3, 1), 5, "r")]
    legs = spark.createDataFrame(rows, "n bigint, external_id string, account_ref string, date date, amount bigint, receipt string").withColumn("currency", F.lit("AUD")).withColumn("clearing", F.lit(None).cast("string"))
    got = {r["from_n"]: r["transfer_id"] for r in ladder.match(legs).collect()}
    assert got[1] == "TRF-r" and got[3].startswith("TRF-") and len(got[3]) == 20


def test_revokes_cancel(spark):
    rows = [(1, "PIN", 0), (2, "PIN", 0), (3, "REVOKE", 1), (4, "REVOKE", 2), (5, "REVOKE", 4)]
    assert {r["n"] for r in decisions.effective(spark.createDataFrame(rows, "n bigint, action string, target bigint")).collect()} == {2, 3, 5}


def test_revokes_at_any_depth(spark):
    def held(rows):
        known, revoked, out = {n for n, _, _ in rows}, {}, set()
        for n, action, target in sorted(rows, reverse=True):
            if action == "REVOKE" and target not in known:
                continue
            if not revoked.get(n, False):
                out.add(n)
                if action == "REVOKE":
                    revoked[target] = not revoked.get(target, False)
        return out

    r = random.Random(8)
    mixed = [(n, "PIN", 0) if n < 20 else (n, "REVOKE", r.choice([r.randint(1, n), n - 1, n - 1, 5000, n + 1])) for n in range(1, 300)]
    for rows in ([(1, "PIN", 0), (2, "REVOKE", 1), (3, "REVOKE", 2), (4, "REVOKE", 3)], [(1, "PIN", 0)] + [(n, "REVOKE", n - 1) for n in range(2, 130)], mixed):
        assert {x["n"] for x in decisions.effective(spark.createDataFrame(rows, "n bigint, action string, target bigint")).collect()} == held(rows)


def test_long_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(700)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (2000, 2000)]
    got = {r["id"]: (r["resolved"], r["hops"]) for r in decisions.chain_resolve(spark.createDataFrame(edges, "from_id bigint, to_id bigint")).collect()}
    assert got == {i: (700, 700 - i) for i in range(700)} | {i: (None, None) for i in (1000, 1001, 1002, 1003, 2000)}
    assert decisions.chain_resolve(spark.createDataFrame([], "from_id bigint, to_id bigint")).count() == 0


def test_statement_files(spark, tmp_path):
    head = "Date,Description,Credit,Debit,Balance\n"
    (tmp_path / "a.csv").write_text(head + '01/02/2026,"Coffee, ""the"" cart - Receipt 770001",,-4.50,"1,095.50"\n02/02/2026,Pay,100.00,,1195.50\n')
    (tmp_path / "b.csv").write_text(head + "31/02/2026,No such day,1.00,,1.00\n01/02/2026,Fine,1.00,,2.00\n")
    rows = statements.ing_csv(spark, str(tmp_path / "*.csv"))
    got = [(str(r["date"]), r["amount"], r["balance"], r["raw_description"], r["receipt"]) for r in statements.accepted(rows).orderBy("line").collect()]
    assert got == [("2026-02-01", -450, 109550, 'Coffee, "the" cart - Receipt 770001', "770001"), ("2026-02-02", 10000, 119550, "Pay", None)]
    assert [(r["file"].endswith("b.csv"), r["bad_rows"]) for r in statements.rejected(rows).collect()] == [(True, 1)]
    (tmp_path / "c.txt").write_text('03/02/2026,"-7.25","SHOP","+12.00"\n')
    assert [(r["amount"], r["receipt"], r["raw_description"]) for r in statements.cba_csv(spark, str(tmp_path / "c.txt")).collect()] == [(-725, None, "SHOP")]


def test_guard_verdicts(spark):
    day = lambda d: dt.date(2026, 3, d)
    facts = spark.createDataFrame([("a", day(1), 100, 100), ("a", day(2), 50, 150), ("b", day(1), 7, 7), ("z", day(1), 5, 0)], "account_ref string, date date, amount bigint, balance bigint")
    rows = [("over", day(2), 50, 150), ("opens", day(5), 10, 160), ("odd", day(2), 1, 900), ("odd", day(2), 2, 950), ("zero", day(1), 5, 0), ("blank", day(9), None, None)]
    files = spark.createDataFrame(rows, "file_id string, date date, amount bigint, balance bigint")
    chosen = spark.createDataFrame([("over", "a"), ("opens", "b"), ("odd", "a"), ("zero", "z"), ("blank", "new")], "file_id string, chosen string")
    got = {r["file_id"]: (r["verdict"], r["others"]) for r in guard.verdicts(files, facts, chosen).collect()}
    assert got == {"over": ("FITS", ""), "opens": ("ELSEWHERE", "a"), "odd": ("CONTRADICTS", ""), "zero": ("UNPROVEN", ""), "blank": ("NEW", "")}
    assert guard.verdicts(files.limit(0), facts, chosen.limit(0)).count() == 0


def brute_verdicts(files, facts, chosen):
    """Verdicts by the rules as they are written, file by file and account by account."""
    by_file, by_account, out = {}, {}, {}
    for r in files:
        by_file.setdefault(r["file_id"], []).append((r["date"], r["amount"] or 0, r["balance"]))
    for r in facts:
        by_account.setdefault(r["account_ref"], set()).add((r["date"], r["amount"], r["balance"]))
    for r in chosen:
        rows, fits, odd = by_file[r["file_id"]], set(), False
        ends, start = {b for _, _, b in rows}, min(d for d, _, _ in rows)
        opens = {b - a for _, a, b in rows} - ends
        opening = next(iter(opens)) if len(opens) == 1 and opens != {0} else None
        for account, known in by_account.items():
            newest = max((d for d, _, _ in known if d <= start), default=None)
            met = {x for x in rows if x in known}
            if any(b != 0 for _, _, b in met) or any(d == newest and b == opening for d, _, b in known if opening is not None):
                fits.add(account)
            if account == r["chosen"]:
                odd = bool({d for d, _, _ in rows} & {d for d, _, _ in known} - {d for d, _, _ in met})
        others = sorted(fits - {r["chosen"]})
        verdict = "FITS" if r["chosen"] in fits else "ELSEWHERE" if len(others) == 1 else "NEW" if r["chosen"] not in by_account else "CONTRADICTS" if odd else "UNPROVEN"
        out[r["file_id"]] = (r["chosen"], verdict, ",".join(others) if verdict in ("ELSEWHERE", "UNPROVEN") else "")
    return out


def test_guard_judges_files_of_the_whole_table(spark):
    ledger_rows = registry.bridge.balanced(spark, SF)
    want = brute_verdicts(*(x.collect() for x in registry._all_files(ledger_rows)))
    got = {r["file_id"]: (r["chosen"], r["verdict"], r["others"]) for r in registry.queries()["account_guard_all"](spark, SF).collect()}
    assert got == want
    months = {(r["account_ref"], r["date"].year, r["date"].month) for r in ledger_rows.collect()}
    assert len(got) == len(months) and {f.split("/")[1][:4] for f in got} == {str(y) for y in range(1995, 2002)}
    assert {v for _, v, _ in got.values()} == {"FITS", "ELSEWHERE", "NEW", "CONTRADICTS", "UNPROVEN"}


def test_loans(spark):
    names = "loan double, offset double, rate double, payment double, extra double"
    loans = [(1000.0, 0.0, 12.0, 10.0, 0.0), (1000.0, 1000.0, 12.0, 10.0, 0.0), (1200.0, 0.0, 0.0, 100.0, 0.0), (1000.0, 0.0, 12.0, 500.0, 10.0), (1000.0, 0.0, 12.0, 0.0, 0.0)]
    got = [(r["months"], round(r["interest"], 2), r["stalled"]) for r in reads.amortise(spark.createDataFrame(loans, names)).collect()]
    assert got == [(None, 0.0, True), (0, 0.0, False), (12, 0.0, False), (2, 15.0, False), (0, 0.0, False)]


def test_pages_and_one_offs(spark):
    rows = spark.range(5).select(F.col("id").alias("n"), F.lit("a").alias("account_ref"), (F.col("id") % 2).alias("amount"))
    assert [r["n"] for r in reads.ledger_page(rows, sort="amount", limit=0, offset=1).collect()] == [3]
    assert [r["n"] for r in reads.ledger_page(rows, sort="amount", ascending=True, limit=5000, offset=-1).collect()] == [0, 2, 4, 1, 3]
    with pytest.raises(ValueError):
        reads.ledger_page(rows, sort="n; drop")
    days = spark.createDataFrame([("s", dt.date(2026, 1, i + 1), a) for i, a in enumerate([-10, -30, -10, -4, -10, 0, -10])], "stem string, date date, amount bigint")
    assert sorted(r["date"].day for r in reads.one_offs(days).collect()) == [2, 4, 6]


def test_fingerprint_ignores_order(spark):
    rows = spark.range(20).select(F.lit("a").alias("k"), "id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("x"))
    one_way, other = reads.fingerprint(rows, ["id", "x"], "k"), reads.fingerprint(rows.orderBy(F.desc("id")).repartition(3), ["id", "x"], "k")
    changed = reads.fingerprint(rows.withColumn("x", F.coalesce("x", F.lit(1))), ["id", "x"], "k")
    assert one_way.collect() == other.collect() != changed.collect()


def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, SF)
        columns = sorted(got.columns)
        result = con.execute(sql)
        names = [c[0] for c in result.description]
        want = sorted(repr([r[names.index(c)] for c in columns]) for r in result.fetchall())
        assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == want, name


def test_rules_are_checked():
    from tallyforge.operators import ledger

    assert ledger.checked(["a"], [("a", {"match": "x"})]) == [("a", {"match": "x"})]
    for names, rules in ((["a", "a"], []), ([" "], []), (["TRANSFER"], []), (["a"], [("b", {"match": "x"})]), (["a"], [("a", {})]), (["a"], [("UNCATEGORIZED", {"match": "x"})])):
        with pytest.raises(ValueError):
            ledger.checked(names, rules)


def test_reparse_takes_each_old_row_once():
    from tallyforge.operators import reparse

    row = lambda i, text: {"id": i, "text": text, "words": text.split()}
    before = [row("a", "SHOP ONE"), row("b", "SHOP ONE"), row("c", "OTHER")]
    after = [row("x", "SHOP ONE"), row("y", "SHOP ONE"), row("z", "SHOP ONE"), row("w", "OTHER THING")]
    assert list(reparse._shifts(before, after)) == [("x", "a"), ("y", "b"), ("w", "c")]


def test_reparse_diff(spark):
    from tallyforge.operators import reparse

    day, names = dt.date(2026, 1, 1), "external_id string, account_ref string, date date, amount bigint, raw_description string"
    facts = spark.createDataFrame([("a", "x", day, 5, "SHOP ONE"), ("b", "x", day, 5, "SHOP ONE"), ("c", "x", day, 5, "OTHER"), ("d", "x", day, 7, "KEPT"), ("e", "x", day, 8, "GONE"), ("f", "x", day, 9, "CLOSED")], names)
    now = spark.createDataFrame([("d", "x", day, 7, "KEPT", 0), ("p", "x", day, 5, "SHOP ONE", 1), ("q", "x", day, 5, "OTHER THING", 2), ("r", "x", day, 6, "SHOP ONE", 3)], names + ", n bigint")
    got = {tuple(r) for r in reparse.diff(facts, spark.createDataFrame([("f",)], "external_id string"), now).collect()}
    assert got == {("MATCHED", "d", "d"), ("SHIFTED", "p", "a"), ("SHIFTED", "q", "c"), ("NEW", "r", None), ("MISSING", "b", "b"), ("MISSING", "e", "e")}


def test_a_replayed_batch_appends_nothing(spark, tmp_path):
    from tallyforge.streaming import ingest

    path, rows = str(tmp_path / "t"), lambda *n: spark.createDataFrame([(i, "a", i * 10) for i in n], "n bigint, account_ref string, amount bigint")
    for batch in (rows(1, 2, 2), rows(1, 2, 2), rows(2, 3), rows(2, 3)):
        ingest.append_new(batch, path, ["n"])
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def held_against_sql(spark, name):
    """The query's rows beside its SQL's, where a shuffle is split and merged as on larger tables."""
    con = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    sizes = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k"}
    before = {k: spark.conf.get(k, None) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        got = registry.queries()[name](spark, SF)
        columns, rows = sorted(got.columns), got.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    result = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    want = sorted(repr([r[names.index(c)] for c in columns]) for r in result.fetchall())
    assert want and sorted(repr([r[c] for c in columns]) for r in rows) == want


def test_ing_files_begin_with_their_header(spark):
    held_against_sql(spark, "source_ing_csv")


def test_bw_files_begin_with_their_header(spark):
    held_against_sql(spark, "source_bw_csv")


def test_text_files_begin_with_their_heading(spark):
    held_against_sql(spark, "source_cba_text")


@pytest.mark.parametrize("more", ["", " union all select * from o", " where o_custkey % 30 <> 3 or o_orderkey % 7 >= 4", " where o_custkey % 30 <> 17 or o_orderkey = (select min(o_orderkey) from o where o_custkey % 30 = 17 and o_orderkey % 7 < 4)"])
def test_bw_files_mix_signs_whatever_their_keys(spark, tmp_path, monkeypatch, more):
    """An account's numbers are all even or all odd; files that are to mix signs have many debits, none or one."""
    for t in ("orders", "customer", "nation"):
        keys = "* replace (o_orderkey * 2 + o_custkey % 2 as o_orderkey)" if t == "orders" else "*"
        duckdb.execute(f"copy (with o as (select {keys} from read_parquet('{SF}/{t}.parquet')) select * from o{more if t == 'orders' else ''}) to '{tmp_path}/{t}.parquet' (format parquet)")
    monkeypatch.setitem(globals(), "SF", str(tmp_path))
    held_against_sql(spark, "source_bw_csv")


@pytest.mark.parametrize("priority", ["substr(o_orderpriority, 1, 2)", "rpad(o_orderpriority, 15, ' ')", "concat(o_orderpriority, chr(13), chr(10), 'AGAIN', chr(9))"])
def test_texts_keep_descriptions_with_white_space_at_their_ends(spark, tmp_path, monkeypatch, priority):
    for t in ("orders", "customer", "nation"):
        held = f"* replace ({priority} as o_orderpriority)" if t == "orders" else "*"
        duckdb.execute(f"copy (select {held} from read_parquet('{SF}/{t}.parquet')) to '{tmp_path}/{t}.parquet' (format parquet)")
    monkeypatch.setitem(globals(), "SF", str(tmp_path))
    held_against_sql(spark, "source_cba_text")


def folded(spark, rows):
    """The fold of (n, action, commitment_id, id) with a declaration of pay-1 and pay-2 before; only the id x is known."""
    from tallyforge.operators import commitments

    day, names = dt.date(2000, 1, 1), "n bigint, action string, commitment_id string, id string, direction string, cadence string, amount_kind string, match string, account string, amount bigint, day date"
    said = [(n, "DECLARE", c, None, "out", "weekly", "fixed", "shop", None, 5, day) for n, c in ((1, "pay-1"), (2, "pay-2"))] + [(*r, *[None] * 7) for r in rows]
    return commitments.fold(spark.createDataFrame(said, names), spark.createDataFrame([("x", "x")], "id string, current_id string"))


def test_an_exclusion_beside_a_bad_pin_of_its_number(spark):
    got = folded(spark, [(5, "PIN", "pay-1", "nope"), (5, "EXCLUDE", "pay-2", "x"), (6, "EXCLUDE", "pay-1", "x"), (6, "EXCLUDE", "pay-1", "nope")])
    assert [tuple(r) for r in got["exclusions"].select("commitment_id", "external_id", "decision_n").collect()] == [("pay-2", "x", 5)]


def test_decisions_without_effect_that_share_a_number(spark):
    got = folded(spark, [(1, "EXCLUDE", "pay-1", "x"), (5, "PIN", "pay-1", "nope"), (5, "PIN", "pay-2", "nope"), (5, "EXCLUDE", "pay-2", "x"), (7, "RETIRE", "pay-1", None), (7, "PIN", "pay-1", "x")])
    assert sorted(tuple(r) for r in got["without_effect"].collect()) == [(1, "EXCLUDE"), (5, "PIN"), (5, "PIN")]
