"""All queries of the ledger library, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import identity, text
from tallyforge.operators import decisions, guard, ladder, ledger, reads, wallets
from tallyforge.plans import bridge
from tallyforge.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_CLEAN = r"regexp_replace(regexp_replace(raw_description, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
_STEM = r"upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_description, '^\s+|\s+$', '', 'g'), '( - Visa Purchase| - Receipt| {3,}).*$', ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"
_CATEGORY = f"""case
  when regexp_matches({_CLEAN}, '(?i)merchant 1[0-9] ') and amount < 0 then 'groceries'
  when regexp_matches({_CLEAN}, '(?i)urgent') and amount > 0 and abs(amount) between 10000 and 40000 then 'salary'
  when regexp_matches({_CLEAN}, '(?i)merchant [2-3] ') or regexp_matches({_CLEAN}, '(?i)merchant 2[0-4] ') then 'transport'
  when abs(amount) between 0 and 5000 and not regexp_matches({_CLEAN}, '(?i)high') then 'small'
  when account_ref in ('acct-3', 'acct-6', 'acct-9') then 'savings'
  else 'UNCATEGORIZED' end"""
_FACT = f"with fact as ({bridge.FACT}), stemmed as (select *, {_STEM} as stem from fact)"
_BAL = f"with bal as ({bridge.BALANCED})"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _over(name: str, source: Query, operator: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(lambda spark, sf_dir: operator(source(spark, sf_dir)))


_over("month_category_net", bridge.fact, lambda f: ledger.categorised(f).groupBy(F.date_format("date", "yyyy-MM").alias("month"), "category").agg(F.sum("amount").alias("net"), F.count("*").alias("facts")),
      _FACT + f" select strftime(date, '%Y-%m') as month, {_CATEGORY} as category, cast(sum(amount) as bigint) as net, count(*) as facts from fact group by 1, 2")
_over("category_rules", bridge.fact, lambda f: ledger.categorised(f).select("n", "category"), _FACT + f" select n, {_CATEGORY} as category from fact")
_over("workbook_coverage", bridge.fact, lambda f: ledger.stemmed(ledger.categorised(f)).groupBy("category").agg(F.count("*").alias("hits"), F.countDistinct("stem").alias("merchants"), F.sum("amount").alias("total"), F.min("date").alias("first"), F.max("date").alias("last")),
      _FACT + f" select {_CATEGORY} as category, count(*) as hits, count(distinct stem) as merchants, cast(sum(amount) as bigint) as total, min(date) as first, max(date) as last from stemmed group by 1")
_over("account_totals", bridge.fact, lambda f: f.groupBy("account_ref").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("facts"), F.sum("amount").alias("net")),
      _FACT + " select account_ref, min(date) as first, max(date) as last, count(*) as facts, cast(sum(amount) as bigint) as net from fact group by 1")
_over("account_frontier", bridge.fact, lambda f: f.where(F.col("date") <= F.lit("1998-06-30").cast("date")).groupBy("account_ref").agg(F.max("date").alias("frontier")),
      _FACT + " select account_ref, max(date) as frontier from fact where date <= date '1998-06-30' group by 1")
_over("cash_month", bridge.fact, ledger.cash_month,
      _FACT + " select account_ref, strftime(date, '%Y-%m') as month, cast(sum(case when amount > 0 then amount else 0 end) as bigint) as money_in, cast(sum(case when amount < 0 then amount else 0 end) as bigint) as money_out, cast(sum(amount) as bigint) as net, count(*) as rows from fact group by 1, 2")
_over("merchant_stem", bridge.fact, lambda f: f.select("n", text.clean(F.col("raw_description")).alias("clean"), text.stem(F.col("raw_description")).alias("stem")), _FACT + f" select n, {_CLEAN} as clean, stem from stemmed")
_over("merchant_tokens", bridge.fact, lambda f: f.select("n", F.array_join(text.tokens(F.col("raw_description")), " ").alias("words")),
      _FACT + r""" select n, array_to_string(list_distinct_in_order, ' ') as words from (
        select n, list_filter(list_transform(range(1, len(w) + 1), lambda i: case when list_position(w, w[i]) = i then w[i] end), lambda x: x is not null) as list_distinct_in_order from (
          select n, list_filter(string_split(regexp_replace(stem, '[^A-Z0-9]+', ' ', 'g'), ' '), lambda x: regexp_matches(x, '^[A-Z]{3,}$')
            and x not in ('VISA', 'EFTPOS', 'POS', 'AUTHORISATION', 'AUTHORIZATION', 'DEBIT', 'CREDIT', 'PURCHASE', 'CARD', 'PAYMENT', 'RECEIPT', 'WITHDRAWAL', 'DEPOSIT', 'TRANSACTION')) as w from stemmed))""")
_MINT = _FACT + """, judged as (
    select *, receipt is not null and count(distinct concat_ws('|', amount, raw_description)) over (partition by account_ref, date, receipt) = 1 as nk from fact),
  placed as (select *, case when nk then 0 else cast(row_number() over (partition by account_ref, date, amount, raw_description, nk order by n) - 1 as int) end as occ from judged),
  minted as (select *, substr(case when nk then sha256(concat_ws('|', 'nk', account_ref, date, receipt)) else sha256(concat_ws('|', 'ch', account_ref, date, amount, raw_description, occ)) end, 1, 16) as external_id from placed)"""
_over("mint_ids", bridge.fact, lambda f: identity.mint(f).select("n", "occ", "external_id"), _MINT + " select n, occ, external_id from minted")
def _offered(f: DataFrame) -> DataFrame:
    """Rows with their ids, and some of them offered again: as they were, or with another balance."""
    rows = identity.mint(f).withColumn("balance", F.col("balance").cast("bigint"))
    again = rows.where(F.col("n") % 9 == 0).withColumn("balance", F.col("balance") + F.when(F.col("n") % 2 == 0, 1).otherwise(0)).withColumn("n", F.col("n") + 100000000)
    return rows.unionByName(again)


_over("dedup_outcomes", bridge.balanced, lambda f: ledger.dedup_outcomes(_offered(f)).groupBy("outcome").agg(F.count("*").alias("rows"), F.sum("n").alias("sum_n")),
      _MINT.replace(bridge.FACT, bridge.BALANCED) + """, offered as (select * replace (cast(balance as bigint) as balance) from minted union all select * replace (n + 100000000 as n, cast(balance as bigint) + case when n % 2 = 0 then 1 else 0 end as balance) from minted where n % 9 = 0),
      judged2 as (select n, case when row_number() over (partition by external_id, account_ref, date, amount, raw_description, receipt, occ, balance, observation order by n) > 1 then 'Duplicate' when row_number() over (partition by external_id order by n) > 1 then 'Flagged' else 'Appended' end as outcome from offered)
      select outcome, count(*) as rows, cast(sum(n) as bigint) as sum_n from judged2 group by 1""")
_over("current_facts", bridge.fact, lambda f: ledger.latest(identity.mint(f), ["external_id"], "n").where(F.col("observation") == "posted").select("n", "external_id", "account_ref", "date", "amount"),
      _MINT + " select n, external_id, account_ref, date, amount from (select *, row_number() over (partition by external_id order by n desc) as r from minted) where r = 1 and observation = 'posted'")
_over("state_hash", bridge.fact, lambda f: ledger.categorised(identity.mint(f)).select("n", identity.state_hash(F.col("external_id"), F.lit(None).cast("string"), F.when(F.col("amount") < 0, "OUT").otherwise("IN"), F.lit("EXTERNAL"), F.col("account_ref"), F.col("date"), F.col("amount"), F.lit("AUD"), F.col("category"), F.lit("RULE"), F.lit(None).cast("string")).alias("state_hash")),
      _MINT + f" select n, 'sha256:' || sha256(concat(external_id, '||', case when amount < 0 then 'OUT' else 'IN' end, '|EXTERNAL|', account_ref, '|', date, '|', amount, '|AUD|', {_CATEGORY}, '|RULE|')) as state_hash from minted")


def _shaped(f: DataFrame) -> DataFrame:
    """Legs of a receipt that has an equal and opposite leg in another account within four days."""
    keys = [F.abs("amount").alias("_a"), "receipt"]
    left, right = f.where(F.col("receipt").isNotNull()).select("*", *keys[:1]), f.select(F.abs("amount").alias("_a"), "receipt", F.col("account_ref").alias("_acct"), F.col("amount").alias("_amt"), F.col("date").alias("_d"))
    met = left.join(right, ["_a", "receipt"]).where((F.col("account_ref") != F.col("_acct")) & (F.col("amount") == -F.col("_amt")) & (F.abs(F.datediff("date", "_d")) <= 4))
    return met.select("n", "account_ref", "receipt", "amount").distinct()


def _transfer_candidates(f: DataFrame) -> DataFrame:
    """Equal and opposite posted legs in two accounts within four days, by tier of their closeness.

    Days are dealt to stretches of four, so legs of a common amount meet those of their own and the neighbouring stretches only.
    """
    stretch = F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / 4)
    legs = f.where(F.col("observation") == "posted").withColumn("_a", F.abs("amount")).withColumn("_s", stretch)
    out, into = legs.where(F.col("amount") < 0).withColumn("_s", F.explode(F.array(F.col("_s") - 1, F.col("_s"), F.col("_s") + 1))), legs.where(F.col("amount") > 0).select("_a", "_s", F.col("n").alias("to_n"), F.col("account_ref").alias("_acct"), F.col("date").alias("_d"), F.col("receipt").alias("_r"))
    met = out.join(into, ["_a", "_s"]).where((F.col("account_ref") != F.col("_acct")) & (F.abs(F.datediff("date", "_d")) <= 4))
    return met.select(F.col("n").alias("from_n"), "to_n", F.abs(F.datediff("date", "_d")).alias("days"), F.when(F.col("receipt") == F.col("_r"), "T1").when(F.col("date") == F.col("_d"), "T2").otherwise("T3").alias("tier"))


_over("receipt_shaped_legs", bridge.fact, _shaped, _FACT + " select distinct a.n, a.account_ref, a.receipt, a.amount from fact a join fact b on a.receipt = b.receipt and a.amount = -b.amount and a.account_ref <> b.account_ref and abs(date_diff('day', a.date, b.date)) <= 4")
_over("transfer_candidates", bridge.fact, _transfer_candidates, _FACT + """ select a.n as from_n, b.n as to_n, cast(abs(date_diff('day', a.date, b.date)) as int) as days, case when a.receipt = b.receipt then 'T1' when a.date = b.date then 'T2' else 'T3' end as tier
  from fact a join fact b on a.amount = -b.amount and a.amount < 0 and a.account_ref <> b.account_ref and abs(date_diff('day', a.date, b.date)) <= 4 where a.observation = 'posted' and b.observation = 'posted'""")
# Every posted leg takes part, in one currency, and no text names a clearing account; the query transfers has all of that, with SQL.
_over("transfer_ladder", bridge.fact, lambda f: ladder.match(identity.mint(f).where(F.col("observation") == "posted").withColumn("currency", F.lit("AUD")).withColumn("clearing", F.lit(None).cast("string"))))


def _edges(f: DataFrame) -> DataFrame:
    return f.where(F.col("n") % 50 < 3).select(F.col("n").alias("from_id"), (F.col("n") + 7).alias("to_id")).unionByName(f.where((F.col("n") % 50).between(10, 14)).select(F.col("n").alias("from_id"), (F.col("n") + 1).alias("to_id")))


def _decisions(f: DataFrame) -> DataFrame:
    pins = f.where(F.col("n") % 101 == 0).select((F.col("n") + 1000000).alias("n"), F.lit("PIN").alias("action"), F.col("n").alias("target"))
    revokes = f.where(F.col("n") % 303 == 0).select((F.col("n") + 2000000).alias("n"), F.lit("REVOKE").alias("action"), (F.col("n") + 1000000).alias("target"))
    again = f.where(F.col("n") % 909 == 0).select((F.col("n") + 3000000).alias("n"), F.lit("REVOKE").alias("action"), (F.col("n") + 2000000).alias("target"))
    return pins.unionByName(revokes).unionByName(again)


_DECISIONS = _FACT + """, decision as (select n + 1000000 as n, 'PIN' as action, n as target from fact where n % 101 = 0 union all select n + 2000000, 'REVOKE', n + 1000000 from fact where n % 303 = 0 union all select n + 3000000, 'REVOKE', n + 2000000 from fact where n % 909 = 0)"""
_over("chain_resolve", bridge.fact, lambda f: decisions.chain_resolve(_edges(f)),
      f"with recursive fact as ({bridge.FACT}), edge as (select n as from_id, n + 7 as to_id from fact where n % 50 < 3 union all select n, n + 1 from fact where n % 50 between 10 and 14), walk as (select from_id, to_id as at, 1 as depth from edge union all select w.from_id, e.to_id, w.depth + 1 from walk w join edge e on e.from_id = w.at where depth < 40) select w.from_id as id, max(case when e.from_id is null then w.at end) as resolved, max(w.depth) as hops from walk w left join edge e on e.from_id = w.at group by 1")
_over("effective_decisions", bridge.fact, lambda f: decisions.effective(_decisions(f)),
      _DECISIONS + " select * from decision d where (select count(*) from decision r where r.action = 'REVOKE' and r.target = d.n and not exists (select 1 from decision s where s.action = 'REVOKE' and s.target = r.n)) % 2 = 0")


def _deep_decisions(f: DataFrame) -> DataFrame:
    """Pins with chains of 0 to 7 revokes, each of the one before it, and revokes of missing decisions."""
    levels = f.where(F.col("n") % 101 == 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 101) % 8)))
    chains = levels.select((F.col("n") + 1000000 * (F.col("k") + 1)).alias("n"), F.when(F.col("k") == 0, "PIN").otherwise("REVOKE").alias("action"), (F.col("n") + 1000000 * F.col("k")).alias("target"))
    return chains.unionByName(f.where(F.col("n") % 101 == 1).select((F.col("n") + 20000000).alias("n"), F.lit("REVOKE").alias("action"), (F.col("n") + 10000000).alias("target")))


_over("effective_decisions_deep", bridge.fact, lambda f: decisions.effective(_deep_decisions(f)),
      _FACT + """, l as (select n, n // 101 % 8 as top, unnest(range(0, 8)) as k from fact where n % 101 = 0)
  select n + 1000000 * (k + 1) as n, case when k = 0 then 'PIN' else 'REVOKE' end as action, n + 1000000 * k as target from l where k <= top and (top - k) % 2 = 0""")
_over("statement_reconcile", bridge.balanced, ledger.statement_reconcile,
      _BAL + """, net as (select account_ref, v, sum(s) as s from (select account_ref, balance - amount as v, 1 as s from bal union all select account_ref, balance, -1 from bal) group by 1, 2), t as (select account_ref, cast(sum(greatest(s, 0)) as bigint) as openings, cast(sum(greatest(-s, 0)) as bigint) as closings from net group by 1) select *, openings = 1 and closings = 1 as reconciled from t""")
_over("opening_balances", bridge.balanced, ledger.openings, _BAL + " select account_ref, cast(arg_min(balance - amount, (date, n)) as bigint) as forward, cast(arg_max(balance, (date, n)) - sum(amount) as bigint) as backward from bal group by 1")
_over("balance_chain_break", bridge.balanced, ledger.chain_breaks,
      _BAL + ", l as (select *, lag(balance) over (partition by account_ref order by date, n) + amount as expected from bal) select account_ref, n, date, cast(expected as bigint) as expected, cast(balance as bigint) as balance from l where expected <> balance")
_over("new_stem", bridge.fact, lambda f: ledger.new_stems(f, "1995-02-01", "1995-12-31"), _FACT + " select stem, n, date, amount from (select *, row_number() over (partition by stem order by date, n) as r from stemmed) where r = 1 and date between date '1995-02-01' and date '1995-12-31'")
_over("amount_outlier_p99", bridge.fact, lambda f: ledger.amount_outliers(f.withColumn("amount", F.col("amount") * F.when(F.col("n") % 499 == 7, 3).otherwise(1)).withColumn("raw_description", F.element_at(F.split("raw_description", " "), -1))),
      f"with fact as (select * replace (amount * case when n % 499 = 7 then 3 else 1 end as amount, split_part(raw_description, ' ', -1) as raw_description) from ({bridge.FACT})), stemmed as (select *, {_STEM} as stem from fact)" + ", lim as (select stem, quantile_disc(abs(amount), 0.99) as p99 from stemmed group by 1 having count(*) >= 8) select n, stem, amount, cast(p99 as bigint) as p99 from stemmed join lim using (stem) where abs(amount) > p99")
_over("duplicate_looking", bridge.fact, lambda f: ledger.duplicate_looking(f, 30),
      _FACT + ", g as (select *, cast(date_diff('day', lag(date) over (partition by stem, amount order by date, n), date) as int) as gap from stemmed where stem <> '') select n, account_ref, stem, amount, gap from g where gap <= 30")
_over("account_silent", bridge.fact, lambda f: ledger.silent_accounts(f, "2001-09-15"),
      _FACT + """, d as (select distinct account_ref, date from fact), g as (select *, date_diff('day', lag(date) over (partition by account_ref order by date), date) as gap, row_number() over (partition by account_ref order by date desc) as r from d),
      a as (select account_ref, max(date) as last, count(*) as dates, list_sort(list(gap) filter (r <= 10 and gap is not null)) as gs from g group by 1)
      select account_ref, last, cast(gs[cast(floor(len(gs) / 2) as int) + 1] as int) as median_gap, cast(date_diff('day', last, date '2001-09-15') as int) as days from a where dates >= 4 and date_diff('day', last, date '2001-09-15') > 2 * gs[cast(floor(len(gs) / 2) as int) + 1]""")
_over("dup_clusters", bridge.fact, lambda f: ledger.dup_clusters(f, 5000),
      _FACT + """, m as (select *, amount < 0 as negative from stemmed), b as (select *, coalesce(amount - lag(amount) over (partition by account_ref, date, stem, negative order by amount, n) > 5000, true) as apart from m),
      i as (select *, sum(cast(apart as int)) over (partition by account_ref, date, stem, negative order by amount, n) as island from b) select account_ref, date, stem, negative, count(*) as rows, min(n) as first_n from i group by account_ref, date, stem, negative, island having count(*) > 1""")
_over("occurrence_calendar", bridge.series, lambda f: ledger.occurrence_calendar(f.groupBy(F.col("raw_description").alias("commitment_id")).agg(F.min("date").alias("anchor"), F.max("amount").alias("amount")).withColumn("months", F.lit(1)), "2023-06-30"),
      f"with fact as ({bridge.SERIES}), c as (select raw_description as commitment_id, min(date) as anchor, max(amount) as amount from fact group by 1), k as (select *, unnest(range(0, 40)) as k from c) select commitment_id, cast(k as int) as k, cast(anchor + interval 1 month * k as date) as due, amount from k where cast(anchor + interval 1 month * k as date) <= date '2023-06-30' + 92")
_over("coverage_buckets", bridge.fact, ledger.coverage,
      _FACT + """, m as (select account_ref, cast(date_trunc('month', date) as date) as month, count(*) as facts from fact group by 1, 2), s as (select account_ref, min(month) as a, max(month) as b from m group by 1),
      cal as (select s.*, cast(unnest(generate_series((select min(a) from s), (select max(b) from s), interval 1 month)) as date) as month from s)
      select cal.account_ref, cal.month, coalesce(facts, 0) as facts, case when cal.month < a then 'before' when cal.month > b then 'after' when facts is null then 'hole' else 'facts' end as state from cal left join m on m.account_ref = cal.account_ref and m.month = cal.month""")


_over("export_rows", bridge.balanced, lambda f: ledger.categorised(identity.mint(f)).select("n", "date", F.col("account_ref").alias("account"), F.lit("AUD").alias("currency"), F.col("amount").alias("amount_cents"), F.col("balance").cast("bigint").alias("balance_cents"), "category", "external_id", "raw_description"),
      _MINT.replace(bridge.FACT, bridge.BALANCED) + f" select n, date, account_ref as account, 'AUD' as currency, amount as amount_cents, cast(balance as bigint) as balance_cents, {_CATEGORY} as category, external_id, raw_description from minted")
def _counted(f: DataFrame) -> DataFrame:
    return f.withColumn("snap", F.when(F.col("n") % 37 == 0, F.col("n") % 1000 * 100))


_SEG = _FACT + """, c as (select *, case when n % 37 = 0 then n % 1000 * 100 end as snap from fact),
  seg as (select *, count(snap) over (partition by account_ref order by date, n) as g, case when snap is null then amount else 0 end as moved from c)"""
_over("wallet_balance", bridge.fact, lambda f: wallets.wallet_balance(_counted(f)),
      _SEG + """, r as (select *, sum(moved) over (partition by account_ref, g order by date, n) as up, sum(moved) over (partition by account_ref, g) as total, max(snap) over (partition by account_ref, g) as own from seg),
      one as (select account_ref, arg_min(snap, (date, n)) as s from seg where snap is not null group by 1)
      select r.account_ref, n, date, cast(case when g > 0 then own + up else coalesce(s - (total - up), up) end as bigint) as balance from r left join one on one.account_ref = r.account_ref""")
_over("declared_reconcile", bridge.fact, lambda f: wallets.declared_reconcile(_counted(f)),
      _SEG + """, k as (select account_ref, g, max(snap) as s, sum(moved) as m from seg where g > 0 group by 1, 2), d as (select *, lead(s) over (partition by account_ref order by g) - s - m as gap from k)
      select account_ref, count(*) as counts, cast(coalesce(sum(gap), 0) as bigint) as gap from d group by 1""")
_AFTER = "\n".join(x for i, x in enumerate(_CATEGORY.split("\n")) if i != 1)
_over("reflow_diff", bridge.fact, lambda f: wallets.reflow_diff(f, ledger.RULES, ledger.RULES[1:]),
      _FACT + f", b as (select amount, {_CATEGORY} as before, {_AFTER} as after from fact) select before, after, count(*) as facts, cast(sum(amount) as bigint) as net from b where before <> after group by 1, 2")
_over("price_steps", bridge.series, wallets.price_steps,
      f"with fact as ({bridge.SERIES}), day as (select {_STEM} as stem, date, cast(sum(amount) as bigint) as amount from fact group by 1, 2), s as (select *, lag(amount) over (partition by stem order by date) as before from day) select stem, date, before, amount from s where abs(abs(amount) - abs(before)) >= 50 or abs(abs(amount) - abs(before)) >= 0.05 * abs(before)")
_over("recurring_missing", bridge.fact, lambda f: wallets.recurring_missing(f, "1996-05", "1996-06"),
      _FACT + """, m as (select distinct stem, strftime(date, '%Y-%m') as m from stemmed where date < date '1996-07-01')
      select stem, count(*) filter (m < '1996-06') as months from m group by 1 having count(*) filter (m < '1996-06') >= 3 and bool_or(m = '1996-05') and not bool_or(m = '1996-06')""")


def _plan(f: DataFrame) -> DataFrame:
    units = f.select(F.col("n").alias("unit_id"), F.col("amount").alias("hash"))
    there = f.where(F.col("n") % 7 != 0).select(F.col("n").alias("unit_id"), (F.col("amount") + F.when(F.col("n") % 11 == 0, 1).otherwise(0)).alias("hash"))
    gone = f.where(F.col("n") % 13 == 0).select((F.col("n") + 100000000).alias("unit_id"), F.col("amount").alias("hash"))
    return wallets.projection_plan(units, there.unionByName(gone))


_over("projection_plan", bridge.fact, _plan,
      _FACT + """, e as (select n as unit_id, amount + case when n % 11 = 0 then 1 else 0 end as h from fact where n % 7 <> 0 union all select n + 100000000, amount from fact where n % 13 = 0)
      select coalesce(fact.n, e.unit_id) as unit_id, case when e.unit_id is null then 'create' when fact.n is null then 'orphan' when amount = h then 'unchanged' else 'update' end as plan from fact full join e on e.unit_id = fact.n""")

def _all_files(f: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A file for each account and month of the whole table, some chosen for another account and some with strange balances, and the facts of every other half year."""
    month, rows = F.month("date"), f.withColumn("balance", F.col("balance").cast("bigint"))
    named = rows.withColumn("file_id", F.concat_ws("/", "account_ref", F.date_format("date", "yyyy-MM"))).withColumn("chosen", F.when(month % 4 == 1, "acct-99").when(month % 4 == 2, "acct-0").otherwise(F.col("account_ref")))
    files = named.select("file_id", "date", "amount", (F.col("balance") + F.when(month % 3 == 0, 5).otherwise(0)).alias("balance"))
    return files, rows.where((month < 7) & (F.col("n") % 3 != 0)), named.select("file_id", "chosen").distinct()


_over("account_guard_all", bridge.balanced, lambda f: guard.verdicts(*_all_files(f)),
      _BAL + """, r as (select account_ref, date, n, amount, cast(balance as bigint) as balance, month(date) as m, strftime(date, '%Y-%m') as ym from bal),
  f as (select account_ref || '/' || ym as file_id, case m % 4 when 1 then 'acct-99' when 2 then 'acct-0' else account_ref end as chosen, date, amount, balance + case when m % 3 = 0 then 5 else 0 end as balance from r),
  c as (select distinct account_ref, date, amount, balance from r where m < 7 and n % 3 <> 0),
  met as (select f.file_id, c.account_ref, f.date, f.balance from f join c using (date, amount, balance)),
  op as (select file_id, min(p) as o from (select distinct file_id, balance - amount as p from f) x where not exists (select 1 from f y where y.file_id = x.file_id and y.balance = x.p) group by 1 having count(*) = 1),
  st as (select file_id, min(date) as s from f group by 1),
  pair as (select st.file_id, a.account_ref, (select max(c.date) from c where c.account_ref = a.account_ref and c.date <= st.s) as d from st, (select distinct account_ref from c) a),
  ev as (select p.file_id, p.account_ref,
      exists (select 1 from met where met.file_id = p.file_id and met.account_ref = p.account_ref and met.balance <> 0)
        or exists (select 1 from op join c on c.balance = op.o where op.file_id = p.file_id and op.o <> 0 and c.account_ref = p.account_ref and c.date = p.d) as fits,
      exists (select 1 from f join c on c.date = f.date where f.file_id = p.file_id and c.account_ref = p.account_ref
        and not exists (select 1 from met where met.file_id = p.file_id and met.account_ref = p.account_ref and met.date = f.date)) as odd from pair p),
  ch as (select distinct file_id, chosen from f),
  v as (select ch.file_id, ch.chosen, bool_or(ev.account_ref = ch.chosen and fits) as own, bool_or(ev.account_ref = ch.chosen) as known, bool_or(ev.account_ref = ch.chosen and odd) as odd,
      count(*) filter (ev.account_ref <> ch.chosen and fits) as k, coalesce(string_agg(ev.account_ref, ',' order by ev.account_ref) filter (ev.account_ref <> ch.chosen and fits), '') as others from ch join ev using (file_id) group by 1, 2),
  w as (select *, case when own then 'FITS' when k = 1 then 'ELSEWHERE' when not known then 'NEW' when odd then 'CONTRADICTS' else 'UNPROVEN' end as verdict from v)
  select file_id, chosen, verdict, case when verdict in ('ELSEWHERE', 'UNPROVEN') then others else '' end as others from w""")
_PAGE = ["n", "date", "account_ref", "amount", "category"]
_over("ledger_page", bridge.fact, lambda f: reads.ledger_page(ledger.categorised(f), sort="amount", limit=200, offset=50, direction="out", start="1995-01-01", text="merchant 1", least=5000).select(*_PAGE),
      _FACT + f", k as (select *, {_CATEGORY} as category from fact) select n, date, account_ref, amount, category from k where amount < 0 and date >= date '1995-01-01' and lower(raw_description) like '%merchant 1%' and abs(amount) >= 5000 order by amount desc, n limit 200 offset 50")
_over("ledger_total", bridge.fact, lambda f: reads.ledger_filter(ledger.categorised(f), category="transport", end="1996-12-31", most=30000).groupBy("account_ref").agg(F.count("*").alias("rows"), F.sum("amount").alias("net")),
      _FACT + f", k as (select *, {_CATEGORY} as category from fact) select account_ref, count(*) as rows, cast(sum(amount) as bigint) as net from k where category = 'transport' and date <= date '1996-12-31' and abs(amount) <= 30000 group by 1")
_over("derived_fingerprint", bridge.fact, lambda f: reads.fingerprint(f, ["n", "date", "amount", "raw_description", "receipt"], "account_ref"),
      _FACT + """, h as (select account_ref, sha256(concat_ws('|', n, date, amount, raw_description, coalesce(receipt, '~'))) as h from fact)
  select account_ref, count(*) as rows, cast(sum(cast(cast('0x' || substr(h, 1, 15) as bigint) as hugeint)) as varchar) as fingerprint from h group by 1""")


def _spiked(f: DataFrame) -> DataFrame:
    days = ledger.stemmed(f).groupBy("stem", "date").agg(F.sum("amount").alias("amount"))
    return days.withColumn("amount", F.col("amount") * F.when(F.dayofyear("date") % 11 == 0, 3).otherwise(1))


_over("one_off_amounts", bridge.series, lambda f: reads.one_offs(_spiked(f)),
      f"with fact as ({bridge.SERIES}), day as (select {_STEM} as stem, date, cast(sum(amount) * case when dayofyear(date) % 11 = 0 then 3 else 1 end as bigint) as amount from fact group by 1, 2)," + """
  s as (select *, abs(lag(amount) over (partition by stem order by date)) as b, abs(lead(amount) over (partition by stem order by date)) as a from day)
  select stem, date, amount from s where b <> 0 and (abs(amount) >= 2.0 * b or abs(amount) * 2.0 <= b) and abs(a - b) <= cast(0.1 as double) * b""")
_LOAN = "select c_custkey as loan_id, cast(100000 + c_custkey % 700 * 1000 as double) as loan, cast(c_custkey % 9 * 5000 as double) as offset, cast(2.0 + c_custkey % 13 * 0.5 as double) as rate, cast(c_custkey % 37 * 150 as double) as payment, cast(c_custkey % 4 * 100 as double) as extra from customer"


@query("loan_amortise", f"""with recursive loan as ({_LOAN}), w as (
    select loan_id, loan as bal, cast(0.0 as double) as paid, 0 as months, false as stalled from loan
    union all select w.loan_id, case when payment + extra > (bal - "offset") * (rate / 100 / 12) then bal - (payment + extra - (bal - "offset") * (rate / 100 / 12)) else bal end,
      case when payment + extra > (bal - "offset") * (rate / 100 / 12) then paid + (bal - "offset") * (rate / 100 / 12) else paid end, months + 1, payment + extra <= (bal - "offset") * (rate / 100 / 12)
    from w join loan using (loan_id) where not stalled and bal > "offset" + 0.01 and payment + extra > 0 and months < 720),
  e as (select loan_id, max(months) as months, arg_max(paid, months) as paid, arg_max(stalled, months) as stalled from w group by 1)
  select loan_id, case when not stalled then months end as months, cast(round(paid) as bigint) as interest, stalled from e""".replace("as offset", 'as "offset"'))
def _amortised(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return reads.amortise(spark.sql(_LOAN)).select("loan_id", "months", F.round("interest").cast("bigint").alias("interest"), "stalled")


query("stream_ingest", "select event_id as n, event_type as account_ref, cast(round(value * 100) as bigint) as amount from events where event_id is not null")(ingest.replay)


def queries() -> dict[str, Query]:
    from tallyforge.plans import commitment_queries, derive_queries, egress_queries, hub_queries, review_queries, source_queries  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
