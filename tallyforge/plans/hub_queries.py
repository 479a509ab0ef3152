"""Queries over the read model of the book, with SQL written from the rules they follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import periods
from tallyforge.operators import hub, reads
from tallyforge.plans import book
from tallyforge.plans.registry import query

Book = book.Book
DAY, MONTH = book.AS_OF, "2001-06"
LOANS, REPAYMENTS, INTEREST = ["acct-8", "acct-9"], ["com-1", "com-6", "com-11"], ["com-2", "com-7", "com-12"]


def over(name: str, body: str | None, recursive: bool = False) -> Callable[[Callable[[Book], DataFrame]], Callable]:
    """Register an operator on the book's tables, with the rest of its oracle's text."""

    def add(f: Callable[[Book], DataFrame]) -> Callable:
        query(name, None if body is None else book.sql(body, recursive))(lambda spark, sf_dir: f(book.load(spark, sf_dir)))
        return f

    return add


over("ledger_enriched", """select t.external_id, exists (select 1 from review r where r.subject = t.external_id) as has_review,
    (select n.text from note n where n.external_id = t.external_id order by n.decision_n desc limit 1) as latest_note, cf.commitment_id, c.name as commitment_name,
    (select o.account_ref from txn o where o.transfer_id = t.transfer_id and o.external_id <> t.external_id order by o.external_id limit 1) as counterpart_account
  from txn t left join commitment_fact cf on cf.external_id = t.external_id left join commitment c on c.commitment_id = cf.commitment_id""")(
    lambda b: hub.ledger_enriched(b["txn"], b["review"], b["note"], b["commitment_fact"], b["commitment"]).select("external_id", "has_review", "latest_note", "commitment_id", "commitment_name", "counterpart_account"))
over("review_enriched", r"""select r.subject, r.kind, r.detail, regexp_replace(regexp_replace(x.raw_description, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') as description, x.date,
    coalesce(x.account_ref, case when r.kind = 'BALANCE_BREAK' then r.subject end) as account_ref, x.amount
  from review r left join (select f.* from obs f where f.n = (select max(g.n) from obs g where g.external_id = f.external_id)) x on x.external_id = r.subject""")(lambda b: hub.review_enriched(b["review"], b["obs"]))
over("review_filtered", """select r.subject, r.kind from review r left join (select external_id, arg_max(account_ref, n) as account_ref from obs group by 1) x on x.external_id = r.subject
  where coalesce(x.account_ref, case when r.kind = 'BALANCE_BREAK' then r.subject end) = 'acct-4'""")(lambda b: hub.review_enriched(b["review"], b["obs"], account="acct-4").select("subject", "kind"))
over("ledger_filter_full", """select external_id from txn t where leg = 'HELD' and role = 'transaction' and amount < 0 and lower(raw_description) like '%trans_er%' and abs(amount) between 1000 and 15000
  and date between date '1996-01-01' and date '2000-12-31' and exists (select 1 from review r where r.subject = t.external_id)""")(
    lambda b: reads.ledger_filter(b["txn"], leg="HELD", role="transaction", direction="out", text="TRANS_ER", least=1000, most=15000, start="1996-01-01", end="2000-12-31", review=b["review"]).select("external_id"))
over("ledger_sorted_page", "select external_id, amount from txn where account_ref = 'acct-7' order by amount desc, external_id limit 100 offset 20")(
    lambda b: reads.ledger_page(b["txn"], sort="amount", limit=100, offset=20, key="external_id", account="acct-7").select("external_id", "amount"))
over("index_scan", "select case when synthetic then 'synthetic' when role = 'noop' then 'noops' else 'transactions' end as scan, count(*) as rows, cast(sum(amount) as bigint) as net from txn group by 1")(
    lambda b: reads.scans(b["txn"]))
over("review_counts", "select kind, count(*) as items from review group by kind")(lambda b: b["review"].groupBy("kind").agg(F.count("*").alias("items")))
over("decision_counts", "select user_id, action, count(distinct n) as decisions from dec group by 1, 2")(lambda b: b["dec"].groupBy("user_id", "action").agg(F.countDistinct("n").alias("decisions")))
over("evidence_ids", "select distinct evidence_id from obs where evidence_id is not null")(lambda b: b["obs"].where(F.col("evidence_id").isNotNull()).select("evidence_id").distinct())
over("log_head", "select max(n) as head, count(*) as lines from (select n from obs union all select n from dec union all select n from marker)")(
    lambda b: b["obs"].select("n").unionByName(b["dec"].select("n")).unionByName(b["marker"].select("n")).agg(F.max("n").alias("head"), F.count("*").alias("lines")))
over("month_account_net", "select account_ref, cast(sum(amount) as bigint) as net from txn where role <> 'noop' and date between date '2001-06-01' and date '2001-06-30' group by 1")(
    lambda b: b["txn"].where((F.col("role") != "noop") & F.col("date").between(F.lit("2001-06-01").cast("date"), F.lit("2001-06-30").cast("date"))).groupBy("account_ref").agg(F.sum("amount").alias("net")))
_BATCH = ", batch as (select s.batch, s.file, s.account_ref, s.n as n_start, c.n as n_end, c.appended, c.status, s.at_ms as started_ms, c.at_ms as completed_ms from marker s left join marker c on c.batch = s.batch and c.phase = 'complete' where s.phase = 'start')"
over("ingest_batches", _BATCH + " select * from batch")(lambda b: hub.ingest_batches(b["marker"]))
over("newest_batches", _BATCH + f" select batch.*, (select max(t.date) from txn t where t.account_ref = batch.account_ref and t.date <= date '{DAY}') as frontier from batch order by n_start desc limit 50")(
    lambda b: hub.newest_batches(hub.ingest_batches(b["marker"]), b["txn"], DAY))
over("batches_since", _BATCH + " select batch from batch where n_end > 5000")(lambda b: hub.newest_batches(hub.ingest_batches(b["marker"]), b["txn"], DAY, since_n=5000).select("batch"))
over("last_imports", _BATCH + " select account_ref, file, status, started_ms from (select *, row_number() over (partition by account_ref order by started_ms desc) as r from batch where status is null or status <> 'guard_refused') where r = 1")(
    lambda b: hub.last_imports(hub.ingest_batches(b["marker"])))
over("batch_files", _BATCH + " select t.external_id, batch.file from txn t left join batch on batch.account_ref = t.account_ref and t.n > batch.n_start and t.n < batch.n_end")(
    lambda b: hub.with_files(b["txn"], hub.ingest_batches(b["marker"])).select("external_id", "file"))
_COVER = """{batch}, cal as (select ref, cast(unnest(generate_series({first}, date '2001-06-30', interval 1 {grain})) as date) as d from acct),
  keyed as (select t.account_ref, strftime(t.date, '{key}') as bucket, batch.file from txn t left join batch on batch.account_ref = t.account_ref and t.n > batch.n_start and t.n < batch.n_end where t.date between {start} and date '2001-06-30'),
  got as (select account_ref, bucket, count(*) as rows, coalesce(array_to_string(list_sort(list(distinct file) filter (file is not null)), ','), '') as files from keyed group by 1, 2),
  tot as (select account_ref, strftime(min(date), '{key}') as a, strftime(max(date), '{key}') as z from txn group by 1)
  select cal.ref as account_ref, strftime(cal.d, '{key}') as bucket, coalesce(got.rows, 0) as rows, case when a is null then 'none' when strftime(cal.d, '{key}') < a then 'before' when strftime(cal.d, '{key}') > z then 'after' when rows is not null then 'facts' else 'hole' end as state, coalesce(got.files, '') as files
  from cal left join tot on tot.account_ref = cal.ref left join got on got.account_ref = cal.ref and got.bucket = strftime(cal.d, '{key}')"""
over("coverage_weeks", _COVER.format(batch=_BATCH, grain="week", key="%G-W%V", start="date '1994-06-20'", first="date '1994-06-20'"))(lambda b: hub.coverage(b["acct"], b["txn"], hub.ingest_batches(b["marker"]), "1994-06-20", "2001-06-30"))
over("coverage_months", _COVER.format(batch=_BATCH, grain="month", key="%Y-%m", start="date '1994-06-01'", first="date '1994-06-01'"))(lambda b: hub.coverage(b["acct"], b["txn"], hub.ingest_batches(b["marker"]), "1994-06-01", "2001-06-30", "month"))
over("expected_totals", "select direction, count(*) as occurrences, cast(sum(case when o.amount is not null then abs(o.amount) when c.current_amount is not null then abs(c.current_amount) else 0 end) as bigint) as committed from occurrence o join commitment c using (commitment_id) where due_date between date '2001-06-01' and date '2001-06-30' group by 1")(
    lambda b: hub.expected(b["occurrence"], b["commitment"], "2001-06-01", "2001-06-30"))
over("arrears_running", "select commitment_id, due_date, cast(abs(coalesce(current_amount, 0)) as bigint) as expected, cast(sum(abs(coalesce(current_amount, 0))) over (order by due_date, commitment_id) as bigint) as running from occurrence o join commitment c using (commitment_id) where status = 'missed'")(
    lambda b: hub.arrears(b["occurrence"], b["commitment"]))
over("manual_to_pay", f"""select commitment_id, due_date, status, coalesce(remind_days, 5) as remind_days, case when due_date < date '{DAY}' then 'overdue' else 'upcoming' end as bucket from occurrence join commitment using (commitment_id)
  where origin = 'declared' and retired_n is null and payment = 'manual' and ((status = 'due' and due_date between date '{DAY}' and date '{DAY}' + coalesce(remind_days, 5)) or (status in ('due', 'missed', 'awaiting') and due_date >= date '{DAY}' - 30 and due_date < date '{DAY}'))""")(
    lambda b: hub.manual_to_pay(b["occurrence"], b["commitment"], DAY))
over("due_this_week", "select count(*) as due from occurrence o join commitment c using (commitment_id) where c.origin = 'declared' and o.status = 'due' and due_date between date '2001-07-09' and date '2001-07-15'")(
    lambda b: hub.due_in(b["occurrence"], b["commitment"], periods.bounds(F.lit("2001-W28"))["first"], periods.bounds(F.lit("2001-W28"))["last"]))
over("stale_accounts", "select account_ref, max(date) as frontier, cast(date '2001-09-02' - max(date) as int) as days, fetch_days from txn join acct on acct.ref = account_ref where not synthetic and date <= date '2001-09-02' and coalesce(fetch_days, 0) <> 0 group by account_ref, fetch_days having date '2001-09-02' - max(date) > fetch_days")(
    lambda b: hub.stale_accounts(b["acct"], b["txn"], "2001-09-02"))
over("stale_acks", """, ack as (select user_id, id1 as external_id, case when n % 3 = 0 then 'sha-' || cast((cast(substr(id1, 2) as bigint) + 1) % 1000 as varchar) else 'sha-0' end as state_hash, case when n % 5 = 1 then 'v1' else 'v2' end as hash_version from dec where action = 'USER_ACK')
  select user_id, ack.external_id, hash_version <> 'v2' or t.state_hash is null or t.state_hash <> ack.state_hash as stale from ack left join txn t on t.external_id = ack.external_id""")(
    lambda b: hub.stale_acks(b["dec"].where(F.col("action") == "USER_ACK").select("user_id", F.col("id1").alias("external_id"), F.when(F.col("n") % 3 == 0, F.concat(F.lit("sha-"), ((F.substring("id1", 2, 20).cast("bigint") + 1) % 1000).cast("string"))).otherwise("sha-0").alias("state_hash"), F.when(F.col("n") % 5 == 1, "v1").otherwise("v2").alias("hash_version")), b["txn"], "v2").select("user_id", "external_id", "stale"))
over("since", _BATCH + """ select 'facts' as what, account_ref as key, count(*) as number from obs where n > 9000 group by 2 union all select 'batches', '', count(*) from batch where n_end > 9000 having count(*) > 0
  union all select 'items', '', count(*) from review where opened_ms > 1600009000000 having count(*) > 0
  union all select 'occurrences', status, count(*) from occurrence o left join txn t on t.external_id = o.matched_id where (status = 'occurred' and t.n > 9000) or (status = 'missed' and window_end > date '2020-09-13') group by 2
  union all select 'decisions', coalesce(user_id, ''), count(*) from dec where n > 9000 and (user_id is null or user_id <> 'user-1') group by 2""")(
    lambda b: hub.since(9000, 1600009000000, "user-1", b["obs"], hub.ingest_batches(b["marker"]), b["review"], b["occurrence"], b["txn"], b["dec"]))
over("activity_candidate", r"select external_id, date, amount, cast(null as varchar) as matched_by, false as excluded from txn where not synthetic and role <> 'noop' and upper(regexp_replace(split_part(raw_description, ' - Visa', 1), '\s+', ' ', 'g')) = 'MERCHANT 7 LOW'")(
    lambda b: hub.activity("cand", "MERCHANT 7 LOW", "out", None, "", b["txn"], b["commitment_fact"], b["commitment_fact"]))
over("activity_declared", """select t.external_id, date, amount, matched_by, false as excluded from commitment_fact cf join txn t using (external_id) where commitment_id = 'com-9'
  union all select t.external_id, date, amount, 'rule', true from commitment_fact x join txn t using (external_id) where commitment_id = 'com-10' and amount < 0 and date <= date '2000-01-01' and regexp_matches(raw_description, '(?i)merchant')""")(
    lambda b: hub.activity("com-9", None, "out", "2000-01-01", "merchant", b["txn"], b["commitment_fact"], b["commitment_fact"].where(F.col("commitment_id") == "com-10").withColumn("commitment_id", F.lit("com-9"))))
over("transfer_only", "select commitment_id, count(*) = count(transfer_id) as transfer_only from commitment_fact join txn using (external_id) group by 1")(lambda b: hub.transfer_only(b["commitment_fact"], b["txn"]))
_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
_WALK = f""", ta as (select t.*, a.liquid as own, (select o.account_ref from txn o where o.transfer_id = t.transfer_id and o.external_id <> t.external_id order by o.external_id limit 1) as other from txn t join acct a on a.ref = t.account_ref),
  r as (select ta.*, cf.commitment_id, oc.matched_id is not null as attached, coalesce(b.liquid, false) as too, ta.account_ref in ({_quoted(LOANS)}) as loan, case when trim(coalesce(category, '')) = '' then 'UNCATEGORIZED' else category end as cat
    from ta left join commitment_fact cf using (external_id) left join occurrence oc on oc.matched_id = ta.external_id left join acct b on b.ref = ta.other where not synthetic and date between date '{MONTH}-01' and date '{MONTH}-30'),
  post as (select *, transfer_id is not null and other is not null as move from r where role <> 'noop'),
  flow as (select * from post where not move and not (not attached and leg = 'HELD') and (own or loan)),
  cc as (select commitment_id, arg_min(category, external_id) as ccat from r where commitment_id is not null and category is not null group by 1),
  tro as (select commitment_id, bool_and(transfer_id is not null) as tonly from commitment_fact join txn using (external_id) group by 1),
  oc as (select o.*, c.direction = 'in' as inn, abs(coalesce(c.current_amount, 0)) as owed, abs(coalesce(o.amount, 0)) as moved, case when trim(coalesce(ccat, '')) = '' then 'UNCATEGORIZED' else ccat end as kind, o.commitment_id in ({_quoted(REPAYMENTS)}) as rep, coalesce(tonly, false) as tonly, o.commitment_id in ({_quoted(INTEREST)}) as intr,
      status in ('occurred', 'settled', 'partial') as paid, status in ('due', 'awaiting') as opn
    from occurrence o join commitment c using (commitment_id) left join cc using (commitment_id) left join tro using (commitment_id)
    where case when status in ('occurred', 'settled', 'partial') then coalesce(matched_date, due_date) else due_date end between date '{MONTH}-01' and date '{MONTH}-30'),
  cnt as (select * from oc where not rep and not tonly),
  line as (
    select 'repayments' as figure, other as key, -amount as amount from post where move and own and not too and other in ({_quoted(LOANS)})
    union all select 'set_aside', other, -amount from post where move and own and not too and other not in ({_quoted(LOANS)})
    union all select 'unpaired', '', abs(amount) from post where not move and not attached and leg = 'HELD'
    union all select 'charges', account_ref, -amount from flow where loan
    union all select case when amount < 0 then 'loan_spend' else 'loan_income' end, cat, abs(amount) from flow where loan
    union all select case when amount < 0 then 'spend' else 'income' end, cat, abs(amount) from flow where not attached
    union all select 'uncommitted', '', -amount from flow where not attached and amount < 0
    union all select 'repayment_due', '', owed from oc where rep and opn and not inn
    union all select 'settled_without_fact', '', case when inn then moved else -moved end from cnt where paid and matched_id is null
    union all select case when inn then 'income' else 'spend' end, kind, moved from cnt where paid
    union all select 'committed_paid', '', moved from cnt where paid and not inn
    union all select case when inn then 'income_due' when intr then 'interest_due' else 'committed_due' end, '', owed from cnt where opn
    union all select 'missed', '', owed from cnt where status = 'missed' and not inn
    union all select 'liquid_net', '', amount from txn join acct on acct.ref = account_ref and liquid where role <> 'noop' and date between date '{MONTH}-01' and date '{MONTH}-30'
    union all select 'unrecorded', '', unrecorded from cash_book join acct on acct.ref = account_ref and liquid where month = '{MONTH}'),
  walk as (select figure, key, cast(sum(amount) as bigint) as amount from line group by 1, 2)"""


def _lines(b: Book) -> DataFrame:
    return hub.walk_lines(MONTH, b["txn"], b["occurrence"], b["commitment"], b["commitment_fact"], b["acct"], b["cash_book"], LOANS, REPAYMENTS, INTEREST)


_FIGURES = ("income", "income_due", "committed_paid", "uncommitted", "committed_due", "interest_due", "unrecorded", "missed", "unpaired", "settled_without_fact", "liquid_net", "repayment_due")
over("cashflow_walk", _WALK + " select * from walk")(_lines)
over("headroom", _WALK + ", h as (select " + ", ".join(f"cast(coalesce(sum(amount) filter (figure = '{f}'), 0) as bigint) as {f}" for f in _FIGURES) + " from walk) select *, income + income_due - committed_paid - uncommitted - committed_due - interest_due - unrecorded as left from h".replace(" as left", ' as "left"'))(
    lambda b: hub.headroom(_lines(b)))
_SHEET = _WALK + """, sp as ({spend}), named as (select key, amount, case when trim(coalesce(grp, '')) = '' then 'Expense' else grp end as g from sp left join category_group on category = key),
  part as (select g as slice, key as part, amount from named where key not in ('salary') and g not in ('Nope') {more}
    union all select 'Due', '', sum(amount) from walk where figure in ('committed_due', '{due}') union all select 'Unrecorded', '', sum(amount) from walk where figure = 'unrecorded'),
  tot as (select slice, sum(amount) as s from part where coalesce(amount, 0) <> 0 group by 1)
  select slice, part, cast(amount as bigint) as amount, cast(s as bigint) as slice_amount from part join tot using (slice) where coalesce(amount, 0) <> 0 and s <> 0"""
over("cashflow_sheet_cost", _SHEET.format(spend="select key, amount from walk where figure = 'spend' and amount <> 0", more="", due="interest_due"))(
    lambda b: hub.sheet(_lines(b), b["category_group"].withColumnRenamed("grp", "group"), False, ["salary", "Nope"]))
over("cashflow_sheet_cash", _SHEET.format(spend="select key, sum(case figure when 'spend' then amount else -amount end) as amount from walk where figure in ('spend', 'loan_spend') group by 1 having sum(case figure when 'spend' then amount else -amount end) <> 0", due="repayment_due",
    more="""union all select 'Mortgage', 'Interest & fees', sum(amount) from walk where figure = 'charges' union all select 'Mortgage', 'Principal', sum(case figure when 'repayments' then amount else -amount end) from walk where figure in ('repayments', 'charges')
      union all select 'Set aside', key, amount from walk where figure = 'set_aside'"""))(
    lambda b: hub.sheet(_lines(b), b["category_group"].withColumnRenamed("grp", "group"), True, ["salary", "Nope"]))
over("map_difference", _WALK + " select key, cast(sum(case figure when 'spend' then amount else -amount end) as bigint) as amount from walk where figure in ('spend', 'loan_spend') group by 1 having sum(case figure when 'spend' then amount else -amount end) <> 0")(
    lambda b: (lambda w: hub.map_difference(w.where(F.col("figure") == "spend"), w.where(F.col("figure") == "loan_spend")))(_lines(b)))
for _grain, _key in (("week", "%G-W%V"), ("month", "%Y-%m"), ("day", "%Y-%m-%d")):
    over(f"eyeball_{_grain}s", f""", p as (select *, strftime(date, '{_key}') as bucket, row_number() over (partition by strftime(date, '{_key}'), account_ref order by date desc, n desc) as r from txn where date between date '1999-01-01' and date '2000-06-30')
      select bucket, cast(sum(case when leg = 'MATCHED' then 0 else amount end) as bigint) as total, min(date) as first, max(date) as last, string_agg(case when r = 1 then account_ref || ':' || cast(cast(balance as bigint) as varchar) end, ',' order by account_ref || ':' || cast(cast(balance as bigint) as varchar)) as closing from p group by 1""")(
        lambda b, g=_grain: hub.eyeball_buckets(b["txn"], "1999-01-01", "2000-06-30", g))
_KEYS = "select case when o_orderkey % 5 = 0 then strftime(cast(o_orderdate as date), '%Y') when o_orderkey % 5 = 1 then strftime(cast(o_orderdate as date), '%Y') || '-Q' || quarter(o_orderdate) when o_orderkey % 5 = 2 then strftime(cast(o_orderdate as date), '%Y-%m') when o_orderkey % 5 = 3 then strftime(cast(o_orderdate as date), '%G-W%V') else strftime(cast(o_orderdate as date), '%Y-%m-%d') end as p, cast(o_orderdate as date) as d, o_orderkey as n from orders"


def _period_keys(b: Book) -> DataFrame:
    day, n = F.col("date"), F.col("n") - 1
    kind = n % 5
    year = F.date_format(day, "yyyy")
    key = F.when(kind == 0, year).when(kind == 1, F.concat(year, F.lit("-Q"), F.quarter(day).cast("string"))).when(kind == 2, F.date_format(day, "yyyy-MM")).when(kind == 3, periods.week_key(day)).otherwise(day.cast("string"))
    span = periods.bounds(F.col("p"))
    return b["said"].where(F.col("n") < 1000000000).select(n.alias("n"), key.alias("p"), F.col("date").alias("d")).select("n", "p", span["first"].alias("first"), span["last"].alias("last"), F.col("d").between(span["first"], span["last"]).alias("inside"))


query("period_bounds", f"""with k as ({_KEYS}) select n, p, true as inside,
    cast(case n % 5 when 0 then date_trunc('year', d) when 1 then date_trunc('quarter', d) when 2 then date_trunc('month', d) when 3 then date_trunc('week', d) else d end as date) as first,
    cast(case n % 5 when 0 then date_trunc('year', d) + interval 1 year - interval 1 day when 1 then date_trunc('quarter', d) + interval 3 month - interval 1 day when 2 then last_day(d) when 3 then date_trunc('week', d) + interval 6 day else d end as date) as last from k""")(
    lambda spark, sf_dir: _period_keys(book.load(spark, sf_dir)))
over("period_add", """, s as (select commitment_id, anchor, cadence, unnest(range(0, 14)) as k from commitment) select commitment_id, cast(k as int) as k,
    cast(case cadence when 'weekly' then anchor + interval 7 day * k when 'fortnightly' then anchor + interval 14 day * k when 'monthly' then anchor + interval 1 month * k when 'bimonthly' then anchor + interval 2 month * k when 'quarterly' then anchor + interval 3 month * k when 'semiannual' then anchor + interval 6 month * k else anchor + interval 12 month * k end as date) as due from s""")(
    lambda b: b["commitment"].withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(13)))).select("commitment_id", "k", periods.step(F.col("anchor"), F.col("cadence"), F.col("k")).alias("due")))
over("cadence_due", "select n, case when n % 4 = 0 then false else at_ms // (n % 4 * 3600000) <> (at_ms + n % 7000000) // (n % 4 * 3600000) end as due from txn")(
    lambda b: b["txn"].select("n", periods.cadence_due(F.col("at_ms"), F.col("at_ms") + F.col("n") % 7000000, F.col("n") % 4 * 3600000).alias("due")))
