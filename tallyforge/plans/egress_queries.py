"""Queries over balance chains, openings and projections of the book, with SQL written from the rules they follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import chains, derive, egress
from tallyforge.plans.derive_queries import _REALS, _shut, _transfers
from tallyforge.plans.hub_queries import Book, over
from tallyforge.session import cut

_POSTED = _REALS + ", ps as (select txn.*, source from txn join acct on ref = account_ref where role <> 'noop')"
over("reconcile_status", _POSTED + """, ed as (select account_ref, v, sum(s) as s from (select account_ref, balance - amount as v, 1 as s from ps where source = 'statement' union all select account_ref, balance, -1 from ps where source = 'statement') group by 1, 2),
  oc as (select account_ref, sum(greatest(s, 0)) as o, sum(greatest(-s, 0)) as c, max(v) filter (s > 0) as ov, max(v) filter (s < 0) as cv from ed group by 1),
  sm as (select account_ref, sum(amount) as t, arg_min(balance - amount, (date, n)) as fv from ps group by 1),
  pt as (select account_ref, date, n, 0 as o, amount, case when amount = 0 then balance end as snap from ps where source = 'declared' union all select account_ref, date, n, 1, amount, null from side where account_ref in ('acct-27', 'acct-28')),
  ct as (select *, count(snap) over (partition by account_ref order by date, n, o rows between unbounded preceding and 1 preceding) as g from pt),
  sp as (select account_ref, g, max(snap) as snap, sum(amount) as moved from ct group by 1, 2 having max(snap) is not null),
  w as (select account_ref, arg_min(snap - moved, g) as opening, arg_max(snap, g) as closing, coalesce(sum(gap), 0) as gap from (select *, snap - moved - lag(snap) over (partition by account_ref order by g) as gap from sp) group by 1)
  select account_ref, case when account_ref = 'acct-2' then 'closed' when o = 1 and c = 1 then 'reconciled' else 'broken' end as status, cast(case when account_ref = 'acct-2' then (case when o = 1 then ov else fv end) when o = 1 and c = 1 then ov else 0 end as bigint) as opening, cast(case when account_ref = 'acct-2' then 900 when o = 1 and c = 1 then cv else 0 end as bigint) as closing, cast(t + case when account_ref = 'acct-2' then 500 else 0 end as bigint) as sum, cast(0 as bigint) as gap from oc join sm using (account_ref)
  union all select account_ref, 'declared', cast(coalesce(opening, 0) as bigint), cast(coalesce(closing, 0) as bigint), cast(t as bigint), cast(coalesce(gap, 0) as bigint) from sm left join w using (account_ref) where account_ref in ('acct-27', 'acct-28')
  union all select ref, 'clearing', cast(closing - coalesce((select sum(amount) from side where side.account_ref = ref), 0) as bigint), closing, 0, 0 from acct where source = 'clearing'""")(
    lambda b: chains.reconcile(b["txn"], b["acct"], _transfers(b), _shut(b)).select("account_ref", "status", *[F.col(c).cast("bigint").alias(c) for c in ("opening", "closing", "sum", "gap")]))
_FORK = ", tx as (select * from txn where role <> 'noop'), fk as (select account_ref, 'OPENING' as side, balance - amount as value, list_sort(list(external_id)) as ids from tx group by 1, 2, 3 having count(*) > 1 union all select account_ref, 'CLOSING', balance, list_sort(list(external_id)) from tx group by 1, 2, 3 having count(*) > 1)"
over("chain_forks", _FORK + " select account_ref, side, cast(value as bigint) as value, array_to_string(ids, ',') as ids from fk")(lambda b: chains.forks(b["txn"].where(F.col("role") != "noop")).withColumn("ids", F.array_join("ids", ",")))
over("chain_preview", _FORK + """, mem as (select distinct unnest(ids) as external_id from fk), smm as (select external_id, account_ref from tx join mem using (external_id)),
  pairs as (select s.external_id as out_id, t.* from smm s join tx t on t.account_ref = s.account_ref and t.external_id <> s.external_id),
  e as (select out_id, account_ref, v, sum(x) as s from (select out_id, account_ref, balance - amount as v, 1 as x from pairs union all select out_id, account_ref, balance, -1 from pairs) group by 1, 2, 3)
  select out_id as external_id, account_ref, cast(sum(greatest(s, 0)) as bigint) as openings, cast(sum(greatest(-s, 0)) as bigint) as closings from e group by 1, 2""")(lambda b: chains.preview(b["txn"].where(F.col("role") != "noop")))
over("account_openings", _REALS + """, o as (select txn.*, source from txn join acct on ref = account_ref),
  s as (select account_ref, cast(sum(amount) as bigint) + case when account_ref = 'acct-2' then 500 else 0 end as t, case when account_ref = 'acct-2' then 900 else arg_max(balance, (date, n)) end as latest, arg_min(balance - amount, (date, n)) as forward from o where source = 'statement' group by 1),
  f as (select account_ref, min((date, n)) as at0 from o where source = 'declared' and amount = 0 group by 1),
  w as (select o.account_ref, arg_min(balance, (date, n)) filter (amount = 0) as b0, arg_max(balance, (date, n)) filter (amount = 0) as b1, coalesce(sum(amount) filter ((date, n) < at0), 0) as pre, coalesce(sum(amount) filter ((date, n) > at0), 0) as post from o join f on f.account_ref = o.account_ref group by 1)
  select account_ref, cast(latest as bigint) as latest, cast(latest - t as bigint) as backward, cast(forward as bigint) as forward, cast(latest - t - forward as bigint) as gap from s
  union all select account_ref, cast(b1 as bigint), cast(b0 - pre as bigint), cast(b0 - pre as bigint), cast(b1 - (b0 - pre) - post as bigint) from w
  union all select ref, closing, cast(closing - coalesce((select sum(amount) from side where account_ref = ref), 0) as bigint), cast(closing - coalesce((select sum(amount) from side where account_ref = ref), 0) as bigint), 0 from acct where source = 'clearing'""")(
    lambda b: chains.openings(b["txn"], b["acct"], _transfers(b), _shut(b)).select("account_ref", *[F.col(c).cast("bigint").alias(c) for c in ("latest", "backward", "forward", "gap")]))
_STEM = r"upper(regexp_replace(regexp_replace(regexp_replace(x.raw_description, '( - Visa Purchase| - Receipt| {3,}).*$', ''), '\s+', ' ', 'g'), '\s+$', ''))"
_UNIT = rf""", unit as (select t.transfer_id as unit_id, 'TRANSFER' as kind, x.date, abs(x.amount) as amount, currency, 'TRANSFER' as category from transfer t join txn x on x.external_id = case when clearing = from_leg then to_leg else from_leg end join acct on ref = x.account_ref
  union all select external_id, 'EXTERNAL', date, amount, currency, category from txn join acct on ref = account_ref where role <> 'noop' and leg = 'EXTERNAL' and not (source = 'declared' and amount = 0)),
  pu as (select u.*, case when t.clearing is null and a.amount > 0 and b.amount < 0 then b.account_ref else coalesce(a.account_ref, t.clearing) end as pays, case when t.clearing is null and a.amount > 0 and b.amount < 0 then a.account_ref else coalesce(b.account_ref, t.clearing) end as gets, coalesce(a.raw_description, b.raw_description) as text, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) as n, array_to_string(list_sort([from_leg, to_leg]), ',') as legs
    from unit u join transfer t on t.transfer_id = u.unit_id left join txn a on a.external_id = from_leg left join txn b on b.external_id = to_leg where kind = 'TRANSFER'
    union all select u.*, account_ref, null, raw_description, x.n, '' from unit u join txn x on x.external_id = u.unit_id where kind <> 'TRANSFER')"""


def units(b: Book) -> DataFrame:
    return egress.projected(derive.units(b["transfer"], b["txn"], b["acct"]), b["txn"], b["transfer"])


def _openings(b: Book) -> DataFrame:
    return b["acct"].select(F.col("ref").alias("account_ref"), (F.length("ref").cast("bigint") * 100 - 600).alias("opening"))


over("projection_units", _UNIT + " select * from pu")(units)
over("posting_rows", _UNIT + rf""", x as (select *, text as raw_description from pu) select 1 as type, null as category, ref as account, null as to_account, length(ref) * 100 - 600 as amount, date '1994-12-31' as date, 'opening' as comment, cast(epoch(timestamp '1994-12-31 12:00:00' - interval 11 hour) as bigint) as at, 660 as offset from acct where length(ref) * 100 <> 600
  union all select case when kind = 'TRANSFER' then 4 when amount < 0 then 3 else 2 end, category, pays, gets, abs(amount), date, substr({_STEM} || ' — ' || regexp_replace(x.text, '\s+', ' ', 'g'), 1, 255), cast(epoch(timezone('Australia/Sydney', date + interval 12 hour)) as bigint), cast((epoch(date + interval 12 hour) - epoch(timezone('Australia/Sydney', date + interval 12 hour))) / 60 as int) from x where kind = 'TRANSFER' or amount <> 0""".replace(" as offset", ' as "offset"'))(
    lambda b: egress.postings(units(b), _openings(b), "Australia/Sydney", "1994-12-31"))
_MOVED = _UNIT + ", mv as (select account_ref, cast(sum(amount) as bigint) as m from (select pays as account_ref, case when kind = 'TRANSFER' then -abs(amount) else amount end as amount from pu union all select gets, abs(amount) from pu where gets is not null) group by 1)"
over("posting_verify", _MOVED + " select ref as account_ref, length(ref) * 100 - 600 + coalesce(m, 0) as expected, case when length(ref) = 6 then coalesce(m, 0) when ref <> 'acct-15' then 1 end as found from acct left join mv on mv.account_ref = ref where (length(ref) * 100 - 600 + coalesce(m, 0)) is distinct from case when length(ref) = 6 then coalesce(m, 0) when ref <> 'acct-15' then 1 end")(
    lambda b: (lambda u: egress.verify(u, _openings(b), b["acct"].select(F.col("ref").alias("account_ref")).where(F.col("ref") != "acct-15").join(egress.movements(u).groupBy("account_ref").agg(F.sum("amount").alias("m")), "account_ref", "left").select("account_ref", F.when(F.length("account_ref") == 6, F.coalesce("m", F.lit(0))).otherwise(1).cast("bigint").alias("balance"))))(units(b)))
over("postings", _UNIT + rf""", x as (select *, text as raw_description from pu) select unit_id, case when kind = 'TRANSFER' then 'transfer' when amount < 0 then 'withdrawal' else 'deposit' end as type, case when kind = 'TRANSFER' or amount < 0 then pays else {_STEM} end as source, case when kind = 'TRANSFER' then gets when amount < 0 then {_STEM} else pays end as destination,
    printf('%d.%02d', abs(amount) // 100, abs(amount) % 100) as amount, 'category:' || category as tag from x""")(lambda b: egress.posting(units(b)))
_STATE = _UNIT + """, hu as (select *, 'h' || cast(abs(amount) + n % 3 as varchar) as hash, category as cat from pu),
  stt as (select unit_id, case when n % 13 = 0 then 'other' else coalesce(category, '') end as category, case when n % 11 = 0 then 'old' else hash end as hash, 'g' || unit_id as group_id from hu where n % 7 <> 0
    union all select 'was-' || unit_id, '', 'h', 'gw' || unit_id from hu where kind = 'EXTERNAL' and n % 21 = 0 union all select 'TRF-was-' || unit_id, '', 'h', 'gw' || unit_id from hu where kind = 'TRANSFER' and n % 14 = 0),
  grp as (select group_id, not ends_with(group_id, '4') as ours, case when starts_with(unit_id, 'TRF-was') then (select legs from hu where 'TRF-was-' || hu.unit_id = stt.unit_id) else '' end as legs from stt where not ends_with(group_id, '6'))"""


def _state(u: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Units with hashes, a state that lags behind them, the groups that are there, and ids that were replaced."""
    h = cut(u.withColumn("hash", F.concat(F.lit("h"), (F.abs("amount") + F.col("n") % 3).cast("string"))).withColumn("category", F.coalesce("category", F.lit(""))))
    n = F.col("n")
    now = h.where(n % 7 != 0).select("unit_id", F.when(n % 13 == 0, "other").otherwise(F.col("category")).alias("category"), F.when(n % 11 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.concat(F.lit("g"), "unit_id").alias("group_id"), F.lit("").alias("_legs"))
    was = lambda kind, mod, name, legs: h.where((F.col("kind") == kind) & (n % mod == 0)).select(F.concat(F.lit(name), "unit_id").alias("unit_id"), F.lit("").alias("category"), F.lit("h").alias("hash"), F.concat(F.lit("gw"), "unit_id").alias("group_id"), legs.alias("_legs"))
    state = cut(now.unionByName(was("EXTERNAL", 21, "was-", F.lit(""))).unionByName(was("TRANSFER", 14, "TRF-was-", F.col("legs"))))
    groups = state.where(~F.col("group_id").endswith("6")).select("group_id", (~F.col("group_id").endswith("4")).alias("ours"), F.col("_legs").alias("legs"))
    resolved = h.where((F.col("kind") == "EXTERNAL") & (n % 21 == 0)).select(F.concat(F.lit("was-"), "unit_id").alias("id"), F.col("unit_id").alias("current_id"))
    return h, state.drop("_legs"), groups, resolved


over("projection_plan_full", _STATE + """, j as (select hu.unit_id, case when stt.unit_id is null then 'create' when coalesce(hu.category, '') <> stt.category then 'retag' when hu.hash <> stt.hash then 'update' else 'unchanged' end as plan from hu left join stt on stt.unit_id = hu.unit_id),
  orp as (select stt.unit_id, grp.ours, (select h.unit_id from hu h where 'was-' || h.unit_id = stt.unit_id or 'TRF-was-' || h.unit_id = stt.unit_id) as nxt, grp.legs, starts_with(stt.unit_id, 'TRF-') as mv from stt left join grp using (group_id) where stt.unit_id not in (select unit_id from hu)),
  jj as (select orp.unit_id, nxt, case when ours is null then 'gone' when j.plan = 'create' and (not mv or legs <> '') then (case when ours then 'rekey' else 'foreign' end) else 'orphan' end as plan from orp left join j on j.unit_id = orp.nxt)
  select unit_id, plan from j where unit_id not in (select nxt from jj where plan = 'rekey') union all select unit_id, plan from jj""")(lambda b: egress.plan(*_state(units(b))))
over("projection_findings", _STATE + """, g2 as (select group_id, case when ends_with(group_id, '3') then 'bad' else stt.unit_id end as external_id, ours, case when ends_with(group_id, '8') then 2 else 1 end as splits, '' as legs, case when ends_with(group_id, '5') then 'seen' else hash end as seen, 77 as total from grp join stt using (group_id)),
  v as (select stt.unit_id, hu.unit_id is not null as cur, g2.external_id is not null as there, coalesce(ours, false) as ours, splits, external_id, seen, stt.hash, hu.hash as now, abs(amount) as amt, total from stt left join hu using (unit_id) left join g2 using (group_id))
  select unit_id, 'ORPHAN' as finding from v where not cur union all select unit_id, 'MISSING' from v where cur and not there union all select unit_id, 'UNTAGGED' from v where cur and there and not ours union all select unit_id, 'TAMPERED' from v where cur and ours and external_id <> unit_id
  union all select unit_id, 'DRIFT' from v where cur and ours and splits = 1 and seen <> hash union all select unit_id, 'BEHIND' from v where cur and ours and splits = 1 and seen = hash and now <> hash union all select unit_id, 'HAND_SPLIT' from v where cur and ours and splits <> 1 and total <> amt""")(
    lambda b: (lambda s: egress.findings(s[0], s[1], s[2].join(s[1].select("group_id", "unit_id", "hash"), "group_id").select("group_id", F.when(F.col("group_id").endswith("3"), "bad").otherwise(F.col("unit_id")).alias("external_id"), "ours", F.when(F.col("group_id").endswith("8"), 2).otherwise(1).alias("splits"), F.lit("").alias("legs"), F.when(F.col("group_id").endswith("5"), "seen").otherwise(F.col("hash")).alias("hash"), F.lit(77).alias("total")), s[3]))(_state(units(b))))
over("export_all", "select n, date, account_ref as account, currency, amount as amount_cents, balance as balance_cents, category, origin, leg, transfer_id, external_id, raw_description from txn join acct on ref = account_ref")(lambda b: egress.export(b["txn"], b["acct"]))
