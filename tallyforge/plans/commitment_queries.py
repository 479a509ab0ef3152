"""Queries over commitments and recurring series of the book, with SQL written from the rules they follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import commitments
from tallyforge.plans import book
from tallyforge.plans.hub_queries import Book, over
from tallyforge.session import cut

DAY = book.AS_OF
_DAYS = "case cadence when 'weekly' then 7 when 'fortnightly' then 14 when 'monthly' then 30 when 'bimonthly' then 61 when 'quarterly' then 91 when 'semiannual' then 182 when 'annual' then 365 end"
_YEARLY = "case cadence when 'weekly' then 52 when 'fortnightly' then 26 when 'monthly' then 12 when 'bimonthly' then 6 when 'quarterly' then 4 when 'semiannual' then 2 when 'annual' then 1 end"
FOLD = """, sc as (select s.*, s.id in (select external_id from obs) as there, s.action = 'DECLARE' and s.match <> '(' as good from said_commitment s),
  ev as (select sc.*, commitment_id is null or exists (select 1 from sc d where d.good and d.commitment_id = sc.commitment_id and d.n < sc.n) as known,
      commitment_id is null or coalesce((select arg_max(d.action, d.n) from sc d where (d.good or d.action = 'RETIRE') and d.commitment_id = sc.commitment_id and d.n < sc.n), '') = 'DECLARE' as alive from sc),
  vd as (select *, case action when 'DECLARE' then not good when 'PIN' then not (known and alive and there) when 'EXCLUDE' then not (known and there) when 'INCLUDE' then not (known and there) when 'UNPIN' then not there else not known end as fails from ev),
  ok as (select * from vd where not fails),
  dc as (select * from ok where action = 'DECLARE' qualify row_number() over (partition by commitment_id order by n desc) = 1),
  com as (select dc.commitment_id, dc.n as declared_n, direction, cadence, amount_kind, match, account, case when direction = 'out' then -abs(amount) else abs(amount) end as expected, day as anchor, r.rn as retired_n, r.ended_at
    from dc left join (select commitment_id, max(n) as rn, arg_max(day, n) as ended_at from ok where action = 'RETIRE' group by 1) r on r.commitment_id = dc.commitment_id and r.rn > dc.n),
  pin as (select id as external_id, commitment_id from (select * from ok where action in ('PIN', 'UNPIN') qualify row_number() over (partition by id order by n desc) = 1) where action = 'PIN'),
  excl as (select commitment_id, id as external_id, n as decision_n from (select * from ok where action in ('EXCLUDE', 'INCLUDE') qualify row_number() over (partition by commitment_id, id order by n desc) = 1) where action = 'EXCLUDE'),
  settle as (select commitment_id, day as due_date, max(n) as settle_n from ok where action = 'SETTLE' group by 1, 2)"""
CLAIM = FOLD + rf""", tracked as (select * from com where cadence = 'irregular' or anchor is not null),
  fx as (select *, regexp_replace(regexp_replace(raw_description, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') as t from txn where role <> 'noop' and date <= date '{DAY}'),
  fits as (select fx.external_id, c.commitment_id, c.declared_n, regexp_matches(t, '(?i)' || c.match) and (c.account is null or c.account = fx.account_ref) as rule, p.commitment_id is not null as pinned
    from fx join tracked c on fx.amount <> 0 and (c.direction = 'out') = (fx.amount < 0) and (c.ended_at is null or fx.date <= c.ended_at) left join pin p on p.external_id = fx.external_id and p.commitment_id = c.commitment_id
    where not exists (select 1 from excl where excl.commitment_id = c.commitment_id and excl.external_id = fx.external_id)),
  claim as (select external_id, commitment_id, case when pinned then 'pin' else 'rule' end as matched_by from fits where pinned or rule qualify row_number() over (partition by external_id order by pinned desc, declared_n desc, commitment_id) = 1)"""
SLOT = CLAIM + f""", sl0 as (select c.*, {_DAYS} as days, unnest(range(0, 700)) as k from tracked c where cadence <> 'irregular'),
  sl as (select *, cast(case cadence when 'weekly' then anchor + interval 7 day * k when 'fortnightly' then anchor + interval 14 day * k when 'monthly' then anchor + interval 1 month * k when 'bimonthly' then anchor + interval 2 month * k when 'quarterly' then anchor + interval 3 month * k when 'semiannual' then anchor + interval 6 month * k else anchor + interval 12 month * k end as date) as due_date, cast(least(days // 2, 7) as int) as w from sl0),
  slot as (select commitment_id, due_date, due_date - w as window_start, due_date + w as window_end, case when due_date + w < date '{DAY}' then 'missed' else 'due' end as status, expected from sl
    where due_date >= greatest(anchor, date '{DAY}' - interval 12 month) and due_date <= date '{DAY}' + 92 and (ended_at is null or due_date <= ended_at))"""
OCC = SLOT + f""", cf as (select claim.*, x.n, x.date, x.amount, x.account_ref from claim join txn x using (external_id)),
  land as (select cf.*, (select min(s.due_date) from slot s where s.commitment_id = cf.commitment_id and cf.date between s.window_start and s.window_end) as due_date, (select min(s.window_start) from slot s where s.commitment_id = cf.commitment_id) as span, c.cadence from cf join com c using (commitment_id)),
  hit as (select commitment_id, due_date, sum(amount) as amount, arg_min(external_id, (date, n)) as matched_id, arg_min(date, (date, n)) as matched_date, arg_min(matched_by, (date, n)) as matched_by from land where due_date is not null and date >= span group by 1, 2),
  alone as (select commitment_id, date as due_date, cadence <> 'irregular' as off_schedule, sum(amount) as amount, arg_min(external_id, n) as matched_id, arg_min(matched_by, n) as matched_by from land where cadence = 'irregular' or (due_date is null and date >= span) group by 1, 2, 3),
  front as (select account_ref, max(date) as f from txn where date <= date '{DAY}' group by 1),
  reach as (select commitment_id, max(f) as f from (select commitment_id, account as account_ref from com where account is not null union select commitment_id, account_ref from cf where commitment_id not in (select commitment_id from com where account is not null)) join front using (account_ref) group by 1),
  occ as (select s.commitment_id, s.due_date, case when h.matched_id is not null then 'occurred' when settle_n is not null then 'settled' when s.status = 'missed' and window_end >= f then 'awaiting' else s.status end as status, window_start, window_end, matched_id, matched_date, matched_by, false as off_schedule,
      case when h.matched_id is null then settle_n end as settle_n, cast(case when h.matched_id is not null then h.amount when settle_n is not null then expected end as bigint) as amount
    from slot s left join hit h using (commitment_id, due_date) left join settle using (commitment_id, due_date) left join reach using (commitment_id)
    union all select commitment_id, due_date, 'occurred', null, null, matched_id, due_date, matched_by, off_schedule, null, cast(amount as bigint) from alone)"""
LATE = OCC + f""", behind as (select commitment_id, count(*) filter (status = 'missed') as count, cast(coalesce(sum(coalesce(expected, 0)) filter (status = 'missed'), 0) as bigint) as amount, coalesce(arg_max(status, due_date) filter (window_end < date '{DAY}') = 'missed', false) as lapsed from occ join com using (commitment_id) where window_end is not null group by 1),
  last as (select commitment_id, max(due_date) as since from occ where matched_id is not null or status = 'settled' group by 1),
  own as (select distinct commitment_id, account_ref from occ join txn x on x.external_id = matched_id),
  newest as (select commitment_id, max(f) as frontier from (select * from own union select commitment_id, account from com where account is not null and commitment_id not in (select commitment_id from own)) join front using (account_ref) group by 1),
  silent as (select commitment_id, since, frontier from com join last using (commitment_id) join newest using (commitment_id) where retired_n is null and cadence <> 'irregular' and date_diff('day', since, frontier) > {_DAYS} + greatest(2, 0.2 * {_DAYS}))"""
_FIXED_STEP = "(abs(abs({b}) - abs({a})) >= 50 or abs(abs({b}) - abs({a})) >= abs({a}) * cast(0.05 as double))"


def ids(b: Book) -> DataFrame:
    return b["obs"].select(F.col("external_id").alias("id"), F.col("external_id").alias("current_id")).distinct()


def folded(b: Book) -> dict[str, DataFrame]:
    return b.once("folded", lambda b: commitments.fold(cut(b["said_commitment"]), ids(b)))


def _happened(b: Book) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, DataFrame]:
    state, rows = folded(b), cut(b["txn"])
    claimed = cut(commitments.claims(state, rows, DAY))
    return state, rows, claimed, cut(commitments.occurrences(state, claimed, rows, DAY))


def happened(b: Book) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, DataFrame]:
    return b.once("happened", _happened)


over("commitment_fold", FOLD + " select * from com")(lambda b: folded(b)["commitments"])
over("commitment_pins", FOLD + " select * from pin")(lambda b: folded(b)["pins"])
over("commitment_exclusions", FOLD + " select * from excl")(lambda b: folded(b)["exclusions"])
over("commitment_settles", FOLD + " select * from settle")(lambda b: folded(b)["settles"])
over("commitment_without_effect", FOLD + " select n as decision_n, action from vd where fails")(lambda b: folded(b)["without_effect"])
over("commitment_claims", CLAIM + " select * from claim")(lambda b: commitments.claims(folded(b), b["txn"], DAY))
over("commitment_schedule", SLOT + " select commitment_id, due_date, window_start, window_end, status from slot")(lambda b: commitments.schedule(folded(b)["commitments"], DAY).drop("expected"))
over("commitment_occurrences", OCC + " select * from occ")(lambda b: happened(b)[3])
over("occurrence_hash", OCC + """ select commitment_id, due_date, off_schedule, 'sha256:' || sha256(commitment_id || '|' || due_date || '|' || status || '|' || coalesce(matched_id, 'null') || '|' || coalesce(cast(matched_date as varchar), 'null') || '|' || coalesce(cast(amount as varchar), 'null') || '|' || coalesce(cast(settle_n as varchar), 'null') || '|' || off_schedule) as state_hash from occ""")(
    lambda b: commitments.occurrence_hash(happened(b)[3]).select("commitment_id", "due_date", "off_schedule", "state_hash"))
over("commitment_arrears", LATE + " select * from behind")(lambda b: (lambda h: commitments.arrears(h[3], h[0]["commitments"], DAY))(happened(b)))
over("commitment_dormant", LATE + " select * from silent")(lambda b: (lambda h: commitments.dormant(h[3], h[0]["commitments"], h[1], DAY))(happened(b)))


def _faces(b: Book) -> DataFrame:
    state, rows, _, found = happened(b)
    behind, silent = cut(commitments.arrears(found, state["commitments"], DAY)), cut(commitments.dormant(found, state["commitments"], rows, DAY))
    return commitments.faces(found, state, behind, silent, DAY)


over("commitment_faces", LATE + f""", ob as (select *, lag(amount) over w as before, row_number() over w as i, row_number() over (partition by commitment_id order by due_date desc, off_schedule desc) as j from occ where matched_id is not null window w as (partition by commitment_id order by due_date, off_schedule)),
  mv as (select * from ob where before is not null and {_FIXED_STEP.format(a='before', b='amount')}),
  lm as (select commitment_id, arg_max(struct_pack(p := before, a := amount, d := matched_date), i) as m from mv group by 1),
  wd as (select commitment_id, due_date, date_diff('day', lag(due_date) over (partition by commitment_id order by due_date), due_date) as gap from occ where matched_id is not null and window_start is not null),
  rg as (select commitment_id, count(gap) as g, count(*) filter (abs(gap - {_DAYS}) <= greatest(2, 0.2 * {_DAYS})) as near from wd join com using (commitment_id) group by 1),
  ag as (select commitment_id, count(*) as n, min(due_date) as a, max(due_date) as z, cast(sum(amount) as bigint) as cost, cast(coalesce(sum(amount) filter (due_date between date '{DAY}' - interval 12 month and date '{DAY}'), 0) as bigint) as yr, max(case when j = 1 then amount end) as cur, list_sort(list(amount) filter (j <= 12)) as tail from ob group by 1)
  select com.commitment_id, case when retired_n is not null then 'ended' when s.commitment_id is not null then 'dormant' else 'active' end as status, coalesce(a, anchor) as first_date, coalesce(z, anchor) as last_date, cast(case when n is null then expected else cur end as bigint) as current_amount,
    m.p as previous_amount, round(100.0 * (abs(m.a) - abs(m.p)) / nullif(abs(m.p), 0), 6) as change_pct, m.d as change_date, coalesce(cost, 0) as cost,
    cast(case when cadence = 'irregular' then coalesce(yr, 0) when amount_kind = 'variable' and n is not null then {_YEARLY} * (case when len(tail) % 2 = 1 then tail[len(tail) // 2 + 1] else floor((tail[len(tail) // 2] + tail[len(tail) // 2 + 1]) / 2.0 + 0.5) end) else {_YEARLY} * (case when n is null then expected else cur end) end as bigint) as annualised,
    coalesce(n, 0) as occurrences, case when cadence <> 'irregular' and g >= 1 then round(near / g, 6) end as regularity, coalesce(bh.count, 0) as arrears, coalesce(bh.amount, 0) as arrears_amount
  from com left join ag using (commitment_id) left join lm using (commitment_id) left join rg using (commitment_id) left join behind bh using (commitment_id) left join silent s using (commitment_id)""")(_faces)
#: The oracle takes refunds one after the other, with the charges that are left in a list.
DETECT = rf""", fr as (select *, upper(regexp_replace(split_part(raw_description, ' - Visa Purchase', 1), '\s+', ' ', 'g')) as stem, regexp_extract(raw_description, 'Foreign Currency Amount:\s*[A-Z]{{3}}\s*(-?\d+(\.\d+)?)', 1) as fx from charge),
  st as (select stem, bool_and(fx <> '') as fcy, count(*) as rows from fr group by 1),
  dn0 as (select stem, date, sum(case when fcy then (case when amount < 0 then -1 else 1 end) * cast(round(cast(fx as decimal(20, 6)) * 100) as bigint) else amount end) as net from fr join st using (stem) group by 1, 2),
  sg as (select stem, case when abs(coalesce(sum(net) filter (net < 0), 0)) >= coalesce(sum(net) filter (net > 0), 0) then -1 else 1 end as sign from dn0 group by 1),
  seq as (select stem, sign, list(struct_pack(d := date, a := net) order by date) filter (net * sign > 0) as o, coalesce(list(struct_pack(d := date, a := abs(net)) order by date) filter (net * sign < 0), []) as r from dn0 join sg using (stem) group by 1, 2),
  net as (select stem, sign, o, r, cast(0 as bigint) as i from seq where o is not null
    union all select stem, sign, list_transform(range(1, len(o) + 1), lambda x: struct_pack(d := o[x].d, a := o[x].a - sign * case when o[x].d > r[i + 1].d then 0 else least(abs(o[x].a), greatest(0, r[i + 1].a - coalesce(list_sum(list_transform(list_filter(o[x + 1:], lambda y: y.d <= r[i + 1].d), lambda y: abs(y.a))), 0))) end)), r, i + 1 from net where i < len(r)),
  left0 as (select stem, sign, unnest(list_filter(o, lambda x: x.a <> 0)) as x from net where i = len(r)),
  oc as (select stem, sign, x.d as date, cast(x.a as bigint) as amount, row_number() over w as i, row_number() over (partition by stem order by x.d desc) as j, date_diff('day', lag(x.d) over w, x.d) as gap, cast(lag(x.a) over w as bigint) as before, cast(lead(x.a) over w as bigint) as after from left0 window w as (partition by stem order by x.d)),
  g1 as (select stem, sign, count(*) as n, quantile_cont(gap, 0.5) as med from oc group by 1, 2 having count(*) >= 3),
  cd as (select g1.*, cadence, days from g1, (values ('weekly', 7, 1), ('fortnightly', 14, 2), ('monthly', 30, 3), ('bimonthly', 61, 4), ('quarterly', 91, 5), ('semiannual', 182, 6), ('annual', 365, 7)) as v(cadence, days, ord) qualify row_number() over (partition by stem order by abs(med - days), ord) = 1),
  rg as (select cd.*, avg(case when abs(oc.gap - days) <= greatest(2, 0.2 * days) then 1.0 else 0.0 end) as regularity from cd join oc on oc.stem = cd.stem and oc.gap is not null where abs(med - days) <= greatest(2, 0.2 * days) group by all having avg(case when abs(oc.gap - days) <= greatest(2, 0.2 * days) then 1.0 else 0.0 end) >= 0.7),
  sp as (select oc.*, before is not null and {_FIXED_STEP.format(a='before', b='amount')} as step from oc),
  an as (select *, coalesce(max(case when step then i end) over (partition by stem order by i rows between unbounded preceding and 1 preceding), 1) as ai from sp),
  vr as (select x.stem, bool_or(not x.step and x.i > 1 and {_FIXED_STEP.format(a='y.amount', b='x.amount')}) as variable, sum(cast(x.step as int)) as steps, arg_max(struct_pack(p := x.before, a := x.amount, d := x.date), case when x.step then x.i end) filter (x.step) as m,
      count(*) filter (x.before <> 0 and x.after is not null and (abs(x.amount) >= 2.0 * abs(x.before) or abs(x.amount) * 2.0 <= abs(x.before)) and abs(abs(x.after) - abs(x.before)) <= cast(0.1 as double) * abs(x.before)) as one_offs from an x join oc y on y.stem = x.stem and y.i = x.ai group by 1),
  ft as (select stem, max(f) as f from (select distinct stem, account_ref from fr) join (select account_ref, max(date) as f from charge where date <= date '{DAY}' group by 1) using (account_ref) group by 1),
  tl as (select stem, min(date) as a, max(date) as z, cast(sum(amount) as bigint) as cost, max(case when j = 1 then amount end) as cur, list_sort(list(amount) filter (j <= 12)) as tail from oc group by 1),
  found as (select 'cand|' || substr(sha256('cand|' || stem), 1, 16) as candidate_id, stem, case when sign < 0 then 'out' else 'in' end as direction, cadence, case when variable then 'variable' else 'fixed' end as amount_kind,
      case when f is null then 'active' when date_diff('day', z, f) > 2 * days then 'ended' when date_diff('day', z, f) > days + greatest(2, 0.2 * days) then 'dormant' else 'active' end as status, a as first_date, z as last_date, cur as current_amount, m.p as previous_amount, m.d as change_date, round(100.0 * (abs(m.a) - abs(m.p)) / nullif(abs(m.p), 0), 6) as change_pct, cost,
      cast({_YEARLY} * (case when not variable then cur when len(tail) % 2 = 1 then tail[len(tail) // 2 + 1] else floor((tail[len(tail) // 2] + tail[len(tail) // 2 + 1]) / 2.0 + 0.5) end) as bigint) as annualised, n as occurrences, one_offs, cast(steps as bigint) as steps, round(regularity, 6) as regularity
    from rg join vr using (stem) join ft using (stem) join tl using (stem))"""
over("recurring_candidates", DETECT + " select * from found", True)(lambda b: commitments.detect(b["charge"], DAY))
over("candidates_open", DETECT + r""" select found.stem from found where stem not in (select 'SERIES ' || n_nationkey from nation) and not exists (
    select 1 from (select 'a' as id, 'series 1[0-4]' as m, null as acc union all select 'b', 'series', 'acct-3') ru where not exists (select 1 from fr where fr.stem = found.stem and not (regexp_matches(raw_description, '(?i)' || m) and (acc is null or acc = account_ref))))""", True)(
    lambda b: commitments.open_candidates(commitments.detect(b["charge"], DAY), b["charge"].sparkSession.table("nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("SERIES "), F.col("n_nationkey").cast("string")).alias("stem")), b["charge"].sparkSession.table("nation").where("n_nationkey % 2 = 1").select(F.concat(F.lit("SERIES "), F.col("n_nationkey").cast("string")).alias("stem")),
        b["charge"].sparkSession.createDataFrame([("a", "series 1[0-4]", None), ("b", "series", "acct-3")], "commitment_id string, match string, account string"), b["charge"]).select("stem"))
