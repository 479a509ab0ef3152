"""Queries of the derivation over the book: each stage from observations and decisions on, with SQL written from the rules they follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import derive, ledger
from tallyforge.plans import book
from tallyforge.plans.hub_queries import Book, over
from tallyforge.session import cut

DAY, WINDOW = book.AS_OF, 4
PATTERNS: dict[str, list[derive.Pattern]] = {
    "acct-4": [("internet transfer low", "BPAY", True, None), ("merchant 4 ", "CARD", True, "clr-2")],
    "default": [("internet transfer (high|urgent)", "OSKO", True, None), ("internet transfer", None, True, None), ("atm withdrawal urgent", "ATM", True, "acct-27"), ("atm", "ATM", False, None), ("fee 3", None, True, "clr-1")],
}
PROFILES = [("acct-5", "fee"), ("*", "merchant 39 "), ("acct-6", "atm.*medium")]
DECLARED = ["salary", "groceries", "transport", "small"]


def _rule() -> Column:
    text = F.col("raw_description")
    return F.when(text.rlike("(?i)merchant 1[0-9] "), "groceries").when(F.abs("amount") <= 2000, "small")


_RULE = "case when regexp_matches(raw_description, '(?i)merchant 1[0-9] ') then 'groceries' when abs(amount) <= 2000 then 'small' end"
_CLEAN = r"lower(regexp_replace(regexp_replace(raw_description, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"


def _case(field: int) -> str:
    out = "case"
    for name, own in sorted(PATTERNS.items(), key=lambda x: x[0] == "default"):
        for p in own:
            value = {str: f"'{p[field]}'", bool: str(p[field]).lower(), type(None): "null"}[type(p[field])]
            out += f" when {'' if name == 'default' else f'''account_ref = '{name}' and '''}regexp_matches({_CLEAN}, '{p[0]}') then {value}"
    return out + " end"


EFF = """, dn as (select distinct n, action, target from dec),
  rv as (select n, target from dn where action = 'REVOKE' and target in (select n from dn) and target < n),
  sub as (select n as root, n from dn union all select sub.root, rv.n from sub join rv on rv.target = sub.n),
  eff as (select dec.* from dec join (select root, count(*) as c from sub group by 1) s on s.root = dec.n where c % 2 = 1 and (dec.action <> 'REVOKE' or dec.target in (select n from dn)))"""
SUP = EFF + """, known as (select distinct external_id from obs),
  act as (select n, action, id1 as f, case when action = 'SUPERSEDE' then id2 end as t, id1 in (select external_id from known) and (action = 'RETIRE' or id2 in (select external_id from known)) as ok from eff where action in ('SUPERSEDE', 'RETIRE')),
  lst0 as (select f, t, n from act where ok qualify row_number() over (partition by f order by n desc) = 1),
  lst as (select *, coalesce(t in (select f from lst0 where t is null), false) as gone from lst0),
  edge as (select f, t, n from lst where t is not null and not gone),
  trail as (select f as start, t as cur, [f] as path from edge union all select trail.start, edge.t, list_append(trail.path, edge.f) from trail join edge on edge.f = trail.cur where not list_contains(trail.path, edge.f)),
  ring as (select start, path, path[list_position(path, cur):] as cycle, list_min(path[list_position(path, cur):]) as name from trail where list_contains(path, cur)),
  ringed as (select distinct unnest(cycle) as f from ring),
  dropped as (select distinct unnest(path) as f from ring where (name, start) in (select (name, min(start)) from ring group by name)),
  sup as (select f, t, n from lst where not gone and f not in (select f from dropped))"""
RES = SUP + """, hop as (select external_id as id, external_id as cur from known union all select hop.id, sup.t from hop join sup on sup.f = hop.cur where sup.t is not null),
  res as (select id, cur as current_id from hop where cur not in (select f from sup where t is not null)),
  newest as (select * from obs where external_id not in (select f from sup) qualify row_number() over (partition by external_id order by n desc) = 1)"""
CUR = RES + f""", said_role as (select current_id, arg_max(action, eff.n) as action from eff join res on res.id = eff.id1 where action in ('MARK_NOOP', 'UNMARK_NOOP') group by 1),
  curr as (select newest.*, case when s.action = 'MARK_NOOP' then 'noop' when s.action is not null then 'transaction'
      when (account_ref = 'acct-5' and regexp_matches({_CLEAN}, 'fee')) or regexp_matches({_CLEAN}, 'merchant 39 ') or (account_ref = 'acct-6' and regexp_matches({_CLEAN}, 'atm.*medium')) then 'noop' else 'transaction' end as role
    from newest left join said_role s on s.current_id = newest.external_id where observation = 'posted')"""


def _base(b: Book) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Decisions in force, current ids, newest observations and current rows with their roles, stored."""
    acts = cut(derive.in_force(b["dec"]))
    facts = cut(b["obs"])
    gone, _ = derive.supersessions(acts, facts)
    gone = cut(gone)
    ids = cut(derive.resolved(facts, gone))
    newest = cut(derive.latest_facts(facts, gone))
    current = cut(derive.with_roles(newest.where(F.col("observation") == "posted"), acts, ids, PROFILES))
    return acts, ids, newest, current


def base(b: Book) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return b.once("base", _base)


def paired(b: Book) -> tuple:
    return b.once("paired", _paired)


def categorised(b: Book) -> tuple:
    return b.once("categorised", _categorised)


over("decisions_in_force", EFF + " select n, action, id1 from eff", True)(lambda b: derive.in_force(b["dec"]).select("n", "action", "id1"))
over("supersession", SUP + " select f as from_id, t as to_id, n as decision_n from sup", True)(lambda b: derive.supersessions(cut(derive.in_force(b["dec"])), b["obs"])[0])
over("supersession_without_effect", SUP + " select n as decision_n, 'unknown id' as reason from act where not ok union all select n, 'retired target' from lst where gone union all select n, 'cycle' from edge where f in (select f from ringed)", True)(
    lambda b: derive.supersessions(cut(derive.in_force(b["dec"])), b["obs"])[1])
over("chain_resolved", RES + " select id, current_id from res", True)(lambda b: base(b)[1])
over("current_rows", CUR + " select external_id, n, account_ref, amount, role from curr", True)(lambda b: base(b)[3].select("external_id", "n", "account_ref", "amount", "role"))
_CLOSE = CUR + """, lastrow as (select account_ref, arg_max(struct_pack(d := date, b := balance), (date, n)) as l from curr where role <> 'noop' group by 1),
  ca as (select * from eff where action = 'CLOSE_ACCOUNT' and n in (select max(n) from eff where action = 'CLOSE_ACCOUNT' group by ref)),
  cl as (select ca.n, ca.ref, ca.amount as closing, ca.day, ca.id1, c.external_id, c.account_ref as la, c.amount as lamt from ca left join res on res.id = ca.id1 left join curr c on c.external_id = res.current_id),
  ce as (select n, ref, closing, day, count(id1) as legs, count(*) filter (id1 is not null and external_id is null) as unknown, count(*) filter (la = ref) as own, coalesce(sum(-lamt), 0) as moves, list_sort(list(distinct external_id) filter (external_id is not null)) as settles from cl group by all),
  closed as (select ref as account_ref, n as decision_n, day as closed_at, ce.closing, cast(ce.closing - l.b as bigint) as adjustment, coalesce(settles, []) as settles,
      case when coalesce(source, '') <> 'statement' then 'not a statement account' when l is null then 'no rows' when day < l.d then 'before the last row' when unknown > 0 then 'unknown leg' when own > 0 then 'own leg' when legs > 0 and moves <> ce.closing - l.b then 'legs don''t add up' end as reason
    from ce left join acct using (ref) left join lastrow on lastrow.account_ref = ce.ref)"""


def _closures(b: Book, stage: tuple) -> DataFrame:
    acts, ids, _, current = stage
    return cut(derive.closures(acts, current, ids, b["acct"]))


over("account_closures", _CLOSE + " select account_ref, decision_n, closed_at, closing, adjustment, array_to_string(settles, ',') as settles, reason from closed", True)(
    lambda b: _closures(b, base(b)).withColumn("adjustment", F.col("adjustment").cast("bigint")).withColumn("settles", F.array_join("settles", ",")))
_SHAPED = CUR + f""", pr as (select curr.*, a.currency, {_case(1)} as rail, coalesce({_case(2)}, false) as shape, {_case(3)} as clearing from curr left join acct a on a.ref = account_ref where role <> 'noop'),
  rs as (select distinct a.external_id from pr a join pr b on a.receipt = b.receipt and trim(a.receipt) <> '' and a.account_ref <> b.account_ref and a.amount = -b.amount and a.amount <> 0 and a.currency = b.currency and abs(date_diff('day', a.date, b.date)) <= {WINDOW})"""
over("receipt_shaped", _SHAPED + " select external_id from rs", True)(lambda b: (lambda c: derive.receipt_shaped(c.where(F.col("role") != "noop").join(b["acct"].select(F.col("ref").alias("account_ref"), "currency"), "account_ref"), WINDOW))(base(b)[3]))
over("transfer_patterns", CUR + f" select external_id, {_case(1)} as rail, {_case(2)} as shape, {_case(3)} as clearing from curr", True)(
    lambda b: base(b)[3].select("external_id", derive.pattern(PATTERNS, F.col("account_ref"), F.col("raw_description")).alias("p")).select("external_id", "p.*"))
# The ladder's oracle walks the legs of each amount and currency one by one, with the open ones in a list.
_MEET = "x.n <> me.n and not list_contains(taken, x.n) and x.account_ref <> me.account_ref and x.amount = -me.amount"
_BACK = "y.n <> o1.n and not list_contains(taken, y.n) and y.account_ref <> o1.account_ref and y.amount = -o1.amount"
_PAIRED = _SHAPED + _CLOSE[len(CUR):] + f""", pd as (select eff.n, eff.action, r1.current_id as a, r2.current_id as b from eff left join res r1 on r1.id = id1 left join res r2 on r2.id = id2 where action in ('MARK_EXTERNAL', 'PAIR', 'UNPAIR') and r1.id is not null and (action = 'MARK_EXTERNAL' or r2.id is not null)),
  pleg as (select n, action, a as id from pd union select n, action, b from pd where b is not null),
  plast as (select id, max(n) as n, arg_max(action, n) as action from pleg where id in (select external_id from pr) group by 1),
  live as (select pd.* from pd join plast x on x.id = a and x.n = pd.n join plast y on y.id = b and y.n = pd.n where pd.action = 'PAIR'),
  given0 as (select current_id as id, arg_max(eff.ref, eff.n) as g from eff join acct on acct.ref = eff.ref and source in ('clearing', 'declared') join res on res.id = id1 where action = 'ATTACH_ACCOUNT' group by 1),
  setl as (select unnest(settles) as id, account_ref as g from closed where reason is null),
  given as (select coalesce(s.id, g.id) as id, coalesce(s.g, g.g) as g from given0 g full join setl s on s.id = g.id),
  free as (select pr.*, given.g from pr left join given on given.id = external_id where external_id not in (select a from live union select b from live) and external_id not in (select id from plast where action <> 'PAIR')),
  direct as (select * from free where g is not null and g <> account_ref),
  pool as (select * from free where (g is null or g = account_ref) and (shape or external_id in (select external_id from rs))),
  bucket as (select abs(amount) as a, currency, list(struct_pack(n := n, id := external_id, account_ref := account_ref, date := date, amount := amount, receipt := case when trim(receipt) <> '' then receipt end, clearing := case when clearing <> account_ref then clearing end) order by date, n) as legs from pool group by 1, 2),
  step as (
    select a, currency, legs, cast(0 as bigint) as i, cast([] as bigint[]) as taken, cast(null as bigint) as n, cast(null as bigint) as other_n, cast(null as varchar) as fate, cast(null as varchar) as ids from bucket
    union all
    select a, currency, legs, i + 1, case when done then taken when me.clearing is not null then list_append(taken, me.n) when o.n is not null then list_concat(taken, [me.n, o.n]) else taken end, me.n, case when not done and me.clearing is null then o.n end,
      case when done then null when me.clearing is not null then 'CLEARING' when o.n is not null then tier when tier is not null then 'HELD' end,
      case when not done and me.clearing is null and o.n is null and tier is not null then array_to_string(list_sort(list_transform(found, lambda x: x.id)), ',') end
    from (select *, case when len(found) = 1 and (tier = 'T1' or len(list_filter(legs, lambda y: {_BACK} and (case when tier = 'T2' then y.date = o1.date else y.date <> o1.date and abs(date_diff('day', y.date, o1.date)) <= {WINDOW} end))) = 1) then o1 end as o
      from (select *, found[1] as o1 from (select *, case when len(t1) > 0 then 'T1' when len(t2) > 0 then 'T2' when len(t3) > 0 then 'T3' end as tier, case when len(t1) > 0 then t1 when len(t2) > 0 then t2 else t3 end as found
        from (select *, list_contains(taken, me.n) as done,
            list_filter(legs, lambda x: {_MEET} and me.receipt is not null and x.receipt is not distinct from me.receipt and abs(date_diff('day', x.date, me.date)) <= {WINDOW}) as t1,
            list_filter(legs, lambda x: {_MEET} and x.date = me.date) as t2,
            list_filter(legs, lambda x: {_MEET} and x.date <> me.date and abs(date_diff('day', x.date, me.date)) <= {WINDOW}) as t3
          from (select *, legs[i + 1] as me from step where i < len(legs))) q1) q2) q3) q4),
  fate as (select step.*, l.external_id, l.date as att from step join pool l on l.n = step.n where fate is not null),
  wanted as (
    select a as f, b as t, x.receipt as r1, y.receipt as r2, 'MANUAL' as confidence, 0 as phase, cast(null as date) as att, live.n, case when x.amount < 0 then coalesce(x.rail, y.rail, 'BANK_TRANSFER') else coalesce(y.rail, x.rail, 'BANK_TRANSFER') end as method from live join pr x on x.external_id = a join pr y on y.external_id = b
    union all select x.external_id, y.external_id, x.receipt, y.receipt, case when fate = 'T1' then 'EXACT' else 'HIGH' end, 1, fate.att, fate.n, case when x.amount < 0 then coalesce(x.rail, y.rail, 'BANK_TRANSFER') else coalesce(y.rail, x.rail, 'BANK_TRANSFER') end from fate join pr x on x.n = fate.n join pr y on y.n = fate.other_n),
  hashed as (select *, 'TRF-' || substr(sha256('tr|' || least(f, t) || '|' || greatest(f, t)), 1, 16) as h, case when trim(r1) <> '' and r1 = r2 then 'TRF-' || r1 end as w from wanted),
  named as (select *, case when row_number() over (partition by coalesce(w, h) order by phase, att, n) = 1 then coalesce(w, h) else h end as transfer_id from hashed),
  side as (select external_id, g, amount, rail from direct union all select pool.external_id, pool.clearing, amount, rail from fate join pool on pool.n = fate.n where fate = 'CLEARING'),
  transfers as (select transfer_id, f as from_leg, t as to_leg, confidence, method, cast(null as varchar) as clearing from named
    union all select 'TRF-' || substr(sha256('tr|' || least(external_id, g) || '|' || greatest(external_id, g)), 1, 16), case when amount < 0 then external_id else g end, case when amount < 0 then g else external_id end, 'EXACT', coalesce(rail, 'BANK_TRANSFER'), g from side),
  legst as (select pr.external_id, x.transfer_id, case when x.transfer_id is not null then 'MATCHED' when pr.external_id in (select external_id from pool) then 'HELD' else 'EXTERNAL' end as leg
    from pr left join (select transfer_id, from_leg as id from transfers where from_leg is distinct from clearing union select transfer_id, to_leg from transfers where to_leg is distinct from clearing) x on x.id = pr.external_id)"""


def _paired(b: Book) -> tuple:
    stage = base(b)
    acts, ids, newest, current = stage
    closed = _closures(b, stage)
    settled = closed.where(F.col("reason").isNull()).select(F.explode("settles").alias("external_id"), F.col("account_ref").alias("account"))
    return (*stage, *derive.pairing(current, acts, ids, b["acct"], PATTERNS, settled, WINDOW))


over("transfers", _PAIRED + " select * from transfers", True)(lambda b: paired(b)[4])
over("leg_states", _PAIRED + " select * from legst", True)(lambda b: paired(b)[5])
over("ambiguous_transfers", _PAIRED + " select external_id, ids as candidates from fate where fate = 'HELD'", True)(lambda b: paired(b)[6])


def _categorised(b: Book) -> tuple:
    stage = paired(b)
    acts, ids, _, current, _, states, _ = stage
    rows = current.join(states, "external_id", "left").withColumn("leg", F.coalesce("leg", F.lit("EXTERNAL")))
    return (*stage, *derive.categories(cut(rows), acts, ids, DECLARED, _rule()))


_CATEGORY = _PAIRED + f""", rowed as (select curr.*, l.transfer_id, coalesce(l.leg, 'EXTERNAL') as leg from curr left join legst l using (external_id)),
  pa as (select eff.n, eff.action, eff.ref, res.current_id as id, res.id is null or (eff.action = 'PIN' and (ref not in ('salary', 'groceries', 'transport', 'small') or coalesce(r.leg = 'MATCHED', false))) as bad from eff left join res on res.id = id1 left join rowed r on r.external_id = res.current_id where action in ('PIN', 'UNPIN')),
  pl as (select id, arg_max(action, n) as action, arg_max(ref, n) as ref from pa where not bad group by 1),
  cated as (select rowed.*, case when leg = 'MATCHED' then 'TRANSFER' when pl.action = 'PIN' then pl.ref else coalesce({_RULE}, 'UNCATEGORIZED') end as category,
      case when leg = 'MATCHED' then 'STRUCTURAL' when pl.action = 'PIN' then 'PIN' when {_RULE} is not null then 'RULE' else 'NONE' end as origin from rowed left join pl on pl.id = external_id)"""
over("category_current", _CATEGORY + " select external_id, category, origin from cated", True)(lambda b: categorised(b)[7].select("external_id", "category", "origin"))
over("pins_without_effect", _CATEGORY + " select distinct n as decision_n from pa where bad", True)(lambda b: categorised(b)[8])
over("row_hashes", _CATEGORY + f" select external_id, 'sha256:' || sha256(concat(external_id, '|', upper(role), '|', coalesce({_case(1)}, ''), '|', leg, '|', account_ref, '|', date, '|', amount, '|', currency, '|', category, '|', origin, '|', coalesce(transfer_id, ''))) as state_hash from cated join acct on acct.ref = account_ref", True)(
    lambda b: derive.hashed(categorised(b)[7].withColumn("rail", derive.pattern(PATTERNS, F.col("account_ref"), F.col("raw_description"))["rail"]), b["acct"]).select("external_id", "state_hash"))
over("pin_current", RES + " select current_id as external_id, ref as category, n as decision_n, user_id from (select current_id, eff.*, row_number() over (partition by current_id order by n desc) as r from eff join res on res.id = id1 where action in ('PIN', 'UNPIN')) where r = 1 and action = 'PIN'", True)(
    lambda b: (lambda s: derive.pins(s[0], s[1]))(base(b)))
over("note_current", RES + " select current_id as external_id, ref as text, n as decision_n, user_id from eff join res on res.id = id1 where action = 'NOTE'", True)(lambda b: (lambda s: derive.notes(s[0], s[1]))(base(b)))
over("user_acks", RES + " select user_id, external_id, ref as state_hash, n as decision_n from (select eff.*, coalesce(current_id, id1) as external_id, row_number() over (partition by user_id, coalesce(current_id, id1) order by n desc) as r from eff left join res on res.id = id1 where action in ('USER_ACK', 'USER_UNACK')) where r = 1 and action = 'USER_ACK'", True)(
    lambda b: (lambda s: derive.acks(s[0], s[1]))(base(b)))
_WORDS = "list_distinct(list_filter(string_split(regexp_replace(upper(regexp_replace({0}.raw_description, '( - Visa Purchase| - Receipt| {{3,}}).*$', '')), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda x: regexp_matches(x, '^[A-Z]{{3,}}$') and x not in ('VISA', 'EFTPOS', 'POS', 'AUTHORISATION', 'AUTHORIZATION', 'DEBIT', 'CREDIT', 'PURCHASE', 'CARD', 'PAYMENT', 'RECEIPT', 'WITHDRAWAL', 'DEPOSIT', 'TRANSACTION')))"
over("pending_states", CUR + f""", pend as (select p.*, window_days as w, {_WORDS.format('p')} as t from newest p join acct on acct.ref = account_ref where observation = 'pending'),
  posted as (select c.*, {_WORDS.format('c')} as t from curr c),
  cand as (select pend.external_id, list_sort(list(posted.external_id)) as by_ids from pend join posted on posted.account_ref = pend.account_ref and posted.date between pend.date and pend.date + cast(w as int) and not (posted.amount < 0 and pend.amount > 0) and not (posted.amount > 0 and pend.amount < 0) and posted.amount = pend.amount
      and least(len(pend.t), len(posted.t)) > 0 and len(list_intersect(pend.t, posted.t)) >= 0.5 * least(len(pend.t), len(posted.t)) group by 1),
  force as (select r1.current_id as id, arg_max(r2.current_id, eff.n) as q from eff join res r1 on r1.id = id1 join res r2 on r2.id = id2 where action = 'SETTLE' group by 1),
  front as (select account_ref, max(date) as f from curr group by 1)
  select pend.external_id, case when cq.external_id is not null or len(by_ids) = 1 then 'SETTLED' when len(by_ids) > 1 then 'OPEN' when date_diff('day', pend.date, f) > w then 'STALE' else 'OPEN' end as state,
    coalesce(cq.external_id, case when len(by_ids) = 1 then by_ids[1] end) as settled_by, case when cq.external_id is null and len(by_ids) > 1 then array_to_string(by_ids, ',') end as candidates
  from pend left join cand using (external_id) left join force on force.id = pend.external_id left join curr cq on cq.external_id = force.q left join front on front.account_ref = pend.account_ref""", True)(
    lambda b: (lambda s: derive.pending(s[2], s[3], s[0], s[1], b["acct"]))(base(b)))
_SHUT = "select 'acct-2' as account_ref, cast(null as varchar) as reason, cast(900 as bigint) as closing, cast(500 as bigint) as adjustment, date '2001-08-05' as closed_at, cast(77 as bigint) as decision_n"
_REALS = """, tr as (select * from transfer union all select 'TRF-close', 'x6', 'acct-2', 'acct-2'), side as (select tr.transfer_id, tr.clearing as account_ref, x.external_id, x.date, x.n, -x.amount as amount from tr join txn x on x.external_id = case when tr.clearing = tr.from_leg then tr.to_leg else tr.from_leg end where tr.clearing is not null)"""


def _transfers(b: Book) -> DataFrame:
    spark = b["transfer"].sparkSession
    return b["transfer"].unionByName(spark.createDataFrame([("TRF-close", "x6", "acct-2", "acct-2")], "transfer_id string, from_leg string, to_leg string, clearing string"))


def _shut(b: Book, account: str = "acct-2") -> DataFrame:
    return b["transfer"].sparkSession.sql(_SHUT.replace("varchar", "string").replace("acct-2", account))


over("clearing_legs", _REALS + """, cb as (select side.*, closing + sum(amount) over (partition by account_ref order by date, n) - sum(amount) over (partition by account_ref) as balance from side join acct on acct.ref = account_ref and source = 'clearing'),
  pt as (select account_ref, date, n, 1 as o, amount, null as snap, transfer_id, external_id from side where account_ref in ('acct-27', 'acct-28') union all select account_ref, date, n, 0, amount, case when amount = 0 then balance end, null, external_id from txn where account_ref in ('acct-27', 'acct-28') and role <> 'noop'),
  idx as (select *, row_number() over (partition by account_ref order by date, n, o) as i from pt),
  f1 as (select account_ref, min(i) as i from idx where snap is not null group by 1),
  wb as (select p.account_ref, p.transfer_id, p.external_id, p.date, p.amount, coalesce(
      (select q.snap + (select coalesce(sum(z.amount), 0) from idx z where z.account_ref = p.account_ref and z.i > q.i and z.i <= p.i) from idx q where q.account_ref = p.account_ref and q.i < p.i and q.snap is not null order by q.i desc limit 1),
      (select q.snap - (select coalesce(sum(z.amount), 0) from idx z where z.account_ref = p.account_ref and z.i < q.i and z.i > p.i) from idx q join f1 on f1.account_ref = q.account_ref and f1.i = q.i where q.account_ref = p.account_ref),
      (select sum(z.amount) from idx z where z.account_ref = p.account_ref and z.i <= p.i)) as balance from idx p where transfer_id is not null)
  select transfer_id, 'clr|' || account_ref || '|' || external_id as leg_id, account_ref, date, amount, cast(balance as bigint) as balance from cb
  union all select transfer_id, 'clr|' || account_ref || '|' || external_id, account_ref, date, amount, cast(balance as bigint) from wb
  union all select transfer_id, 'cls|' || account_ref || '|' || external_id, account_ref, date, amount, 400 + amount from side where account_ref = 'acct-2'""")(
    lambda b: derive.clearing_legs(_transfers(b), b["txn"], b["acct"], _shut(b)))
over("closure_write_off", "select null as transfer_id, 'cls|acct-3|2001-08-05' as leg_id, 'acct-3' as account_ref, date '2001-08-05' as date, cast(500 as bigint) as amount, cast(900 as bigint) as balance from (select 1)")(
    lambda b: derive.clearing_legs(_transfers(b), b["txn"], b["acct"], _shut(b, "acct-3")).where(F.col("leg_id").startswith("cls|")))
over("wallet_months", _REALS + """, mv as (select account_ref, date, 0 as own, amount as leg from side where account_ref in ('acct-27', 'acct-28') union all select account_ref, date, amount, 0 from txn where account_ref in ('acct-27', 'acct-28') and role <> 'noop' and amount <> 0),
  cal as (select account_ref, cast(unnest(generate_series(date_trunc('month', a), date '2001-06-01', interval 1 month)) as date) as m from (select account_ref, min(date) as a from mv group by 1)),
  sm as (select cal.account_ref, cal.m, coalesce(sum(greatest(leg, 0)), 0) as i, coalesce(sum(greatest(-leg, 0)), 0) as o, coalesce(sum(greatest(-own, 0)), 0) as ro, coalesce(sum(greatest(own, 0)), 0) as ri from cal left join mv on mv.account_ref = cal.account_ref and date_trunc('month', mv.date) = cal.m group by 1, 2),
  held as (select sm.*, (select c.balance from txn c where c.account_ref = sm.account_ref and c.role <> 'noop' and c.amount = 0 and c.date < sm.m order by c.date desc, c.n desc limit 1) as ho, (select c.balance from txn c where c.account_ref = sm.account_ref and c.role <> 'noop' and c.amount = 0 and c.date <= last_day(sm.m) order by c.date desc, c.n desc limit 1) as hc from sm)
  select account_ref, strftime(m, '%Y-%m') as month, cast(i as bigint) as in_from_bank, cast(o as bigint) as out_to_bank, cast(ro as bigint) as recorded_out, cast(ri as bigint) as recorded_in, ho as held_open, hc as held_close, cast(coalesce(hc - ho, 0) as bigint) as held_delta, cast(i - o - ro + ri - coalesce(hc - ho, 0) as bigint) as unrecorded, m = date '2001-06-01' as open from held""")(
    lambda b: derive.cash_months(b["transfer"], b["txn"], b["acct"], DAY))
over("units", """select t.transfer_id as unit_id, 'TRANSFER' as kind, x.account_ref, x.date, abs(x.amount) as amount, currency, 'TRANSFER' as category from transfer t join txn x on x.external_id = case when clearing = from_leg then to_leg else from_leg end join acct on ref = x.account_ref where clearing is not null or to_leg in (select external_id from txn)
  union all select external_id, 'EXTERNAL', account_ref, date, amount, currency, category from txn join acct on ref = account_ref where role <> 'noop' and leg = 'EXTERNAL' and not (source = 'declared' and amount = 0)""")(lambda b: derive.units(b["transfer"], b["txn"], b["acct"]))
