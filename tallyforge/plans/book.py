"""A whole ledger from the driver's tables: observations, decisions, accounts and a read model, in SQL that Spark and the oracle both run.

Every table is one SELECT over the driver's tables and the tables before it.  Spark gets temporary views, the oracle a WITH list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The day that stands for now.
AS_OF = "2001-06-30"

_DAY = "cast(o_orderdate as date)"
_TEXT = """case o_orderkey % 6 when 0 then concat('Internet  Transfer ', substr(o_orderpriority, 3))
    when 1 then concat('ATM Withdrawal ', substr(o_orderpriority, 3), '   SYDNEY')
    when 2 then concat('FEE ', cast(o_custkey % 9 as string), ' - Receipt 1')
    else concat('MERCHANT ', cast(o_custkey % 40 as string), ' ', substr(o_orderpriority, 3), case when o_orderkey % 4 = 0 then ' - Visa Purchase' else '' end) end"""
_AMOUNT = "cast(case when o_custkey % 30 in (27, 28) and o_orderkey % 3 = 0 then 0 else (case when o_orderkey % 7 < 4 then -1 else 1 end) * (1 + o_orderkey % 40) * 500 end as bigint)"
_RECEIPT = "case when o_orderkey % 35 = 0 then ' ' when o_orderkey % 5 = 0 then cast(o_orderkey % 120 as string) end"


def _seen(n: str, name: str, where: str, *, amount: str = _AMOUNT, text: str = _TEXT, day: str = _DAY, observation: str = "'posted'", extra: str = "0") -> str:
    return f"""select {n} as n, concat('{name}', cast(o_orderkey as string)) as external_id, concat('acct-', cast(o_custkey % 30 as string)) as account_ref, {day} as date,
  {amount} as amount, {text} as raw_description, {_RECEIPT} as receipt, cast({observation} as string) as observation, cast({extra} as bigint) as off, o_custkey as cust, o_orderkey as k
  from orders where {where}"""


TABLES: dict[str, str] = {}
TABLES["acct"] = """select concat('acct-', cast(k as string)) as ref, case when k % 7 = 6 then 'USD' else 'AUD' end as currency,
    case when k in (27, 28) then 'declared' else 'statement' end as source, cast(5 + k % 4 as bigint) as window_days, cast(null as bigint) as closing,
    cast(case when k % 4 = 0 then 30 when k % 4 = 1 then 0 when k % 4 = 2 then 4000 end as bigint) as fetch_days, (k % 10 < 7) as liquid
  from (select distinct o_custkey % 30 as k from orders) ks
  union all select 'clr-1', 'AUD', 'clearing', cast(0 as bigint), cast(50000 as bigint), cast(null as bigint), false from (select 1 as one) x
  union all select 'clr-2', 'AUD', 'clearing', cast(0 as bigint), cast(-7000 as bigint), cast(null as bigint), false from (select 1 as one) x"""
#: What sources said: rows seen once, rows seen again with other words, pending rows and what settles them, and look-alikes.
TABLES["said"] = " union all ".join((
    _seen("o_orderkey + 1", "x", "o_orderkey >= 0", observation="case when o_orderkey % 29 = 0 or o_orderkey % 123 = 0 then 'pending' else 'posted' end"),
    _seen("1000000000 + o_orderkey", "x", "o_orderkey % 41 = 0", amount=f"{_AMOUNT} + case when o_custkey % 3 = 0 and o_orderkey % 2 = 0 then 100 else 0 end", extra="case when o_custkey % 3 = 0 and o_orderkey % 2 = 1 then 7 else 0 end"),
    _seen("2000000000 + o_orderkey", "y", "o_orderkey % 29 = 0 and o_orderkey % 4 <> 3", day=f"{_DAY} + cast(o_orderkey % 9 as int)"),
    _seen("3000000000 + o_orderkey", "z", "o_orderkey % 87 = 0", day=f"{_DAY} + 1"),
    _seen("4000000000 + o_orderkey", "d", "o_orderkey % 67 < 2", text=f"case when o_orderkey % 67 = 1 then concat('STORE ', {_TEXT}) else {_TEXT} end", amount=f"{_AMOUNT} + case when o_orderkey % 67 = 0 and o_orderkey % 3 = 0 then 40 else 0 end"),
))
TABLES["obs"] = """select n, external_id, account_ref, date, amount,
    case when amount = 0 and account_ref in ('acct-27', 'acct-28') then cast(k % 500 * 100 as bigint)
      else cast(sum(amount) over (partition by account_ref order by date, n rows between unbounded preceding and current row) as bigint) + off + (case when cust % 3 = 0 and n % 4999 = 7 then 1 else 0 end) end as balance,
    raw_description, receipt, cast(0 as int) as occ, observation, cast(1600000000000 + (n % 1000000000) * 1000 as bigint) as at_ms,
    case when n % 11 = 0 then null else concat('ev-', cast(n % 97 as string)) end as evidence_id
  from said"""
_N = "10000000000 + o_orderkey * 100"


def _decide(code: int, action: str, where: str, id1: str = "null", id2: str = "null", ref: str = "null", amount: str = "null", day: str = "null", target: str = "null") -> str:
    cast = lambda x, t: f"cast({x} as {t})"
    return f"""select {_N} + {code} as n, '{action}' as action, {cast(id1, 'string')} as id1, {cast(id2, 'string')} as id2, {cast(ref, 'string')} as ref,
    {cast(amount, 'bigint')} as amount, {cast(day, 'date')} as day, {cast(target, 'bigint')} as target, concat('user-', cast(o_orderkey % 3 as string)) as user_id from orders where {where}"""


def _id(name: str, shift: int = 0) -> str:
    return f"concat('{name}', cast(o_orderkey + {shift} as string))"


#: Decisions, a row for each id that one names (same n).  Revokes fall on some of each kind, up to three deep.
TABLES["dec"] = " union all ".join((
    _decide(1, "MARK_NOOP", "o_orderkey % 211 = 3", _id("x")),
    _decide(2, "UNMARK_NOOP", "o_orderkey % 422 = 3 or o_orderkey % 509 = 4", _id("x")),
    _decide(3, "SUPERSEDE", "o_orderkey % 73 = 5 or o_orderkey % 73 = 7", _id("x"), _id("x", 2)),
    _decide(4, "SUPERSEDE", "o_orderkey % 511 = 20", _id("x"), _id("x", 1)),
    _decide(5, "SUPERSEDE", "o_orderkey % 511 = 21", _id("x"), _id("x", -1)),
    _decide(6, "SUPERSEDE", "o_orderkey % 511 = 18 or o_orderkey % 511 = 23", _id("x"), "concat('x', cast(o_orderkey - o_orderkey % 511 + 20 as string))"),
    _decide(7, "SUPERSEDE", "o_orderkey % 601 = 30", _id("x"), _id("nope")),
    _decide(8, "RETIRE", "o_orderkey % 307 = 11 or o_orderkey % 73 = 12", _id("x")),
    _decide(9, "SUPERSEDE", "o_orderkey % 307 = 9", _id("x"), _id("x", 2)),
    _decide(10, "PAIR", "o_orderkey % 131 = 9", _id("x"), _id("x", 4)),
    _decide(11, "UNPAIR", "o_orderkey % 262 = 9", _id("x"), _id("x", 4)),
    _decide(12, "PAIR", "o_orderkey % 393 = 9", _id("x", 4), _id("x", 8)),
    _decide(13, "MARK_EXTERNAL", "o_orderkey % 97 = 6", _id("x")),
    _decide(14, "ATTACH_ACCOUNT", "o_orderkey % 89 = 8", _id("x"), ref="case o_orderkey % 4 when 0 then 'acct-27' when 1 then 'clr-1' when 2 then 'acct-3' else 'acct-28' end"),
    _decide(15, "PIN", "o_orderkey % 53 = 2", _id("x"), ref="case when o_orderkey % 5 = 0 then 'TRANSFER' when o_orderkey % 5 = 1 then 'unheard' else 'salary' end"),
    _decide(15, "PIN", "o_orderkey % 106 = 2", _id("x", 1), ref="case when o_orderkey % 5 = 0 then 'TRANSFER' when o_orderkey % 5 = 1 then 'unheard' else 'salary' end"),
    _decide(16, "UNPIN", "o_orderkey % 159 = 2", _id("x")),
    _decide(17, "SETTLE", "o_orderkey % 145 = 0", _id("x"), _id("y")),
    _decide(18, "NOTE", "o_orderkey % 83 = 1 or o_orderkey % 83 = 2", "case when o_orderkey % 1000 = 1 then 'nobody' else concat('x', cast(o_orderkey - o_orderkey % 83 as string)) end", ref="concat('note ', cast(o_orderkey as string))"),
    _decide(19, "USER_ACK", "o_orderkey % 31 = 1", _id("x"), ref="concat('hash ', cast(o_orderkey % 2 as string))"),
    _decide(20, "USER_UNACK", "o_orderkey % 93 = 1", _id("x")),
    _decide(21, "DISMISS", "o_orderkey % 67 = 1 and o_orderkey % 2 = 0", _id("d"), ref="'RESTATEMENT'"),
    _decide(21, "DISMISS", "o_orderkey % 67 = 0 and o_orderkey % 4 = 0", _id("d"), ref="'POTENTIAL_DUP'"),
    _decide(22, "DISMISS", "o_orderkey % 499 = 17", "concat('acct-', cast(o_custkey % 33 as string))", ref="'BALANCE_BREAK'"),
    _decide(23, "CLOSE_ACCOUNT", "o_orderkey < 1000 and o_orderkey % 100 = 37", "case when o_orderkey % 300 = 37 then concat('x', cast(o_orderkey as string)) end", ref="concat('acct-', cast(o_custkey % 33 as string))", amount="o_orderkey * 100", day="case when o_orderkey % 200 = 37 then date '2001-09-01' else date '1999-01-01' end"),
    _decide(30, "REVOKE", "o_orderkey % 211 = 3 and o_orderkey % 5 = 0", target=f"{_N} + 1"),
    _decide(31, "REVOKE", "o_orderkey % 211 = 3 and o_orderkey % 10 = 0", target=f"{_N} + 30"),
    _decide(32, "REVOKE", "o_orderkey % 211 = 3 and o_orderkey % 20 = 0", target=f"{_N} + 31"),
    _decide(33, "REVOKE", "o_orderkey % 53 = 2 and o_orderkey % 7 = 0", target=f"{_N} + 15"),
    _decide(34, "REVOKE", "o_orderkey % 131 = 9 and o_orderkey % 6 = 0", target=f"{_N} + 10"),
    _decide(35, "REVOKE", "o_orderkey % 73 = 7 and o_orderkey % 4 = 0", target=f"{_N} + 3"),
    _decide(36, "REVOKE", "o_orderkey % 701 = 5", target=f"{_N} + 99"),
))
#: The read model that the reads are over: current rows with made-up pairing, as the derived table has them.
TABLES["txn"] = """select n, external_id, account_ref, date, amount, balance, raw_description, receipt, at_ms,
    case when k % 6 = 0 and k % 5 < 3 then 'MATCHED' when k % 6 = 0 then 'HELD' else 'EXTERNAL' end as leg,
    case when k % 19 = 0 then 'noop' else 'transaction' end as role,
    case k % 4 when 0 then 'OSKO' when 1 then 'CARD' end as rail,
    case when k % 6 = 0 and k % 5 < 3 then concat('TRF-', cast(floor(k / 12) as int)) end as transfer_id,
    case when k % 6 = 0 and k % 5 < 3 then 'TRANSFER' when k % 3 = 1 then 'groceries' when k % 9 = 2 then 'salary' when k % 9 = 5 then null else 'UNCATEGORIZED' end as category,
    case when k % 6 = 0 and k % 5 < 3 then 'STRUCTURAL' when k % 3 = 1 then 'RULE' when k % 9 = 2 then 'PIN' else 'NONE' end as origin,
    (k % 23 = 0) as synthetic, concat('sha-', cast(n % 1000 as string)) as state_hash
  from (select *, n - 1 as k from obs where n < 1000000000 and observation = 'posted') o"""
TABLES["transfer"] = """select transfer_id, min(external_id) as from_leg, max(external_id) as to_leg, cast(null as string) as clearing from txn where transfer_id is not null group by transfer_id having count(*) = 2
  union all select transfer_id, min(external_id), 'clr-1', 'clr-1' from txn where transfer_id is not null group by transfer_id having count(*) = 1 and min(amount) < 0
  union all select transfer_id, 'acct-27', min(external_id), 'acct-27' from txn where transfer_id is not null group by transfer_id having count(*) = 1 and min(amount) > 0"""
TABLES["review"] = """select external_id as subject, case when n % 3 = 0 then 'UNMATCHED_LEG' when n % 3 = 1 then 'POTENTIAL_DUP' else 'RESTATEMENT' end as kind, concat('item ', cast(n as string)) as detail, at_ms + 500 as opened_ms from txn where n % 17 = 0
  union all select ref, 'BALANCE_BREAK', 'chain', cast(1600000500000 as bigint) from acct where source = 'statement'"""
TABLES["note"] = "select external_id, concat('note ', cast(n as string)) as text, n * 10 as decision_n from txn where n % 13 = 0 union all select external_id, concat('later ', cast(n as string)), n * 10 + 5 from txn where n % 26 = 0"
TABLES["commitment"] = """select concat('com-', cast(c_custkey as string)) as commitment_id, concat('Name ', cast(c_custkey as string)) as name, case when c_custkey % 5 = 0 then 'in' else 'out' end as direction,
    case c_custkey % 7 when 0 then 'weekly' when 1 then 'fortnightly' when 2 then 'monthly' when 3 then 'bimonthly' when 4 then 'quarterly' when 5 then 'semiannual' else 'annual' end as cadence,
    cast(case when c_custkey % 11 = 0 then null else (case when c_custkey % 5 = 0 then 1 else -1 end) * (1 + c_custkey % 90) * 100 end as bigint) as current_amount,
    case when c_custkey % 4 = 0 then 'detected' else 'declared' end as origin, cast(case when c_custkey % 13 = 0 then 7 end as bigint) as retired_n, case when c_custkey % 3 = 0 then 'manual' when c_custkey % 3 = 1 then 'auto' end as payment,
    cast(case when c_custkey % 6 = 0 then null else 3 + c_custkey % 9 end as int) as remind_days, cast(date '1998-01-31' + cast(c_custkey % 900 as int) as date) as anchor, c_custkey as k from customer"""
TABLES["occurrence"] = """select commitment_id, date '2001-06-30' + cast((n_nationkey - 12) * 9 + k % 9 as int) as due_date, date '2001-06-30' + cast((n_nationkey - 12) * 9 + k % 9 + 7 as int) as window_end,
    case when n_nationkey < 12 then (case (k + n_nationkey) % 5 when 0 then 'missed' when 1 then 'settled' when 2 then 'awaiting' else 'occurred' end) else 'due' end as status,
    cast(case when n_nationkey < 12 and (k + n_nationkey) % 5 in (1, 3, 4) then current_amount + n_nationkey end as bigint) as amount,
    case when n_nationkey < 12 and (k + n_nationkey) % 5 >= 3 then concat('x', cast(k * 25 + n_nationkey as string)) end as matched_id,
    case when n_nationkey < 12 and (k + n_nationkey) % 5 >= 3 then date '2001-06-30' + cast((n_nationkey - 12) * 9 + k % 9 + 2 as int) end as matched_date
  from commitment, nation"""
TABLES["commitment_fact"] = "select external_id, concat('com-', cast(n % 97 + 1 as string)) as commitment_id, case when n % 2 = 0 then 'rule' else 'pin' end as matched_by from txn where n % 7 = 1"
#: Markers of ingests: each batch has the numbers between its two markers; some never ended.
TABLES["marker"] = """select concat('b', cast(b as string)) as batch, 'start' as phase, b * 100 as n, concat('acct-', cast(b % 30 as string)) as account_ref, concat('file-', cast(b % 40 as string), '.csv') as file, cast(null as bigint) as appended, cast(null as string) as status, b * 1000 as at_ms
    from (select distinct cast(floor(o_orderkey / 100) as bigint) as b from orders) s
  union all select concat('b', cast(b as string)), 'complete', b * 100 + 99, null, null, b % 90, case when b % 8 = 0 then 'guard_refused' else 'ok' end, b * 1000 + 400
    from (select distinct cast(floor(o_orderkey / 100) as bigint) as b from orders) e where b % 9 <> 5"""
TABLES["cash_book"] = "select 'acct-27' as account_ref, '2001-06' as month, cast(1234 as bigint) as unrecorded from (select 1 as one) x union all select 'acct-28', '2001-06', cast(99 as bigint) from (select 1 as one) x union all select 'acct-27', '2001-05', cast(5 as bigint) from (select 1 as one) x"
TABLES["category_group"] = "select 'groceries' as category, 'Home' as grp from (select 1 as one) x union all select 'salary', 'Work' from (select 1 as one) x union all select 'other', ' ' from (select 1 as one) x"
_CN = "20000000000 + cast(n_nationkey as bigint) * 100000000"
_CO = "20000000000 + o_orderkey % 25 * 100000000"
_CADENCE = "case n_nationkey % 8 when 0 then 'weekly' when 1 then 'fortnightly' when 2 then 'monthly' when 3 then 'bimonthly' when 4 then 'quarterly' when 5 then 'semiannual' when 6 then 'annual' else 'irregular' end"
#: Commitments that people declare, end, declare again, pin, exclude and settle; ``match`` is the rule's regex, ``account`` its scope.
TABLES["said_commitment"] = f"""select {_CN} + 1000000 as n, 'DECLARE' as action, concat('pay-', cast(n_nationkey as string)) as commitment_id, cast(null as string) as id, case when n_nationkey % 5 = 0 then 'in' else 'out' end as direction, {_CADENCE} as cadence,
    case when n_nationkey % 3 = 0 then 'variable' else 'fixed' end as amount_kind, concat('merchant ', cast(n_nationkey as string), ' ') as match, case when n_nationkey % 4 = 1 then concat('acct-', cast(n_nationkey as string)) end as account,
    cast(case when n_nationkey % 11 = 0 then null else 500 * (n_nationkey + 1) end as bigint) as amount, case when n_nationkey % 12 = 7 then null else date '1999-01-31' + cast(n_nationkey * 9 as int) end as day from nation
  union all select {_CN} + 50000000, 'DECLARE', concat('pay-', cast(n_nationkey as string)), null, 'out', {_CADENCE}, 'fixed', case when n_nationkey % 18 = 6 then '(' else concat('merchant ', cast(n_nationkey + 10 as string), ' ') end, null, cast(700 as bigint), date '2000-02-29' from nation where n_nationkey % 6 = 0
  union all select {_CN} + 20000000, 'RETIRE', concat(case when n_nationkey % 8 = 3 then 'ghost-' else 'pay-' end, cast(n_nationkey as string)), null, null, null, null, null, null, null, date '2001-03-15' from nation where n_nationkey % 6 < 2 or n_nationkey % 8 = 3
  union all select {_CO} + (5 + o_orderkey % 60) * 1000000 + o_orderkey, 'PIN', concat('pay-', cast(o_orderkey % 28 as string)), concat(case when o_orderkey % 370 = 4 then 'nope' else 'x' end, cast(o_orderkey as string)), null, null, null, null, null, null, null from orders where o_orderkey % 37 = 4
  union all select {_CO} + 90000000 + o_orderkey, 'UNPIN', null, concat('x', cast(o_orderkey as string)), null, null, null, null, null, null, null from orders where o_orderkey % 74 = 4
  union all select {_CO} + 30000000 + o_orderkey, 'EXCLUDE', concat('pay-', cast(o_custkey % 40 as string)), concat('x', cast(o_orderkey as string)), null, null, null, null, null, null, null from orders where o_orderkey % 13 = 6
  union all select {_CO} + 80000000 + o_orderkey, 'INCLUDE', concat('pay-', cast(o_custkey % 40 as string)), concat('x', cast(o_orderkey as string)), null, null, null, null, null, null, null from orders where o_orderkey % 39 = 6
  union all select {_CN} + 60000000 + s, 'SETTLE', concat('pay-', cast(n_nationkey as string)), null, null, null, null, null, null, null, case when n_nationkey % 8 = 0 then (case when n_nationkey % 6 = 0 then date '2000-02-29' else date '1999-01-31' + cast(n_nationkey * 9 as int) end) + cast(7 * (s + 40) as int)
      else cast((case when n_nationkey % 6 = 0 then date '2000-02-29' else date '1999-01-31' + cast(n_nationkey * 9 as int) end) + interval '1' month * cast(s as int) as date) end
    from nation, (select distinct o_orderkey % 30 as s from orders) ss where (n_nationkey + s) % 3 = 0"""
#: Series of charges with refunds, foreign prices and doubled days, for the detection of recurring ones.
TABLES["charge"] = """select cast(1000000 + c_custkey * 100 + n_nationkey as bigint) as n, concat('acct-', cast(c_custkey % 30 as string)) as account_ref,
    cast(case when c_custkey % 3 = 0 then cast(date '1999-07-31' + interval '1' month * n_nationkey as date) when c_custkey % 3 = 1 then date '2000-12-01' + cast(n_nationkey * 7 as int) else cast(date '1995-02-15' + interval '1' month * (3 * n_nationkey) as date) end as date) as date,
    cast(case when c_custkey % 10 = 7 then 1 else -1 end * (500 + c_custkey % 50 * 10 + case when n_nationkey >= 12 then 200 else 0 end + case when c_custkey % 14 = 3 then n_nationkey * 3 else 0 end + case when c_custkey % 9 = 2 and n_nationkey = 6 then 2000 else 0 end) as bigint) as amount,
    concat('SERIES ', cast(c_custkey as string), ' - Visa Purchase', case when c_custkey % 8 = 1 or (c_custkey % 8 = 2 and n_nationkey < 20) then concat(' Foreign Currency Amount: USD ', cast(20 + c_custkey % 7 as string), '.5') else '' end) as raw_description
    from customer, nation where c_custkey % 10 < 8
  union all select cast(900000000 + c_custkey * 100 + n_nationkey as bigint), concat('acct-', cast((c_custkey + 1) % 30 as string)), cast(case when c_custkey % 3 = 0 then cast(date '1999-07-31' + interval '1' month * n_nationkey as date) when c_custkey % 3 = 1 then date '2000-12-01' + cast(n_nationkey * 7 as int) else cast(date '1995-02-15' + interval '1' month * (3 * n_nationkey) as date) end as date) + cast(c_custkey % 4 as int),
    cast(case when n_nationkey = 3 then 300 when n_nationkey = 4 then 900 + c_custkey % 5 * 300 else -40 end as bigint), concat('SERIES ', cast(c_custkey as string), ' - Visa Purchase') from customer, nation where c_custkey % 4 = 0 and n_nationkey in (3, 4, 9)"""
_BASE = ("orders", "customer", "nation")


def sql(body: str, recursive: bool = False) -> str:
    """The oracle's text: all tables of the book, then ``body`` (which may begin with a comma and more tables)."""
    held = ", ".join(f"{name} as ({text})" for name, text in TABLES.items())
    return f"with {'recursive ' if recursive else ''}{held}{' ' if body.lstrip().startswith(',') else ' '}{body}"


class Book(dict[str, DataFrame]):
    """The book's tables, and what queries derived from them and stored: a stage is derived once in an application, and read by all after it."""

    stored: dict[tuple[str, str, str], object] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.place = (spark.sparkContext.applicationId, sf_dir)

    def once(self, name: str, make):
        key = (*self.place, name)
        if key not in self.stored:
            self.stored[key] = make(self)
        return self.stored[key]


def load(spark: SparkSession, sf_dir: str) -> Book:
    """All tables of the book, unread until they are used."""
    for name in _BASE:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    out = Book(spark, sf_dir)
    for name, text in TABLES.items():
        out[name] = spark.sql(text)
        out[name].createOrReplaceTempView(name)
    return out
