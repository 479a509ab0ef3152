"""Queries over what people should review, and over rules, with SQL written from the rules they follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import identity, text
from tallyforge.operators import commitments, reparse, review
from tallyforge.plans import book, derive_queries
from tallyforge.plans.derive_queries import _WORDS, CUR, EFF
from tallyforge.plans.hub_queries import Book, over

DAY = book.AS_OF
_STEM = r"upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}.raw_description, '^\s+|\s+$', '', 'g'), '( - Visa Purchase| - Receipt| {{3,}}).*$', ''), '\s+', ' ', 'g'), '\s+$', ''))"
_ROWS = f""", rw as (select f.*, case when n % 31 = 0 then 'MATCHED' when n % 37 = 0 then 'HELD' else 'EXTERNAL' end as leg, {_STEM.format('f')} as stem, {_WORDS.format('f')} as w from (select * from obs where observation = 'posted' qualify row_number() over (partition by external_id order by n desc) = 1) f)"""


def _rows(b: Book):
    newest = b["obs"].where(F.col("observation") == "posted").groupBy("external_id").agg(F.max_by(F.struct("n", "account_ref", "date", "amount", "balance", "raw_description"), "n").alias("f")).select("external_id", "f.*")
    return newest.withColumn("leg", F.when(F.col("n") % 31 == 0, "MATCHED").when(F.col("n") % 37 == 0, "HELD").otherwise("EXTERNAL"))


_joined = lambda df: df.withColumn("members", F.array_join("members", ","))
over("potential_dups", _ROWS + """, l as (select a.external_id as x, b.external_id as y from rw a join rw b on a.account_ref = b.account_ref and a.date = b.date and a.stem = b.stem and (a.amount < 0) = (b.amount < 0) and abs(a.amount - b.amount) <= 40 where a.leg <> 'MATCHED' and b.leg <> 'MATCHED'),
  r as (select x, y from l union select r.x, l.y from r join l on l.x = r.y), c as (select x, list_sort(list(distinct y)) as m from r group by 1) select distinct m[1] as subject, array_to_string(m, ',') as members from c where len(m) > 1""", True)(lambda b: _joined(review.dup_clusters(_rows(b), 40)))
over("restatements", _ROWS + """, l as (select a.external_id as x, b.external_id as y from rw a join rw b on a.account_ref = b.account_ref and a.date = b.date and a.amount = b.amount and a.stem <> b.stem and least(len(a.w), len(b.w)) > 0 and len(list_intersect(a.w, b.w)) >= 0.5 * least(len(a.w), len(b.w)) where a.leg <> 'MATCHED' and b.leg <> 'MATCHED'),
  r as (select x, y from l union select r.x, l.y from r join l on l.x = r.y), c as (select x, list_sort(list(distinct y)) as m from r group by 1) select distinct m[1] as subject, array_to_string(m, ',') as members from c where len(m) > 1""", True)(lambda b: _joined(review.restatement_clusters(_rows(b))))
over("re_observations", r""", p as (select * from obs where observation = 'posted'), g as (select external_id, count(*) as n, count(distinct (amount, raw_description)) as c, count(distinct balance) as b from p group by 1 having count(*) > 1),
  t as (select external_id, c, 're-observed: ' || string_agg('n' || p.n || ' ' || amount || case when c > 1 then ' ' || regexp_replace(regexp_replace(raw_description, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') else ' bal ' || cast(balance as bigint) end, '  /  ' order by p.n) as d from g join p using (external_id) where c > 1 or b > 1 group by 1, 2)
  select external_id as subject, case when c > 1 then 'RESTATEMENT' else 'POTENTIAL_DUP' end as kind, case when length(d) <= 140 then d else substr(d, 1, 139) || '…' end as detail from t""")(lambda b: review.re_observations(_rows(b), b["obs"]))


def _items(b: Book):
    rows = _rows(b)
    some = lambda mod, name: b["txn"].where(F.col("n") % mod == 0).select(F.col("external_id").alias(name))
    waiting = b["txn"].select("external_id", F.when(F.col("n") % 41 == 0, "STALE").otherwise("OPEN").alias("state"), F.when(F.col("n") % 43 == 0, "a,b").alias("candidates"))
    com = b["commitment"]
    return review.items(rows, b["obs"], waiting, b["acct"].where(F.col("source") == "statement").select(F.col("ref").alias("account_ref")), some(47, "external_id"), com.select(F.col("name").alias("stem"), F.when(F.col("origin") == "detected", "active").otherwise("ended").alias("status")), com.where("k % 7 = 0").select("commitment_id"), com.select("commitment_id", (F.col("k") % 3).alias("count")), b["dec"].where(F.col("action") == "REVOKE").select(F.col("n").alias("decision_n")), DAY, tolerance=40)


_ITEMS = _ROWS + f""", dl as (select a.external_id as x, b.external_id as y from rw a join rw b on a.account_ref = b.account_ref and a.date = b.date and a.stem = b.stem and (a.amount < 0) = (b.amount < 0) and abs(a.amount - b.amount) <= 40 where a.leg <> 'MATCHED' and b.leg <> 'MATCHED'),
  dr as (select x, y from dl union select dr.x, dl.y from dr join dl on dl.x = dr.y),
  sl as (select a.external_id as x, b.external_id as y from rw a join rw b on a.account_ref = b.account_ref and a.date = b.date and a.amount = b.amount and a.stem <> b.stem and least(len(a.w), len(b.w)) > 0 and len(list_intersect(a.w, b.w)) >= 0.5 * least(len(a.w), len(b.w)) where a.leg <> 'MATCHED' and b.leg <> 'MATCHED'),
  sr as (select x, y from sl union select sr.x, sl.y from sr join sl on sl.x = sr.y),
  again as (select external_id, count(distinct (amount, raw_description)) as c, count(distinct balance) as bs from obs where observation = 'posted' group by 1 having count(*) > 1),
  item as (select min(y) as subject, 'POTENTIAL_DUP' as kind from dr group by x having count(distinct y) > 1 union select min(y), 'RESTATEMENT' from sr group by x having count(distinct y) > 1
    union select external_id, case when c > 1 then 'RESTATEMENT' else 'POTENTIAL_DUP' end from again where c > 1 or bs > 1 union select external_id, 'UNMATCHED_LEG' from rw where leg = 'HELD' and date_diff('day', date, date '{DAY}') > 30
    union select external_id, 'AMBIGUOUS_TRANSFER' from txn where n % 47 = 0 union select external_id, 'AMBIGUOUS_SETTLEMENT' from txn where n % 43 = 0 union select external_id, 'STALE_PENDING' from txn where n % 41 = 0 union select ref, 'BALANCE_BREAK' from acct where source = 'statement'
    union select name, 'SUSPECTED_RECURRING' from commitment where origin = 'detected' union select commitment_id, 'DORMANT_COMMITMENT' from commitment where k % 7 = 0 union select commitment_id, 'COMMITMENT_ARREARS' from commitment where k % 3 > 0 union select cast(n as varchar), 'INEFFECTIVE_DECISION' from dec where action = 'REVOKE')"""
over("review_items", _ITEMS + " select * from item", True)(_items)
over("review_undismissed", _ITEMS + EFF + """, ds as (select case when ref = 'BALANCE_BREAK' or id1 in (select external_id from obs) then id1 end as subject, ref as kind, max(n) as d from eff where action = 'DISMISS' group by 1, 2),
  nf as (select external_id as subject, max(n) * (1 + 3 * (max(n) % 2)) as n from obs group by 1 union all select account_ref, max(n) * (1 + 3 * (max(n) % 2)) from obs group by 1)
  select item.* from item left join ds on ds.subject = item.subject and ds.kind = item.kind left join (select subject, max(n) as n from nf group by 1) f on f.subject = item.subject where item.kind = 'INEFFECTIVE_DECISION' or d is null or d <= coalesce(f.n, 0)""", True)(
    lambda b: review.undismissed(_items(b), derive_queries.derive.in_force(b["dec"]), b["obs"].select(F.col("external_id").alias("id"), F.col("external_id").alias("current_id")).distinct(),
        b["obs"].groupBy(F.col("external_id").alias("subject")).agg((F.max("n") * (1 + 3 * (F.max("n") % 2))).alias("n")).unionByName(b["obs"].groupBy(F.col("account_ref").alias("subject")).agg((F.max("n") * (1 + 3 * (F.max("n") % 2))).alias("n"))).withColumn("kind", F.lit(None).cast("string"))))
_RULES = ["regexp_matches(raw_description, '(?i)merchant 1')", "abs(amount) <= 3000", "account_ref in ('acct-1', 'acct-2')", "regexp_matches(raw_description, '(?i)merchant 1[0-9]')"]
over("rule_stats", f", r as (select txn.*, {_STEM.format('txn')} as stem, list_filter([" + ", ".join(f"case when {c} then {i + 1} end" for i, c in enumerate(_RULES)) + "], lambda x: x is not null) as f from txn), e as (select *, f[1] as w, unnest(f) as rule from r) select rule, count(*) filter (rule = w) as hits, count(distinct stem) filter (rule = w) as merchants, cast(coalesce(sum(amount) filter (rule = w), 0) as bigint) as total, count(*) filter (rule <> w) as shadowed, min(w) filter (rule <> w) as shadowed_by from e group by 1")(
    lambda b: review.rule_stats(b["txn"], [("a", F.col("raw_description").rlike("(?i)merchant 1")), ("b", F.abs("amount") <= 3000), ("c", F.col("account_ref").isin("acct-1", "acct-2")), ("d", F.col("raw_description").rlike("(?i)merchant 1[0-9]"))]))
over("category_trend", "select strftime(date, '%Y-%m') as month, count(*) filter (origin = 'RULE') as rule, count(*) filter (origin = 'PIN') as pin, count(*) filter (origin = 'NONE') as none from txn group by 1")(lambda b: review.trend(b["txn"]))
over("rule_suggestions", f"select {_STEM.format('txn')} as stem, count(*) as rows, cast(sum(amount) as bigint) as total, min(date) as first, max(date) as last, array_to_string(list_sort(list(distinct account_ref)), ',') as accounts from txn where origin = 'NONE' group by 1")(lambda b: review.suggestions(b["txn"]))
over("foreign_amounts", r"select n, case when x <> '' then cast(round(cast(x as decimal(20, 6)) * 100) as bigint) end as minor from (select n, regexp_extract(raw_description, 'Foreign Currency Amount:\s*[A-Z]{3}\s*(-?\d+(\.\d+)?)', 1) as x from charge)")(lambda b: b["charge"].select("n", text.foreign_amount(F.col("raw_description")).alias("minor")))
over("transfer_ids", "select transfer_id, 'TRF-' || substr(sha256('tr|' || least(from_leg, to_leg) || '|' || greatest(from_leg, to_leg)), 1, 16) as by_legs, 'cand|' || substr(sha256('cand|' || from_leg), 1, 16) as candidate from transfer")(
    lambda b: b["transfer"].select("transfer_id", identity.transfer_id(F.col("from_leg"), F.col("to_leg")).alias("by_legs"), identity.candidate_id(F.col("from_leg")).alias("candidate")))
over("price_faces", "select commitment_id, coalesce(abs(abs(current_amount) - abs(declared)) >= 50 or abs(abs(current_amount) - abs(declared)) >= abs(declared) * cast(0.05 as double), false) as step, round(100.0 * (abs(current_amount) - abs(declared)) / nullif(abs(declared), 0), 6) as pct from (select *, k % 5 * 900 as declared from commitment)")(
    lambda b: b["commitment"].withColumn("declared", F.col("k") % 5 * 900).select("commitment_id", F.coalesce(commitments.is_step(F.col("declared"), F.col("current_amount")), F.lit(False)).alias("step"), F.round(commitments.change_pct(F.col("declared"), F.col("current_amount")), 6).alias("pct")))
over("config_drift", "select external_id, case when n % 5 = 0 then 'unknown' when coalesce(n % 3 = n % 2, false) then 'same' when n % 7 = 0 then 'unknown' when n % 2 = n % 4 then 'repo-newer' when n % 3 = n % 4 then 'edited-here' else 'both-changed' end as state from txn")(
    lambda b: b["txn"].select("external_id", text.drift(F.when(F.col("n") % 5 != 0, F.col("n") % 3), F.when(F.col("n") % 7 != 0, F.col("n") % 4), F.col("n") % 2).alias("state")))
over("risky_regexes", r"select commitment_id, regexp_matches(m, '\([^)]*[*+][^)]*\)[*+]|\([^)]*\{\d*,?\d*\}[^)]*\)[*+]') or regexp_matches(m, '(\.\*){2,}|(\.\+){2,}') as risky from (select commitment_id, case k % 4 when 0 then '(a+)+b' when 1 then 'x.*.*y' when 2 then 'merchant [0-9]+' else '(a{2,3})*' end as m from commitment)")(
    lambda b: b["commitment"].select("commitment_id", text.risky(F.element_at(F.array(F.lit("(a+)+b"), F.lit("x.*.*y"), F.lit("merchant [0-9]+"), F.lit("(a{2,3})*")), (F.col("k") % 4 + 1).cast("int"))).alias("risky")))


def _reread(b: Book):
    """A file's rows, and what it has now: some with a new id, some in other words, some new, some gone."""
    n = F.col("n")
    rows = b["txn"].where("n % 3 = 0")
    now = rows.where(n % 10 != 3).select(F.when(n % 10 == 6, F.concat(F.lit("new-"), "external_id")).when(n % 10 == 9, F.concat(F.lit("alike-"), "external_id")).otherwise(F.col("external_id")).alias("external_id"), "account_ref", "date", F.when(n % 50 == 0, F.col("amount") + 1).otherwise(F.col("amount")).alias("amount"), F.when(n % 10 == 9, F.concat(F.lit("SHOP "), "raw_description")).otherwise(F.col("raw_description")).alias("raw_description"), "n")
    return reparse.diff(rows, rows.where(n % 70 == 0).select("external_id"), now)


# No SQL: new rows take old ones one after the other; the tests hold it against the rule.
over("reparse_diff", None)(_reread)
