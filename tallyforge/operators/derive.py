"""From observations and decisions to current rows: replaced ids, roles, closed accounts, pairing, categories, settlement.

Facts are observations (n, external_id, ...); several of one id are what a source said again, and the newest holds.  Decisions have a row for
each id that they name (n, action, id1, id2, ref, amount, day, target, user_id); only effective ones come here.  Decisions are few beside
facts but not bounded, so they join by key; accounts, patterns and rules are configuration, and are broadcast or compiled into columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.identity import state_hash, transfer_id
from tallyforge.functions.text import clean, similar, stem, tokens
from tallyforge.operators import ladder
from tallyforge.operators.decisions import chain_resolve, effective
from tallyforge.session import cut

#: (regex, rail, whether it shapes a transfer, the account that the leg goes to), tried in order: an account's own, then the default's.
Pattern = tuple[str, str | None, bool, str | None]


def in_force(decisions: DataFrame) -> DataFrame:
    """Effective decisions with all the ids that they name."""
    decisions = cut(decisions)
    one = decisions.select("n", "action", "target").distinct()
    return decisions.join(effective(one).select("n"), "n", "left_semi")


def pattern(patterns: dict[str, list[Pattern]], account: Column, text: Column) -> Column:
    """The first pattern that is found in the cleaned text, as (rail, shape, clearing); null if none is."""
    cleaned, out = clean(text), F
    for name, own in sorted(patterns.items(), key=lambda x: x[0] == "default"):
        for regex, rail, shape, clearing in own:
            hit = cleaned.rlike(f"(?iu){regex}")
            made = F.struct(F.lit(rail).cast("string").alias("rail"), F.lit(shape).alias("shape"), F.lit(clearing).cast("string").alias("clearing"))
            out = out.when(hit if name == "default" else hit & (account == name), made)
    return out.otherwise(F.lit(None))


def supersessions(decisions: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(from_id, to_id, decision_n), to_id null where an id is retired, and the decisions (decision_n, reason) that have no effect.

    The last decision on an id counts.  Ids that no fact has, targets that are retired, and cycles have no effect: of a cycle, all its
    decisions go, and with them those on the way to it from the smallest id that leads there.
    """
    known = facts.select(F.col("external_id").alias("_k")).distinct()
    acts = decisions.where(F.col("action").isin("SUPERSEDE", "RETIRE")).select("n", "action", F.col("id1").alias("from_id"), F.when(F.col("action") == "SUPERSEDE", F.col("id2")).alias("to_id"))
    judged = acts.join(known.select(F.col("_k").alias("from_id"), F.lit(True).alias("_f")), "from_id", "left").join(known.select(F.col("_k").alias("to_id"), F.lit(True).alias("_t")), "to_id", "left")
    ok = F.col("_f").isNotNull() & ((F.col("action") == "RETIRE") | F.col("_t").isNotNull())
    judged = cut(judged.select("n", "action", "from_id", "to_id", ok.alias("ok")))
    last = judged.where("ok").groupBy("from_id").agg(F.max_by(F.struct("to_id", "n"), "n").alias("s")).select("from_id", "s.to_id", F.col("s.n").alias("decision_n"))
    retired = last.where(F.col("to_id").isNull()).select(F.col("from_id").alias("to_id"), F.lit(True).alias("_gone"))
    last = cut(last.join(retired, "to_id", "left").select("from_id", "to_id", "decision_n", F.coalesce("_gone", F.lit(False)).alias("gone")))
    edges = cut(last.where(~F.col("gone") & F.col("to_id").isNotNull()).select("from_id", "to_id"))
    around = _cycles(edges)
    bad = judged.where(~F.col("ok")).select(F.col("n").alias("decision_n"), F.lit("unknown id").alias("reason"))
    bad = bad.unionByName(last.where("gone").select("decision_n", F.lit("retired target").alias("reason")))
    bad = bad.unionByName(last.join(around.where("cycle"), "from_id", "left_semi").select("decision_n", F.lit("cycle").alias("reason")))
    return last.where(~F.col("gone")).join(around, "from_id", "left_anti").drop("gone"), bad


def _cycles(edges: DataFrame) -> DataFrame:
    """(from_id, cycle): the ids on cycles, and (cycle false) those on the way to each from the smallest id that leads to it."""
    ends = chain_resolve(edges.select("from_id", "to_id"))
    loose = cut(edges.join(ends.where(F.col("resolved").isNull()).select(F.col("id").alias("from_id")), "from_id", "left_semi"))
    n = loose.count()
    if not n:
        return edges.select("from_id", F.lit(True).alias("cycle")).limit(0)
    # After at least as many steps as there are ids every pointer is on its cycle; the least id passed on the way names the cycle.
    hop = cut(loose.select("from_id", F.col("to_id").alias("at"), F.col("to_id").alias("least")))
    hops = [hop]
    while 2 ** (len(hops) - 1) < n:
        ahead = hops[-1].select(F.col("from_id").alias("at"), F.col("at").alias("_at"), F.col("least").alias("_least"))
        hops.append(cut(hops[-1].join(ahead, "at").select("from_id", F.col("_at").alias("at"), F.least("least", "_least").alias("least"))))
    cycle = cut(hops[-1].select(F.col("at").alias("from_id")).distinct())
    name = hops[-1].join(cycle, "from_id", "left_semi").select(F.col("from_id").alias("at"), F.col("least").alias("name"))
    start = hops[-1].join(name, "at").groupBy("name").agg(F.min("from_id").alias("from_id"))
    # What the smallest id passes: doubled with every length of step.
    path = cut(start.select("from_id"))
    for step in hops:
        path = cut(path.unionByName(step.join(path, "from_id", "left_semi").select(F.col("at").alias("from_id"))).distinct())
    return cycle.withColumn("cycle", F.lit(True)).unionByName(path.join(cycle, "from_id", "left_anti").withColumn("cycle", F.lit(False)))


def resolved(facts: DataFrame, superseded: DataFrame) -> DataFrame:
    """(id, current_id) of every id that a fact has: the end of its chain, or itself."""
    ends = chain_resolve(superseded.where(F.col("to_id").isNotNull()).select("from_id", "to_id")).select("id", "resolved")
    return facts.select(F.col("external_id").alias("id")).distinct().join(ends, "id", "left").select("id", F.coalesce("resolved", "id").alias("current_id"))


def latest_facts(facts: DataFrame, superseded: DataFrame) -> DataFrame:
    """The newest observation of every id that is neither replaced nor retired."""
    newest = facts.groupBy("external_id").agg(F.max_by(F.struct(*[c for c in facts.columns if c != "external_id"]), "n").alias("f")).select("external_id", "f.*")
    return newest.join(superseded.select(F.col("from_id").alias("external_id")), "external_id", "left_anti")


def latest_by_id(decisions: DataFrame, actions: list[str], ids: DataFrame, column: str = "id1") -> DataFrame:
    """The last decision of some actions on each current id: (external_id, n, action, ref, id1, id2)."""
    rows = decisions.where(F.col("action").isin(*actions)).join(ids.select(F.col("id").alias(column), F.col("current_id").alias("external_id")), column)
    return rows.groupBy("external_id").agg(F.max_by(F.struct("n", "action", "ref", "id1", "id2", "user_id"), "n").alias("d")).select("external_id", "d.*")


def with_roles(current: DataFrame, decisions: DataFrame, ids: DataFrame, profiles: list[tuple[str, str]]) -> DataFrame:
    """Rows with their role: the last decision, or else noop for those that a profile's regex finds (account or ``*``)."""
    noop, text = F.lit(False), clean(F.col("raw_description"))
    for account, regex in profiles:
        noop = noop | (text.rlike(f"(?iu){regex}") & (F.lit(account == "*") | (F.col("account_ref") == account)))
    said = latest_by_id(decisions, ["MARK_NOOP", "UNMARK_NOOP"], ids).select("external_id", F.col("action").alias("_said"))
    role = F.when(F.col("_said") == "MARK_NOOP", "noop").when(F.col("_said") == "UNMARK_NOOP", "transaction").otherwise(F.when(noop, "noop").otherwise("transaction"))
    return current.join(said, "external_id", "left").withColumn("role", role).drop("_said")


def closures(decisions: DataFrame, current: DataFrame, ids: DataFrame, accounts: DataFrame) -> DataFrame:
    """The last closing of each account: its adjustment, or the reason why it closes nothing; and the current ids that settle it.

    A closing names a statement account with rows, none after its day; the legs that settle it lie in other accounts and add up to
    what the declared balance adds to the last row's.
    """
    last = current.where(F.col("role") != "noop").groupBy("account_ref").agg(F.max_by(F.struct(F.col("date").alias("last_date"), F.col("balance").alias("last_balance")), F.struct("date", "n")).alias("l")).select(F.col("account_ref").alias("ref"), "l.*")
    acts = decisions.where(F.col("action") == "CLOSE_ACCOUNT").withColumn("_last", F.max("n").over(Window.partitionBy("ref"))).where(F.col("n") == F.col("_last"))
    real = current.select(F.col("external_id").alias("current_id"), F.col("account_ref").alias("_a"), F.col("amount").alias("_amount"))
    legs = acts.join(ids.withColumnRenamed("id", "id1"), "id1", "left").join(real, "current_id", "left")
    each = legs.groupBy("n", "ref", F.col("amount").alias("closing"), "day").agg(
        F.count("id1").alias("_legs"), F.count_if(F.col("id1").isNotNull() & F.col("_a").isNull()).alias("_unknown"), F.count_if(F.col("_a") == F.col("ref")).alias("_own"),
        F.coalesce(F.sum(-F.col("_amount")), F.lit(0)).alias("_moves"), F.array_sort(F.collect_set(F.when(F.col("_a").isNotNull(), F.col("current_id")))).alias("settles"),
    )
    each = each.join(F.broadcast(accounts.select("ref", "source")), "ref", "left").join(last, "ref", "left")
    adjustment = F.col("closing") - F.col("last_balance")
    reason = F.when(F.coalesce("source", F.lit("")) != "statement", "not a statement account").when(F.col("last_date").isNull(), "no rows").when(F.col("day") < F.col("last_date"), "before the last row")
    reason = reason.when(F.col("_unknown") > 0, "unknown leg").when(F.col("_own") > 0, "own leg").when((F.col("_legs") > 0) & (F.col("_moves") != adjustment), "legs don't add up")
    return each.select(F.col("ref").alias("account_ref"), F.col("n").alias("decision_n"), F.col("day").alias("closed_at"), "closing", adjustment.alias("adjustment"), "settles", reason.alias("reason"))


def receipt_shaped(current: DataFrame, window: int) -> DataFrame:
    """Ids of rows whose receipt a plausible counterpart shares: opposite and equal, in another account of the currency, within the window.

    Days are dealt to stretches of the window's length, so a receipt that comes back over the years meets only its neighbours.
    """
    rows = current.where(F.trim(F.coalesce("receipt", F.lit(""))) != "").select("external_id", "account_ref", "date", "amount", "receipt", "currency", F.abs("amount").alias("_a"))
    stretch = F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / max(1, window))
    left = rows.withColumn("_s", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    right = rows.withColumn("_s", stretch).select("receipt", "_a", "currency", "_s", F.col("account_ref").alias("_acct"), F.col("amount").alias("_amt"), F.col("date").alias("_d"))
    met = left.join(right, ["receipt", "_a", "currency", "_s"]).where((F.col("account_ref") != F.col("_acct")) & (F.col("amount") * F.col("_amt") < 0) & (F.abs(F.datediff("date", "_d")) <= window))
    return met.select("external_id").distinct()


def pairing(current: DataFrame, decisions: DataFrame, ids: DataFrame, accounts: DataFrame, patterns: dict[str, list[Pattern]], settled: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transfers, leg states and legs held with several candidates.

    ``settled`` are (external_id, account) of closing legs.  In order: people's pairs, legs that people or closings give to an account, the
    ladder over the shaped rest.  A pair holds only while it is the last decision on both its legs.
    """
    hit = pattern(patterns, F.col("account_ref"), F.col("raw_description"))
    rows = current.where(F.col("role") != "noop").join(F.broadcast(accounts.select(F.col("ref").alias("account_ref"), "currency")), "account_ref", "left")
    rows = cut(rows.withColumn("_p", hit).select("n", "external_id", "account_ref", "date", "amount", "receipt", "currency", F.col("_p.rail").alias("rail"), F.coalesce("_p.shape", F.lit(False)).alias("shape"), F.col("_p.clearing").alias("clearing")))
    here = rows.select("external_id")
    map_ = ids.select(F.col("id"), F.col("current_id"))
    acts = decisions.where(F.col("action").isin("MARK_EXTERNAL", "PAIR", "UNPAIR")).select("n", "action", "id1", "id2")
    both = acts.join(map_.select(F.col("id").alias("id1"), F.col("current_id").alias("a")), "id1", "left").join(map_.select(F.col("id").alias("id2"), F.col("current_id").alias("b")), "id2", "left")
    both = cut(both.where(F.col("a").isNotNull() & ((F.col("action") == "MARK_EXTERNAL") | F.col("b").isNotNull())).select("n", "action", "a", "b"))
    legs = both.select("n", "action", F.explode(F.array_distinct(F.filter(F.array("a", "b"), lambda x: x.isNotNull()))).alias("external_id")).join(here, "external_id", "left_semi")
    last = cut(legs.groupBy("external_id").agg(F.max("n").alias("n"), F.max_by("action", "n").alias("action")))
    live = both.where(F.col("action") == "PAIR").join(last.select(F.col("external_id").alias("a"), F.col("n").alias("_na")), "a").join(last.select(F.col("external_id").alias("b"), F.col("n").alias("_nb")), "b")
    live = live.where((F.col("n") == F.col("_na")) & (F.col("n") == F.col("_nb"))).select("n", "a", "b")
    face = lambda name: rows.select(F.col("external_id").alias(name), F.col("receipt").alias(f"_r{name}"), F.col("amount").alias(f"_m{name}"), F.col("rail").alias(f"_l{name}"))
    live = cut(live.join(face("a"), "a").join(face("b"), "b"))
    paired = live.select(F.explode(F.array("a", "b")).alias("external_id"))
    out = last.where(F.col("action") != "PAIR").select("external_id")
    given = decisions.where(F.col("action") == "ATTACH_ACCOUNT").join(F.broadcast(accounts.where(F.col("source").isin("clearing", "declared")).select("ref")), "ref").join(map_.select(F.col("id").alias("id1"), F.col("current_id").alias("external_id")), "id1")
    given = given.groupBy("external_id").agg(F.max_by("ref", "n").alias("_to"))
    given = given.join(settled.select("external_id", F.col("account").alias("_by")), "external_id", "full").select("external_id", F.coalesce("_by", "_to").alias("given"))
    free = cut(rows.join(paired, "external_id", "left_anti").join(out, "external_id", "left_anti").join(given, "external_id", "left"))
    direct = free.where(F.col("given").isNotNull() & (F.col("given") != F.col("account_ref")))
    shaped = receipt_shaped(rows, window).withColumn("_shaped", F.lit(True))
    pool = free.where(F.col("given").isNull() | (F.col("given") == F.col("account_ref"))).join(shaped, "external_id", "left").where(F.col("shape") | F.col("_shaped"))
    pool = cut(pool.select("n", "external_id", "account_ref", "date", "amount", "receipt", "currency", F.when(F.col("clearing") != F.col("account_ref"), F.col("clearing")).alias("clearing")))
    fates = cut(ladder.walk(pool, window))
    method = lambda a, b: F.coalesce(a, b, F.lit("BANK_TRANSFER"))
    of = lambda x: F.when(F.trim(x) != "", x)
    by_hand = live.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), of(F.col("_ra")).alias("receipt"), of(F.col("_rb")).alias("other_receipt"), F.lit("MANUAL").alias("confidence"), F.lit(0).alias("_phase"), F.lit(None).cast("date").alias("at"), F.col("n"), F.when(F.col("_ma") < 0, method(F.col("_la"), F.col("_lb"))).otherwise(method(F.col("_lb"), F.col("_la"))).alias("method"))
    walked = fates.where(F.col("other_n").isNotNull()).join(face("a").withColumnRenamed("a", "from_id"), "from_id").join(face("b").withColumnRenamed("b", "to_id"), "to_id")
    walked = walked.select("from_id", "to_id", F.col("receipt"), F.when(F.col("tier") == "T1", F.col("receipt")).otherwise(F.col("other_receipt")).alias("other_receipt"), F.when(F.col("tier") == "T1", "EXACT").otherwise("HIGH").alias("confidence"), F.lit(1).alias("_phase"), "at", "n", F.when(F.col("_ma") < 0, method(F.col("_la"), F.col("_lb"))).otherwise(method(F.col("_lb"), F.col("_la"))).alias("method"))
    pairs = ladder.named(by_hand.unionByName(walked), ["_phase", "at", "n"]).select("transfer_id", F.col("from_id").alias("from_leg"), F.col("to_id").alias("to_leg"), "confidence", "method", F.lit(None).cast("string").alias("clearing"))
    to_clear = fates.where(F.col("fate") == ladder.CLEARING).select(F.col("from_id").alias("external_id"), F.col("to_id").alias("given")).join(rows, "external_id")
    sided = direct.select("external_id", "given", "amount", "rail").unionByName(to_clear.select("external_id", "given", "amount", "rail"))
    pays = F.col("amount") < 0
    sided = sided.select(transfer_id(F.col("external_id"), F.col("given")).alias("transfer_id"), F.when(pays, F.col("external_id")).otherwise(F.col("given")).alias("from_leg"), F.when(pays, F.col("given")).otherwise(F.col("external_id")).alias("to_leg"), F.lit("EXACT").alias("confidence"), method(F.col("rail"), F.lit(None)).alias("method"), F.col("given").alias("clearing"))
    transfers = cut(pairs.unionByName(sided))
    met = transfers.select("transfer_id", F.explode(F.array_distinct(F.filter(F.array("from_leg", "to_leg"), lambda x: ~x.eqNullSafe(F.col("clearing"))))).alias("external_id"))
    held = pool.select("external_id", F.lit("HELD").alias("_held"))
    states = rows.select("external_id").join(met, "external_id", "left").join(held, "external_id", "left")
    states = states.select("external_id", "transfer_id", F.when(F.col("transfer_id").isNotNull(), "MATCHED").otherwise(F.coalesce("_held", F.lit("EXTERNAL"))).alias("leg"))
    return transfers, states, fates.where(F.col("fate") == ladder.HELD).select(F.col("from_id").alias("external_id"), "candidates")


def categories(rows: DataFrame, decisions: DataFrame, ids: DataFrame, declared: list[str], rule: Column) -> tuple[DataFrame, DataFrame]:
    """Rows (with leg) and their category and its origin, and the pins (decision_n) that could not apply to all their ids.

    A matched leg is structural; then the last pin or its lifting; then the first rule (``rule``, null if none); else uncategorized.
    """
    acts = decisions.where(F.col("action").isin("PIN", "UNPIN")).join(ids.select(F.col("id").alias("id1"), F.col("current_id").alias("external_id")), "id1", "left")
    acts = acts.join(rows.select("external_id", (F.col("leg") == "MATCHED").alias("_m")), "external_id", "left")
    bad = F.col("external_id").isNull() | ((F.col("action") == "PIN") & (~F.col("ref").isin(*declared) | F.col("ref").isin("TRANSFER", "UNCATEGORIZED") | F.coalesce("_m", F.lit(False))))
    acts = cut(acts.select("n", "action", "ref", "external_id", bad.alias("bad")))
    last = acts.where(~F.col("bad")).groupBy("external_id").agg(F.max_by(F.struct("action", "ref"), "n").alias("d"))
    pin = F.when(F.col("d.action") == "PIN", F.col("d.ref"))
    out = rows.join(last, "external_id", "left").withColumn("_rule", rule)
    matched = F.col("leg") == "MATCHED"
    out = out.withColumn("category", F.when(matched, "TRANSFER").otherwise(F.coalesce(pin, "_rule", F.lit("UNCATEGORIZED")))).withColumn("origin", F.when(matched, "STRUCTURAL").when(pin.isNotNull(), "PIN").when(F.col("_rule").isNotNull(), "RULE").otherwise("NONE"))
    return out.drop("d", "_rule"), acts.where("bad").select(F.col("n").alias("decision_n")).distinct()


def pins(decisions: DataFrame, ids: DataFrame) -> DataFrame:
    """The last pin of each current id that no later decision lifted."""
    return latest_by_id(decisions, ["PIN", "UNPIN"], ids).where(F.col("action") == "PIN").select("external_id", F.col("ref").alias("category"), F.col("n").alias("decision_n"), "user_id")


def notes(decisions: DataFrame, ids: DataFrame) -> DataFrame:
    """Every note on a known id."""
    rows = decisions.where(F.col("action") == "NOTE").join(ids.select(F.col("id").alias("id1"), F.col("current_id").alias("external_id")), "id1")
    return rows.select("external_id", F.col("ref").alias("text"), F.col("n").alias("decision_n"), "user_id")


def acks(decisions: DataFrame, ids: DataFrame) -> DataFrame:
    """The last acknowledgement of each user and row that wasn't taken back; unknown ids stand for themselves."""
    rows = decisions.where(F.col("action").isin("USER_ACK", "USER_UNACK")).join(ids.select(F.col("id").alias("id1"), "current_id"), "id1", "left").withColumn("external_id", F.coalesce("current_id", "id1"))
    last = rows.groupBy("user_id", "external_id").agg(F.max_by(F.struct("n", "action", "ref"), "n").alias("d"))
    return last.where(F.col("d.action") == "USER_ACK").select("user_id", "external_id", F.col("d.ref").alias("state_hash"), F.col("d.n").alias("decision_n"))


def hashed(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows with the hash of all that a person who has read one would want to read again."""
    own = rows.join(F.broadcast(accounts.select(F.col("ref").alias("account_ref"), "currency")), "account_ref", "left")
    fields = [F.col("external_id"), F.upper("role"), F.col("rail"), F.col("leg"), F.col("account_ref"), F.col("date"), F.col("amount"), F.col("currency"), F.col("category"), F.col("origin"), F.col("transfer_id")]
    return own.withColumn("state_hash", state_hash(*fields))


def pending(latest: DataFrame, current: DataFrame, decisions: DataFrame, ids: DataFrame, accounts: DataFrame, tolerance: int = 0, overlap: float = 0.5) -> DataFrame:
    """(external_id, state, settled_by, candidates) of the ids whose newest observation is pending.

    A person's settlement with a current row comes first; then the only candidate: a current row of the account, of like text, of the same sign
    or zero and an amount within the tolerance, not before it and within the account's window.  Several candidates leave it open; none
    makes it stale once the account has rows beyond the window.  Days are dealt to stretches of a window's length, so a row meets its own and the next.
    """
    acct = F.broadcast(accounts.select(F.col("ref").alias("account_ref"), "window_days"))
    words = lambda df: df.withColumn("_t", tokens(F.col("raw_description")))
    days = F.datediff("date", F.lit("1970-01-01").cast("date"))
    width = F.greatest(F.lit(1).cast("bigint"), F.col("window_days"))
    open_ = words(latest.where(F.col("observation") == "pending").join(acct, "account_ref")).select("external_id", "account_ref", "date", "amount", "_t", "window_days", F.floor(days / width).alias("_s"))
    open_ = cut(open_)
    rows = words(current.join(acct, "account_ref")).select(F.col("external_id").alias("by"), "account_ref", F.col("date").alias("_d"), F.col("amount").alias("_amt"), F.col("_t").alias("_w"), F.floor(days / width).alias("_s"))
    met = open_.withColumn("_s", F.explode(F.array("_s", F.col("_s") + 1))).join(rows, ["account_ref", "_s"])
    gap = F.datediff("_d", "date")
    met = met.where(gap.between(0, F.col("window_days")) & ~(F.col("amount") * F.col("_amt") < 0) & (F.abs(F.col("amount") - F.col("_amt")) <= tolerance) & similar(F.col("_t"), F.col("_w"), overlap))
    found = met.groupBy("external_id").agg(F.array_sort(F.collect_list("by")).alias("_by"))
    at = ids.select(F.col("id"), F.col("current_id"))
    forced = decisions.where(F.col("action") == "SETTLE").join(at.select(F.col("id").alias("id1"), F.col("current_id").alias("external_id")), "id1").join(at.select(F.col("id").alias("id2"), F.col("current_id").alias("_q")), "id2")
    forced = forced.groupBy("external_id").agg(F.max_by("_q", "n").alias("_q")).join(current.select(F.col("external_id").alias("_q")), "_q", "left_semi")
    front = current.groupBy("account_ref").agg(F.max("date").alias("_front"))
    n = F.coalesce(F.size("_by"), F.lit(0))
    out = open_.join(found, "external_id", "left").join(forced, "external_id", "left").join(front, "account_ref", "left").withColumn("_n", F.when(F.col("_by").isNull(), 0).otherwise(n))
    state = F.when(F.col("_q").isNotNull() | (F.col("_n") == 1), "SETTLED").when(F.col("_n") > 1, "OPEN").when(F.datediff("_front", "date") > F.col("window_days"), "STALE").otherwise("OPEN")
    by = F.coalesce("_q", F.when(F.col("_n") == 1, F.element_at("_by", 1)))
    return out.select("external_id", state.alias("state"), by.alias("settled_by"), F.when(F.col("_q").isNull() & (F.col("_n") > 1), F.array_join("_by", ",")).alias("candidates"))


def clearing_legs(transfers: DataFrame, rows: DataFrame, accounts: DataFrame, closed: DataFrame) -> DataFrame:
    """The account side of every transfer that has one, with its account's running balance.

    A clearing account ends on its declared balance, a closed one on its closing; a declared wallet runs with its own rows between
    its counts (rows of amount 0), which set the balance; before the first count it is counted back from it.  A closing without any leg is a leg itself.
    """
    real = rows.select("external_id", "date", "n", "amount", "raw_description")
    sides = transfers.where(F.col("clearing").isNotNull()).withColumn("external_id", F.when(F.col("clearing") == F.col("from_leg"), F.col("to_leg")).otherwise(F.col("from_leg"))).join(real, "external_id")
    sides = cut(sides.select("transfer_id", F.col("clearing").alias("account_ref"), "external_id", "date", "n", (-F.col("amount")).alias("amount"), "raw_description"))
    shut = F.broadcast(closed.where(F.col("reason").isNull()).select("account_ref", F.col("closing").alias("_closing"), F.col("adjustment").alias("_adj"), "closed_at", "decision_n"))
    kinds = F.broadcast(accounts.select(F.col("ref").alias("account_ref"), "source", F.col("closing").alias("_end")))
    order = Window.partitionBy("account_ref").orderBy("date", "n")
    up_to, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("account_ref")
    plain = sides.join(kinds, "account_ref").where(F.col("source") != "declared").join(shut.select("account_ref", "_closing", "_adj"), "account_ref", "left")
    opening = F.when(F.col("source") == "clearing", F.coalesce("_end", F.lit(0)) - F.sum("amount").over(whole)).otherwise(F.col("_closing") - F.col("_adj"))
    plain = plain.withColumn("balance", opening + F.sum("amount").over(up_to)).withColumn("_name", F.when(F.col("_closing").isNotNull(), "cls").otherwise("clr"))
    wallet = sides.join(kinds.where(F.col("source") == "declared").select("account_ref"), "account_ref", "left_semi").select("account_ref", "date", "n", F.lit(1).alias("_o"), "amount", F.lit(None).cast("bigint").alias("_snap"), "transfer_id")
    own = rows.where(F.col("role") != "noop").join(kinds.where(F.col("source") == "declared").select("account_ref"), "account_ref", "left_semi")
    points = wallet.unionByName(own.select("account_ref", "date", "n", F.lit(0).alias("_o"), "amount", F.when(F.col("amount") == 0, F.col("balance")).cast("bigint").alias("_snap"), F.lit(None).cast("string").alias("transfer_id")))
    so_far = Window.partitionBy("account_ref").orderBy("date", "n", "_o").rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumn("_seg", F.count("_snap").over(so_far))
    part = Window.partitionBy("account_ref", "_seg")
    running = F.sum("amount").over(part.orderBy("date", "n", "_o").rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(F.when(F.col("_snap").isNotNull(), F.struct("date", "n", "_snap"))).over(whole)["_snap"]
    points = points.withColumn("balance", F.when(F.col("_seg") > 0, F.max("_snap").over(part) + running).otherwise(F.coalesce(first - F.sum("amount").over(part), F.lit(0)) + running))
    in_wallet = sides.join(points.where(F.col("transfer_id").isNotNull()).select("transfer_id", "balance"), "transfer_id").withColumn("_name", F.lit("clr"))
    legs = plain.select(*sides.columns, "balance", "_name").unionByName(in_wallet)
    legs = legs.select("transfer_id", F.concat_ws("|", "_name", "account_ref", "external_id").alias("leg_id"), "account_ref", "date", "amount", F.col("balance").cast("bigint").alias("balance"))
    off = shut.join(sides.select("account_ref"), "account_ref", "left_anti").where(F.col("_adj") != 0)
    return legs.unionByName(off.select(F.lit(None).cast("string").alias("transfer_id"), F.concat_ws("|", F.lit("cls"), "account_ref", F.col("closed_at").cast("string")).alias("leg_id"), "account_ref", F.col("closed_at").alias("date"), F.col("_adj").cast("bigint").alias("amount"), F.col("_closing").cast("bigint").alias("balance")))


def cash_months(transfers: DataFrame, rows: DataFrame, accounts: DataFrame, as_of: str) -> DataFrame:
    """Each declared wallet's months, from its first movement to the month of ``as_of``: what came from and went to banks, what was recorded,
    what the counts before and at the month's end hold, and what nobody recorded."""
    wallets = F.broadcast(accounts.where(F.col("source") == "declared").select(F.col("ref").alias("account_ref")))
    own = rows.where(F.col("role") != "noop").join(wallets, "account_ref", "left_semi").select("account_ref", "date", "n", "amount", "balance")
    real = rows.select("external_id", "date", "amount")
    legs = transfers.withColumn("external_id", F.when(F.col("clearing") == F.col("from_leg"), F.col("to_leg")).otherwise(F.col("from_leg"))).join(wallets.select(F.col("account_ref").alias("clearing")), "clearing", "left_semi").join(real, "external_id").select(F.col("clearing").alias("account_ref"), "date", (-F.col("amount")).alias("_leg"))
    moves = own.where(F.col("amount") != 0).select("account_ref", "date", F.col("amount").alias("_own"), F.lit(0).cast("bigint").alias("_leg")).unionByName(legs.select("account_ref", "date", F.lit(0).cast("bigint").alias("_own"), "_leg"))
    positive = lambda c: F.coalesce(F.sum(F.when(c > 0, c)), F.lit(0)).cast("bigint")
    month = F.trunc("date", "month")
    sums = moves.groupBy("account_ref", month.alias("_m")).agg(positive(F.col("_leg")).alias("in_from_bank"), positive(-F.col("_leg")).alias("out_to_bank"), positive(-F.col("_own")).alias("recorded_out"), positive(F.col("_own")).alias("recorded_in"))
    now = F.trunc(F.lit(as_of).cast("date"), "month")
    calendar = moves.groupBy("account_ref").agg(F.min(month).alias("_a")).where(F.col("_a") <= now).withColumn("_m", F.explode(F.sequence("_a", now, F.expr("interval 1 month")))).drop("_a")
    counts = own.where(F.col("amount") == 0).groupBy("account_ref", month.alias("_m")).agg(F.max_by("balance", F.struct("date", "n")).alias("_held"))
    # A count holds until the next one: months and counts in one line, the last count filled forward.
    line = calendar.withColumn("_is", F.lit(True)).join(counts, ["account_ref", "_m"], "full")
    order = Window.partitionBy("account_ref").orderBy("_m")
    close = F.last("_held", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("_held", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    line = line.withColumn("held_open", before.cast("bigint")).withColumn("held_close", close.cast("bigint")).where("_is").join(sums, ["account_ref", "_m"], "left").na.fill(0, ["in_from_bank", "out_to_bank", "recorded_out", "recorded_in"])
    delta = F.coalesce(F.col("held_close") - F.col("held_open"), F.lit(0))
    unrecorded = F.col("in_from_bank") - F.col("out_to_bank") - F.col("recorded_out") + F.col("recorded_in") - delta
    return line.select("account_ref", F.date_format("_m", "yyyy-MM").alias("month"), "in_from_bank", "out_to_bank", "recorded_out", "recorded_in", "held_open", "held_close", delta.cast("bigint").alias("held_delta"), unrecorded.cast("bigint").alias("unrecorded"), (F.col("_m") == now).alias("open"))


def units(transfers: DataFrame, rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """What can be posted elsewhere: one unit a transfer, and one for each unpaired posting that isn't a wallet's count."""
    own = rows.join(F.broadcast(accounts.select(F.col("ref").alias("account_ref"), "currency", "source")), "account_ref")
    leg = own.select(F.col("external_id").alias("_id"), "account_ref", "date", "amount", "currency")
    carrier = F.when(F.col("clearing") == F.col("from_leg"), F.col("to_leg")).otherwise(F.col("from_leg"))
    other = F.when(F.col("clearing").isNull(), F.col("to_leg"))
    moved = transfers.withColumn("_id", carrier).withColumn("_other", other).join(leg, "_id").join(rows.select(F.col("external_id").alias("_other"), F.lit(True).alias("_there")), "_other", "left")
    moved = moved.where(F.col("_other").isNull() | F.col("_there"))
    moved = moved.select(F.col("transfer_id").alias("unit_id"), F.lit("TRANSFER").alias("kind"), "account_ref", "date", F.abs("amount").alias("amount"), "currency", F.lit("TRANSFER").alias("category"))
    posted = own.where((F.col("role") != "noop") & (F.col("leg") == "EXTERNAL") & ~((F.col("source") == "declared") & (F.col("amount") == 0)))
    return moved.unionByName(posted.select(F.col("external_id").alias("unit_id"), F.lit("EXTERNAL").alias("kind"), "account_ref", "date", "amount", "currency", "category"))


def stemmed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("stem", stem(F.col("raw_description")))
