"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four patterns with checks (e-mail, IPv4, card number with Luhn's sum, phone number).  The field
adds spans that the patterns miss: its nodes are a text's *units* (runs of non-white-space with a digit or ``@``), each
with features of its form, its neighbours and the base span over it.  Neighbouring units are joined by chain edges;
units that repeat or are similar (same letters and digits, or the same last seven digits) are joined, each to its next
occurrence, by skip edges, so a text has fewer edges than twice its units.  Loopy sum-product messages run over both until
they settle, which carries a label from a clear place (a number after "phone") to its unclear repeats, however many, as far as
the potentials allow.  Node, chain and skip
potentials are trained by stochastic gradient steps on texts with known labels that a seeded generator writes.

Base spans always stay; an added span never overlaps one.

Defined results: a null text is empty; an empty text has no spans; equal texts get equal spans; very long runs without
white space are one unit; spans are in code points, end exclusive.
"""

from __future__ import annotations

import collections
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.llm import kernels as K
from tallyforge.llm.common import annotate

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
LABELS = ("", *KINDS)
#: Messages run until none moves by SETTLED, for at most ROUNDS rounds and as many more for each edge of the longest skip chain.
ROUNDS, DAMPING, SETTLED = 8, 0.3, 1e-4
FIELDS = "spans array<struct<kind:string,start:int,stop:int,base:boolean>>"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# A match ends where its digits end, so it can only begin where digits begin: the look-behind skips no match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_UNIT = re.compile(r"[^\x20\x09-\x0D]+")
_HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
_MARKED = np.zeros(256, bool)
_MARKED[48:58] = _MARKED[64] = True
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outward, so a long run without one costs nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        # What lies before this sign can't be part of a later match.
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Checked matches as (start, end, kind), by start and then kind as listed."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


#: Words that announce a kind.
CUES = {
    "email": {"email", "mail", "contact", "e"},
    "ip": {"ip", "host", "server", "addr", "address"},
    "card": {"card", "visa", "mastercard", "cc"},
    "phone": {"phone", "tel", "telephone", "mobile", "call", "fax", "cell"},
    "secret": {"token", "key", "secret", "password", "passwd", "pwd", "apikey", "bearer", "api_key"},
}
_FORMS = 22


def form(unit: str, before: str, covered: int) -> np.ndarray:
    """A unit's features: its own form, the word before it, and the base label over it."""
    digits = sum(c in "0123456789" for c in unit)
    letters = sum(c.isalpha() for c in unit)
    core = unit.strip("\"'`.,;:()[]{}<>&%$#*!?")
    cue = before.lower().strip("\"'`.,;:()[]{}<>&%$#*!?=")
    f = np.zeros(_FORMS + len(LABELS) + len(KINDS), np.float64)
    f[[0, 1 + min(6, digits // 3)]] = 1
    f[8] = "@" in unit
    f[9] = digits > 0.7 * len(core) > 0
    f[10] = unit.count(".") >= 3 and letters == 0
    f[11] = unit[:1] in "+("
    f[12] = bool(_HEX.search(unit)) and letters > 2
    f[13] = len(core) >= 20 and digits > 2 and letters > 2
    f[14] = unit[:1] in "\"'"
    f[15] = "-" in core and letters == 0
    f[16] = 0 < letters <= len(core) and digits < 4
    f[17] = before[-1:] in ("=", ":")
    f[18] = digits == 4 and letters == 0
    f[19] = len(core) >= 8 and digits > 1 and letters > 1
    f[20] = 7 <= digits <= 12 and letters == 0
    f[21] = "." in core and digits < 5 and letters == 0
    f[_FORMS + covered] = 1
    for i, k in enumerate(KINDS):
        f[_FORMS + len(LABELS) + i] = cue in CUES[k]
    return f


def key(unit: str) -> str:
    """Units with equal keys are taken for similar."""
    digits = re.sub("[^0-9]", "", unit)
    if len(digits) >= 7 and not any(c.isalpha() for c in unit):
        return digits[-7:]
    return re.sub(r"[^\w@]", "", unit).lower()


class Graph:
    """Units of one text, their features and edges (a, b, 0 chain or 1 skip)."""

    def __init__(self, text: str, base: list[tuple[int, int, str]]):
        self.units: list[tuple[int, int]] = []
        self.features, last, edges, order = [], {}, [], []
        repeats: collections.Counter[str] = collections.Counter()
        previous, place = "", 0
        b = 0
        for m in _UNIT.finditer(text):
            word = m.group()
            place += 1
            if any(c in "0123456789@" for c in word):
                while b < len(base) and base[b][1] <= m.start():
                    b += 1
                covered = LABELS.index(base[b][2]) if b < len(base) and base[b][0] < m.end() else 0
                i = len(self.units)
                self.units.append(m.span())
                self.features.append(form(word, previous, covered))
                if order and place - order[-1] <= 1:
                    edges.append((i - 1, i, 0))
                order.append(place)
                if len(k := key(word)) >= 4:
                    if k in last and last[k] != i:
                        edges.append((last[k], i, 1))
                        repeats[k] += 1
                    last[k] = i
            previous = word
        self.edges = np.array(edges, np.int64).reshape(-1, 3)
        self.rounds = ROUNDS * (1 + max(repeats.values(), default=0))
        self.matrix = np.array(self.features).reshape(len(self.units), _FORMS + len(LABELS) + len(KINDS))


def marginals(graph: Graph, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Node marginals, and pair marginals of the edges, by loopy sum-product messages in log space."""
    node = graph.matrix @ model["node"]
    if not len(graph.edges):
        return _normal(node), np.zeros((0, len(LABELS), len(LABELS)))
    a, b, kind = graph.edges.T
    pair = model["pair"][kind]
    there, back = np.zeros((len(a), len(LABELS))), np.zeros((len(a), len(LABELS)))
    for _ in range(graph.rounds):
        before = there, back
        belief = node.copy()
        np.add.at(belief, b, there)
        np.add.at(belief, a, back)
        new = _log_sum((belief[a] - back)[:, :, None] + pair, 1)
        old = _log_sum((belief[b] - there)[:, None, :] + pair, 2)
        there = DAMPING * there + (1 - DAMPING) * (new - new.max(1, keepdims=True))
        back = DAMPING * back + (1 - DAMPING) * (old - old.max(1, keepdims=True))
        if max(np.abs(there - before[0]).max(), np.abs(back - before[1]).max()) < SETTLED:
            break
    belief = node.copy()
    np.add.at(belief, b, there)
    np.add.at(belief, a, back)
    both = (belief[a] - back)[:, :, None] + (belief[b] - there)[:, None, :] + pair
    return _normal(belief), _normal(both.reshape(len(a), -1)).reshape(both.shape)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _normal(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def written(random: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """A generated training text and its labelled spans; some values come back later without their cue."""
    digits = lambda n: "".join(map(str, random.integers(0, 10, n)))
    pick = lambda *x: x[random.integers(0, len(x))]
    word = lambda: "".join(pick("th", "er", "on", "an", "re", "he", "in", "ou") for _ in range(random.integers(1, 4)))
    makers = {
        "phone": lambda: pick(f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"({digits(3)}){digits(3)}-{digits(4)}", f"+{digits(11)}"),
        "secret": lambda: "".join(pick(*"0123456789abcdef") for _ in range(random.integers(20, 40))),
        "email": lambda: f"{word()}{digits(2)}@{word()}.com",
        "ip": lambda: ".".join(str(random.integers(0, 256)) for _ in range(4)),
        "card": lambda: next(x for _ in iter(int, 1) if luhn(x := digits(16))),
    }
    plain = (lambda: digits(random.integers(1, 5)), lambda: f"{digits(1)}.{digits(1)}", lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}", lambda: f"{word()}{digits(1)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(2)},{digits(3)}", lambda: digits(9), lambda: digits(16))
    out, spans, length, said = [], [], 0, []

    def put(x: str, kind: str = "") -> None:
        nonlocal length
        if kind:
            spans.append((length, length + len(x), kind))
        out.append(x)
        length += len(x) + 1

    for _ in range(random.integers(3, 9)):
        for _ in range(random.integers(2, 7)):
            put(word())
        turn = random.random()
        if said and turn < 0.3:
            kind, value = said[random.integers(0, len(said))]
            put(value, kind)
        elif turn < 0.65:
            put(plain[random.integers(0, len(plain))]())
        else:
            kind = pick(*KINDS)
            if random.random() < 0.8:
                put(pick(*sorted(CUES[kind])) + pick("", ":", " ="))
            value = makers[kind]()
            said.append((kind, value))
            put(value, kind)
    return " ".join(out), spans


@functools.cache
def train(texts: int = 400, passes: int = 4, rate: float = 0.25, seed: int = 5) -> dict:
    """Potentials by gradient steps on the log-likelihood; expectations come from the loopy marginals."""
    random, size = np.random.default_rng(seed), len(LABELS)
    examples = []
    for _ in range(texts):
        text, spans = written(random)
        graph = Graph(text, base_spans(text))
        gold = np.array([next((LABELS.index(k) for a, b, k in spans if a < stop and start < b), 0) for start, stop in graph.units], np.int64)
        if len(gold):
            examples.append((graph, gold))
    width = examples[0][0].matrix.shape[1]
    model = {"node": np.zeros((width, size)), "pair": np.zeros((2, size, size))}
    for step in range(passes * len(examples)):
        graph, gold = examples[step % len(examples)]
        now = rate * (1 - 0.8 * step / (passes * len(examples)))
        alone, both = marginals(graph, model)
        model["node"] += now * (graph.matrix.T @ (np.eye(size)[gold] - alone) - 1e-3 * model["node"])
        for e, (a, b, kind) in enumerate(graph.edges.tolist()):
            model["pair"][kind] -= now * both[e]
            model["pair"][kind, gold[a], gold[b]] += now
    return model


def added_spans(text: str, base: list[tuple[int, int, str]], model: dict, least: float = 0.6) -> list[tuple[int, int, str]]:
    """Units that the field labels and no base span touches, without the signs at their ends."""
    graph = Graph(text, base)
    if not graph.units:
        return []
    alone, _ = marginals(graph, model)
    best, out, b = alone.argmax(1), [], 0
    for (start, stop), label, p in zip(graph.units, best.tolist(), alone.max(1).tolist(), strict=True):
        while b < len(base) and base[b][1] <= start:
            b += 1
        if not label or p < least or (b < len(base) and base[b][0] < stop):
            continue
        word = text[start:stop]
        core = word.strip("\"'`.,;:[]{}<>&%$#*!?=")
        if core:
            at = start + word.index(core)
            out.append((at, at + len(core), LABELS[label]))
    return out


def find_personal(docs: DataFrame, keep: list[str] | None = None, text: str = "text", **options) -> DataFrame:
    """``docs`` with all spans of personal data in each whole text: kind, place in code points, and whether a pattern found it."""
    model = train(**options)

    def compute(column: pa.Array) -> list[pa.Array]:
        found: list[list[dict]] = [[] for _ in range(len(column))]
        for row, _, data, offsets in K.chunks(column):
            marked = np.concatenate([[0], np.cumsum(_MARKED[data])])
            for d in np.flatnonzero(np.diff(marked[offsets])).tolist():
                whole = column[row + d].as_py()
                base = base_spans(whole)
                spans = [(*s, True) for s in base] + [(*s, False) for s in added_spans(whole, base, model)]
                found[row + d] = [{"kind": k, "start": a, "stop": b, "base": is_base} for a, b, k, is_base in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())])
        return [pa.array(found, pa.list_(kind))]

    return annotate(docs, compute, FIELDS, keep, text)
