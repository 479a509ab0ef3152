"""License scans by template markup: templates compiled into token automata.

A template is a text with two kinds of marked regions: ``<<beginOptional>> … <<endOptional>>`` may be missing, and
``<<var;max=k>>`` stands for 0 to k arbitrary words.  All other words are mandatory and have to stand exactly as
written.  Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, in templates too, so case, layout and punctuation
don't count.  Each template becomes a nondeterministic automaton over words; a text is scanned from every word that can begin a
template, and the longest accepted run from each start is a match.  A match that has all of a text's words *accepts* the text: it is
that licence and nothing else.  As mandatory words can't be missing, only texts that hold a template's
``anchor`` (its longest mandatory word) are run through the automata; that skips no match.

Templates are whole licence texts, headers, notices and tags (``license_texts``); any others may be given.

Defined results: a null text is empty; an empty text has no words and no match; repeated rows are scanned each on its
own; a phrase that stands several times matches at each place.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.llm import kernels as K
from tallyforge.llm import license_texts
from tallyforge.llm.common import annotate

#: Phrases without regions, which are the contract's base, by label.
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
ALL = BASE | license_texts.NOTICES | license_texts.TEXTS | license_texts.TAGS
#: Mandatory words that make a match certain (score 1).
STRONG = 8
FIELDS = "n_words bigint, matches array<struct<label:string,start:int,stop:int,mandatory:int,accepts:boolean>>"
_MARK = re.compile(r"<<beginOptional>>|<<endOptional>>|<<var;max=(\d+)>>|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """States are numbers; ``step[state]`` has the next state by word, ``skip[state]`` those reached without a word."""

    def __init__(self, label: str, markup: str):
        self.label, self.step, self.skip, self.anything = label, [{}], [[]], {}
        mandatory, opened, at = [], [], 0
        for m in _MARK.finditer(re.sub("[A-Z]+", lambda x: x.group().lower(), markup).replace("beginoptional", "beginOptional").replace("endoptional", "endOptional")):
            token = m.group()
            if token == "<<beginOptional>>":
                opened.append(at := self._skip_to(at))
            elif token == "<<endOptional>>":
                at = self._skip_to(at)
                self.skip[opened.pop()].append(at)
            elif m.group(1):
                over = self._new()
                for _ in range(int(m.group(1))):
                    self.skip[at].append(over)
                    self.anything[at] = at = self._new()
                self.skip[at].append(over)
                at = over
            else:
                self.step[at][token.encode()] = to = self._new()
                at = to
                if not opened:
                    mandatory.append(token.encode())
        if opened or not mandatory:
            raise ValueError(f"template {label}: unbalanced regions or no mandatory word")
        self.final, self.mandatory, self.anchor = at, len(mandatory), max(mandatory, key=len)
        self.closed = [self._closure(s) for s in range(len(self.step))]
        if any(s in self.anything for s in self.closed[0]):
            raise ValueError(f"template {label}: a replaceable region can't come first")
        self.first = {w for s in self.closed[0] for w in self.step[s]}

    def _new(self) -> int:
        self.step.append({})
        self.skip.append([])
        return len(self.step) - 1

    def _skip_to(self, at: int) -> int:
        to = self._new()
        self.skip[at].append(to)
        return to

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for to in self.skip[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def longest(self, words: list[bytes], start: int) -> int:
        """The end of the longest accepted run of words from ``start``; -1 if there is none."""
        now, end = self.closed[0], -1
        for i in range(start, len(words)):
            then: set[int] = set()
            for s in now:
                if (to := self.step[s].get(words[i])) is not None:
                    then |= self.closed[to]
                if s in self.anything:
                    then |= self.closed[self.anything[s]]
            if not then:
                break
            if self.final in then:
                end = i + 1
            now = then
        return end


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.automata = [Automaton(k, v) for k, v in templates.items()]
        anchors = sorted({a.anchor for a in self.automata})
        raw = np.frombuffer(b" ".join(anchors), np.uint8)
        starts, ends, _ = K.runs(K.WORD[raw], np.array([0, len(raw)]))
        self.anchors = np.unique(K.span_hashes(raw, starts, ends))

    def matches(self, words: list[bytes]) -> list[dict]:
        out, there = [], set(words)
        live = [a for a in self.automata if a.anchor in there]
        first = set().union(*(a.first for a in live))
        last: dict[str, int] = {}
        for i, w in enumerate(words):
            for a in live if w in first else ():
                # A run that ends inside an earlier one of the same label only lacks its optional beginning.
                if w in a.first and (end := a.longest(words, i)) > last.get(a.label, 0):
                    last[a.label] = end
                    out.append({"label": a.label, "start": i, "stop": end, "mandatory": a.mandatory, "accepts": i == 0 and end == len(words)})
        return out

    def scan(self, column: pa.Array) -> list[pa.Array]:
        counts, found = [], [[] for _ in range(len(column))]
        for row, _, data, offsets in K.chunks(column):
            low, starts, ends, first = K.words_of(data, offsets)
            counts.append(np.diff(first))
            at = np.flatnonzero(np.isin(K.span_hashes(low, starts, ends), self.anchors))
            for d in np.unique(np.searchsorted(first, at, "right") - 1).tolist():
                a, b = first[d], first[d + 1]
                found[row + d] = self.matches([low[s:e].tobytes() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)])
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("mandatory", pa.int32()), ("accepts", pa.bool_())]))
        return [pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64()), pa.array(found, kind)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with n_words and every match: label, word places, the template's number of mandatory words, and whether it accepts the whole text."""
    scanner = Scanner(ALL if templates is None else templates)
    return annotate(docs, scanner.scan, FIELDS, keep, text)
