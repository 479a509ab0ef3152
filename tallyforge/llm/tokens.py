"""Token counts by a map-side two-tier lookup, with no shuffle of pre-tokens.

A byte-level BPE merges inside pre-tokens only, so a text has as many tokens as its pre-tokens together.

Tier 1 is a compact hash table of frequent pre-tokens' lengths, broadcast once.  The vocabulary names them: a BPE
vocabulary is a list of byte strings by falling frequency, so those of its entries that are whole pre-tokens are the
frequent ones.  The table is bounded by the vocabulary (at most ``FREQUENT`` entries), whatever the corpus's size; a
caller may add pre-tokens of its own corpus.  Tier 2 is a cache in each Python worker, of at most ``CACHE`` misses of at most
``CACHE_CHARS`` characters; what neither holds is encoded by the library and then kept there.

The byte-level pre-token pattern is cut by ``re`` with character classes written out over the characters ``SURE``, whose
categories have been the same in every Unicode version in use; any other character sends the whole text to the library.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings are single tokens, as the library's
default is; long texts are counted whole; rows are counted each on its own.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.llm import kernels as K
from tallyforge.llm.common import annotate

FREQUENT = 65_536
CACHE, CACHE_CHARS = 500_000, 64
#: Latin, Greek, punctuation, currency, kana, Han and Hangul characters that every Unicode table classes alike.
SURE = r"\x00-\x1b\x20-\x84\x86-\u0377\u1f00-\u1f15\u2000-\u2017\u202a-\u202f\u20a0-\u20b0\u2100-\u2138\u3041-\u3094\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3\u2018-\u2027"
SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNSURE = re.compile(f"[^{SURE}]")
_state: dict = {}


def _class(kind: str) -> str:
    """The sure characters of a general category, as ranges for a character class."""
    marks = [0, *((UNSURE.match(chr(c)) is None and unicodedata.category(chr(c))[0] == kind) for c in range(0x10000)), 0]
    edges = np.flatnonzero(np.diff(np.array(marks, np.int8)))
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in edges.reshape(-1, 2).tolist())


@functools.cache
def pre_tokens() -> re.Pattern:
    """Fixed pattern of byte-level BPE: contractions, words, numbers, other signs (each with a space before), white space."""
    letters, numbers = _class("L"), _class("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def load(path: str):
    """The tokenizer of a file, once a worker."""
    if _state.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _state.clear()
        _state.update(path=path, tokenizer=Tokenizer.from_file(path), cache={})
    return _state["tokenizer"]


def frequent_lengths(path: str, more: list[str] = (), limit: int = FREQUENT) -> dict[str, int]:
    """Tier 1: tokens of each vocabulary entry that is a whole pre-token, most frequent first, and of ``more``."""
    tokenizer, cut = load(path), pre_tokens()
    by_rank = sorted(tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
    texts = [*more, *(tokenizer.decoder.decode([t]) for t, _ in by_rank)][:limit]
    whole = [t for t in dict.fromkeys(texts) if len(t) <= CACHE_CHARS and not UNSURE.search(t) and cut.findall(t) == [t]]
    return dict(zip(whole, (len(e.ids) for e in tokenizer.encode_batch(whole, add_special_tokens=False)), strict=True))


class Tiers(dict):
    """Lengths of pre-tokens: tier 1 first, then what this worker has met.  A miss counts 0 and is noted."""

    def __init__(self, frequent: dict[str, int]):
        super().__init__(frequent)
        self.missed: list[str] = []

    def __missing__(self, key: str) -> int:
        self.missed.append(key)
        return 0


class Counter:
    """Counts the tokens of texts; its worker keeps the second tier from task to task."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.tokenizer, self.frequent, self.cut = load(path), frequent, pre_tokens()
        specials = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.split = re.compile("|".join(map(re.escape, specials))) if specials else None

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; pre-tokens that both tiers miss are encoded once for all of these texts."""
        if len(_state.get("tiers", ())) > CACHE + len(self.frequent) or "tiers" not in _state:
            _state["tiers"] = Tiers(self.frequent)
        tiers, total, missed = _state["tiers"], np.zeros(len(texts), np.int64), {}
        for i, text in enumerate(texts):
            if UNSURE.search(text):
                total[i] = self.encode([text])[0]
                continue
            parts = self.split.split(text) if self.split is not None and self.split.search(text) else [text]
            total[i] = len(parts) - 1 + sum(sum(map(tiers.__getitem__, self.cut.findall(part))) for part in parts)
            if tiers.missed:
                missed[i], tiers.missed = tiers.missed, []
        new = list(set().union(*missed.values()))
        found = dict(zip(new, self.encode(new), strict=True)) if new else {}
        for i, own in missed.items():
            total[i] += sum(map(found.__getitem__, own))
        tiers.update((k, v) for k, v in found.items() if len(k) <= CACHE_CHARS)
        return total


def count_tokens(docs: DataFrame, path: str, more: list[str] = (), keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes and n_tokens of each whole text, by the byte-level BPE tokenizer file at ``path``."""
    tier1 = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path, list(more)))

    def compute(column: pa.Array) -> list[pa.Array]:
        counter, out = Counter(path, tier1.value), []
        for row, to, _, _ in K.chunks(column):
            out.append(counter.count([x or "" for x in column.slice(row, to - row).to_pylist()]))
        _, offsets = K.buffers(column)
        return [pa.array(np.diff(offsets)), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))]

    return annotate(docs, compute, "n_bytes bigint, n_tokens bigint", keep, text)
