"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams and one scan of training windows.

Texts are lower-cased (A-Z only) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  Benchmark items give
their windows of ``n`` words (a shorter, non-empty item is one window of all its words).  Every document window of a
length that occurs among them is hashed; a hash that is in the set is verified word by word, so no collision can make
a hit.  All words inside a verified window are hit.

The set is broadcast in blocks of at most ``block_windows`` windows: its size is bounded by that parameter, whatever
the benchmark's size; more blocks mean more scans, whose hits are united by document.

Defined results: a null text is empty; empty texts have no words and no hits; items that are null or have no words are
skipped; repeated items count each; repeated rows are judged each on its own; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm.common import annotate, numbered

N = 13
#: Windows in one broadcast block: about 0.2 kB each.
BLOCK_WINDOWS = 200_000
_SALT = 11
FIELDS = "n_words bigint, hit_words array<int>, hit_items array<string>, spans array<struct<start:int,stop:int>>"


class WindowSet:
    """Windows by length: sorted hashes for the scan, and each window's words with the items that hold it."""

    def __init__(self, windows: dict[bytes, set[str]]):
        self.items = {w: sorted(i) for w, i in windows.items()}
        self.hashes: dict[int, np.ndarray] = {}
        by_length: dict[int, list[bytes]] = {}
        for w in windows:
            by_length.setdefault(w.count(b" ") + 1, []).append(w)
        for n, group in by_length.items():
            raw = np.frombuffer(b" ".join(group), np.uint8)
            starts, ends, _ = K.runs(K.WORD[raw], np.array([0, len(raw)]))
            self.hashes[n] = np.unique(K.window_hashes(K.span_hashes(raw, starts, ends), n, _SALT)[::n])

    def scan(self, column: pa.Array) -> list[pa.Array]:
        counts: list[np.ndarray] = []
        rows: dict[int, tuple[list[int], set[str], list[dict]]] = {}
        for row, _, data, offsets in K.chunks(column):
            low, starts, ends, first = K.words_of(data, offsets)
            counts.append(np.diff(first))
            if not len(starts):
                continue
            words, last = K.span_hashes(low, starts, ends), np.repeat(first[1:], np.diff(first))
            hit = np.zeros(len(starts), bool)
            found: dict[int, set[str]] = {}
            for n, known in self.hashes.items():
                seen = K.window_hashes(words, n, _SALT)
                at = np.searchsorted(known, seen)
                at[at == len(known)] = 0
                at = np.flatnonzero((known[at] == seen) & (np.arange(len(seen)) + n <= last[: len(seen)]))
                for i in at.tolist():
                    key = b" ".join(low[s:e].tobytes() for s, e in zip(starts[i : i + n], ends[i : i + n], strict=True))
                    if key in self.items:
                        hit[i : i + n] = True
                        found.setdefault(int(np.searchsorted(first, i, "right")) - 1, set()).update(self.items[key])
            for d, items in found.items():
                inside = hit[first[d] : first[d + 1]]
                spans, stops, _ = K.runs(inside, np.array([0, len(inside)]))
                at = (starts[first[d] + spans] - offsets[d], ends[first[d] + stops - 1] - offsets[d])
                rows[row + d] = (np.flatnonzero(inside).tolist(), items, [{"start": int(a), "stop": int(b)} for a, b in zip(*at, strict=True)])
        n, none = len(column), ([], (), [])
        return [
            pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64()),
            pa.array([rows.get(i, none)[0] for i in range(n)], pa.list_(pa.int32())),
            pa.array([sorted(rows.get(i, none)[1]) for i in range(n)], pa.list_(pa.string())),
            pa.array([rows.get(i, none)[2] for i in range(n)], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
        ]


def blocks(benchmark: DataFrame, n: int, limit: int, item: str, text: str) -> Iterator[WindowSet]:
    """The benchmark's windows, in blocks of at most ``limit`` and one item; the driver holds one block at a time."""
    windows: dict[bytes, set[str]] = {}
    for got in benchmark.select(F.col(item).cast("string"), F.col(text).cast("string")).toLocalIterator():
        raw = np.frombuffer((got[1] or "").encode(), np.uint8)
        low, starts, ends, _ = K.words_of(raw, np.array([0, len(raw)]))
        words = [low[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
        for i in range(max(1, len(words) - n + 1) if words and got[0] is not None else 0):
            windows.setdefault(b" ".join(words[i : i + n]), set()).add(got[0])
            if len(windows) >= limit:
                yield WindowSet(windows)
                windows = {}
    yield WindowSet(windows)


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, block_windows: int = BLOCK_WINDOWS, text: str = "text", item: str = "item_id", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, the hit words' places, the items with occurring windows, and hit byte spans of the text."""
    spark, sets = docs.sparkSession, []
    scans = []
    for found in blocks(benchmark, n, block_windows, item, "text"):
        sets.append(shared := spark.sparkContext.broadcast(found))
        scans.append(annotate(docs if not scans else numbered(docs), lambda column, s=shared: s.value.scan(column), FIELDS, keep if not scans else ["_row"], text))
    if len(scans) == 1:
        return scans[0]
    scans[0] = annotate(numbered(docs), lambda column, s=sets[0]: s.value.scan(column), FIELDS, [*(docs.columns if keep is None else keep), "_row"], text)
    more = scans[1].where(F.size("hit_words") > 0)
    for scan in scans[2:]:
        more = more.unionByName(scan.where(F.size("hit_words") > 0))
    united = more.groupBy("_row").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(f"_{c}") for c in ("hit_words", "hit_items", "spans")])
    both = scans[0].join(united, "_row", "left")
    for c in ("hit_words", "hit_items"):
        both = both.withColumn(c, F.array_sort(F.array_union(c, F.coalesce(f"_{c}", F.col(c)))))
    return both.withColumn("spans", _merged(F.array_sort(F.array_union("spans", F.coalesce("_spans", "spans"))))).drop("_row", "_hit_words", "_hit_items", "_spans")


def _merged(spans: Column) -> Column:
    """Sorted spans with those that overlap united."""
    return F.aggregate(
        spans,
        F.slice(spans, 1, 0),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= x["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop")))),
        ).otherwise(F.concat(done, F.array(x))),
    )


def is_contaminated() -> Column:
    """At least one hit word, and a twentieth of all words hit."""
    return (F.size("hit_words") > 0) & (20 * F.size("hit_words") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, as they were."""
    hits = find_hits(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_t")), benchmark, text="_t", keep=["_doc"], **options)
    return hits.where(~is_contaminated()).select("_doc.*")


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents, their hit spans removed from the text; the other way to decontaminate."""
    hits = find_hits(docs, benchmark, text=text, **options)
    return annotate_cut(hits, text).select(*[F.col(f"`{c}`") for c in docs.columns])


def annotate_cut(hits: DataFrame, text: str) -> DataFrame:
    """Spans are byte offsets of the UTF-8 text, so the text is cut as binary."""
    raw = F.col(text).cast("binary")
    edges = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["stop"]))
    kept = F.zip_with(edges, F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length(text))), lambda a, b: F.hex(F.substring(raw, a + 1, b - a)))
    return hits.withColumn(text, F.when(F.size("spans") > 0, F.decode(F.unhex(F.array_join(kept, "")), "UTF-8")).otherwise(F.col(text)))
