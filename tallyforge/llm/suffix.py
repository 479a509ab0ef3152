"""Suffix-array dedup: every byte that a repeated 200-byte string covers is removed.

Texts are UTF-8 bytes.  A *window* is a string of ``WINDOW`` bytes inside one text.  Windows are dealt to shards by their
*minimiser*: of the ``GRAM``-byte grams in the window, the first one of least hash.  Equal windows have equal minimisers,
so they always meet, and neighbouring windows mostly share one, so a text is dealt as a few *segments*: runs of windows
with one minimiser.  Segments of equal bytes are combined before anything moves and counted; the counts say which of
them stand in several places.  Segments whose minimiser occurs nowhere else are gone by then: they can't hold repeated windows.

A shard sorts all suffixes of its segments: first by eight bytes, then by Larsson-Sadakane doubling, where suffixes that
are sorted already leave.  Kasai's rule gives common prefixes of neighbours in that order, for all segments side by side.
A window is repeated if its suffix shares ``WINDOW`` bytes with a neighbour, or its segment stands in several places.
Segments of one minimiser that outgrow a shard are split over several; those shards are merged by binary
search of each one's windows in the others' suffix arrays.

Defined results: a null text is empty; texts shorter than a window lose nothing; repeats may overlap, and may be in one
document; all copies go, the first included; repeated rows repeat each other wholly; windows are judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm import kernels as K
from tallyforge.llm.common import cut, join_classes, numbered, settle

WINDOW, GRAM = 200, 32
#: Bytes of segments in a shard, and windows of a text that are dealt at once.
SHARD_BYTES, PIECE = 2 << 20, 8 << 20
_U = np.uint64
_PLACE = _U(26)


def minimisers(data: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the buffer its minimiser's place; hashes of all grams; prefix sums for hashes of any span."""
    n = len(data)
    up, down = K.powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=total[1:])
    grams = K.mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    width = window - gram + 1
    # The least of each ``width`` packed values (hash above, place below), by minima of blocks from either side.
    packed = (grams >> _PLACE << _PLACE) | np.arange(len(grams), dtype=_U)
    size = -(-len(packed) // width) * width
    blocks = np.full(size, np.iinfo(_U).max, _U)
    blocks[: len(packed)] = packed
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    count = n - window + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    return (least & _U((1 << 26) - 1)).astype(np.int64), grams, total


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """document, start, number of windows, minimiser hash and content hash of each segment of a chunk."""
    n = len(data)
    if n < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    place, grams, total = minimisers(data)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = doc[: len(place)] == doc[WINDOW - 1 :]
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(new)
    stop = np.append(np.flatnonzero(~valid), len(place))
    ends = np.minimum(np.append(starts[1:], len(place)), stop[np.searchsorted(stop, starts, "right")])
    spans = ends + WINDOW - 1
    content = K.mix((total[spans] - total[starts]) * K.powers(n + 1)[1][starts] + (spans - starts).astype(_U) * _U(0x9E3779B1))
    return doc[starts], starts - offsets[doc[starts]], ends - starts, grams[place[starts]].view(np.int64), content.view(np.int64)


def segment_table(rows: DataFrame) -> DataFrame:
    """row, off, windows, gram (the minimiser's hash) and content of each segment of ``_row, _text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, _, data, offsets in K.chunks(batch.column(1)):
                for at in range(0, max(1, len(data) - WINDOW + 1), PIECE):
                    # A chunk over PIECE bytes is one long text; its pieces share WINDOW - 1 bytes, so no window is lost or twice.
                    part = data[at : at + PIECE + WINDOW - 1] if len(data) > PIECE + WINDOW else data
                    own = np.array([0, len(part)]) if part is not data else offsets
                    doc, off, windows, gram, content = _segments(part, own)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row + doc]), pa.array(off + (at if part is not data else 0)), pa.array(windows.astype(np.int32)), pa.array(gram), pa.array(content)], names=["row", "off", "windows", "gram", "content"])
                    if part is data:
                        break

    return rows.select("_row", "_text").mapInArrow(run, "row bigint, off bigint, windows int, gram bigint, content bigint")


class SuffixArray:
    """All suffixes of some segments, sorted inside the groups (minimisers) that the segments are of."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, group: np.ndarray):
        self.data, n = data, len(data)
        size = np.diff(offsets)
        self.end = np.repeat(offsets[1:], size)
        self.group = np.repeat(group, size)
        self.begin, self.sizes = offsets[:-1], size
        # One sort key: the group's number above, then bytes of nine bits each; a suffix that ends sorts before every byte.
        names, number = np.unique(group, return_inverse=True)
        h = (64 - max(1, len(names) - 1).bit_length()) // 9
        wide = np.zeros(n + h, np.uint16)
        wide[:n] = data
        wide[:n] += np.uint16(1)
        left = self.end - np.arange(n)
        key = np.repeat(number.astype(_U), size)
        for j in range(h):
            key = key << _U(9) | np.where(left > j, wide[j : j + n], np.uint16(0))
        order = np.argsort(key)
        changed = np.ones(n, bool)
        sorted_ = key[order]
        changed[1:] = sorted_[1:] != sorted_[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(changed, np.arange(n), 0))
        while True:
            # Places in groups of more than one suffix that don't all end within h bytes.
            firsts = np.flatnonzero(changed)
            many = np.repeat(np.diff(np.append(firsts, n)) > 1, np.diff(np.append(firsts, n)))
            slots = np.flatnonzero(many)
            at = order[slots]
            if not len(slots) or h >= (size.max() if len(size) else 0):
                # What is left are equal suffixes that end with their segments; Kasai's rule needs them in order of place.
                order[slots] = at[np.argsort(rank[at] * np.int64(n + 1) + at)]
                break
            beyond = at + h
            second = np.where(beyond < self.end[at], rank[np.minimum(beyond, n - 1)], -1)
            pair = rank[at] * np.int64(n + 1) + second + 1
            sort = np.argsort(pair)
            order[slots] = at[sort]
            pair = pair[sort]
            fresh = np.ones(len(slots), bool)
            fresh[1:] = pair[1:] != pair[:-1]
            changed[slots] = fresh
            rank[order[slots]] = np.maximum.accumulate(np.where(fresh, slots, 0))
            h *= 2
        self.order, self.rank = order, np.empty(n, np.int64)
        self.rank[order] = np.arange(n)

    def common(self) -> np.ndarray:
        """For each window's place, the common prefix (to WINDOW bytes) of its suffix and the one before in order: Kasai's walk along all segments at once."""
        out = np.zeros(len(self.data), np.int32)
        held = np.zeros(len(self.begin), np.int64)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data), "<u8", padded.data, strides=(1,))
        for j in range(int(self.sizes.max()) - WINDOW + 1 if len(self.sizes) else 0):
            live = np.flatnonzero(self.sizes - WINDOW >= j)
            p = self.begin[live] + j
            slot = self.rank[p]
            q = self.order[np.maximum(slot - 1, 0)]
            paired = (slot > 0) & (self.group[q] == self.group[p])
            h = np.where(paired, np.maximum(held[live] - 1, 0), 0)
            most = np.minimum(np.minimum(self.end[p] - p, self.end[q] - q), WINDOW)
            run = np.flatnonzero(paired)
            while len(run):
                a = h[run]
                apart = eight[np.minimum(p[run] + a, len(eight) - 1)] ^ eight[np.minimum(q[run] + a, len(eight) - 1)]
                # Equal low bytes: the zero bits below the lowest bit that differs, by eights.
                same = np.bitwise_count((apart & (~apart + _U(1))) - _U(1)) >> 3
                h[run] = a = np.minimum(a + same, most[run])
                run = run[(same == 8) & (a < most[run])]
            out[p] = h
            held[live] = h
        return out

    def repeated(self) -> np.ndarray:
        """Places whose window also begins elsewhere in this array."""
        near = self.common() >= WINDOW
        by_order = near[self.order]
        by_order[:-1] |= by_order[1:]
        out = np.empty_like(by_order)
        out[self.order] = by_order
        return out

    def find(self, other: np.ndarray, places: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of the windows at ``places`` of other bytes, in a group: which are here, and where one of each begins."""
        ordered = self.group[self.order]
        low = np.full(len(places), np.searchsorted(ordered, group, "left"))
        high = stop = np.full(len(places), np.searchsorted(ordered, group, "right"))
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            less = self._compare(self.order[middle], other, places[open_]) < 0
            low[open_[less]] = middle[less] + 1
            high = high.copy()
            high[open_[~less]] = middle[~less]
        inside = np.flatnonzero(low < stop)
        hit = inside[self._compare(self.order[low[inside]], other, places[inside]) == 0]
        return hit, self.order[low[hit]]

    def _compare(self, mine: np.ndarray, other: np.ndarray, places: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffixes here (to WINDOW bytes) are less, equal or greater."""
        out, open_ = np.zeros(len(mine), np.int8), np.arange(len(mine))
        for j in range(WINDOW):
            a = mine[open_] + j
            ended = a >= self.end[mine[open_]]
            x = np.where(ended, -1, self.data[np.minimum(a, len(self.data) - 1)].astype(np.int16))
            sign = np.sign(x - other[places[open_] + j].astype(np.int16))
            out[open_] = sign
            open_ = open_[sign == 0]
            if not len(open_):
                break
        return out


def repeated_windows(segments: list[tuple[int, int, int, bytes]], shard_bytes: int = SHARD_BYTES) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """For (gram, content, copies, bytes) segments, whole groups of ``gram``: the runs of repeated windows of each."""
    if not segments:
        return []
    shards: list[list[int]] = [[]]
    used = 0
    for i, s in enumerate(segments):
        if used and used + len(s[3]) > shard_bytes:
            shards.append([])
            used = 0
        shards[-1].append(i)
        used += len(s[3])
    built: list[tuple[SuffixArray, np.ndarray, np.ndarray]] = []
    for own in shards:
        offsets = np.concatenate([[0], np.cumsum([len(segments[i][3]) for i in own])])
        data = np.frombuffer(b"".join(segments[i][3] for i in own), np.uint8)
        array = SuffixArray(data, offsets, np.array([segments[i][0] for i in own], np.int64))
        flags = array.repeated()
        for k, i in enumerate(own):
            if segments[i][2] > 1:
                flags[offsets[k] : offsets[k + 1]] = True
        built.append((array, flags, offsets))
    # Shards are merged where they hold parts of one group, which are neighbours in the input.
    for x in range(len(built)):
        for y in range(x + 1, len(built)):
            array, flags, offsets = built[x]
            there, marks, _ = built[y]
            shared = np.intersect1d(np.unique(array.group), np.unique(there.group))
            if not len(shared):
                break
            for g in shared.tolist():
                at = np.flatnonzero((array.group == g) & (array.end - np.arange(len(array.data)) >= WINDOW))
                hit, where = there.find(array.data, at, g)
                flags[at[hit]] = True
                marks[where] = True
    out = []
    for own, (_, flags, offsets) in zip(shards, built, strict=True):
        for k, i in enumerate(own):
            windows = flags[offsets[k] : offsets[k + 1] - WINDOW + 1]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], windows.view(np.int8), [0]])))
            if len(edges):
                out.append((segments[i][0], segments[i][1], [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]))
    return out


def _packed(rows: DataFrame) -> DataFrame:
    """Texts compressed, for the shuffles that bring them to their segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress((x or "").encode()) for x in batch.column(1).to_pylist()], pa.binary())], names=["_row", "_packed"])

    return rows.select("_row", "_text").mapInArrow(run, "_row bigint, _packed binary")


def _unpack(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _fetch(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """The bytes of the segments that ``wanted`` names (first_row, first_off, windows, gram, content, n)."""
    by_row = wanted.groupBy(F.col("first_row").alias("_row")).agg(F.collect_list(F.struct("first_off", "windows", "gram", "content", "n")).alias("_want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for packed, want in zip(batch.column(0), batch.column(1), strict=True):
                raw = _unpack(packed.as_py())
                for w in want.as_py():
                    for x, y in zip(out, (w["gram"], w["content"], w["n"], raw[w["first_off"] : w["first_off"] + w["windows"] + WINDOW - 1]), strict=True):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], names=["gram", "content", "n", "bytes"])

    return _packed(rows).join(by_row, "_row").select("_packed", "_want").mapInArrow(run, "gram bigint, content bigint, n bigint, bytes binary")


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by gram; whole groups are sorted together, about a shard's bytes at a time."""

    def done(held: list) -> pa.RecordBatch:
        got = repeated_windows(held)
        spans = pa.array([[{"start": a, "stop": b} for a, b in s] for _, _, s in got], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array([g for g, _, _ in got], pa.int64()), pa.array([c for _, c, _ in got], pa.int64()), spans], names=["gram", "content", "spans"])

    held: list[tuple[int, int, int, bytes]] = []
    used = 0
    for batch in batches:
        for s in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if used >= SHARD_BYTES * 3 // 4 and s[0] != held[-1][0]:
                yield done(held)
                held, used = [], 0
            held.append(s)
            used += len(s[3])
    yield done(held)


def repeated_segments(rows: DataFrame) -> DataFrame:
    """_row and its runs of repeated windows, (start, stop) by first bytes, for ``_row, _text`` rows of a stored table."""
    segments = segment_table(rows)
    numbered_ = segments.withColumn("_seq", F.monotonically_increasing_id())
    contents = numbered_.groupBy("gram", "content", "windows").agg(F.count("*").alias("n"), F.min_by("row", "_seq").alias("first_row"), F.min_by("off", "_seq").alias("first_off"))
    group = Window.partitionBy("gram")
    contents = cut(contents.withColumn("_all", F.sum("n").over(group)).withColumn("_kinds", F.count("*").over(group)).where(F.col("_all") > 1).drop("_all"))
    # Alone with its minimiser, a content is repeated as a whole (it has n > 1) and can share no window with another.
    alone = contents.where(F.col("_kinds") == 1).select("gram", "content", F.array(F.struct(F.lit(0).alias("start"), F.col("windows").alias("stop"))).alias("spans"))
    shards = _fetch(contents.where(F.col("_kinds") > 1), rows).repartition("gram").sortWithinPartitions("gram", "content")
    found = shards.mapInArrow(_sorted_shards, "gram bigint, content bigint, spans array<struct<start:int,stop:int>>")
    found = cut(found.unionByName(alone).join(contents.select("gram", "content", "n"), ["gram", "content"]))
    total = rows.count() * 64
    back = join_classes(segments, found, ["gram", "content"], total)
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("off")).alias("start"), (s["stop"] + F.col("off")).alias("stop")))
    return back.select(F.col("row").alias("_row"), moved.alias("_spans")).groupBy("_row").agg(F.flatten(F.collect_list("_spans")).alias("_spans"))


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` (a stored table) with n_bytes, the removed byte spans and the kept bytes.  Columns of those names are replaced."""
    settle(docs.sparkSession)
    added = ("n_bytes", "spans", "kept")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = numbered(docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("_text")))
    spans = repeated_segments(rows)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, left = [], [], []
            for packed, got in zip(batch.column(0), batch.column(1), strict=True):
                raw = _unpack(packed.as_py())
                cover: list[list[int]] = []
                for s in sorted((s["start"], s["stop"] + WINDOW - 1) for s in got.as_py() or ()):
                    if cover and s[0] <= cover[-1][1]:
                        cover[-1][1] = max(cover[-1][1], s[1])
                    else:
                        cover.append([*s])
                edges = [0, *(x for c in cover for x in c), len(raw)]
                sizes.append(len(raw))
                gone.append([{"start": a, "stop": b} for a, b in cover])
                left.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sizes, pa.int64()), pa.array(gone, kind), pa.array(left, pa.binary())], names=[*kept, *added])

    whole = _packed(rows)
    schema = T.StructType([*[rows.schema[c] for c in kept], *T.StructType.fromDDL("n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary").fields])
    others = rows.select("_row", *[F.col(f"`{c}`") for c in kept])
    return whole.join(others, "_row").join(spans, "_row", "left").select("_packed", "_spans", *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
