"""Line dedup: a suffix array over sequences of line ids, by distributed prefix doubling.

Non-blank lines, in table order, are numbered; a line's id is a 128-bit hash of its text.  Prefix doubling ranks the suffixes
of every document's sequence: round 0 groups places by their line, round k by the pair of names at i and i + 2**(k-1), so that
places of one *name* are the interval of suffixes with a common prefix of 2**k lines.  A name is the first place of its
interval (in table order), so equal names are equal runs, and a place whose name is its own number begins no later copy.  A place
whose run occurs once leaves, as sorted suffixes do in suffix sorting; rounds go on while any run that decides is longer.
The interval of a common prefix of any other length L is found by two names that overlap: the one at its begin and the one that
ends with it, both of the greatest power of two within L.

A run of lines is a later copy if the same run also begins earlier (same document included).  Maximal runs are judged
whole: one of at least ``min_lines`` lines with at least ``min_chars`` characters together is deleted, whatever its length.  Such a
run is the union of the shortest runs with both that begin at one of its places or end at one; each of these is a later copy too,
and which they are depends on the text alone.  So intervals are looked up for them, and the deleted lines are exactly those of
all maximal runs that count.  A single line of at least ``line_chars`` characters is a run of its own.

Names are found by aggregation (combined map-side) and joined back with hot names apart, so a line that is in a third
of all documents makes no large task.

Defined results: a null text stays null and an empty one empty; blank lines are never deleted and don't interrupt runs;
repeated rows are documents of their own, so the later ones lose their repeated lines; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm import kernels as K
from tallyforge.llm.common import cut, fresh, join_classes, numbered, settle

MIN_LINES, MIN_CHARS, LINE_CHARS = 2, 100, 200
_SALT = 7919


def line_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """row, line (its index in the text), pos (its number in table order), its id in two halves, and its length."""
    split = docs.select("_row", F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "_s"))
    solid = split.where(F.col("_s").rlike("[^\\x20\\x09-\\x0D]"))
    return solid.select(F.col("_row").alias("row"), "line", F.monotonically_increasing_id().alias("pos"), F.xxhash64("_s").alias("a"), F.xxhash64(F.lit(_SALT), "_s").alias("b"), F.length("_s").alias("chars"))


def named(places: DataFrame, keys: list[str]) -> DataFrame:
    """Places whose run (``keys``) occurs again, with its name: the first place where it begins."""
    places = cut(places)
    classes = cut(places.groupBy(*keys).agg(F.min("pos").alias("name"), F.count("*").alias("n")).where(F.col("n") > 1))
    return join_classes(places, classes, keys, places.count())


def shortest_runs(pos: np.ndarray, row: np.ndarray, chars: np.ndarray, min_lines: int, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the shortest runs of ``min_lines`` lines and ``min_chars`` characters from and to each place."""
    n = len(pos)
    place = np.arange(n)
    breaks = np.flatnonzero((np.diff(pos) != 1) | (np.diff(row) != 0)) + 1
    bounds = np.concatenate([[0], breaks, [n]])
    part = np.searchsorted(bounds, place, "right")
    total = np.concatenate([[0], np.cumsum(chars)])
    ends = np.maximum(np.searchsorted(total, total[:-1] + min_chars, "left"), place + min_lines)
    starts = np.minimum(np.searchsorted(total, total[1:] - min_chars, "right") - 1, place + 1 - min_lines)
    from_, to = ends <= bounds[part], starts >= bounds[part - 1]
    both = np.unique(np.concatenate([place[from_] * (n + 1) + ends[from_], starts[to] * (n + 1) + place[to] + 1]))
    return both // (n + 1), both % (n + 1)


def _places(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, ...]:
    """Document, number, line, name and characters of the repeated lines of a batch of documents (column ``at``)."""
    lists = batch.column(at)
    pos, line, name, chars = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), pos, line, name, chars


def rounds_needed(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place the doubling rounds that the runs over it need: the greatest power of two within the longest of them."""
    out = np.zeros(n, np.int64)
    power = np.log2(np.maximum(1, ends - starts)).astype(np.int64)
    for k in range(1, int(power.max(initial=0)) + 1):
        long = power >= k
        cover = np.bincount(starts[long], minlength=n + 1) - np.bincount(ends[long], minlength=n + 1)
        out[np.cumsum(cover)[:n] > 0] = k
    return out


def doubled(board: DataFrame, min_lines: int, min_chars: int) -> DataFrame | None:
    """Names by round: row, level, pos, name for runs of 2**level lines; None if no run has two lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, _, name, chars = _places(batch, 1)
            need = rounds_needed(len(pos), *shortest_runs(pos, row, chars, min_lines, min_chars))
            on = need > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (batch.column(0).to_numpy()[row], pos, name, need)], names=["row", "pos", "name", "need"])

    now = cut(board.mapInArrow(run, "row bigint, pos bigint, name bigint, need bigint"))
    found = None
    for k in range(now.agg(F.max("need")).first()[0] or 0):
        after = Window.partitionBy("row").orderBy("pos").rangeBetween(2**k, 2**k)
        pairs = now.where(F.col("need") > k).select("row", "pos", "need", F.col("name").alias("left"), F.first("name").over(after).alias("right"))
        now = cut(named(pairs.where(F.col("right").isNotNull()), ["left", "right"]).select("row", "pos", "name", "need"))
        level = now.select("row", F.lit(k + 1).alias("level"), "pos", "name")
        found = level if found is None else found.unionByName(level)
    return found


def repeated_runs(single: DataFrame, min_lines: int, min_chars: int) -> DataFrame:
    """The places of repeated shortest runs: row, line, last, pos, name."""
    board = cut(single.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "line", "name", "chars"))).alias("lines")))
    names = doubled(board, min_lines, min_chars)
    one = single.select("row", F.lit(0).alias("level"), "pos", "name") if min_lines < 2 else None
    names = one if names is None else names if one is None else names.unionByName(one)
    if names is None:
        return single.select("row", "line", F.col("line").alias("last"), "pos", "name").limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, line, _, chars = _places(batch, 1)
            level, place, name = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.column(2).flatten().flatten())
            starts, ends = shortest_runs(pos, row, chars, min_lines, min_chars)
            size = ends - starts
            power = np.log2(np.maximum(1, size)).astype(np.int64)
            # Names are looked up by level and place; numbers of places are unique in the table.
            order = np.lexsort((place, level))
            level, place, name = level[order], place[order], name[order]
            left, right = np.full(len(size), -1), np.full(len(size), -1)
            for k in np.unique(power).tolist():
                begin, stop = np.searchsorted(level, [k, k + 1])
                own = np.flatnonzero(power == k)
                for out, want in ((left, pos[starts[own]]), (right, pos[ends[own] - 2**k])):
                    at = begin + np.searchsorted(place[begin:stop], want)
                    hit = at < stop
                    hit[hit] = place[at[hit]] == want[hit]
                    out[own[hit]] = name[at[hit]]
            on = (left >= 0) & (right >= 0)
            starts, ends = starts[on], ends[on]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (batch.column(0).to_numpy()[row[starts]], line[starts], line[ends - 1], pos[starts], size[on], left[on], right[on])], names=["row", "line", "last", "pos", "size", "left", "right"])

    by_row = names.groupBy("row").agg(F.collect_list(F.struct("level", "pos", "name")).alias("names"))
    runs = cut(board.join(by_row, "row").mapInArrow(run, "row bigint, line bigint, last bigint, pos bigint, size bigint, left bigint, right bigint"))
    # A run of a power of two lines has its name already; others are the intervals of their two names.
    whole = runs.where(F.col("left") == F.col("right")).where(F.expr("size & (size - 1)") == 0).select("row", "line", "last", "pos", F.col("left").alias("name"))
    others = runs.where((F.expr("size & (size - 1)") != 0) | (F.col("left") != F.col("right")))
    return whole.unionByName(named(others, ["size", "left", "right"]).select("row", "line", "last", "pos", "name"))


def later_copies(docs: DataFrame, text: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, line_chars: int = LINE_CHARS) -> DataFrame:
    """For each numbered document with later copies: the runs of lines to delete, as (line, last)."""
    if min_lines < 1:
        raise ValueError("min_lines has to be at least 1")
    single = cut(named(line_table(docs, text), ["a", "b"]).select("row", "line", "pos", "name", "chars"))
    runs = repeated_runs(single, min_lines, min_chars)
    later = runs.where(F.col("name") != F.col("pos")).select("row", "line", "last")
    later = later.unionByName(single.where((F.col("name") != F.col("pos")) & (F.col("chars") >= line_chars)).select("row", "line", F.col("line").alias("last")))
    return later.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("line", "last")).alias("_later"))


def deleted_lines(text: str, later: list[tuple[int, int]]) -> tuple[str, int, int, int]:
    """The text without the runs' non-blank lines; how many lines it had, how many went, in how many maximal runs."""
    lines = text.split("\n")
    gone = {i for a, b in later for i in range(a, b + 1) if lines[i].strip(" \t\n\v\f\r")}
    kept, runs, open_ = [], 0, False
    for i, x in enumerate(lines):
        if i in gone:
            runs += not open_
            open_ = True
        else:
            kept.append(x)
            open_ = open_ and not x.strip(" \t\n\v\f\r")
    return "\n".join(kept), len(lines), len(gone), runs


def dedup_lines(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """``docs`` with later copies of line runs deleted from the text, and n_lines, n_removed and n_runs of each.

    ``docs`` has to be a stored table.  Input columns of those three names are replaced.
    """
    settle(docs.sparkSession)
    added = ("n_lines", "n_removed", "n_runs")
    kept = [c for c in docs.columns if c not in added]
    mark, found = fresh(docs, "_row"), fresh(docs, "_later")
    rows = numbered(docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(text, F.col(f"`{text}`").cast("string")), mark)
    later = later_copies(rows.select(F.col(mark).alias("_row"), F.col(f"`{text}`").alias("_text")), "_text", **limits)
    later = later.select(F.col("_row").alias(mark), F.col("_later").alias(found))
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[], [], [], []]
            runs = batch.column(len(kept))
            for i in range(batch.num_rows):
                whole = batch.column(at)[i].as_py()
                got = (whole, whole.count("\n") + 1 if whole else 0, 0, 0) if whole is None or not runs[i].is_valid else deleted_lines(whole, [(r["line"], r["last"]) for r in runs[i].as_py()])
                for x, y in zip(made, got, strict=True):
                    x.append(y)
            columns = list(batch.columns[: len(kept)])
            columns[at] = pa.array(made[0], columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in made[1:])], names=[*kept, *added])

    schema = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(c, T.LongType()) for c in added]])
    return rows.join(later, mark, "left").select(*[F.col(f"`{c}`") for c in kept], found).mapInArrow(run, schema)
