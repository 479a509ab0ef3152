"""Exact top-k search by MaxScore over sharded impact postings.

Vectors are quantised to integers, floor(256 * x).  A term is a component with a sign; a vector stands in the posting list
of (component, +) with its impact if that component is positive, and of (component, -) if it is negative.  A query with a positive
component asks for the + list, with a negative one for the - list: there products are positive, and a list's
largest impact times the query's weight bounds what its term adds.  What the opposite lists hold takes away, so it never lifts a bound.

About ``SHARD_ROWS`` candidates are a shard with postings of its own; as half of all vectors may stand in a list, both lists of a
component are one array of signed impacts by row.  For each query, its terms are sorted by their bounds; the longest
run of the smallest bounds whose sum stays below the current k-th score is non-essential.  A vector that only
non-essential lists hold can't enter the result.  So only the essential components' lists are traversed, term by term, for all queries
of a block together: a matrix product of weights (non-essential ones are zero) and postings, in floating point where that is exact.
Vectors whose sum and the bounds left can't reach the k-th score leave; the others are probed
for the non-essential terms, from the largest bound down, while they stay competitive.

The k-th score begins with that of a few vectors of high impact.  It is carried from shard to shard inside a task, as k
vectors that reached it elsewhere make every lower score useless.  Shards give k rows a query at most; a window over queries merges them.

Queries are broadcast in blocks of at most ``QUERY_BYTES`` of vectors (a bounded size), of which the driver holds one at a time;
every candidate meets every block.  So the table is read once for each such block, not once for some fixed number of queries.

Defined results: null ids or vectors, and vectors that are empty or hold null or non-finite components, take no part; vectors
of another length than the query's are no candidates for it; ties go to the smaller id; rows that repeat an id and vector are
each candidates, except that a query's own id is none; query rows that repeat an id and vector are one query, and those that share
an id only are ranked apart, under the same ``query_id``.  Components and scores beyond 64 bits become the nearest 64-bit integer;
sums are exact before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import settle

SCALE = 256
K_BEST = 5
#: Bytes of query vectors in one broadcast, and candidates in a shard.
QUERY_BYTES = 32 << 20
SHARD_ROWS = 4096
#: Terms probed, and queries whose essential lists are traversed, at once.
PROBE, TOGETHER = 8, 1024
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vector: Column) -> Column:
    """Integer components; null for vectors that take no part."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when((F.size(wide) > 0) & ~bad, F.transform(wide, lambda x: F.floor(x * SCALE)))


class Shard:
    """Postings of some vectors: by component, signed impacts by row, and the largest of either sign."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.impacts, self.wide = ids, vectors, np.ascontiguousarray(vectors.T), None
        self.most, self.least = np.maximum(vectors.max(0), 0), np.minimum(vectors.min(0), 0)
        self.size = max(int(self.most.max()), -int(self.least.min()))
        self.seeds = [np.argsort(-vectors * sign, axis=0, kind="stable")[:32] for sign in (1, -1)]

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query (a row), its place, and ids and scores of the k best rows but its own of those that score its floor at least."""
        limit = self.size * max(int(queries.max()), -int(queries.min())) * queries.shape[1]
        if limit >= 1 << 53:
            for i, q in enumerate(queries):
                yield i, *self._wide_best(int(query_ids[i]), q, k)
            return
        kind = np.float32 if limit < 1 << 24 else np.float64
        bound = np.where(queries > 0, queries * self.most, queries * self.least)
        order = np.argsort(bound, axis=1, kind="stable")
        rising = np.cumsum(np.take_along_axis(bound, order, 1), 1)
        kth = floors.copy()
        for i in np.flatnonzero(floors == _LOW).tolist():
            seeds = np.unique(np.concatenate([self.seeds[int(queries[i, d] < 0)][:, d] for d in order[i, -4:].tolist()]))
            kth[i] = self._kth(self.vectors[seeds[self.ids[seeds] != query_ids[i]]] @ queries[i], k)
        free = (rising < kth[:, None]).sum(1)
        weights = queries.astype(kind)
        np.put_along_axis(weights, order, np.where(np.arange(queries.shape[1]) < free[:, None], 0, np.take_along_axis(weights, order, 1)), 1)
        rest = np.where(free > 0, rising[np.arange(len(free)), free - 1], 0)
        total = weights @ self.impacts.astype(kind)
        # Rows that no essential list holds have sum 0, and stay only while the slight terms alone could reach the k-th score.
        hits = (total >= (kth.astype(np.float64) - rest).astype(kind)[:, None]) & (self.ids != query_ids[:, None])
        for i in np.flatnonzero(hits.any(1)).tolist():
            rows = np.flatnonzero(hits[i])
            yield i, *self._probe(queries[i], rows, total[i, rows].astype(np.int64), order[i, : free[i]], rising[i], int(kth[i]), k)

    def _probe(self, query: np.ndarray, rows: np.ndarray, total: np.ndarray, slight: np.ndarray, rising: np.ndarray, kth: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        while True:
            if len(rows) > 4 * k:
                kth = max(kth, self._kth(total + self._worst(query, slight), k))
                stay = total + (int(rising[len(slight) - 1]) if len(slight) else 0) >= kth
                rows, total = rows[stay], total[stay]
            if not len(slight):
                break
            part, slight = slight[-PROBE:], slight[:-PROBE]
            total = total + query[part] @ self.impacts[part][:, rows]
        keep = np.lexsort((self.ids[rows], -total))[:k]
        return self.ids[rows][keep], total[keep]

    def _wide_best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with unbounded integers, for components whose products could leave 64 bits."""
        if self.wide is None:
            self.wide = self.vectors.astype(object)
        rows = np.flatnonzero(self.ids != query_id)
        total = np.array([min(_HIGH, max(_LOW, x)) for x in self.wide[rows] @ query.astype(object)], np.int64)
        keep = sorted(range(len(rows)), key=lambda i: (-int(total[i]), int(self.ids[rows[i]])))[:k]
        return self.ids[rows[keep]], total[keep]

    def _worst(self, query: np.ndarray, terms: np.ndarray) -> int:
        """The least that the terms can add, so that a partial sum is a sure score."""
        return int(np.where(query[terms] > 0, query[terms] * self.least[terms], query[terms] * self.most[terms]).sum())

    @staticmethod
    def _kth(scores: np.ndarray, k: int) -> int:
        return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else _LOW


def _blocks(queries: DataFrame, limit: int) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Blocks of queries: for each length of vectors their places in the block, ids and vectors as a matrix."""
    held, used = [], 0

    def made() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        sizes = np.array([len(v) for _, v in held])
        return [(own, np.array([held[i][0] for i in own], np.int64), np.array([held[i][1] for i in own])) for own in (np.flatnonzero(sizes == n) for n in np.unique(sizes))]

    for q in queries.toLocalIterator():
        held.append((q[0], np.array(q[1], np.int64)))
        used += held[-1][1].nbytes
        if used >= limit:
            yield made()
            held, used = [], 0
    if held:
        yield made()


def search(vectors: DataFrame, is_query: Column, k: int = K_BEST, id_col: str = "vec_id", vector: str = "embedding", query_bytes: int = QUERY_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, id and score of each query's k best other rows, by integer inner product."""
    settle(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), quantised(F.col(vector)).alias("_v")).where(F.col("_id").isNotNull() & F.col("_v").isNotNull())
    queries = vectors.where(is_query).select(F.col(id_col).cast("long").alias("_id"), quantised(F.col(vector)).alias("_v")).where(F.col("_id").isNotNull() & F.col("_v").isNotNull())
    context, found, before = vectors.sparkSession.sparkContext, None, 0
    for block in _blocks(queries.dropDuplicates(), query_bytes):
        shared = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, before=before) -> Iterator[pa.RecordBatch]:
            # The k best scores that this task has seen for each query; the least of them is the next shards' floor.
            seen: dict[int, np.ndarray] = {}
            for batch in _merged(batches, shard_rows):
                lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                ids, flat = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False)
                begins = np.cumsum(lengths) - lengths
                out: tuple[list, list, list, list] = ([], [], [], [])
                for places, query_ids, matrix in shared.value:
                    own = np.flatnonzero(lengths == matrix.shape[1])
                    if not len(own):
                        continue
                    shard = Shard(ids[own], flat[begins[own][:, None] + np.arange(matrix.shape[1])])
                    # Sums of TOGETHER queries and a shard's rows are held at a time.
                    for at in range(0, len(places), TOGETHER):
                        some = places[at : at + TOGETHER].tolist()
                        floors = np.array([had[-1] if (had := seen.get(p)) is not None and len(had) == k else _LOW for p in some], np.int64)
                        for i, got, scores in shard.best(query_ids[at : at + TOGETHER], matrix[at : at + TOGETHER], k, floors):
                            if len(got):
                                had = seen.get(some[i])
                                seen[some[i]] = scores if had is None else np.sort(np.concatenate([had, scores]))[::-1][:k]
                                for x, y in zip(out, (np.full(len(got), query_ids[at + i]), np.full(len(got), before + some[i]), got, scores), strict=True):
                                    x.append(y)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["query_id", "_q", id_col, "score"])

        hits = rows.mapInArrow(run, f"query_id bigint, _q bigint, `{id_col}` bigint, score bigint")
        found, before = hits if found is None else found.unionByName(hits), before + sum(len(x[0]) for x in block)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"query_id bigint, rank int, `{id_col}` bigint, score bigint")
    best = Window.partitionBy("_q").orderBy(F.desc("score"), F.asc(id_col))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def _merged(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows, so that a shard's postings are worth building."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
