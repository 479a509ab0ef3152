"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed features: whole words (runs of non-white-space bytes), pairs
of neighbouring words, and the 3- and 4-byte grams inside words and at their edges.  A softmax layer over the average
gives the class.  All vectors and the layer are trained together by stochastic gradient descent in numpy.

The scores of two classes differ by (w1 - w0) . average + (b1 - b0), so after training each bucket's vector is
folded into the one number that it adds; scoring is one table lookup a feature, which is the same model.

Learning takes at most ``MAX_DOCS`` labelled documents with at most ``MAX_BYTES`` of whole texts together (those first by a hash
of their id), a documented bound; a text that doesn't fit into what is left of it is passed over, and later ones that fit are taken.  Scoring covers every whole text.

Defined results: null and empty texts have no features and get the bias' score; labels that are null or of no document
are ignored; repeated labels of a document count each; without any label every score is 0.5; repeated
rows get equal scores; non-text columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm.common import annotate, settle

BUCKETS, DIM = 1 << 17, 8
MAX_DOCS, MAX_BYTES = 4000, 48 << 20
STEPS, RATE = 12_000, 0.5
THRESHOLD = 0.3
_SPACE = ~K.SOLID


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature of a chunk, and each feature's document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, first = K.runs(K.SOLID[data], offsets)
    words, of = K.span_hashes(data, starts, ends), K.owner(first)
    same = of[1:] == of[:-1]
    pairs = K.mix((words[1:] - words[:-1])[same] + np.uint64(77))
    ids, docs = [words, pairs], [of, of[1:][same]]
    byte_doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    blank = _SPACE[data]
    wide = np.where(blank, np.uint32(32), data).astype(np.uint32)
    for n in (3, 4):
        size = len(data) - n + 1
        if size <= 0:
            continue
        gram = wide[:size].copy()
        for j in range(1, n):
            gram = gram << np.uint32(8) | wide[j : j + size]
        inside = byte_doc[:size] == byte_doc[n - 1 :]
        for j in range(1, n - 1):
            inside &= ~blank[j : j + size]
        gram = (gram[inside] ^ np.uint32(n * 0x1F123BB5)) * np.uint32(2654435761)
        ids.append((gram >> np.uint32(8)).astype(np.uint64))
        docs.append(byte_doc[:size][inside])
    return (np.concatenate(ids) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(docs)


def train(texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = 7) -> dict:
    """Fit the vectors and the softmax layer; one document a step, in shuffled passes, at a falling rate."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    rows = []
    for text in texts:
        raw = np.frombuffer(text, np.uint8)
        ids, counts = np.unique(features(raw, np.array([0, len(raw)]))[0], return_counts=True)
        rows.append((ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    order = np.zeros(0, np.int64)
    for step in range(steps if texts and len(set(labels)) > 1 else 0):
        if not len(order):
            order = random.permutation(len(rows))
        (ids, share), y, order = rows[order[0]], labels[order[0]], order[1:]
        rate = np.float32(RATE * (1 - step / steps))
        own = vectors[ids]
        mean = share @ own
        score = layer @ mean + bias
        p = np.exp(score - score.max())
        error = p / p.sum()
        error[y] -= 1
        vectors[ids] = own - rate * share[:, None] * (error @ layer)
        layer -= rate * np.outer(error, mean)
        bias -= rate * error * np.float32(0.1)
    return {"table": (vectors @ (layer[1] - layer[0])).astype(np.float32), "bias": float(bias[1] - bias[0])}


def score(model: dict, column: pa.Array) -> np.ndarray:
    out = []
    for _, _, data, offsets in K.chunks(column):
        ids, docs = features(data, offsets)
        n = len(offsets) - 1
        total, count = np.bincount(docs, model["table"][ids], n), np.bincount(docs, minlength=n)
        out.append(total / np.maximum(count, 1) + model["bias"])
    raw = np.concatenate(out) if out else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, steps: int = STEPS) -> dict:
    """Learn from labelled rows outside the held-out fold (remainder 0)."""
    rows = labels.where(F.col(target).isin(0, 1) & (fold(F.col("doc_id")) != 0)).select("doc_id", F.col(target).cast("int").alias("_y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(max_docs)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("_raw"))
    # At most max_docs rows are on the small side, so it can always be broadcast.
    found = texts.join(F.broadcast(rows), "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("_y"), F.col("_raw")]
    found = found.orderBy(*order).limit(max_docs).withColumn("_place", F.row_number().over(Window.orderBy(*order)))
    fits, total = [], 0
    for place, n in sorted(found.select("_place", F.length("_raw")).collect()):
        if total + n <= max_bytes:
            fits.append(place)
            total += n
    # The bounded sample is one partition; one task learns from it, and only the model comes to the driver.
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, classes = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            classes += batch.column(1).to_pylist()
        if texts:
            model = train(texts, classes, steps)
            yield pa.RecordBatch.from_arrays([pa.array([model["table"].tobytes()], pa.binary()), pa.array([model["bias"]])], names=["weights", "bias"])

    settle(docs.sparkSession)
    sample = found.where(F.col("_place").isin(fits)).select("_raw", "_y").coalesce(1)
    got = sample.mapInArrow(learn, "weights binary, bias double").collect()
    return {"table": np.frombuffer(got[0]["weights"], np.float32), "bias": got[0]["bias"]} if got else train([], [], 0)


def classify(docs: DataFrame, model: dict, keep: list[str] | None = None, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the probability that a whole text is of class 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, lambda column: [pa.array(score(shared.value, column))], f"`{name}` double", keep, text)


def learned(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return classify(docs, fit(docs, labels), **options)

