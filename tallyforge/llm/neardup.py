"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; a document is its set of five-word
shingles (all words, if fewer).  Documents with the same word sequence are one *text*; its first row stands for it.
Two texts are linked if their sets' Jaccard similarity is at least 0.8; classes are the connected components.

The forest has ``TREES`` tries.  In each, a text's signature is a path of ``DEPTH`` MinHash values of 16 bits, packed into two
numbers whose order is that of the paths.  All paths are sorted by tree and path, over all tasks by ranges, so a trie is a sorted
table, a node at any depth is a run of it, and a big node is cut by the ranges, like any other rows.  One walk along each range
gives every text its node's first text (centre) at each depth, from the full one up.

The join begins at the full depth, in a few trees; met pairs are verified exactly and joined to classes.  Then matched prefixes
are shortened level by level.  At each level only texts that stand in another class than their centre still meet it; prefixes
are shortened no more once a pair of the least similarity shares a node of some tree with probability ``RECALL``.  At that
depth every pair of texts of a node that isn't in one class yet is verified, with no cap and whatever ranges the node lies in;
pairs inside a class are skipped there, as they can't change any class.  ``n_links`` is the number of other
texts that a document's text is linked to.  All links lie inside classes, so every class is compared in block cells, each of
which gives a count for each of its texts; no pair is written out.

Big groups of near copies are one class after the meetings with centres, so few pairs are left, whatever a group's size.
Nothing is collected: links, classes and signatures stay in tables; components are found by hooking and pointer jumping.

Defined results: null, empty and wordless texts have no shingles, no links and a class each; repeated rows are one text with
copies; classes bear the ``doc_id`` of their first row (null if that is null), and ``class_row`` is unique always.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import kernels as K
from tallyforge.llm.common import annotate, cut, join_classes, numbered, settle

SHINGLE, LEAST = 5, 0.8
TREES, DEPTH, RECALL = 20, 8, 0.999
#: Bits of a path's value, and values in one of the two numbers of a path.
BITS, PACKED = 16, 4
#: Trees whose full-depth nodes are used in the first step.
FIRST_TREES = 8
#: The step of texts at the borders of ranges; no step of the walk.
BORDER = 2 * PACKED + 2
#: A block of a group has about so many texts or shingles at most.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1_000_000
#: The same where links of a class are counted.  A text goes to one cell for each block of its class, so blocks are larger.
COUNT_TEXTS, COUNT_SHINGLES = 1024, 2_000_000
_U = np.uint64
FIELDS = "a bigint, b bigint, n_shingles int, high array<bigint>, low array<bigint>"


def adapted_depth(trees: int = TREES, depth: int = DEPTH, least: float = LEAST, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of similarity ``least`` meets in some tree with probability ``recall``."""
    for k in range(depth, 1, -1):
        if 1 - (1 - least**k) ** trees >= recall:
            return k
    return 1


def shingles(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a chunk's word hashes, and the number of them before each document."""
    size, n = np.diff(first), len(words)
    last = np.repeat(first[1:], size)
    whole = K.window_hashes(words, SHINGLE, 3)
    ok = np.arange(len(whole)) + SHINGLE <= last[: len(whole)]
    at, hashes = [np.flatnonzero(ok)], [whole[ok]]
    for k in range(1, SHINGLE):
        if len(begin := first[:-1][size == k]):
            at.append(begin)
            hashes.append(K.window_hashes(words, k, 3)[begin])
    place = np.concatenate(at)
    order = np.argsort(place, kind="stable") if len(at) > 1 else slice(None)
    return np.concatenate(hashes)[order], np.searchsorted(place[order], first if n else np.zeros_like(first), "left")


def _multipliers(n: int) -> np.ndarray:
    return K.mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


class Forest:
    """Paths of texts by tree: the values of the first ``PACKED`` levels in one number, those of the others in a second."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, least: float = LEAST, recall: float = RECALL):
        if not 1 <= depth <= 2 * PACKED:
            raise ValueError(f"depth must be 1 to {2 * PACKED}")
        self.trees, self.depth, self.short = trees, depth, adapted_depth(trees, depth, least, recall)
        self.by = _multipliers(trees * depth)

    def compute(self, column: pa.Array) -> list[pa.Array]:
        made: list[list[np.ndarray]] = [[], [], [], [], []]
        for _, _, data, offsets in K.chunks(column):
            low, starts, ends, first = K.words_of(data, offsets)
            words = K.span_hashes(low, starts, ends)
            hashes, before = shingles(words, first)
            n = len(offsets) - 1
            some = np.flatnonzero(np.diff(before))
            least = np.zeros((self.trees * self.depth, n), _U)
            if len(some):
                for i, m in enumerate(self.by):
                    # The top bits of a product with an odd number are a well mixed order of the (already mixed) hashes.
                    least[i, some] = np.minimum.reduceat((hashes * m) >> _U(32), before[some])
            values = K.mix(least) >> _U(64 - BITS)
            high, low = np.zeros((n, self.trees), _U), np.zeros((n, self.trees), _U)
            for t in range(self.trees):
                for d in range(self.depth):
                    half = high if d < PACKED else low
                    half[:, t] |= values[t * self.depth + d] << _U(BITS * (PACKED - 1 - d % PACKED))
            up, down = K.powers(len(words) + 1)
            halves = []
            for salt in (0x51ED270B, 0x2545F491):
                total = np.concatenate([np.zeros(1, _U), np.cumsum(K.mix(words ^ _U(salt)) * up[: len(words)])])
                halves.append(K.mix((total[first[1:]] - total[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(_U)))
            for out, x in zip(made, (*halves, np.diff(before), high, low), strict=True):
                out.append(x)
        flat = [np.concatenate(x) if x else np.zeros((0, self.trees), _U) for x in made]
        lists = [pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * self.trees, pa.array(x.reshape(-1).view(np.int64))) for x in flat[3:]]
        return [pa.array(flat[0].reshape(-1).view(np.int64)), pa.array(flat[1].reshape(-1).view(np.int64)), pa.array(flat[2].reshape(-1).astype(np.int32)), *lists]


def shingle_set(text: str) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    low, starts, ends, first = K.words_of(raw, np.array([0, len(raw)]))
    return np.unique(shingles(K.span_hashes(low, starts, ends), first)[0])


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (x, y) whose similarity, computed from the whole texts, is at least ``least``."""
    left = texts.select(F.col("_row").alias("x"), F.col("_text").alias("_tx"))
    right = texts.select(F.col("_row").alias("y"), F.col("_text").alias("_ty"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            xs = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                if xs[i] != last[0]:
                    last = (xs[i], shingle_set(batch.column(2)[i].as_py()))
                own, other = last[1], shingle_set(batch.column(3)[i].as_py())
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep[i] = both > 0 and both >= least * (len(own) + len(other) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["x", "y"])

    both = pairs.join(right, "y").select("x", "y", "_ty").join(left, "x").select("x", "y", "_tx", "_ty")
    return both.mapInArrow(run, "x bigint, y bigint")


def components(links: DataFrame) -> DataFrame:
    """node and the least node (root) of its component, for every node of a link."""
    both = links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    roots = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("root")))
    links = cut(links.select("x", "y"))
    while True:
        # Pointer jumping, then each root hooks on to the least root next to any of its nodes.
        up = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        jumped = roots.join(up, roots["root"] == up["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"))
        rx = jumped.select(F.col("node").alias("x"), F.col("root").alias("rx"))
        ry = jumped.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        across = links.join(rx, "x").join(ry, "y").where(F.col("rx") != F.col("ry"))
        hooks = across.select(F.greatest("rx", "ry").alias("_h"), F.least("rx", "ry").alias("_to")).groupBy("_h").agg(F.min("_to").alias("_to"))
        new = cut(jumped.join(hooks, jumped["root"] == hooks["_h"], "left").select("node", F.coalesce("_to", "root").alias("root")))
        old = roots.select(F.col("node"), F.col("root").alias("_old"))
        moved = new.join(old, "node").where(F.col("root") != F.col("_old")).limit(1).count()
        roots = new
        if not moved:
            return roots


def _cut_path(high, low, depth: int, shift) -> tuple:
    """The two numbers of a path's prefix of ``depth`` values."""
    return (shift(high, BITS * max(0, PACKED - depth)), shift(low, BITS * (2 * PACKED - depth)) if depth > PACKED else low * 0)


def tries(texts: DataFrame) -> DataFrame:
    """(x, tree, high, low): a row for each path of each text that has shingles."""
    paths = texts.where(F.col("n_shingles") > 0).select(F.col("_row").alias("x"), F.posexplode(F.arrays_zip("high", "low")).alias("tree", "_path"))
    return paths.select("x", "tree", "_path.high", "_path.low")


def centre_pairs(paths: DataFrame, forest: Forest) -> DataFrame:
    """(x, y, step) from stored ``paths``: texts with the centres of their nodes, and the first step in which they meet.

    Step 0 is the full depth of the first trees; steps 1, 2, ... are all trees at the full depth and at prefixes shortened by one more each.
    A node that ranges cut has a centre in each.  A range's first and last texts, whose node may go on beyond it, come with themselves too,
    so every text of a node of several texts is named.
    """
    depths = list(range(forest.depth, forest.short - 1, -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centres, end = None, {}, None
        for batch in batches:
            x, tree, high, low = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(x):
                continue
            rows, found, above = np.arange(len(x)), [], x
            for k, depth in enumerate(depths):
                up, down = _cut_path(high, low, depth, np.right_shift)
                begins = np.ones(len(x), bool)
                begins[1:] = (tree[1:] != tree[:-1]) | (up[1:] != up[:-1]) | (down[1:] != down[:-1])
                begins[0] = last is None or last[depth] != (tree[0], up[0], down[0])
                start = np.maximum.accumulate(np.where(begins, rows, -1))
                centre = np.where(start >= 0, x[start], centres.get(depth, -1))
                centres[depth] = centre[-1]
                new = (centre != x) & (centre != above)
                step = np.where(tree[new] < FIRST_TREES, 0, 1) if k == 0 else np.full(new.sum(), k + 1)
                found.append((np.minimum(x[new], centre[new]), np.maximum(x[new], centre[new]), step))
                above = centre
            if last is None:
                found.append((x[:1], x[:1], np.full(1, BORDER)))
            end = x[-1:]
            last = {d: (tree[-1], *(h[0] for h in _cut_path(high[-1:], low[-1:], d, np.right_shift))) for d in depths}
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32))], names=["x", "y", "step"])
        if end is not None:
            yield pa.RecordBatch.from_arrays([pa.array(end), pa.array(end), pa.array([BORDER], pa.int32())], names=["x", "y", "step"])

    order = ["tree", "high", "low", "x"]
    met = paths.select("x", "tree", "high", "low").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "x bigint, y bigint, step int")
    return met.groupBy("x", "y").agg(F.min("step").alias("step"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose texts aren't in one class."""
    pairs = pairs.join(roots.select(F.col("node").alias("x"), F.col("root").alias("_x")), "x", "left").join(roots.select(F.col("node").alias("y"), F.col("root").alias("_y")), "y", "left")
    return pairs.where(F.coalesce("_x", "x") != F.coalesce("_y", "y")).select("x", "y")


def near(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Whether two sets have the similarity ``least``, as a 0/1 matrix (true on the diagonal of sets that share anything).

    Common shingles are counted by products of 0/1 matrices, some thousand shared shingles at a time.
    """
    sizes = np.array([len(s) for s in sets])
    names, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(names, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owners = (np.cumsum(count > 1) - 1)[column[shared]], owners[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owners = column[order], owners[order]
    columns = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, columns, 4096):
        part = slice(*np.searchsorted(column, [at, at + 4096]))
        held = np.zeros((len(sets), min(4096, columns - at)), np.float32)
        held[owners[part], column[part] - at] = 1
        both += held @ held.T
    return (both >= least * (sizes[:, None] + sizes[None, :] - both) - 1e-6) & (both > 0)


#: A text of a cell: x, root, block and the text.
Cell = list[tuple[int, int, int, str]]


def cell_links(rows: Cell, least: float, across: bool) -> list[tuple[int, int]]:
    """Links among the rows that join roots not joined yet; only between the two blocks if ``across``."""
    linked = near([shingle_set(r[3]) for r in rows], least)
    roots, blocks = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    linked &= roots[:, None] != roots[None, :]
    if across:
        linked &= blocks[:, None] != blocks[None, :]
    above = {int(r): int(r) for r in roots}

    def top(r: int) -> int:
        while above[r] != r:
            above[r] = r = above[above[r]]
        return r

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = top(int(roots[i])), top(int(roots[j]))
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])))
    return out


def cell_counts(rows: Cell, least: float, across: bool) -> list[tuple[int, int]]:
    """Each row's number of links in the cell; only those between the two blocks if ``across``."""
    linked = near([shingle_set(r[3]) for r in rows], least)
    np.fill_diagonal(linked, False)
    if across:
        blocks = np.array([r[2] for r in rows])
        linked &= blocks[:, None] != blocks[None, :]
    return [(r[0], n) for r, n in zip(rows, linked.sum(axis=1).tolist(), strict=True) if n]


def over_cells(members: DataFrame, whole: DataFrame, compute, fields: str, least: float, block_texts: int, block_shingles: int) -> DataFrame:
    """``compute(rows, least, across)`` over the cells of groups, from stored ``members`` (x, root, group, n_shingles).

    A group is cut into blocks, and every pair of blocks is one cell, whose pairs are compared inside one task and never written out.
    """
    blocks = F.ceil(F.greatest(F.count("*") / block_texts, F.sum("n_shingles") / block_shingles)).cast("int")
    sizes = cut(members.groupBy("group").agg(blocks.alias("blocks"), F.count("*").alias("n")))
    placed = join_classes(members, sizes, ["group"], members.count()).join(whole.select(F.col("_row").alias("x"), "_text"), "x")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("x"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.select("group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "x", "root", "block", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            out = compute(held, least, now[1] != now[2])
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=names)

        now, held = None, []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != now:
                    if held:
                        yield made()
                    now, held = r[:3], []
                held.append(r[3:])
        if held:
            yield made()

    names = [f.split()[0] for f in fields.split(", ")]
    return cells.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "x").mapInArrow(run, fields)


def cross_links(texts: DataFrame, paths: DataFrame, roots: DataFrame, whole: DataFrame, short: int, least: float) -> DataFrame:
    """Links that join classes, from all pairs of texts of different classes that share a node at the depth ``short``.

    Texts of nodes that hold several classes are gathered into groups (nodes that share a text are one group), compared in cells.
    """
    key = ["tree", "up", "down"]
    up, down = _cut_path(F.col("high"), F.col("low"), short, F.shiftright)
    nodes = paths.select("x", "tree", up.alias("up"), down.alias("down"))
    nodes = cut(nodes.join(roots.withColumnRenamed("node", "x"), "x", "left").select("x", *key, F.coalesce("root", "x").alias("root")))
    open_ = cut(nodes.groupBy(*key).agg(F.min("x").alias("y"), F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("n")).where(F.col("_a") != F.col("_b")).select(*key, "y", "n"))
    left = cut(join_classes(nodes, open_, key, nodes.count()).select("x", "root", "y").distinct())
    groups = components(left.where(F.col("x") != F.col("y")).select("x", "y").distinct()).select(F.col("node").alias("x"), F.col("root").alias("group"))
    members = cut(left.select("x", "root").distinct().join(groups, "x").join(texts.select(F.col("_row").alias("x"), "n_shingles"), "x"))
    return over_cells(members, whole, cell_links, "x bigint, y bigint", least, BLOCK_TEXTS, BLOCK_SHINGLES)


def link_counts(texts: DataFrame, roots: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """_first and n_links: how many other texts each text of a class is linked to, from all pairs inside the class."""
    members = cut(roots.join(texts.select(F.col("_row").alias("node"), "n_shingles"), "node").select(F.col("node").alias("x"), "root", F.col("root").alias("group"), "n_shingles"))
    counts = over_cells(members, whole, cell_counts, "x bigint, n bigint", least, COUNT_TEXTS, COUNT_SHINGLES)
    return counts.groupBy(F.col("x").alias("_first")).agg(F.sum("n").alias("n_links"))


def join_similar(docs: DataFrame, least: float = LEAST, recall: float = RECALL, keep: list[str] | None = None, text: str = "text", id_col: str = "doc_id", trees: int = TREES, depth: int = DEPTH, counted: bool = True) -> DataFrame:
    """``docs`` (a stored table) with class_id, class_row, n_links, n_copies and whether the row is its class's first.

    Unless ``counted``, the links aren't counted and n_links is null.
    """
    settle(docs.sparkSession)
    added = ("class_id", "class_row", "n_links", "n_copies", "is_first")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = numbered(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, id_col])], F.col(text).cast("string").alias("_text")))
    forest = Forest(trees, depth, least, recall)
    paths = cut(annotate(rows, forest.compute, FIELDS, ["_row"], "_text"))
    n = paths.count()
    solid = paths.where(F.col("n_shingles") > 0)
    classes = cut(solid.groupBy("a", "b").agg(F.min("_row").alias("_first"), F.count("*").alias("n")))
    # One row of each text goes on; texts that occur once need no join.
    member = cut(paths.where(F.col("n_shingles") == 0).select("_row", F.col("_row").alias("_first"), F.lit(1).cast("long").alias("n")).unionByName(join_classes(solid.select("_row", "a", "b"), classes, ["a", "b"], n).select("_row", "_first", "n")))
    texts = paths.join(member.where(F.col("_row") == F.col("_first")).select("_row"), "_row", "left_semi")
    trie = cut(tries(texts))
    met = cut(centre_pairs(trie, forest))
    # Only texts that share a node with another are compared from here on.
    named = cut(met.select(F.explode(F.array("x", "y")).alias("_row")).distinct())
    whole = cut(rows.select("_row", "_text").join(named, "_row", "left_semi"))
    links = cut(verify(met.where("step = 0").select("x", "y"), whole, least))
    roots = components(links)
    for step in range(1, forest.depth - forest.short + 2):
        left = cut(apart(met.where(F.col("step") == step), roots))
        new = cut(verify(left, whole, least))
        if new.limit(1).count():
            links = cut(links.unionByName(new))
            roots = components(links)
    links = cut(links.unionByName(cross_links(texts, trie, roots, whole, forest.short, least)).distinct())
    roots = components(links)
    facts = roots.withColumnRenamed("node", "_first")
    if counted:
        facts = facts.join(link_counts(texts, roots, whole, least), "_first")
    none = F.lit(0 if counted else None).cast("long")
    heads = rows.select(F.col("_row").alias("class_row"), F.col(id_col).alias("class_id"))
    found = member.join(facts, "_first", "left").select("_row", F.coalesce("root", "_first").alias("class_row"), (F.coalesce("n_links", none) if counted else none).alias("n_links"), F.col("n").alias("n_copies"))
    # A class has one head, and heads carry an id only, so this join moves no texts.
    found = found.join(heads, "class_row")
    out = rows.drop("_text").join(found, "_row")
    return out.select(*[F.col(f"`{c}`") for c in kept], "class_id", "class_row", "n_links", "n_copies", (F.col("class_row") == F.col("_row")).alias("is_first"))


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """The first document of each class, as it was.  Only ids move until the last join."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_t"), F.lit(0).alias("_id"))
    return join_similar(named, text="_t", id_col="_id", keep=["_doc"], counted=False, **options).where("is_first").select("_doc.*")
