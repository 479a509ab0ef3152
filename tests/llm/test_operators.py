"""Operators against brute force on small fixtures, with the awkward cases: nulls, empties, ties, repeats, clashing columns."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, licenses, lines, mixing, neardup, pii, quality, suffix, tokens, topk

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    base = [prose(i, 60) for i in range(8)]
    near = base[0].split()
    near[30] = "changed"
    rows = [*base, base[1], " ".join(near), None, "", " \n\t", "é ünï 漢字 <|endoftext|>  x", prose(99, 4000), "a b", "a b", base[2] + "\n" + base[3], "Licensed under the Apache License, Version 2.0.", "call +1 (499) 555-6503 or x.y@mail.example.com 10.0.0.1 or 4111 1111 1111 1111"]
    data = [(i if i != 5 else None, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None) for i, t in enumerate(rows)]
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return [r["text"] for r in docs.collect()]


def test_repeated_bytes(docs, empty):
    raw = [(t or "").encode() for t in texts(docs)]
    seen = {}
    for x in raw:
        for i in range(len(x) - 199):
            seen[x[i : i + 200]] = seen.get(x[i : i + 200], 0) + 1
    for x, got in zip(raw, suffix.remove_repeats(docs.withColumn("kept", F.lit(1)).withColumn("_i", F.monotonically_increasing_id()), ["_i", "kept"]).orderBy("_i").collect(), strict=True):
        mark = np.zeros(len(x) + 1, int)
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                mark[i] += 1
                mark[i + 200] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        assert bytes(got["kept"]) == bytes(np.frombuffer(x, np.uint8)[~gone]) and got["n_bytes"] == len(x)
    assert suffix.remove_repeats(empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize("shard", [1 << 30, 1500])
def test_shards_merge(shard):
    r = random.Random(3)
    text = bytes(r.choice(b"ab") for _ in range(900))
    segments = sorted((r.choice([1, 2]), i, 1, text[a : a + r.randint(200, 300)]) for i in range(30) for a in [r.randint(0, 600)])
    got = {(g, c): {i for a, b in s for i in range(a, b)} for g, c, s in suffix.repeated_windows(segments, shard)}
    for g, c, _, x in segments:
        others = [y[i : i + 200] for h, _, _, y in segments if h == g for i in range(len(y) - 199)]
        assert got.get((g, c), set()) == {i for i in range(len(x) - 199) if others.count(x[i : i + 200]) > 1}


def test_token_counts(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    got = tokens.count_tokens(docs.withColumn("n_tokens", F.lit("clash")), path, keep=["n_tokens"]).collect()
    assert [r["n_tokens"] for r in got] == [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts(docs)]
    assert tokens.count_tokens(empty, path).count() == 0


def test_pre_tokens_agree_with_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer
    for c in map(chr, range(0x3000)):
        if not tokens.UNSURE.match(c):
            s = f"a {c}{c}1 {c}!"
            assert tokens.pre_tokens().findall(s) == [s[a:b] for _, (a, b) in cut.pre_tokenize_str(s)], hex(ord(c))


def test_decontamination(spark, docs, empty):
    items = [(1, " ".join(prose(0, 60).split()[5:25])), (2, "a b"), (3, None), (4, "..."), (5, prose(3, 60).upper())]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one, many = (decontaminate.find_hits(docs, bench, block_windows=n, keep=["doc_id"]).collect() for n in (10**6, 7))
    windows = {}
    for i, t in items:
        w = WORDS.findall((t or "").encode().lower())
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    want = []
    for t in texts(docs):
        w, hit, found = WORDS.findall((t or "").encode().lower()), set(), set()
        for x, ids in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found |= ids
        want.append((len(w), sorted(hit), sorted(found)))
    assert [(r["n_words"], r["hit_words"], r["hit_items"]) for r in one] == want
    assert sorted((r["n_words"], r["hit_words"], r["hit_items"]) for r in many) == sorted(want)
    assert decontaminate.find_hits(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    assert decontaminate.cut_spans(docs, bench).count() == docs.count()


def test_lines(spark, empty, tmp_path):
    long, short = prose(1, 60), "x y"
    rows = [f"{long}\n{short}\nend", f"{short}\n\n{long}", None, "", f"{long}\n{short}\nend", "\n\n"]
    spark.createDataFrame([(1, t, None, None, None) for t in rows], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "l"))
    got = lines.dedup_lines(spark.read.parquet(str(tmp_path / "l")).withColumn("n_runs", F.lit("clash"))).collect()
    assert sorted(map(str, (r["text"] for r in got))) == sorted(map(str, [rows[0], f"{short}\n", None, "", "", "\n\n"]))
    assert sorted((r["n_removed"] for r in got)) == [0, 0, 0, 0, 1, 3]
    assert lines.dedup_lines(empty).count() == 0


def test_whole_line_runs(spark, tmp_path):
    r = random.Random(11)
    pool = [prose(900 + i, r.choice([1, 1, 2, 4, 9, 14])) for i in range(12)]
    passage = [prose(700 + i, 8)[:40] for i in range(20)]
    rows = [[r.choice(pool) for _ in range(r.randint(1, 14))] for _ in range(40)] + [["u 1", *passage, "u 2"], ["u 3", "", *passage, "u 4"]]
    spark.createDataFrame([(i, "\n".join(x), None, None, None) for i, x in enumerate(rows)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "l"))
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(spark.read.parquet(str(tmp_path / "l"))).collect()}
    places = [(d, i) for d, x in enumerate(rows) for i, s in enumerate(x) if s]
    solid = [[s for s in x if s] for x in rows]
    at = [(d, i - sum(not s for s in rows[d][:i])) for d, i in places]
    gone, k = set(), len(places)
    for p in range(k):
        for q in range(p):
            (d, i), (e, j) = at[p], at[q]
            n = 0
            while i + n < len(solid[d]) and j + n < len(solid[e]) and solid[d][i + n] == solid[e][j + n]:
                n += 1
            if n >= 2 and sum(map(len, solid[d][i : i + n])) >= 100:
                gone.update(places[p : p + n])
    assert got == {d: "\n".join(s for i, s in enumerate(x) if (d, i) not in gone) for d, x in enumerate(rows)}
    assert got[len(rows) - 1] == "u 3\n\nu 4"


def test_near_copies(docs, empty):
    got = neardup.join_similar(docs, keep=["doc_id", "text"]).collect()
    sets = [neardup.shingle_set(r["text"]) for r in got]
    for i, a in enumerate(got):
        for j, b in enumerate(got[:i]):
            both, union = len(np.intersect1d(sets[i], sets[j])), len(np.union1d(sets[i], sets[j]))
            if union:
                assert (a["class_row"] == b["class_row"]) == (both >= 0.8 * union), (a["text"], b["text"])
            else:
                assert a["class_row"] != b["class_row"]
    assert sum(r["is_first"] for r in got) == len({r["class_row"] for r in got})
    assert neardup.join_similar(empty).count() == 0
    assert neardup.drop_similar(docs).columns == docs.columns


def test_centres_of_trie_nodes(spark):
    forest, r = neardup.Forest(trees=10, depth=8), random.Random(5)
    assert forest.short == neardup.adapted_depth(10, 8)
    forest.short = 3
    paths = [(x, t, [r.choice([7, 65535]) if d > 1 else t for d in range(8)]) for x in range(60) for t in range(10)]
    packed = lambda v: np.uint64(sum(n << (48 - 16 * i) for i, n in enumerate(v))).astype(np.int64).item()
    table = spark.createDataFrame([(x, t, packed(v[:4]), packed(v[4:])) for x, t, v in paths], "x bigint, tree int, high bigint, low bigint")
    met = neardup.centre_pairs(table.repartition(3), forest).collect()
    at = {(x, t): v for x, t, v in paths}
    named = {n for m in met for n in (m["x"], m["y"])}
    assert {a for a in range(60) if any(at[a, t][:3] == at[b, t][:3] for b in range(60) if a != b for t in range(10))} <= named
    assert all((m["x"] == m["y"]) == (m["step"] == neardup.BORDER) for m in met)
    met = [m for m in met if m["x"] != m["y"]]
    first = lambda a, b: min(0 if d == 8 and t < neardup.FIRST_TREES else 9 - d for t in range(10) for d in range(3, 9) if at[a, t][:d] == at[b, t][:d])
    assert met and all(m["x"] < m["y"] and m["step"] >= first(m["x"], m["y"]) for m in met)
    assert {m["step"] for m in met} >= {0, 2, 3, 4, 5, 6}
    # Within a range, a node's texts hang together; ranges here are few, so nearly all do at the least depth.
    above = list(range(60))
    for m in met:
        a, b = above[m["x"]], above[m["y"]]
        above = [min(a, b) if u in (a, b) else u for u in above]
    assert len(set(above)) <= 2
    with pytest.raises(ValueError):
        neardup.Forest(depth=9)


def test_pairs_just_over_the_limit_are_found(spark, tmp_path):
    r, rows, sets = random.Random(8), [], []
    for i in range(300):
        words = prose(3000 + i, 120).split()
        other = [*words[: 120 - (k := r.randint(8, 16))], *prose(9000 + i, k).split()]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        a, b = (set(neardup.shingle_set(t).tolist()) for _, t in rows[-2:])
        sets.append(len(a & b) / len(a | b))
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = {x["doc_id"]: x["class_row"] for x in neardup.join_similar(spark.read.parquet(str(tmp_path / "d")), keep=["doc_id"]).collect()}
    linked = {i for i in range(300) if got[2 * i] == got[2 * i + 1]}
    over = {i for i, x in enumerate(sets) if x >= 0.8}
    assert 50 < len(over) < 250 and linked <= over and len(linked) >= 0.99 * len(over)


def test_links_of_dense_classes_are_counted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neardup, "COUNT_TEXTS", 7)
    base, r, rows = prose(500, 80).split(), random.Random(1), []
    for i in range(40):
        words = list(base)
        for _ in range(r.randint(0, 2)):
            words[r.randrange(80)] = f"w{i}"
        rows.append((i, " ".join(words), None, None, None))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "d"))
    got = neardup.join_similar(spark.read.parquet(str(tmp_path / "d")), keep=["doc_id", "text"]).collect()
    sets = {r["text"]: set(neardup.shingle_set(r["text"]).tolist()) for r in got}
    linked = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    want = {t: sum(linked(s, o) for u, o in sets.items() if u != t) for t, s in sets.items()}
    assert {r["text"]: r["n_links"] for r in got} == want
    assert max(want.values()) > 10 and len(set(want.values())) > 3


def test_group_of_near_copies_by_cells():
    rows = []
    for i in range(40):
        w = prose(7, 100).split()
        w[i * 2] = f"w{i}"
        rows.append((i, i, i % 3, " ".join(w)))
    joined = neardup.cell_links(rows, 0.8, False)
    assert len(joined) == 39 and all(x < y for x, y in joined)
    assert neardup.cell_links(rows[:1], 0.8, False) == []


def test_quality(spark, docs, empty):
    good = [(i, prose(i, 40)) for i in range(120)]
    bad = [(1000 + i, " ".join(x + "%%%" for x in prose(i, 40).split())) for i in range(120)]
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in good + bad], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(table, labels, steps=2000)
    got = {r["doc_id"]: r["score"] for r in quality.classify(table, model, ["doc_id"]).collect()}
    held = [i for i, _ in good + bad if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i < 1000) for i in held]) > 0.95
    scores = [r["score"] for r in quality.classify(docs, model, ["doc_id"]).collect()]
    assert all(0 <= s <= 1 for s in scores) and len(scores) == docs.count()
    assert quality.fit(empty, labels.limit(0))["bias"] == 0 and quality.classify(empty, model).count() == 0


def test_quality_learns_past_a_text_that_does_not_fit(spark):
    rows = [(i, prose(i, 40) if i < 60 else " ".join(x + "%%%" for x in prose(i, 40).split()), None, None, None) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id bigint, quality int, toxic int")
    first = labels.where(quality.fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    table = spark.createDataFrame([(i, "long " * 20_000 if i == first else t, *x) for i, t, *x in rows], SCHEMA)
    model = quality.fit(table, labels, max_bytes=60_000, steps=2000)
    got = {r["doc_id"]: r["score"] for r in quality.classify(table, model, ["doc_id"]).collect()}
    assert np.mean([(got[i] >= 0.5) == (i < 60) for i in range(120) if i != first]) > 0.95


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 8)]) for i in range(60)]
    rows[7] = (7, rows[8][1])
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")] * 8), (103, []), (None, [0.1] * 8), (150, [0.0] * 8), (104, [0.5] * 3)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.search(table, F.col("vec_id") % 10 == 0, shard_rows=16).collect()}
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in whole if i % 10 == 0):
        scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    assert got == want
    assert topk.search(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    # Blocks of a few queries give the same; rows that share an id only are ranked apart; products beyond 64 bits are exact.
    few = {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.search(table, F.col("vec_id") % 10 == 0, query_bytes=100, shard_rows=7).collect()}
    assert few == want
    twice = table.unionByName(spark.createDataFrame([(10, [0.9] * 8)], table.schema))
    assert topk.search(twice, F.col("vec_id") == 10, shard_rows=16).count() == 10
    huge = spark.createDataFrame([(0, [1e17, 1e17]), (1, [-1e17, 1e17]), (2, [1.0, 0.0]), (3, [-1e17, -1e17])], table.schema)
    assert [(x["vec_id"], x["score"]) for x in topk.search(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(2, 256 * (2**63 - 1) if 256 * (2**63 - 1) < 2**63 else 2**63 - 1), (1, -(2**63 - 1)), (3, -(2**63))]


def test_mix(docs, empty):
    slots, taken = mixing.mix(docs)
    rows = taken.collect()
    assert sorted(r["size"] for r in rows) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts(docs))
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["mix_source"], [r["target"], 0, r["source_size"], 0])[1] += r["taken"]
        by[r["mix_source"]][3] += r["size"]
    for target, got, size, summed in by.values():
        assert size == summed and abs(got - target) <= 0.05 * target + 10
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs)[1].collect()))
    assert slots.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] == sum(r["taken"] for r in rows)
    assert mixing.mix(empty)[1].count() == 0
    assert mixing.targets({"a": 100, "b": 1, None: 0}) == {"a": 98.0, "b": 3.0, None: 0.0}


def test_taken_words_recomputed_from_the_slots(docs, monkeypatch, tmp_path):
    slots, taken = mixing.mix(docs.withColumn("taken", F.lit("clash")).withColumn("_row", F.monotonically_increasing_id()), keep=["_row", "taken"], id_col="_row")
    of = {}
    for r in slots.collect():
        assert 0 <= r["start"] < r["stop"]
        of[r["_row"]] = of.get(r["_row"], 0) + r["stop"] - r["start"]
    rows = taken.collect()
    assert {r["_row"]: r["taken"] for r in rows if r["taken"]} == of
    first = {}
    for r in slots.collect():
        first[r["_row"]] = min(r["slot"], first.get(r["_row"], r["slot"]))
    assert {r["_row"]: r["first_slot"] for r in rows if r["first_slot"] is not None} == first
    # Written in order, the mix has just those words.
    path = str(tmp_path / "mix")
    mixing.write_mix(slots, docs.withColumn("_row", F.monotonically_increasing_id()), path, id_col="_row")
    whole = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in enumerate(texts(docs))}
    laid = docs.sparkSession.read.parquet(path).collect()
    assert len(laid) == slots.count() and all(r["words"].split(" ") == whole[r["_row"]][r["start"] : r["stop"]] for r in laid)
    sizes = {}
    for r in rows:
        sizes[r["mix_source"]] = sizes.get(r["mix_source"], 0) + r["size"]
    want = mixing.targets(sizes)
    assert all(abs(r["target"] - want[r["mix_source"]]) < 1e-6 for r in rows)
    # The same where the sources are too many to broadcast.
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    again = mixing.mix(docs.withColumn("_row", F.monotonically_increasing_id()), keep=["_row"], id_col="_row")[1].collect()
    assert sorted((r["_row"], r["taken"]) for r in again) == sorted((r["_row"], r["taken"]) for r in rows)


def test_mix_of_huge_and_tiny_sources(spark, tmp_path):
    rows = [(i, "w " * 10_000, None, f"huge{i % 3}", None) for i in range(45)] + [(100 + i, "w " * (4 + i), None, f"tiny{i}", None) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "m"))
    slots, taken = mixing.mix(spark.read.parquet(str(tmp_path / "m")))
    by = {r["mix_source"]: r for r in taken.groupBy("mix_source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()}
    assert {s: r["taken"] for s, r in by.items()} == {s: round(r["target"]) for s, r in by.items()}
    assert all(by[f"tiny{i}"]["taken"] == 3 * (4 + i) for i in range(30))
    laid = slots.withColumn("n", F.col("stop") - F.col("start")).collect()
    of = {}
    for r in laid:
        of[r["source"]] = of.get(r["source"], 0) + r["n"]
        assert 0 <= r["epoch"] < 3 and r["n"] > 0
    assert of == {s: r["taken"] for s, r in by.items()}
    # Any stretch has nearly the target shares: here the first half.
    middle = len({r["slot"] for r in laid}) / 2
    for s in ("huge0", "huge1", "huge2"):
        assert abs(sum(r["n"] for r in laid if r["source"] == s and r["slot"] < middle) - of[s] / 2) < 0.02 * of[s]


BASE_PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
}


def test_personal_data(docs, empty):
    r = random.Random(4)
    for _ in range(3000):
        s = "".join(r.choice("a1.@@- %é\n2") for _ in range(r.randint(1, 25)))
        assert pii.emails(s) == [m.span() for m in BASE_PATTERNS["email"].finditer(s)]
        assert [m.span() for m in pii._IP.finditer(s)] == [m.span() for m in BASE_PATTERNS["ip"].finditer(s)]
    got = pii.find_personal(docs.withColumn("spans", F.lit(1)), ["doc_id", "spans"]).collect()
    assert {s["kind"] for x in got for s in x["spans"] if s["base"]} == {"email", "ip", "card", "phone"}
    text = "the token = 1eb9c654e721b4f812088970e66a6345cee33dd6 and later 1eb9c654e721b4f812088970e66a6345cee33dd6 again"
    assert [k for _, _, k in pii.added_spans(text, [], pii.train())] == ["secret", "secret"]
    assert pii.find_personal(empty).count() == 0


def test_evidence_reaches_every_repeat():
    text = "token x7y8z9w0" + " on the x7y8z9w0" * 49
    graph, n = pii.Graph(text, []), len(pii.LABELS)
    model = {"node": np.zeros((graph.matrix.shape[1], n)), "pair": np.array([np.zeros((n, n)), 8 * np.eye(n)])}
    model["node"][-1, -1] = 6
    assert len(graph.units) == 50 and (graph.edges[:, 2] == 1).all()
    # The repeats are a path, so its marginals are known: forward and backward sums.
    own, pair = np.exp(graph.matrix @ model["node"]), np.exp(model["pair"][1])
    there, back = [np.ones(n)], [np.ones(n)]
    for i in range(49):
        there.append((m := pair @ (there[-1] * own[i])) / m.sum())
        back.append((m := pair @ (back[-1] * own[49 - i])) / m.sum())
    want = own * np.array(there) * np.array(back[::-1])
    alone, _ = pii.marginals(graph, model)
    assert np.allclose(alone, want / want.sum(1, keepdims=True), atol=1e-3) and (alone.argmax(1) == n - 1).all() and (alone.max(1) > 0.5).all()


def test_licenses(docs, empty):
    got = [{(m["label"], m["start"]) for m in r["matches"]} for r in licenses.scan_licenses(docs.withColumn("matches", F.lit(1)), keep=["doc_id"]).collect()]
    for t, found in zip(texts(docs), got, strict=True):
        w = WORDS.findall((t or "").encode().lower())
        want = {(label, i) for label, p in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split()}
        assert {m for m in found if m[0] in licenses.BASE} == want
    one = licenses.Automaton("x", "a <<beginOptional>>b <<var;max=2>><<endOptional>> c")
    assert [one.longest(s.encode().split(), 0) for s in ("a c", "a b c", "a b x y c", "a b x y z c", "a x c")] == [2, 3, 5, -1, -1]
    assert licenses.scan_licenses(empty).count() == 0


def plain_text(markup, r, optional):
    """A text that a template accepts: optional regions in or out, some words for each replaceable one."""
    while "<<beginOptional>>" in markup:
        end = markup.index("<<endOptional>>")
        begin = markup.rindex("<<beginOptional>>", 0, end)
        inside = markup[begin + 17 : end] if optional(r) else " "
        markup = markup[:begin] + inside + markup[end + 15 :]
    return re.sub(r"<<var;max=(\d+)>>", lambda m: " ".join(f"name{i}" for i in range(r.randint(0, int(m.group(1))))), markup)


def test_whole_licences_are_accepted():
    r = random.Random(2)
    words = lambda t: WORDS.findall(t.encode().lower())
    scanner = licenses.Scanner(licenses.ALL)
    for label, markup in licenses.license_texts.TEXTS.items():
        for optional in (lambda _: True, lambda _: False, lambda r: r.random() < 0.5):
            text = words(plain_text(markup, r, optional))
            assert label in {m["label"] for m in scanner.matches(text) if m["accepts"]}, label
            found = {m["label"]: m for m in scanner.matches([b"before", *text, b"after"])}
            assert found[label]["stop"] > found[label]["start"] >= 1 and not found[label]["accepts"]
            # A mandatory word less, and the text is that licence no more.
            broken = list(text)
            broken.remove(licenses.Automaton(label, markup).anchor)
            assert label not in {m["label"] for m in scanner.matches(broken) if m["accepts"]} or broken.count(licenses.Automaton(label, markup).anchor)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert set(rows[0].asDict()) == {*docs.columns, "mix_size", "mix_target", "mix_taken", "mix_slot"}
    sets = [frozenset(neardup.shingle_set(r["text"]).tolist()) for r in rows]
    for i, a in enumerate(sets):
        assert all(len(a & b) < 0.8 * len(a | b) for b in sets[:i])
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    kept = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id bigint, text string")
    assert decontaminate.find_hits(kept, bench).where(decontaminate.is_contaminated()).count() == 0
