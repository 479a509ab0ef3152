"""The opN queries over a small set of tables, each column against brute force or the query's SQL; awkward rows in all of them."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tallyforge.llm import pii, quality, queries

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    shared = prose(77, 60)
    texts = [prose(i, 50) for i in range(10)] + [prose(3, 50), f"{prose(20, 30)}\n{shared}\n{prose(21, 20)}", f"{shared}\n{prose(22, 9)}", "", None, "  \n ", "ünï 漢字 🙂 <|endoftext|>  x"]
    texts += ["Released under the MIT License. GNU General Public License, CC BY and Apache License", "a@b.co 0000000010.0.0.1 10.0.0.256 4111 1111 1111 1111 +1 (499) 555-6503 " + "0" * 6000 + "1.2.3.4", "token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\"", prose(5, 30) + " " + " ".join(prose(900, 40).split()[3:20])]
    texts += ["word " * 400_000 + prose(44, 80), prose(44, 80)]
    docs = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/{name}.parquet")
    write(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint", "documents")
    write([(1, prose(900, 40)), (2, "a b"), (3, None), (4, "...")], "item_id bigint, text string", "benchmark")
    write([(i, i % 2, 0) for i in range(10)], "doc_id bigint, quality int, toxic int", "labels")
    r = np.random.default_rng(4)
    write([(i, [float(x) for x in r.normal(0, 0.2, 8)]) for i in range(120)] + [(None, [0.1] * 8), (200, None)], "vec_id bigint, embedding array<double>", "embeddings")
    return base, texts


def rows(spark, sf, query):
    return {r["doc_id"]: r for r in query(spark, sf[0]).collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op2_columns(spark, sf):
    raw = [(t or "").encode() for t in sf[1]]
    seen = {}
    for x in raw:
        for i in range(len(x) - 199):
            seen[x[i : i + 200]] = seen.get(x[i : i + 200], 0) + 1
    got = rows(spark, sf, queries.op2_suffix_array_dedup)
    for d, x in enumerate(raw):
        mark = np.zeros(len(x) + 2, int)
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                mark[i + 1] += 1
                mark[i + 201] -= 1
        gone = np.cumsum(mark)[1 : len(x) + 1] > 0
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == (len(x), int(gone.sum()), runs, sha(kept)), d


def test_op3_columns(spark, sf):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    for d, r in rows(spark, sf, queries.op3_token_counts).items():
        t = sf[1][d] or ""
        n = len(whole.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024), d


def test_op4_columns(spark, sf):
    for d, r in rows(spark, sf, queries.op4_quality_classifier).items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op4_table_is_the_softmax_model():
    texts, labels = [prose(i, 20).encode() for i in range(30)], [i % 2 for i in range(30)]
    model, seen = quality.train(texts, labels, 300), []
    for t in texts:
        ids, _ = quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        seen.append(1 / (1 + np.exp(-(model["table"][ids].mean() + model["bias"]))))
    import pyarrow as pa

    assert np.allclose(seen, quality.score(model, pa.array([t.decode() for t in texts])), atol=1e-5)


def test_op6_columns(spark, sf):
    got = rows(spark, sf, queries.op6_mix_sources)
    sizes = {d: len(SOLID.findall(t or "")) for d, t in enumerate(sf[1])}
    source = {d: None if d % 5 == 0 else f"s{d % 3}" for d in sizes}
    total = {}
    for d, n in sizes.items():
        total[source[d]] = total.get(source[d], 0) + n
    for d, r in got.items():
        assert (r["size"], r["source_size"]) == (sizes[d], total[source[d]]) and 0 <= r["taken"] <= 3 * r["size"]
        assert (r["first_slot"] is None) == (r["taken"] == 0)
    for s in total:
        assert sum(r["taken"] for d, r in got.items() if source[d] == s) == round(next(r["target"] for d, r in got.items() if source[d] == s))


def brute_personal(t):
    found = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end(), "card"))
    found += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(found)


def test_op7_columns(spark, sf):
    for d, r in rows(spark, sf, queries.op7_personal_data).items():
        want = brute_personal(sf[1][d] or "")
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[3] == k for x in want) for k in pii.BASE], d
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in want))
        spans = [x for x in r["spans"].split(",") if x]
        assert {f"{k}:{a}:{b}" for a, _, b, k in want} <= set(spans) and r["n_found"] == len(spans)
    assert pii.added_spans("plain words only", [], pii.train()) == []


def test_loopy_marginals_are_exact_on_trees():
    """A chain without repeats is a tree: messages give the marginals that summing over all labellings gives."""
    text = "call 555-123-4567 12 9.5 x1y2z3"
    graph, n = pii.Graph(text, []), len(pii.LABELS)
    model, size = pii.train(), len(pii.Graph(text, []).units)
    own = graph.matrix @ model["node"]
    total = np.zeros((size, n))
    for labels in np.ndindex(*[n] * size):
        score = np.exp(sum(own[i, y] for i, y in enumerate(labels)) + sum(model["pair"][k, labels[a], labels[b]] for a, b, k in graph.edges))
        for i, y in enumerate(labels):
            total[i, y] += score
    assert np.allclose(pii.marginals(graph, model)[0], total / total.sum(1, keepdims=True), atol=1e-3)


def test_skip_edges_carry_labels():
    """Over generated texts with repeats that have no cue, the field finds more with its skip edges than without."""
    random_, model = np.random.default_rng(99), pii.train()
    flat = {**model, "pair": model["pair"] * np.array([1.0, 0.0])[:, None, None]}
    found = {True: 0, False: 0}
    for _ in range(250):
        text, spans = pii.written(random_)
        base = pii.base_spans(text)
        for skip, m in ((True, model), (False, flat)):
            got = pii.added_spans(text, base, m)
            found[skip] += sum(any(a < e and s < b and k == kind for a, b, k in got) for s, e, kind in spans)
    assert found[True] > found[False]


def test_op8_columns(spark, sf):
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    for d, r in rows(spark, sf, queries.op8_license_scan).items():
        w = WORDS.findall((sf[1][d] or "").encode().lower())
        places = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split()]
        at = [i for i, _ in places]
        labels = sorted({k for _, k in places})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(labels)), d
        assert set(labels) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op5_maxscore_top_k", "op9_line_dedup", "op10_decontaminate"])
def test_queries_match_their_sql(spark, sf, name, tmp_path):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        # The SQL lists every shingle of a text, so the text of 400,000 words stays out here; the other tests have it.
        rows = spark.read.parquet(f"{sf[0]}/{t}.parquet")
        (rows.where("text is null or length(text) < 1000000") if t == "documents" else rows).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = queries.queries()[name](spark, str(tmp_path))
    result = con.execute(queries.oracle_sql()[name])
    names, columns = [c[0] for c in result.description], sorted(got.columns)
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[names.index(c)] for c in columns]) for r in result.fetchall())


def test_pipeline_with_awkward_columns(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "documents":
            extra = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (7, "two words", None, None, 9), (7, "two words", None, None, 9)], table.schema)
            table = table.unionByName(extra).selectExpr("*", "doc_id as _row", "doc_id as _quality", "doc_id as mix_size", "doc_id as _doc", "doc_id as size")
        table.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert got and {"_row", "_quality", "_doc", "size", "mix_size", "mix_slot"} <= set(out.columns)
    assert all(r["_row"] == r["doc_id"] == r["_quality"] == r["_doc"] == r["size"] for r in got) and all(r["mix_taken"] > 0 for r in got)
    os.makedirs(tmp_path / "none")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
