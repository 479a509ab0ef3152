"""The queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, licenses, lines, mixing, neardup, pii, quality, suffix, tokens, topk
from tallyforge.llm.common import table

#: The tokenizer file that op3 takes; any byte-level BPE file of the tokenizers library does.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.join_similar(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "class_id", "n_links", "n_copies")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.learned(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    held = F.coalesce(quality.fold(F.col("doc_id")) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[1]


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    of_kind = lambda k: F.filter("spans", lambda s: s["base"] & (s["kind"] == k))
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_found"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("matches", lambda m: m["label"].isin(*licenses.BASE))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"].cast("long"))
    strongest = F.array_max(F.transform("matches", lambda m: m["mandatory"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels("matches").alias("labels"), F.least(F.lit(1.0), F.coalesce(strongest, F.lit(0)) / licenses.STRONG).alias("score"),
        labels(F.filter("matches", lambda m: m["accepts"])).alias("accepted"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lines.dedup_lines(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    made = (op1_ngram_jaccard_join, op2_suffix_array_dedup, op3_token_counts, op4_quality_classifier, op5_maxscore_top_k, op6_mix_sources, op7_personal_data, op8_license_scan, op9_line_dedup, op10_decontaminate)
    return {f.__name__: f for f in made} | {"pipeline": corpus_pipeline.run}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
with recursive texts as (select doc_id, {_WORDS} as w from documents),
copies as (select w, min(doc_id) as first_id, count(*) as n from texts where len(w) > 0 group by w),
shingle as (
  select distinct first_id, array_to_string(w[i : i + 4], ' ') as s
  from (select first_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from copies)),
size as (select first_id, count(*) as n from shingle group by first_id),
link as (
  select x, y from (
    select a.first_id as x, b.first_id as y, count(*) as both_n
    from shingle a join shingle b on a.s = b.s and a.first_id <> b.first_id group by all)
  join size p on p.first_id = x join size q on q.first_id = y
  where both_n * 5 >= (p.n + q.n - both_n) * 4),
reach as (select x, x as root from link union select l.x, r.root from reach r join link l on l.y = r.x),
class as (select x, min(root) as root from reach group by x),
degree as (select x, count(*) as n_links from link group by x)
select t.doc_id, coalesce(c.root, k.first_id, t.doc_id) as class_id, coalesce(d.n_links, 0) as n_links, coalesce(k.n, 1) as n_copies
from texts t left join copies k on k.w = t.w left join class c on c.x = k.first_id left join degree d on d.x = k.first_id
"""

OP5_SQL = """
with rows as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from rows q join rows c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

OP9_SQL = """
with line as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as s, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from documents),
solid as (
  select *, length(s) as c, row_number() over (order by doc_id, i) as pos, row_number() over (partition by doc_id order by i) as p
  from line where regexp_matches(s, '[^\\x20\\x09-\\x0D]')),
total as (select *, sum(c) over (partition by doc_id order by p) as t from solid),
enough as (
  select a.doc_id, a.p, b.p as q from total a join total b on a.doc_id = b.doc_id and b.p between a.p + 1 and a.p + 100 and b.t - a.t + a.c >= 100),
span as (select doc_id, p, min(q) as q from enough group by doc_id, p union select doc_id, max(p), q from enough group by doc_id, q),
said as (
  select span.doc_id, span.p, span.q, min(pos) as pos, string_agg(s, chr(10) order by solid.p) as said
  from span join solid on solid.doc_id = span.doc_id and solid.p between span.p and span.q group by 1, 2, 3),
later as (select * from said qualify row_number() over (partition by said order by pos) > 1),
gone as (
  select solid.doc_id, i from later join solid on solid.doc_id = later.doc_id and solid.p between later.p and later.q
  union select doc_id, i from (select *, row_number() over (partition by s order by pos) as r from solid where c >= 200) where r > 1),
marked as (select l.doc_id, l.i, l.s, g.i is not null as gone, regexp_matches(l.s, '[^\\x20\\x09-\\x0D]') as solid from line l left join gone g on g.doc_id = l.doc_id and g.i = l.i),
run as (select *, coalesce(lag(gone) over (partition by doc_id order by i), false) as before from marked where solid),
runs as (select doc_id, count(*) filter (gone and not before) as n_runs from run group by doc_id),
kept as (select doc_id, count(*) as n, count(*) filter (gone) as n_removed, coalesce(string_agg(s, chr(10) order by i) filter (not gone), '') as kept from marked group by doc_id)
select k.doc_id, case when d.text is null or d.text = '' then 0 else n end as n_lines, n_removed, coalesce(n_runs, 0) as n_runs, sha256(kept) as kept_sha256
from kept k join documents d using (doc_id) left join runs using (doc_id)
"""

OP10_SQL = f"""
with doc as (select doc_id, {_WORDS} as w from documents),
item as (select item_id, {_WORDS} as w from benchmark),
item_window as (
  select distinct item_id, least(len(w), 13) as size, array_to_string(w[i : i + 12], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from item where len(w) > 0)),
sizes as (select distinct size from item_window),
doc_window as (
  select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as s
  from (select doc_id, size, w, unnest(range(1, len(w) - size + 2)) as i from doc, sizes where len(w) >= size)),
found as (select d.doc_id, d.i, d.size, b.item_id from doc_window d join item_window b on b.size = d.size and b.s = d.s),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from found) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join hit using (doc_id) left join items using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op5_maxscore_top_k": OP5_SQL, "op9_line_dedup": OP9_SQL, "op10_decontaminate": OP10_SQL}
