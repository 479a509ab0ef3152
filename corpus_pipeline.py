"""From raw documents to a mix: the stages of a training-data pipeline, each one operator of ``tallyforge.llm``.

Each stage gets the Parquet table that its predecessor wrote, and returns the columns of ``documents``; the last adds what
the mix takes of each document.  Stages treat nulls, empty texts and repeated rows as their operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, lines, mixing, neardup, quality
from tallyforge.llm.common import cut, fresh, numbered, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; the model learns from the labels of this run's documents."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "_quality")
    return quality.classify(docs, model, name=score).where(F.col(f"`{score}`") >= quality.THRESHOLD).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted.  A document that nothing is left of goes; a null or blank one stays as it was."""
    got = lines.dedup_lines(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("text")))
    left = got.where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") == 0, F.col("_doc.n_chars")).otherwise(F.length("text").cast("long"))}
    return left.select(*[changed[c].alias(c) if c in changed else F.col(f"_doc.`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each class of similar texts."""
    return neardup.drop_similar(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes any word, with the words it takes (repeats counted)."""
    added = {"size": "mix_size", "target": "mix_target", "taken": "mix_taken", "first_slot": "mix_slot"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added.values()])
    row = fresh(docs, "_row")
    taken = mixing.mix(numbered(docs, row), keep=[row])[1].where(F.col("taken") > 0)
    return numbered(docs, row).join(taken.select(row, *[F.col(c).alias(a) for c, a in added.items()]), row).drop(row)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources", mix_sources),
]

#: SQL can't express the trained classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder, until the application ends, and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
