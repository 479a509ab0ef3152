"""What the training-data operators share: row numbers, lineage cuts and session settings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.session import cut, find_package, shared_folder

__all__ = ["annotate", "cut", "fresh", "join_classes", "numbered", "settle", "shared_folder", "shuffle_parts", "table"]
#: Rows in an Arrow batch; texts can be long, so fewer than Spark's default.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(spark: SparkSession) -> None:
    """Keep Arrow batches small (a smaller setting of the session stays), and let local workers find this package."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    find_package(spark)


#: Classes that are joined by broadcast hold over 1/HOT of all rows each, so there are fewer than HOT of them.
HOT = 1000


def join_classes(facts: DataFrame, classes: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Inner join of many rows with their classes, which have a row each and a count ``n``.

    A class that holds over a HOT-th of all ``rows`` would make one slow task, so such classes (fewer than HOT, whatever the
    data) are broadcast; the rest, none of which is large, is shuffled.  Both inputs have to be stored tables.
    """
    limit = max(HOT, rows // HOT)
    hot, cold = F.broadcast(classes.where(F.col("n") > limit)), classes.where(F.col("n") <= limit)
    if rows <= limit:
        return facts.join(classes, keys)
    return facts.join(hot, keys).unionByName(facts.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """Number rows by partition and place.

    Repeated ``doc_id`` values and null ones stay apart.  The numbers are the same in every scan of one stored table;
    results of earlier steps have to be stored (or checkpointed) first, as the pipeline does.
    """
    return docs.withColumn(name, F.monotonically_increasing_id())


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or with as many underscores more as make it the name of no column (in any case) of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def annotate(docs: DataFrame, compute, fields: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Add the columns ``fields`` (DDL), which ``compute(texts)`` gives for each Arrow batch of the text column.

    ``keep`` names the input columns that stay (all by default).  An input column that bears the name of an added one
    is replaced.  ``compute`` gets a string array, nulls included, and returns one Arrow array for each field.
    """
    settle(docs.sparkSession)
    added = T.StructType.fromDDL(fields)
    names = {f.name for f in added}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_text"))
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [a.cast(f.type) if a.type != f.type else a for a, f in zip(compute(batch.column(len(kept))), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=[*kept, *arrow.names])

    return source.mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], *added.fields]))
