"""Streaming ingest: micro-batches of observations, appended once each to a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import shared_folder


def append_new(batch: DataFrame, path: str, keys: list[str]) -> None:
    """Append the batch's rows that neither it nor the table had before.

    A replayed batch finds its rows in the table, so a failure between write and commit repeats nothing.  Checking against the
    table keeps no state in the stream.
    """
    spark, new = batch.sparkSession, batch.dropDuplicates(keys)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        new = new.join(spark.read.schema(batch.schema).parquet(path).select(*keys), keys, "left_anti")
    new.write.mode("append").parquet(path)


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of observations, all that is there, into a table that is read back."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{sf_dir}/")
    rows = events.where(F.col("event_id").isNotNull()).select(F.col("event_id").alias("n"), F.col("event_type").alias("account_ref"), F.round(F.col("value") * 100).cast("bigint").alias("amount"))
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    running = rows.writeStream.foreachBatch(lambda batch, _: append_new(batch, f"{base}/table", ["n"])).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/table")
