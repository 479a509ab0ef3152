"""What operators need of the session: the shared folder, lineage cuts, and the package on local workers."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only where that is unset, one under the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a Parquet table in the shared folder and read it; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def find_package(spark: SparkSession) -> None:
    """Let local Python workers find this package.  On a cluster it comes with the application (``--py-files`` or PYTHONPATH)."""
    top, environment = str(Path(__file__).parent.parent), spark.sparkContext.environment
    if top not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, (top, environment.get("PYTHONPATH"))))
