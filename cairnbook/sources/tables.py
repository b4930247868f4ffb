"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on one machine, where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.gettempdir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_partitions(df: DataFrame, name: str, *by: str, path: str | None = None) -> DataFrame:
    """Overwrite only the partitions that df holds, and return the table.  Default place: the shared folder."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
