"""Files that the driver and all executors can see, and small helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset (one machine, as in tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="cairnbook-")
    return _own[app]


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


#: By name, what empties the caches that this worker keeps from task to task.
held: dict[str, Callable[[], None]] = {}


def returned() -> None:
    """Memory that the worker has freed goes back to the system, as workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def trimmed(batches, uses: str = ""):
    """The batches; after the last one, freed memory is returned.  Before the first, held caches other than the one that the task uses are emptied."""
    if others := [held.pop(name) for name in list(held) if name != uses]:
        for empty in others:
            empty()
        returned()
    yield from batches
    returned()


def sliced(batches, rows: int = 1024):
    """Arrow batches in slices of at most so many rows, so that what a task makes of them stays small; trimmed."""
    for batch in trimmed(batches):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, mod modulus; -1 for a null id."""
    return F.coalesce(F.crc32(F.encode(col.cast("string"), "UTF-8")) % modulus, F.lit(-1))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
