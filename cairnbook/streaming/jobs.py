"""The durable queue as a stream with one state per key."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnbook.sources.tables import shared_folder

MOST = 4


def step(status: str, attempts: int, event: str) -> tuple[str, int]:
    """Next status and attempts: view queues, click claims, error fails (dead at the last attempt), others finish."""
    if event == "view" and status in ("", "done", "dead"):
        return "queued", 0
    if event == "click" and status == "queued":
        return "running", attempts
    if event == "error" and status == "running":
        return ("dead", attempts + 1) if attempts + 1 >= MOST else ("queued", attempts + 1)
    if event in ("purchase", "signup") and status == "running":
        return "done", attempts
    return status, attempts


def _fold(key, batches, state: GroupState):
    status, attempts, seen = state.get if state.exists else ("", 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for event in rows["event_type"]:
        status, attempts = step(status, attempts, event)
        seen += 1
    state.update((status, attempts, seen))
    yield pd.DataFrame({"document_id": [key[0]], "status": [status], "attempts": [attempts], "seen": [seen]})


def states(events: DataFrame) -> DataFrame:
    """A stream of (document_id, status, attempts, seen), one row per key and micro-batch."""
    return events.withColumnRenamed("user_id", "document_id").groupBy("document_id").applyInPandasWithState(_fold, "document_id long, status string, attempts int, seen long", "status string, attempts int, seen long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(spark: SparkSession, path: str, timeout: int = 3600) -> DataFrame:
    """All files of path through the stream (availableNow) into a table of the shared folder; the latest state of each key.

    A stream that has not ended after timeout seconds is stopped and raises TimeoutError: no part of a result is returned.
    """
    schema = spark.read.parquet(path).schema
    folder = f"{shared_folder(spark)}/job-states-{uuid.uuid4().hex}"
    # a stream reads folders: the file's own folder with its name as a glob
    base, _, leaf = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", leaf).option("recursiveFileLookup", "false").parquet(base) if leaf else spark.readStream.schema(schema).parquet(path)
    rows = states(source.select("event_id", "ts", "user_id", "event_type"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")  # the same batch again replaces itself

    out = rows.writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start()
    if not out.awaitTermination(timeout):
        out.stop()
        raise TimeoutError(f"the stream did not end in {timeout} s")
    table = spark.read.schema(rows.schema).parquet(f"{folder}/table")
    return table.groupBy("document_id").agg(F.max_by(F.struct("status", "attempts"), "seen").alias("r"), F.max("seen").alias("seen")).select("document_id", "r.status", "r.attempts", "seen")
