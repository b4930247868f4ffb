"""Idempotent requests as a stream: repeats within the watermark go at once, conflicts are told by their digests.

A request is a key and a digest of what it asks.  Spark keeps each pair of them for as long as the watermark allows and lets its repeats
pass no further (dropDuplicatesWithinWatermark); what it lets pass is appended to a table, and a key with one digest there is sound, one
with more a conflict.  A pair that comes again after its state is gone passes once more and changes nothing.  Requests later than the
watermark are dropped by Spark and counted.

Cases: null keys and digests are values; a key's requests may come in any order and in any micro-batches; no requests give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.streaming.queue import drain


def passed(requests: DataFrame, late: float) -> DataFrame:
    """The stream without repeats; requests: a stream of key, digest and ts."""
    return requests.select("key", "digest", "ts").withWatermark("ts", f"{late} seconds").dropDuplicatesWithinWatermark(["key", "digest"]).select("key", "digest")


def outcomes(requests: DataFrame, folder: str, late: float, timeout: int = 3600) -> tuple[DataFrame, int]:
    """key, digests, outcome (stored or conflict) of all that the stream's source holds, and the number of requests that came too late."""
    progress: list = []
    table = drain(passed(requests, late), folder, timeout, progress=progress)
    dropped = sum(int(o["numRowsDroppedByWatermark"]) for p in progress for o in p["stateOperators"])
    digests = F.count_distinct(F.coalesce(F.concat(F.lit("="), "digest"), F.lit("-")))
    return table.groupBy("key").agg(digests.alias("digests")).withColumn("outcome", F.when(F.col("digests") > 1, "conflict").otherwise("stored")), dropped
