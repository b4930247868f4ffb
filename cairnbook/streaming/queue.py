"""The durable queue as a stream with timers: leases run out, failures wait, and exhausted jobs are buried.

One job per document.  Requests are kept in state until the watermark has passed them, and are then taken in the order of
their instants, whatever order and micro-batch they came in; requests later than the watermark are dropped by Spark.  Between two
requests the job's own timer counts: a lease that ran out before the second is lost at the instant it ran out, not when
somebody asks.  So the log is the same for every way of cutting the input into micro-batches, and for a stream that was stopped and
started again.

    enqueue   a job that is new, done or dead is queued, due at once; another one is kept (duplicate)
    claim     a job that is queued and due runs, with one attempt more and a lease of LEASE
    renew     a running job's lease starts again; marked: its handler has noted that the pipeline ended
    fail      a running job is queued again after a delay that doubles with each attempt, or dead after the last one
    finish    a running job is done
    (timer)   a lease that runs out: queued and due at once; after the last attempt done if marked, else dead

A timer is registered for the earliest instant at which something can happen to a document, one at a time.  State lives in
the checkpoint of the stream.  A document's waiting requests are in memory while they are taken: those of one micro-batch and of the
watermark's delay, so that maxFilesPerTrigger bounds them.

Cases: a request that the job's state does not allow is logged as refused; requests of one instant are taken by id; a null document is a
key like any other; instants are whole milliseconds; requests newer than the last watermark stay in state and are not in the log.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairnbook.operators.lifecycle import MAX_ATTEMPTS
from cairnbook.sources.tables import shared_folder

#: The provider that timers and typed state need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEASE, DELAY, DELAY_MOST, LATE = 300, 30, 3600, 60
SCHEMA = "document_id long, at_ms long, event_id long, action string, status string, attempts int, until_ms long"


class Job(NamedTuple):
    """until: the end of the lease of a running job, the instant from which a queued one may be claimed, else None."""

    status: str = ""
    attempts: int = 0
    until: int | None = None
    marked: bool = False


class Limits(NamedTuple):
    """Milliseconds, and attempts."""

    lease: int
    delay: int
    delay_most: int
    attempts: int = MAX_ATTEMPTS


def request(job: Job, kind: str, marked: bool, at: int, limits: Limits) -> tuple[Job, str]:
    """The job after a request, and what was done."""
    if kind == "enqueue":
        return (Job("queued", 0, at), "queued") if job.status in ("", "done", "dead") else (job, "duplicate")
    if kind == "claim" and job.status == "queued" and job.until <= at:
        return Job("running", job.attempts + 1, at + limits.lease, job.marked), "claimed"
    if job.status == "running":
        if kind == "renew":
            return Job("running", job.attempts, at + limits.lease, job.marked or marked), "renewed"
        if kind == "finish":
            return Job("done", job.attempts), "finished"
        if kind == "fail":
            if job.attempts >= limits.attempts:
                return Job("dead", job.attempts), "buried"
            return Job("queued", job.attempts, at + min(limits.delay << (job.attempts - 1), limits.delay_most), job.marked), "retried"
    return job, "refused"


def lost(job: Job, limits: Limits) -> tuple[Job, str]:
    """A running job at the end of its lease."""
    if job.attempts < limits.attempts:
        return Job("queued", job.attempts, job.until, job.marked), "lease_lost"
    return (Job("done", job.attempts), "completed") if job.marked else (Job("dead", job.attempts), "lease_buried")


def advance(job: Job, waiting: list[tuple[int, int, str, bool]], upto: int, limits: Limits) -> tuple[Job, list[tuple], list[tuple]]:
    """Take the requests (instant, id, kind, marked) and ends of leases up to an instant: the job then, the log, the requests that still wait."""
    waiting = sorted(waiting)
    log, n = [], 0
    while True:
        due = waiting[n][0] if n < len(waiting) else upto + 1
        if job.status == "running" and job.until <= min(due, upto):
            at = job.until
            job, action = lost(job, limits)
            log.append((at, None, action, *job[:3]))
        elif due <= upto:
            at, event, kind, marked = waiting[n]
            job, action = request(job, kind, marked, at, limits)
            log.append((at, event, action, *job[:3]))
            n += 1
        else:
            return job, log, waiting[n:]


class Queue(StatefulProcessor):
    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, until long, marked boolean")
        self.waiting = handle.getListState("waiting", "at long, id long, kind string, marked boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.waiting.appendList(list(zip(batch["at"].tolist(), batch["event_id"].tolist(), batch["kind"].tolist(), batch["marked"].tolist(), strict=True)))
        yield from self._take(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._take(key, timerValues)

    def _take(self, key, timer_values) -> Iterator[pd.DataFrame]:
        job = Job(*self.job.get()) if self.job.exists() else Job()
        after, log, rest = advance(job, [tuple(r) for r in self.waiting.get()], timer_values.getCurrentWatermarkInMs(), self.limits)
        self.job.update(tuple(after))
        if log or not rest:
            self.waiting.put(rest) if rest else self.waiting.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        next_ = [r[0] for r in rest[:1]] + ([after.until] if after.status == "running" else [])
        if next_:
            self.handle.registerTimer(min(next_))
        if log:
            columns = list(zip(*log, strict=True))
            out = pd.DataFrame({name: pd.array(values, dtype=kind) for name, values, kind in zip(("at_ms", "event_id", "action", "status", "attempts", "until_ms"), columns, ("Int64", "Int64", "object", "object", "Int32", "Int64"), strict=True)})
            out.insert(0, "document_id", pd.array([key[0]] * len(out), dtype="Int64"))
            yield out

    def close(self) -> None:
        pass


def log(requests: DataFrame, lease: float = LEASE, delay: float = DELAY, delay_most: float = DELAY_MOST, late: float = LATE) -> DataFrame:
    """A stream of SCHEMA, one row for each request and each lease that ran out, once the watermark (late seconds behind) has passed it.

    requests: a stream of document_id, event_id, ts, kind, marked; seconds for all times.
    """
    limits = Limits(int(lease * 1000), int(delay * 1000), int(delay_most * 1000))
    rows = requests.withWatermark("ts", f"{late} seconds").withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("document_id").transformWithStateInPandas(Queue(limits), SCHEMA, "Append", "EventTime")


def drain(rows: DataFrame, folder: str, timeout: int = 3600, batches: int | None = None, progress: list | None = None) -> DataFrame:
    """All that the stream's source holds now, appended to a table of the folder; run again, it goes on where the folder's checkpoint stands.

    batches: stop after so many micro-batches (as a process that ends does).  progress: gets what Spark reports of each.  A stream that has not ended after timeout seconds is stopped and
    raises TimeoutError.
    """
    spark = rows.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)

    class Stopped(Exception):
        pass

    def keep(batch: DataFrame, number: int) -> None:
        if batches is not None and number >= batches:
            raise Stopped(f"stopped before batch {number}")
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")  # the same batch again replaces itself

    try:
        out = rows.writeStream.outputMode("append").foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start()
        try:
            if not out.awaitTermination(timeout):
                out.stop()
                raise TimeoutError(f"the stream did not end in {timeout} s")
        except Exception as error:
            if batches is None or "stopped before batch" not in str(error):
                raise
        if progress is not None:
            progress += out.recentProgress
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return spark.read.schema(rows.schema).parquet(f"{folder}/table/batch=*")


def requests_of(spark: SparkSession, path: str, kinds: dict[str, str], marked: float, files: int | None = None) -> DataFrame:
    """The events of a Parquet file or folder as a stream of requests; an event's value of at least marked notes the pipeline's end."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    base, _, leaf = path.rstrip("/").rpartition("/")
    source = reader.option("pathGlobFilter", leaf).parquet(base) if leaf.endswith(".parquet") else reader.parquet(path)
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    return source.select(F.col("user_id").alias("document_id"), "event_id", F.timestamp_millis(F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)")).alias("ts"), kind.alias("kind"), (F.col("value") >= marked).alias("marked"))


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/queue-{uuid.uuid4().hex}"
