"""The queue with timers: out of order, cut anywhere, stopped and started again, against a fold in plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cairnbook.streaming import queue

KINDS = {"view": "enqueue", "click": "claim", "signup": "renew", "error": "fail", "purchase": "finish"}
START = dt.datetime(2024, 1, 1)
LIMITS = queue.Limits(600_000, 120_000, 300_000)


def events(n=400, keys=7, seed=2):
    rng = random.Random(seed)
    return [(i, START + dt.timedelta(seconds=20 * i), rng.choice([*range(keys), 0, 0, None]), rng.choices([*KINDS], [2, 4, 1, 3, 1])[0], rng.random() * 60) for i in range(n)]


def brute(rows, late):
    """Second by second: every instant of the whole time is looked at, for every key."""
    ms = lambda t: int((t - START).total_seconds() * 1000) + 1_704_067_200_000
    upto = max(ms(r[1]) for r in rows) - late * 1000
    out = []
    for key in {r[2] for r in rows}:
        status, attempts, until, marked = "", 0, None, False
        own = [(ms(r[1]), *r) for r in rows if r[2] == key and ms(r[1]) <= upto]
        for at in range(ms(START), upto + 1, 1000):
            if status == "running" and until == at:
                if attempts < 4:
                    status, action = "queued", "lease_lost"
                else:
                    status, action, until = ("done", "completed", None) if marked else ("dead", "lease_buried", None)
                marked = marked and status == "queued"
                out.append((key, at, None, action, status, attempts, until))
            for _, event, _, _, name, value in [r for r in own if r[0] == at]:
                kind, action = KINDS[name], "refused"
                if kind == "enqueue":
                    action = "duplicate"
                    if status in ("", "done", "dead"):
                        action, status, attempts, until, marked = "queued", "queued", 0, at, False
                elif kind == "claim" and status == "queued" and until <= at:
                    action, status, attempts, until = "claimed", "running", attempts + 1, at + LIMITS.lease
                elif status == "running" and kind == "renew":
                    action, until, marked = "renewed", at + LIMITS.lease, marked or value >= 30
                elif status == "running" and kind == "finish":
                    action, status, until, marked = "finished", "done", None, False
                elif status == "running" and kind == "fail" and attempts == 4:
                    action, status, until, marked = "buried", "dead", None, False
                elif status == "running" and kind == "fail":
                    action, status, until = "retried", "queued", at + min(LIMITS.delay * 2 ** (attempts - 1), LIMITS.delay_most)
                out.append((key, at, event, action, status, attempts, until))
    return sorted(out, key=repr)


def written(spark, rows, path, files):
    """The rows in so many files, one after the other, so that they are read in that order."""
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
        part.coalesce(1).write.mode("append").parquet(path)


def run(spark, path, folder, late, files=None, batches=None):
    rows = queue.log(queue.requests_of(spark, path, KINDS, 30.0, files), LIMITS.lease / 1000, LIMITS.delay / 1000, LIMITS.delay_most / 1000, late)
    return sorted([tuple(r) for r in queue.drain(rows, folder, 600, batches).collect()], key=repr)


@pytest.fixture(scope="module")
def whole():
    out = brute(events(), 300)
    assert {r[3] for r in out} >= {"queued", "claimed", "renewed", "finished", "retried", "buried", "lease_lost", "lease_buried", "duplicate", "refused"}
    return out


def test_one_batch(spark, tmp_path, whole):
    written(spark, events(), f"{tmp_path}/in", 1)
    assert run(spark, f"{tmp_path}/in", f"{tmp_path}/run", 300) == whole


def test_stopped_and_started_again(spark, tmp_path, whole):
    """Six micro-batches with shuffled neighbours, so that requests come late; stopped after two of them, then run to the end."""
    rows = events()
    for a in range(0, len(rows), 10):  # out of order by less than the watermark's delay
        rows[a : a + 10] = random.Random(a).sample(rows[a : a + 10], 10)
    written(spark, rows, f"{tmp_path}/in", 6)
    first = run(spark, f"{tmp_path}/in", f"{tmp_path}/run", 300, files=1, batches=2)
    assert 0 < len(first) < len(whole) and set(first) <= set(whole)
    assert run(spark, f"{tmp_path}/in", f"{tmp_path}/run", 300, files=1) == whole


def test_advance_by_hand():
    job, log, rest = queue.advance(queue.Job(), [(0, 1, "enqueue", False), (1, 2, "claim", False), (900_000, 3, "claim", False)], 700_000, LIMITS)
    assert [(x[0], x[2]) for x in log] == [(0, "queued"), (1, "claimed"), (600_001, "lease_lost")] and job == queue.Job("queued", 1, 600_001) and len(rest) == 1
    for _ in range(3):
        job, log, _ = queue.advance(job, [(job.until, 9, "claim", False)], job.until + 600_000, LIMITS)
    assert job.status == "dead" and log[-1][2] == "lease_buried"
    assert queue.advance(queue.Job(), [], 10, LIMITS) == (queue.Job(), [], [])


def test_uploads_in_any_order(spark, tmp_path):
    from cairnbook.streaming import uploads

    rows = [(i, t, u, name, v) for i, t, u, name, v in events(120, 9)]
    shuffled = random.Random(1).sample(rows, len(rows))
    written(spark, shuffled, f"{tmp_path}/in", 4)
    stream = queue.requests_of(spark, f"{tmp_path}/in", KINDS, 30.0, 1).select(F.col("document_id").cast("string").alias("key"), F.col("kind").alias("digest"), "ts")
    got, dropped = uploads.outcomes(stream, f"{tmp_path}/run", 86_400)
    want = {}
    for _, _, u, name, _ in rows:
        want.setdefault(None if u is None else str(u), set()).add(name)
    assert dropped == 0 and {r["key"]: r["digests"] for r in got.collect()} == {k: len(v) for k, v in want.items()}
    assert {r["outcome"] for r in got.collect()} <= {"stored", "conflict"}


def test_late_uploads_are_counted(spark, tmp_path):
    from cairnbook.streaming import uploads

    rows = events(60, 3)
    # what a batch drops is decided by the watermark of the batch before it
    written(spark, [*rows[20:], *rows[:20]], f"{tmp_path}/in", 3)
    stream = queue.requests_of(spark, f"{tmp_path}/in", KINDS, 30.0, 1).select(F.col("event_id").cast("string").alias("key"), F.col("kind").alias("digest"), "ts")
    got, dropped = uploads.outcomes(stream, f"{tmp_path}/run", 60)
    assert dropped == 20 and got.count() == 40
