"""Versioned rows: latest per key, state folds, change capture, queue states in batch form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.operators.ordered import replay

MAX_ATTEMPTS, DELAY, DELAY_MOST, LEASE = 4, 30, 3600, 300
LEASE_ERROR = "the lease of the last attempt ran out"


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by order; one aggregation with partial maxima, no sort of a key's rows."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], table: str) -> DataFrame:
    """One audit row per changed field of two snapshots: insert, update, delete; null-safe comparison, values as text."""
    a = old.select(F.col(key).alias("k"), *[F.col(c).cast("string").alias(f"old_{c}") for c in fields], F.lit(True).alias("was"))
    b = new.select(F.col(key).alias("k"), *[F.col(c).cast("string").alias(f"new_{c}") for c in fields], F.lit(True).alias("is"))
    both = a.join(b, "k", "full")
    action = F.when(F.col("was").isNull(), "insert").when(F.col("is").isNull(), "delete").otherwise("update")
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").alias("old_value"), F.col(f"new_{c}").alias("new_value")) for c in fields])
    changed = F.filter(pairs, lambda p: ~p["old_value"].eqNullSafe(p["new_value"]))
    return both.select(F.lit(table).alias("table_name"), F.col("k").cast("string").alias("row_pk"), action.alias("action"), F.explode(changed).alias("c")).select("table_name", "row_pk", "action", "c.*")


def retry_delay(attempts: Column, base: int = DELAY) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempts - 1), F.lit(float(DELAY_MOST))).cast("long")


def runnable(now: Column, most: int = MAX_ATTEMPTS) -> Column:
    """Queued and due, or running past its lease with attempts left."""
    due = (F.col("status") == "queued") & (F.col("available_at") <= now)
    lost = (F.col("status") == "running") & (F.col("lease_expires_at") <= now) & (F.col("attempts") < most)
    return due | lost


def enqueue(jobs: DataFrame) -> DataFrame:
    """The first job of each (document, idempotency key)."""
    first = F.row_number().over(Window.partitionBy("document_id", "idempotency_key").orderBy("created_at", "id"))
    return jobs.withColumn("place", first).where("place = 1").drop("place")


def claim(jobs: DataFrame, now: Column, owner: str, lease: int = LEASE, k: int = 1, most: int = MAX_ATTEMPTS) -> DataFrame:
    """The k jobs at the head of the queue as they are after one worker's claim; with one writer nothing is claimed twice."""
    head = jobs.where(runnable(now, most)).orderBy("available_at", "created_at", "id").limit(k)
    until = now + F.make_dt_interval(secs=F.lit(lease).cast("decimal(18,6)"))
    return head.withColumn("status", F.lit("running")).withColumn("attempts", F.col("attempts") + 1).withColumn("lease_owner", F.lit(owner)).withColumn("lease_expires_at", until)


def lease_states(jobs: DataFrame, renewals: DataFrame, now: Column, lease: int = LEASE, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Running jobs with renewed (true or refused: false; null if not asked) and state: held, reclaimable or exhausted.

    renewals: id, owner.  Only the owner renews; a renewed lease runs from now.
    """
    asked = renewals.groupBy("id").agg(F.collect_set("owner").alias("owners"))
    renewed = F.when(F.col("owners").isNotNull(), F.array_contains("owners", F.col("lease_owner")))
    until = F.when(F.coalesce(renewed, F.lit(False)), now + F.make_dt_interval(secs=F.lit(lease).cast("decimal(18,6)"))).otherwise(F.col("lease_expires_at"))
    state = F.when(until > now, "held").when(F.col("attempts") < most, "reclaimable").otherwise("exhausted")
    return jobs.where("status = 'running'").join(asked, "id", "left").select("id", renewed.alias("renewed"), state.alias("state"))


def after_failure(jobs: DataFrame, now: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Failed running jobs: back to the queue after a delay, or dead if the attempt was the last (claims count attempts)."""
    over = F.col("attempts") >= most
    delay = retry_delay(F.col("attempts"))
    return jobs.where("status = 'running'").select("id", "attempts", F.when(over, "dead").otherwise("queued").alias("status"), F.when(~over, now + F.make_dt_interval(secs=delay.cast("decimal(18,6)"))).alias("available_at"))


def bury_exhausted(jobs: DataFrame, now: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Running jobs whose last lease ran out: done where the payload says that the pipeline ended, else dead with an error."""
    ended = F.coalesce(F.get_json_object("payload", "$.pipeline.completed") == "true", F.lit(False))
    gone = jobs.where((F.col("status") == "running") & (F.col("lease_expires_at") <= now) & (F.col("attempts") >= most))
    return gone.select("id", F.when(ended, "done").otherwise("dead").alias("status"), F.when(~ended, LEASE_ERROR).alias("last_error"))


ACTIVE, ENDED = ("queued", "running", "done"), ("dead", "failed")


def retry_targets(jobs: DataFrame, *group: str) -> DataFrame:
    """group, failed_id and recovery_key of each group of which every job is dead or failed: its newest job without successor.

    A successor is named recovery:<id> in idempotency_key.  A group without such a leaf gives its newest job; one
    whose recovery key exists already gives nothing.
    """
    named = jobs.where(F.col("idempotency_key").startswith("recovery:")).select(F.col("idempotency_key").alias("made")).distinct()
    closed = jobs.groupBy(*group).agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active")).where("active = 0").drop("active")
    rows = jobs.join(closed, list(group), "left_semi").withColumn("key", F.concat(F.lit("recovery:"), F.col("id").cast("string")))
    rows = rows.join(named, rows["key"] == named["made"], "left").withColumn("leaf", F.col("made").isNull())
    best = rows.groupBy(*group).agg(F.max_by(F.struct("id", "key", "leaf"), F.struct("leaf", "created_at", "id")).alias("r"))
    return best.where("r.leaf").select(*group, F.col("r.id").alias("failed_id"), F.col("r.key").alias("recovery_key"))


def newest_by_key(jobs: DataFrame, json_path: str, key: str) -> DataFrame:
    """The newest job of each value found at json_path of the payload, among jobs that have one."""
    rows = jobs.withColumn(key, F.get_json_object("payload", json_path)).where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def step_allowed(state: str, version: int, target: str, expected: int | None, allowed: dict[str, frozenset[str]]) -> bool:
    return target in allowed[state] and expected in (None, version)


def transitions(requests: DataFrame, key: str, order: str, allowed: dict[str, frozenset[str]], start: str) -> DataFrame:
    """key, order, accepted, state and version after each request (target, expected_version; null: whatever it is)."""

    def step(now, row):
        if step_allowed(*now, row["target"], row["expected_version"], allowed):
            now = (row["target"], now[1] + 1)
            return now, (True, *now)
        return now, (False, *now)

    return replay(requests, [key], [order], lambda: (start, 1), step, "accepted boolean, state string, version int")


def capability(configs: DataFrame, jobs: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """configs (registry_digest, capabilities_digest) with eligible and reason: the legacy queue must be drained, and the newest heartbeat fresh, sandboxed and of equal digests."""
    legacy = jobs.where(F.col("status").isin("queued", "running") & (F.coalesce(F.col("profile") != "universal", F.lit(True)) | ~F.col("sandboxed"))).limit(1).agg((F.count("*") > 0).alias("legacy"))
    newest = leases.orderBy(F.desc("heartbeat_at"), "worker_id").limit(1).select(F.col("registry_digest").alias("have_registry"), F.col("capabilities_digest").alias("have_capabilities"), "sandbox_verified", "expires_at", "worker_id")
    # both sides are one row
    both = configs.join(F.broadcast(legacy), F.lit(True)).join(F.broadcast(newest), F.lit(True), "left")
    stale = F.col("worker_id").isNull() | (F.col("expires_at") <= now)
    other = ~F.col("sandbox_verified") | (F.col("have_registry") != F.col("registry_digest")) | (F.col("have_capabilities") != F.col("capabilities_digest"))
    reason = F.when(F.col("legacy"), "registry_mismatch").when(stale, "worker_capability_stale").when(other, "registry_mismatch")
    return both.select("registry_digest", "capabilities_digest", reason.isNull().alias("eligible"), reason.alias("reason"))


def idempotent(requests: DataFrame, key: str, digest: str, order: str) -> DataFrame:
    """new for a key's first request, replay for an equal digest, conflict for another."""
    first = requests.groupBy(key).agg(F.min_by(digest, order).alias("first_digest"), F.min(order).alias("first_order"))
    said = F.when(F.col(order) == F.col("first_order"), "new").when(F.col(digest) == F.col("first_digest"), "replay").otherwise("conflict")
    return requests.join(first, key).withColumn("outcome", said)


def leaves(jobs: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows that no other row names as its parent."""
    return jobs.join(jobs.select(F.col(parent).alias("p_")).where("p_ is not null").distinct(), F.col(key) == F.col("p_"), "left_anti")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) counts in one pass."""
    counted = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules])).alias("r")).select("r.*")


def _one(rule: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.lit(rule).alias("rule"), F.count("*").alias("violations"))


def repeated(rows: DataFrame, rule: str, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return _one(rule, rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))


def orphans(rows: DataFrame, owners: DataFrame, rule: str, key: str, owner_key: str) -> DataFrame:
    """Rows whose key no owner has; null keys refer to nothing."""
    return _one(rule, rows.where(F.col(key).isNotNull()).join(owners.select(F.col(owner_key).alias("owner_")).distinct(), F.col(key) == F.col("owner_"), "left_anti"))


def miscounted(owners: DataFrame, members: DataFrame, rule: str, key: str, declared: str) -> DataFrame:
    """Owners whose number of members is not the declared one."""
    n = members.groupBy(key).agg(F.count("*").alias("members_"))
    return _one(rule, owners.join(n, key, "left").where(F.coalesce("members_", F.lit(0)) != F.col(declared)))


def changed_columns(old: DataFrame, new: DataFrame, rule: str, key: str, *columns: str) -> DataFrame:
    """Rows of which a column that must not change did."""
    both = old.select(key, *columns).join(new.select(F.col(key).alias("key_"), *[F.col(c).alias(f"new_{c}") for c in columns]), F.col(key) == F.col("key_"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"new_{c}"))
    return _one(rule, both.where(~same))
