"""Queries of jobs, versions, decisions and change capture."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnbook.operators import lifecycle as lc
from cairnbook.operators import review
from cairnbook.plans.registry import query
from cairnbook.sources import fixtures as fx
from cairnbook.sources.fixtures import SQL_COHORTS, SQL_DERIVATIVES, SQL_EXTRACTED, SQL_JOBS, SQL_VERIFIED

J = f"WITH {SQL_JOBS} "
NOW = "TIMESTAMP '2024-01-15 12:00:00'"


def now():
    return F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")


def jobs(s, d):
    out = fx.jobs(s, d)
    for c in ("available_at", "lease_expires_at", "created_at"):
        out = out.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return out


RUNNABLE = f"((status = 'queued' AND available_at <= {NOW}) OR (status = 'running' AND lease_expires_at <= {NOW} AND attempts < 4))"


@query("b14_runnable_jobs", J + f"SELECT id FROM fx_jobs WHERE {RUNNABLE}")
def b14(s, d):
    return jobs(s, d).where(lc.runnable(now())).select("id")


@query("b15_execution_scope", J + "SELECT id FROM fx_jobs WHERE job_type = 'click' AND idempotency_key = 'key-7'")
def b15(s, d):
    return jobs(s, d).where("job_type = 'click' and idempotency_key = 'key-7'").select("id")


@query("g5_queue_head", J + f"SELECT id FROM fx_jobs WHERE {RUNNABLE} ORDER BY available_at, created_at, id LIMIT 1")
def g5(s, d):
    return jobs(s, d).where(lc.runnable(now())).orderBy("available_at", "created_at", "id").limit(1).select("id")


@query("i1_idempotent_enqueue", J + "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY document_id, idempotency_key ORDER BY created_at, id) AS rn FROM fx_jobs) WHERE rn = 1")
def i1(s, d):
    return lc.enqueue(jobs(s, d)).select("id")


@query("i2_claim", J + f"SELECT id, 'running' AS status, attempts + 1 AS attempts, 'worker-1' AS lease_owner, {NOW} + INTERVAL 300 SECOND AS lease_expires_at FROM fx_jobs WHERE {RUNNABLE} ORDER BY available_at, created_at, id LIMIT 25")
def i2(s, d):
    """The 25 jobs that a worker claims one after the other."""
    return lc.claim(jobs(s, d), now(), "worker-1", k=25).select("id", "status", "attempts", "lease_owner", "lease_expires_at")


RENEWALS = "SELECT id, CASE WHEN id % 2 = 0 THEN lease_owner ELSE 'stranger' END AS owner FROM fx_jobs WHERE id % 4 < 2"


@query("i3_lease_reclaim", J + f", r AS ({RENEWALS}), s AS (SELECT j.id, j.attempts, j.lease_expires_at, CASE WHEN r.id IS NOT NULL THEN owner = lease_owner END AS renewed FROM fx_jobs j LEFT JOIN r USING (id) WHERE status = 'running') SELECT id, renewed, CASE WHEN coalesce(renewed, FALSE) OR lease_expires_at > {NOW} THEN 'held' WHEN attempts < 4 THEN 'reclaimable' ELSE 'exhausted' END AS state FROM s")
def i3(s, d):
    asked = jobs(s, d).where("id % 4 < 2").select("id", F.when(F.col("id") % 2 == 0, F.col("lease_owner")).otherwise("stranger").alias("owner"))
    return lc.lease_states(jobs(s, d), asked, now())

@query("i4_retry_or_bury", J + f"SELECT id, attempts, CASE WHEN attempts >= 4 THEN 'dead' ELSE 'queued' END AS status, CASE WHEN attempts < 4 THEN {NOW} + to_seconds(CAST(least(30 * pow(2, attempts - 1), 3600) AS BIGINT)) END AS available_at FROM fx_jobs WHERE status = 'running'")
def i4(s, d):
    return lc.after_failure(jobs(s, d), now())


@query("i5_bury_exhausted", J + f"SELECT id, CASE WHEN completed THEN 'done' ELSE 'dead' END AS status, CASE WHEN NOT completed THEN '{lc.LEASE_ERROR}' END AS last_error FROM fx_jobs WHERE status = 'running' AND attempts >= 4 AND lease_expires_at <= {NOW}")
def i5(s, d):
    return lc.bury_exhausted(jobs(s, d), now())


@query("i6_superseded_versions", f"WITH {SQL_EXTRACTED}, m AS (SELECT issue, max(version) AS v FROM fx_extracted GROUP BY 1) SELECT extraction_id FROM fx_extracted JOIN m USING (issue) WHERE version < v")
def i6(s, d):
    e = fx.extracted(s, d)
    return e.withColumn("v", F.max("version").over(Window.partitionBy("issue"))).where("version < v").select("extraction_id")


# The states of an intake and where each may go.
INTAKE = {
    "queued": ("processing", "processed", "needs_mapping", "stored_unprocessed", "failed"), "processing": ("queued", "processed", "needs_mapping", "stored_unprocessed", "failed"), "processed": ("queued",),
    "needs_mapping": ("queued", "processing", "failed"), "stored_unprocessed": ("queued", "processing", "failed"), "failed": ("queued",),
}
TARGETS = {"view": "queued", "click": "processing", "purchase": "processed", "error": "failed", "signup": "needs_mapping"}


@query(
    "i7_state_machine",
    "WITH RECURSIVE allowed(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, to in INTAKE.items() for b in to) + """),
q AS (SELECT user_id AS intake_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, CASE event_type """ + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TARGETS.items()) + """ END AS target, CASE WHEN event_id % 5 = 0 THEN 3 END AS expected FROM events),
r AS (
  SELECT user_id AS intake_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS event_id, FALSE AS accepted, 'queued' AS state, 1 AS version FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT q.intake_id, q.seq, q.event_id, ok, CASE WHEN ok THEN target ELSE state END, CAST(version + CASE WHEN ok THEN 1 ELSE 0 END AS INTEGER)
  FROM (SELECT q.*, r.state, r.version, (r.state, q.target) IN (SELECT (a, b) FROM allowed) AND (q.expected IS NULL OR q.expected = r.version) AS ok FROM r JOIN q ON q.intake_id = r.intake_id AND q.seq = r.seq + 1) q)
SELECT intake_id, event_id, accepted, state, version FROM r WHERE seq > 0""",
)
def i7(s, d):
    """Requests of intakes one after the other: a target that is not allowed, or an expected version that has passed, changes nothing."""
    target = F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv])[F.col("event_type")]
    asked = fx.table(s, d, "events").select(F.col("user_id").alias("intake_id"), "event_id", target.alias("target"), F.when(F.col("event_id") % 5 == 0, 3).alias("expected_version"))
    return lc.transitions(asked, "intake_id", "event_id", {a: frozenset(b) for a, b in INTAKE.items()}, "queued")

@query("i8_upload_idempotency", J + ", f AS (SELECT idempotency_key, arg_min(job_type, id) AS t, min(id) AS i FROM fx_jobs GROUP BY 1) SELECT id, CASE WHEN id = i THEN 'new' WHEN job_type = t THEN 'replay' ELSE 'conflict' END AS outcome FROM fx_jobs JOIN f USING (idempotency_key)")
def i8(s, d):
    return lc.idempotent(jobs(s, d), "idempotency_key", "job_type", "id").select("id", "outcome")


ACTIONS = "CASE event_type WHEN 'view' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'supersede' END"


@query("i9_extraction_lifecycle", f"WITH f AS (SELECT user_id, arg_min({ACTIONS}, event_id) FILTER (event_id % 4 <> 0 AND user_id % 3 <> 0) AS a FROM events GROUP BY 1) SELECT user_id AS extraction_id, CASE a WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'supersede' THEN 'superseded' ELSE 'pending_review' END AS status, CASE WHEN a IS NULL THEN 1 ELSE 2 END AS version FROM f")
def i9(s, d):
    e = fx.table(s, d, "events")
    action = F.when(F.col("event_type") == "view", "approve").when(F.col("event_type") == "error", "reject").otherwise("supersede")
    stale = (F.col("event_id") % 4 == 0) | (F.col("user_id") % 3 == 0)
    asked = e.select(F.col("user_id").alias("extraction_id"), F.col("event_id").alias("seq"), F.when(stale, 7).otherwise(1).alias("expected_version"), action.alias("action"))
    return review.extraction_states(asked.select("extraction_id").distinct(), asked)


C = f"WITH {SQL_COHORTS} "


def decided(s, d):
    """Requests of the cohorts and which of them were taken."""
    asked = fx.cohort_requests(s, d)
    return asked, review.decide(asked)


def latest(s, d):
    return review.latest_decisions(review.decision_revisions(*decided(s, d)))


@query("i10_cohort_decisions", C + "SELECT batch_id, CAST(1 AS INTEGER) AS request, TRUE AS accepted FROM fx_taken WHERE first UNION ALL SELECT batch_id, 2, second FROM fx_taken WHERE asked")
def i10(s, d):
    """Which requests for decisions were taken: the batch's version and each candidate's revision must be the expected ones."""
    return decided(s, d)[1]


@query("i10_cohort_ready", C + "SELECT b.batch_id, count(l.candidate) AS decided, count(*) FILTER (l.action = 'include') AS included, count(*) FILTER (l.action = 'exclude') AS excluded, count(l.candidate) = any_value(declared) AND count(*) = any_value(declared) AS ready FROM fx_cohorts b JOIN fx_candidates c USING (batch_id) LEFT JOIN fx_latest l ON l.batch_id = c.batch_id AND l.candidate = c.candidate GROUP BY 1")
def i10b(s, d):
    p = previews(s, d)
    done = F.col("actual") - F.col("pending")
    return p.select("batch_id", done.alias("decided"), "included", "excluded", ((done == F.col("declared")) & (F.col("actual") == F.col("declared"))).alias("ready"))


def previews(s, d):
    return review.preview(fx.cohort_batches(s, d), fx.cohort_candidates(s, d).drop("action"), latest(s, d))


PREVIEW = C + """, p AS (
  SELECT b.batch_id, b.document_id, b.version, source_current, sha256(b.batch_id || '#' || b.version || '#' || any_value(declared) || '#' || string_agg(c.candidate || ':' || coalesce(l.revision, 0) || ':' || coalesce(l.action, '-'), '|' ORDER BY c.candidate)) AS vector_sha256,
    list_filter([CASE WHEN lifecycle NOT IN ('open', 'ready_to_activate') THEN 'batch_not_reviewable' END, CASE WHEN NOT source_current THEN 'stale_source' END, CASE WHEN count(*) <> any_value(declared) THEN 'candidate_reconciliation_mismatch' END,
      CASE WHEN count(*) > count(l.candidate) THEN 'pending_candidates' END, CASE WHEN count(*) FILTER (l.action = 'include' AND c.issues) > 0 THEN 'invalid_candidates' END], lambda x: x IS NOT NULL) AS errors,
    count(*) FILTER (l.action = 'exclude') > 0 AS needs_exclusions, count(*) FILTER (l.action = 'include') = 0 AS needs_empty
  FROM fx_cohorts b JOIN fx_candidates c USING (batch_id) LEFT JOIN fx_latest l ON l.batch_id = c.batch_id AND l.candidate = c.candidate GROUP BY b.batch_id, b.document_id, b.version, source_current, lifecycle)"""
ACTIVATE = PREVIEW + """, a AS (
  SELECT batch_id, document_id, CASE WHEN batch_id % 5 = 0 THEN 'stale_version' WHEN NOT source_current THEN 'stale_source' WHEN batch_id % 19 = 0 THEN 'stale_vector' WHEN len(errors) > 0 THEN 'invalid'
    WHEN needs_exclusions AND batch_id % 3 = 0 OR needs_empty AND batch_id % 2 = 0 THEN 'consent_required' ELSE 'activated' END AS outcome FROM p)"""


@query("i11_activation_preview", PREVIEW + " SELECT batch_id, array_to_string(errors, ',') AS errors, vector_sha256, needs_exclusions, needs_empty FROM p")
def i11(s, d):
    return previews(s, d).select("batch_id", F.array_join("errors", ",").alias("errors"), "vector_sha256", "needs_exclusions", "needs_empty")


def activated(s, d):
    """Every batch is asked for; some requests name an old version or vector, or withhold a consent."""
    p = previews(s, d)
    asked = p.select("batch_id", F.when(F.col("batch_id") % 5 == 0, 9).otherwise(F.col("version")).alias("expected_version"), F.when(F.col("batch_id") % 19 == 0, "x").otherwise(F.col("vector_sha256")).alias("expected_vector"), (F.col("batch_id") % 3 != 0).alias("accept_exclusions"), (F.col("batch_id") % 2 != 0).alias("accept_empty"))
    return review.activate(p, asked)


@query("i11_activation", ACTIVATE + " SELECT batch_id, outcome FROM a")
def i11b(s, d):
    return activated(s, d).select("batch_id", "outcome")


@query("i11_publish", ACTIVATE + ", w AS (SELECT *, max(batch_id) OVER (PARTITION BY document_id) AS last FROM a WHERE outcome = 'activated') SELECT document_id, batch_id, candidate, CASE WHEN action = 'exclude' THEN 'rejected' WHEN batch_id = last THEN 'approved' ELSE 'superseded' END AS status FROM w JOIN fx_latest USING (batch_id)")
def i11c(s, d):
    """Candidates of the activated batches, batches of one document activated in the order of their ids."""
    done = activated(s, d).where("outcome = 'activated'").select("batch_id", F.col("batch_id").alias("seq"))
    return review.publish(done, fx.cohort_batches(s, d), fx.cohort_candidates(s, d).select("batch_id", "candidate"), latest(s, d))


@query("i12_cohort_rejection", C + ", m AS (SELECT batch_id, count(*) AS n, count(*) FILTER (status <> 'pending_review') AS moved FROM fx_candidates GROUP BY 1), o AS (SELECT b.*, n, CASE WHEN lifecycle = 'active' OR batch_id % 6 = 0 THEN 'stale_version' WHEN NOT source_current THEN 'stale_source' WHEN moved > 0 THEN 'stale_candidates' ELSE 'rejected' END AS outcome FROM fx_cohorts b JOIN m USING (batch_id)) SELECT batch_id, outcome, CASE WHEN outcome = 'rejected' THEN n ELSE 0 END AS rejected, CASE WHEN outcome = 'rejected' THEN CASE WHEN document_id % 2 = 0 THEN 'verified' ELSE 'needs_reprocess' END END AS document_status FROM o")
def i12(s, d):
    b = fx.cohort_batches(s, d).withColumn("has_authority", F.col("document_id") % 2 == 0)
    return review.reject(b, fx.cohort_candidates(s, d), b.select("batch_id", F.when(F.col("batch_id") % 6 == 0, 4).otherwise(1).alias("expected_version")))


@query("i13_promote", C + ", f AS (SELECT *, candidate % 3 <> 0 AS ok FROM fx_candidates), l AS (SELECT batch_id, max(candidate) FILTER (ok) AS last FROM f GROUP BY 1) SELECT batch_id AS document_id, candidate, CASE WHEN NOT ok THEN 'pending_review' WHEN candidate = last THEN 'approved' ELSE 'superseded' END AS status, CASE WHEN NOT ok THEN 1 WHEN candidate = last THEN 2 ELSE 3 END AS version FROM f JOIN l USING (batch_id)")
def i13(s, d):
    """Candidates promoted in the order of their numbers, every third with a version that was never shown, then all once more."""
    c = fx.cohort_candidates(s, d).select(F.col("batch_id").alias("document_id"), "candidate")
    once = c.select("*", F.col("candidate").alias("seq"), F.when(F.col("candidate") % 3 == 0, 2).otherwise(1).alias("expected_version"))
    return review.promote(c, once.unionByName(once.withColumn("seq", F.col("seq") + 100)))


@query("i18_field_changes", "WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_name || '!' ELSE c_name END AS c_name, CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 100 <> 7) SELECT 'customer' AS table_name, CAST(k AS VARCHAR) AS row_pk, action, field, old_value, new_value FROM (SELECT o.c_custkey AS k, CASE WHEN n.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS action, unnest(['c_name', 'c_mktsegment']) AS field, unnest([o.c_name, o.c_mktsegment]) AS old_value, unnest([n.c_name, n.c_mktsegment]) AS new_value FROM customer o LEFT JOIN n ON n.c_custkey = o.c_custkey) WHERE old_value IS DISTINCT FROM new_value")
def i18(s, d):
    old = fx.table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = old.where("c_custkey % 100 <> 7").withColumn("c_name", F.when(F.col("c_custkey") % 10 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 15 != 0, F.col("c_mktsegment")))
    return lc.changes(old, new, "c_custkey", ["c_name", "c_mktsegment"], "customer")


FIELDS = {"transaction_date": ("transaction_date", "date"), "total_amount": ("total_amount", "number"), "counterparty": ("counterparty", "text"), "category": ("expense_category", "text")}


@query("i19_payload_corrections", f"""WITH {SQL_VERIFIED}, p AS (
  SELECT id, strftime(transaction_date, '%Y-%m-%d') AS d, CASE WHEN id % 4 = 0 THEN 'about June' ELSE strftime(transaction_date, '%Y-%m-%d') END AS pd, rtrim(rtrim(CAST(total_amount AS VARCHAR), '0'), '.') AS n, CASE id % 5 WHEN 0 THEN '12' ELSE rtrim(rtrim(CAST(total_amount AS VARCHAR), '0'), '.') END AS pn,
    counterparty AS c, CASE WHEN id % 6 = 0 THEN NULL ELSE counterparty END AS pc, category AS k, CASE WHEN id % 7 = 0 THEN lower(category) ELSE category END AS pk FROM fx_verified)
SELECT CAST(id AS VARCHAR) AS row_pk, field, old_value, new_value FROM (SELECT id, unnest(['transaction_date', 'total_amount', 'counterparty', 'category']) AS field, unnest([pd, pn, pc, pk]) AS old_value, unnest([d, n, c, k]) AS new_value FROM p) WHERE old_value IS DISTINCT FROM new_value""")
def i19(s, d):
    """Verified values against payloads that write them otherwise (spaces, zeros, bare values) or differ."""
    v = fx.verified(s, d)
    amount = F.col("total_amount").cast("string")
    payload = F.to_json(
        F.struct(
            F.when(F.col("id") % 4 == 0, "about June").otherwise(F.col("transaction_date").cast("string")).alias("transaction_date"),
            F.struct(F.when(F.col("id") % 5 == 0, "12.0").when(F.col("id") % 5 == 1, F.concat(F.lit(" "), amount, F.lit("00"))).otherwise(amount).alias("value"), F.lit(0.9).alias("confidence")).alias("total_amount"),
            F.struct(F.when(F.col("id") % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), "counterparty")).alias("value")).alias("counterparty"),
            F.when(F.col("id") % 7 == 0, F.lower("category")).otherwise(F.col("category")).alias("expense_category"),
        )
    )
    return review.corrections(v, v.select("id", payload.alias("payload")), "id", FIELDS)


CHAIN = "c AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 AND event_id > 0 THEN event_id - 1 END AS recovers FROM events)"


@query("i20_retry_chain_leaf", f"WITH {CHAIN} SELECT id FROM c WHERE id NOT IN (SELECT recovers FROM c WHERE recovers IS NOT NULL)")
def i20(s, d):
    c = fx.table(s, d, "events").select(F.col("event_id").alias("id"), F.when((F.col("event_id") % 3 == 0) & (F.col("event_id") > 0), F.col("event_id") - 1).alias("recovers"))
    return lc.leaves(c, "id", "recovers").select("id")


@query("i21_derivative_retry", f"WITH {SQL_DERIVATIVES}, g AS (SELECT document_id, target FROM fx_derivatives GROUP BY 1, 2 HAVING count(*) FILTER (status IN ('queued', 'running', 'done')) = 0), l AS (SELECT f.*, NOT EXISTS (SELECT 1 FROM fx_derivatives x WHERE x.idempotency_key = 'recovery:' || f.id) AS leaf FROM fx_derivatives f JOIN g USING (document_id, target)), b AS (SELECT document_id, target, arg_max(id, (leaf, created_at, id)) AS failed_id, bool_or(leaf) AS leaf FROM l GROUP BY 1, 2) SELECT document_id, target, failed_id, 'recovery:' || failed_id AS recovery_key FROM b WHERE leaf")
def i21(s, d):
    return lc.retry_targets(fx.derivatives(s, d), "document_id", "target")


@query("i22_current_error", J + ", t AS (SELECT document_id, arg_max(id, (created_at, id)) AS id, arg_max(status, (created_at, id)) AS status FROM fx_jobs WHERE status IN ('dead', 'done') GROUP BY 1) SELECT document_id, id FROM t WHERE status = 'dead'")
def i22(s, d):
    terminal = jobs(s, d).where("status in ('dead', 'done')").select("document_id", "id", "status", "created_at")
    return lc.latest(terminal, ["document_id"], ["created_at", "id"]).where("status = 'dead'").select("document_id", "id")


CONFIGS = [("r0", "c0"), ("r1", "c1"), ("r2", "c0"), ("r0", "c1")]
LEASES = "SELECT s_suppkey AS worker_id, TIMESTAMP '2024-01-15 11:00:00' + to_seconds(CAST(s_suppkey % 50 AS BIGINT)) AS heartbeat_at, 'r' || (s_suppkey % 3) AS registry_digest, 'c' || (s_suppkey % 2) AS capabilities_digest FROM supplier"


@query("i23_capability_lease", f"WITH l AS (SELECT * FROM ({LEASES}) ORDER BY heartbeat_at DESC, worker_id LIMIT 1), c(registry_digest, capabilities_digest) AS (VALUES {', '.join(str(c) for c in CONFIGS)}), t(mode) AS (VALUES ('drained'), ('legacy'), ('late')), r AS (SELECT mode, c.*, CASE WHEN mode = 'legacy' THEN 'registry_mismatch' WHEN mode = 'late' THEN 'worker_capability_stale' WHEN l.registry_digest <> c.registry_digest OR l.capabilities_digest <> c.capabilities_digest THEN 'registry_mismatch' END AS reason FROM c, l, t) SELECT mode, registry_digest, capabilities_digest, reason IS NULL AS eligible, reason FROM r")
def i23(s, d):
    """Four configurations against the newest worker's lease: with a drained queue, with a legacy job left, and after the lease."""
    configs = s.createDataFrame(CONFIGS, "registry_digest string, capabilities_digest string")
    beat = F.lit("2024-01-15 11:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("s_suppkey") % 50).cast("decimal(18,6)"))
    leases = fx.table(s, d, "supplier").select(F.col("s_suppkey").alias("worker_id"), beat.alias("heartbeat_at"), (beat + F.expr("interval 2 hours")).alias("expires_at"), F.concat(F.lit("r"), (F.col("s_suppkey") % 3).cast("string")).alias("registry_digest"), F.concat(F.lit("c"), (F.col("s_suppkey") % 2).cast("string")).alias("capabilities_digest"), F.lit(True).alias("sandbox_verified"))
    j = jobs(s, d).select("status", F.lit("universal").alias("profile"), F.lit(True).alias("sandboxed"))
    old = j.limit(1).select(F.lit("queued").alias("status"), F.lit(None).cast("string").alias("profile"), F.lit(False).alias("sandboxed"))
    late = F.lit("2024-01-16 12:00:00").cast("timestamp_ntz")
    parts = [lc.capability(configs, x, leases, t).select(F.lit(mode).alias("mode"), "*") for mode, x, t in (("drained", j, now()), ("legacy", j.unionByName(old), now()), ("late", j, late))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


GUARDS = (
    "SELECT 'known_status' AS rule, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS violations FROM orders UNION ALL SELECT 'positive_total', count(*) FILTER (NOT o_totalprice > 1000) FROM orders "
    "UNION ALL SELECT 'unique_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'line_has_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 <> 1) "
    "UNION ALL SELECT 'candidate_count', count(*) FROM fx_cohorts b JOIN (SELECT batch_id, count(*) AS n FROM fx_candidates GROUP BY 1) c USING (batch_id) WHERE n <> declared UNION ALL SELECT 'immutable_total', count(*) FROM orders WHERE o_orderkey % 29 = 0"
)


@query("i24_integrity_guards", C + GUARDS)
def i24(s, d):
    """Violations of checks, of a unique key, of a foreign key, of declared counts and of a column that must not change."""
    o, lines = fx.table(s, d, "orders"), fx.table(s, d, "lineitem")
    checks = lc.violations(o, {"known_status": F.col("o_orderstatus").isin("F", "O"), "positive_total": F.col("o_totalprice") > 1000})
    changed = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 29 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return (
        checks.unionByName(lc.repeated(lines, "unique_line", "l_orderkey", "l_linenumber")).unionByName(lc.orphans(lines, o.where("o_orderkey % 100 <> 1"), "line_has_order", "l_orderkey", "o_orderkey"))
        .unionByName(lc.miscounted(fx.cohort_batches(s, d), fx.cohort_candidates(s, d), "candidate_count", "batch_id", "declared")).unionByName(lc.changed_columns(o, changed, "immutable_total", "o_orderkey", "o_totalprice"))
    )


@query("e26_lease_counts", J + f"SELECT count(*) FILTER (status = 'running' AND lease_expires_at > {NOW}) AS running, count(DISTINCT document_id) FILTER (status = 'running' AND lease_expires_at > {NOW}) AS workers FROM fx_jobs")
def e26(s, d):
    held = (F.col("status") == "running") & (F.col("lease_expires_at") > now())
    return jobs(s, d).agg(F.count_if(held).alias("running"), F.count_distinct(F.when(held, F.col("document_id"))).alias("workers"))


@query("g9_newest_matching_job", J + "SELECT source_version, arg_max(id, (created_at, id)) AS id FROM fx_jobs GROUP BY 1")
def g9(s, d):
    return lc.newest_by_key(jobs(s, d), "$.source.version", "source_version")


BATCHES = "SELECT event_id AS id, 'key-' || (event_id % 997) AS idempotency_key, sha256(event_type) AS digest FROM events"


@query("m8_replay_safe_batches", f"WITH b AS ({BATCHES}), f AS (SELECT idempotency_key, arg_min(digest, id) AS first_digest, min(id) AS first_id FROM b GROUP BY 1) SELECT b.idempotency_key, count(*) FILTER (id = first_id) AS written, count(*) FILTER (id <> first_id AND digest = first_digest) AS replays, count(*) FILTER (digest <> first_digest) AS conflicts FROM b JOIN f USING (idempotency_key) GROUP BY 1")
def m8(s, d):
    """Batches written under their keys and read back: a key's first batch is written, the same again is a replay, another is a conflict."""
    from cairnbook.sources.tables import replace_partitions

    b = fx.table(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("key-"), (F.col("event_id") % 997).cast("string")).alias("idempotency_key"), F.sha2("event_type", 256).alias("digest"))
    said = lc.idempotent(b, "idempotency_key", "digest", "id")
    written = replace_partitions(said.where("outcome = 'new'").select("id", "idempotency_key", "digest", F.pmod(F.xxhash64("idempotency_key"), F.lit(8)).alias("bucket")), "batches", "bucket")
    counts = said.groupBy("idempotency_key").agg(F.count_if(F.col("outcome") == "replay").alias("replays"), F.count_if(F.col("outcome") == "conflict").alias("conflicts"))
    return written.groupBy("idempotency_key").agg(F.count("*").alias("written")).join(counts, "idempotency_key")


@query(
    "streaming_job_states",
    """WITH RECURSIVE q AS (SELECT user_id AS document_id, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
r AS (
  SELECT document_id, CAST(0 AS BIGINT) AS seen, '' AS status, 0 AS attempts FROM (SELECT DISTINCT document_id FROM q)
  UNION ALL
  SELECT q.document_id, q.seq, CASE WHEN e = 'view' AND status IN ('', 'done', 'dead') THEN 'queued' WHEN e = 'click' AND status = 'queued' THEN 'running' WHEN e = 'error' AND status = 'running' THEN CASE WHEN attempts + 1 >= 4 THEN 'dead' ELSE 'queued' END
      WHEN e IN ('purchase', 'signup') AND status = 'running' THEN 'done' ELSE status END,
    CASE WHEN e = 'view' AND status IN ('', 'done', 'dead') THEN 0 WHEN e = 'error' AND status = 'running' THEN attempts + 1 ELSE attempts END
  FROM r JOIN q ON q.document_id = r.document_id AND q.seq = r.seen + 1)
SELECT document_id, arg_max(status, seen) AS status, arg_max(attempts, seen) AS attempts, max(seen) AS seen FROM r GROUP BY 1""",
)
def streaming_jobs(s, d):
    """The durable queue as a stream: events of jobs folded to one state per document, all data processed, then read back."""
    from cairnbook.streaming.jobs import run_to_end

    return run_to_end(s, f"{d}/events.parquet")


# Fixed values of the query: what each kind of event asks of a document's job, seconds, and the value that notes the pipeline's end.
KINDS = {"view": "enqueue", "click": "claim", "signup": "renew", "error": "fail", "purchase": "finish"}
LEASE, DELAY, DELAY_MOST, LATE, MARKED = 6 * 3600, 2 * 3600, 24 * 3600, 24 * 3600, 30.0


@query(
    "i3_lease_timers",
    f"""WITH RECURSIVE lim AS (SELECT max(epoch_us(ts) // 1000) - {LATE * 1000} AS upto FROM events),
e AS (SELECT user_id AS document_id, event_id, epoch_us(ts) // 1000 AS inst, CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())} END AS kind, value >= {MARKED} AS m, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS seq FROM events, lim WHERE epoch_us(ts) // 1000 <= upto),
r AS (
  SELECT document_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS at_ms, CAST(NULL AS BIGINT) AS event_id, '' AS action, '' AS status, 0 AS attempts, CAST(NULL AS BIGINT) AS until_ms, FALSE AS marked FROM (SELECT DISTINCT document_id FROM e)
  UNION ALL
  SELECT document_id, seq, inst, event_id, action,
    CASE action WHEN 'queued' THEN 'queued' WHEN 'claimed' THEN 'running' WHEN 'finished' THEN 'done' WHEN 'completed' THEN 'done' WHEN 'buried' THEN 'dead' WHEN 'lease_buried' THEN 'dead' WHEN 'retried' THEN 'queued' WHEN 'lease_lost' THEN 'queued' ELSE status END,
    CASE action WHEN 'queued' THEN 0 WHEN 'claimed' THEN attempts + 1 ELSE attempts END,
    CASE WHEN action IN ('queued', 'lease_lost') THEN inst WHEN action IN ('claimed', 'renewed') THEN inst + {LEASE * 1000} WHEN action = 'retried' THEN inst + least({DELAY * 1000} * CAST(pow(2, attempts - 1) AS BIGINT), {DELAY_MOST * 1000}) WHEN action IN ('refused', 'duplicate') THEN until_ms END,
    CASE WHEN action IN ('queued', 'finished', 'completed', 'buried', 'lease_buried') THEN FALSE WHEN action = 'renewed' THEN marked OR m ELSE marked END
  FROM (SELECT document_id, CASE WHEN gone THEN seq ELSE seq + 1 END AS seq, CASE WHEN gone THEN until_ms ELSE inst END AS inst, CASE WHEN NOT gone THEN event_id END AS event_id, status, attempts, until_ms, marked, m,
      CASE WHEN gone THEN CASE WHEN attempts < {lc.MAX_ATTEMPTS} THEN 'lease_lost' WHEN marked THEN 'completed' ELSE 'lease_buried' END
        WHEN kind = 'enqueue' THEN CASE WHEN status IN ('', 'done', 'dead') THEN 'queued' ELSE 'duplicate' END
        WHEN kind = 'claim' AND status = 'queued' AND until_ms <= inst THEN 'claimed'
        WHEN status = 'running' AND kind = 'renew' THEN 'renewed' WHEN status = 'running' AND kind = 'finish' THEN 'finished'
        WHEN status = 'running' AND kind = 'fail' THEN CASE WHEN attempts >= {lc.MAX_ATTEMPTS} THEN 'buried' ELSE 'retried' END ELSE 'refused' END AS action
    FROM (SELECT r.document_id, r.seq, r.status, r.attempts, r.until_ms, r.marked, e.inst, e.event_id, e.kind, e.m, r.status = 'running' AND r.until_ms <= least(coalesce(e.inst, upto), upto) AS gone, e.inst IS NOT NULL AS more
      FROM r CROSS JOIN lim LEFT JOIN e ON e.document_id = r.document_id AND e.seq = r.seq + 1) WHERE gone OR more))
SELECT document_id, at_ms, event_id, action, status, attempts, until_ms FROM r WHERE action <> ''""",
)
def lease_timers(s, d):
    """The log of every document's job: leases run out, failures wait and exhausted jobs are buried by timers, up to a day before the last event."""
    from cairnbook.streaming import queue

    return queue.drain(queue.log(queue.requests_of(s, f"{d}/events.parquet", KINDS, MARKED), LEASE, DELAY, DELAY_MOST, LATE), queue.folder(s))


@query("i8_streamed_uploads", "SELECT 'key-' || (event_id % 997) AS key, count(DISTINCT event_type) AS digests, CASE WHEN count(DISTINCT event_type) > 1 THEN 'conflict' ELSE 'stored' END AS outcome FROM events GROUP BY 1")
def streamed_uploads(s, d):
    """Uploads under repeated keys as a stream: repeats go, keys with several digests are conflicts."""
    from cairnbook.streaming import queue, uploads

    events = queue.requests_of(s, f"{d}/events.parquet", KINDS, MARKED)
    asked = events.select(F.concat(F.lit("key-"), (F.col("event_id") % 997).cast("string")).alias("key"), F.element_at(F.create_map(*[F.lit(x) for a, b in KINDS.items() for x in (b, a)]), F.col("kind")).alias("digest"), "ts")
    return uploads.outcomes(asked, queue.folder(s), 31 * 24 * 3600)[0]
