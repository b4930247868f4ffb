"""Review of candidates in cohorts: decisions, activation, rejection, promotion; bills of issuers and months.

Candidates, decisions and batches are rows; what the bookkeeping does to them under a version check (compare and set) is
a fold of requests, or an aggregate where only the first request can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.operators.ordered import replay

MAX_DECISIONS = 100
PENDING, APPROVED, REJECTED, SUPERSEDED = "pending_review", "approved", "rejected", "superseded"


def first_applied(requests: DataFrame, keys: list[str], order: str, good: Column) -> DataFrame:
    """requests with outcome: applied for the first good one of each key, stale for all others.

    For transitions out of a state that is left once: after it, no version that was displayed holds any more.
    """
    first = requests.where(good).groupBy(*keys).agg(F.min(order).alias("first_"))
    return requests.join(first, keys, "left").withColumn("outcome", F.when(good & (F.col(order) == F.col("first_")), "applied").otherwise("stale")).drop("first_")


def extraction_states(extractions: DataFrame, requests: DataFrame) -> DataFrame:
    """extraction_id, status and version after requests (extraction_id, seq, expected_version, action: approve, reject, supersede)."""
    good = F.col("expected_version") == 1
    done = first_applied(requests, ["extraction_id"], "seq", good).where("outcome = 'applied'").select("extraction_id", "action")
    to = F.when(F.col("action") == "approve", APPROVED).when(F.col("action") == "reject", REJECTED).when(F.col("action") == "supersede", SUPERSEDED)
    return extractions.join(done, "extraction_id", "left").select("extraction_id", F.coalesce(to, F.lit(PENDING)).alias("status"), F.when(to.isNotNull(), 2).otherwise(1).alias("version"))


def decide(requests: DataFrame) -> DataFrame:
    """batch_id, request and accepted of requests (expected_batch_version, decisions: array of candidate, expected_revision, action).

    A request holds 1 to MAX_DECISIONS decisions, none on one candidate twice, and is taken whole or not at all: the batch's
    version and every candidate's last revision must be the expected ones.
    """

    def step(state, row):
        version, revisions = state
        items = row["decisions"] or []
        names = [d["candidate"] for d in items]
        good = 1 <= len(items) <= MAX_DECISIONS and len(set(names)) == len(names) and row["expected_batch_version"] == version
        if good and all(revisions.get(d["candidate"], 0) == d["expected_revision"] for d in items):
            return (version + 1, revisions | {n: revisions.get(n, 0) + 1 for n in names}), (True,)
        return state, (False,)

    return replay(requests, ["batch_id"], ["request"], lambda: (1, {}), step, "accepted boolean")


def decision_revisions(requests: DataFrame, accepted: DataFrame) -> DataFrame:
    """batch_id, candidate, revision, supersedes and action of every decision of accepted requests."""
    kept = requests.join(accepted.where("accepted").select("batch_id", "request"), ["batch_id", "request"]).select("batch_id", "request", F.inline("decisions"))
    w = Window.partitionBy("batch_id", "candidate").orderBy("request")
    revision = F.row_number().over(w)
    return kept.select("batch_id", "candidate", revision.alias("revision"), F.when(revision > 1, revision - 1).alias("supersedes"), "action")


def latest_decisions(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("batch_id", "candidate").agg(F.max("revision").alias("revision"), F.max_by("action", "revision").alias("action"))


def preview(batches: DataFrame, candidates: DataFrame, latest: DataFrame) -> DataFrame:
    """One row per batch: counts, errors, digest of its decision vector, the consents an activation needs.

    batches: batch_id, version, declared, source_current, lifecycle; candidates: batch_id, candidate, issues.  A batch's vector
    is digested in one row: cohorts are what one person reviews.
    """
    both = candidates.join(latest, ["batch_id", "candidate"], "left")
    entry = F.concat_ws(":", F.col("candidate").cast("string"), F.coalesce(F.col("revision"), F.lit(0)).cast("string"), F.coalesce("action", F.lit("-")))
    vector = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("candidate", entry.alias("e")))), lambda x: x["e"]), "|")
    sums = both.groupBy("batch_id").agg(
        F.count("*").alias("actual"), F.count_if(F.col("action").isNull()).alias("pending"), F.count_if(F.col("action") == "include").alias("included"), F.count_if(F.col("action") == "exclude").alias("excluded"),
        F.count_if((F.col("action") == "include") & F.col("issues")).alias("invalid"), vector.alias("vector"),
    )
    rows = batches.join(sums, "batch_id", "left").fillna(0, ["actual", "pending", "included", "excluded", "invalid"])
    errors = F.array_compact(
        F.array(
            F.when(~F.col("lifecycle").isin("open", "ready_to_activate"), "batch_not_reviewable"), F.when(~F.col("source_current"), "stale_source"), F.when(F.col("actual") != F.col("declared"), "candidate_reconciliation_mismatch"),
            F.when(F.col("pending") > 0, "pending_candidates"), F.when(F.col("invalid") > 0, "invalid_candidates"),
        )
    )
    digest = F.sha2(F.concat_ws("#", F.col("batch_id").cast("string"), F.col("version").cast("string"), F.col("declared").cast("string"), F.coalesce("vector", F.lit(""))), 256)
    return rows.withColumn("errors", errors).withColumn("vector_sha256", digest).withColumn("needs_exclusions", F.col("excluded") > 0).withColumn("needs_empty", F.col("included") == 0).drop("vector")


def activate(previews: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (batch_id, expected_version, expected_vector, accept_exclusions, accept_empty) with outcome: activated, or the first check that fails."""
    both = requests.join(previews, "batch_id")
    consent = (F.col("needs_exclusions") & ~F.col("accept_exclusions")) | (F.col("needs_empty") & ~F.col("accept_empty"))
    outcome = (
        F.when(F.col("expected_version") != F.col("version"), "stale_version").when(F.array_contains("errors", "stale_source"), "stale_source").when(F.col("expected_vector") != F.col("vector_sha256"), "stale_vector")
        .when(F.size("errors") > 0, "invalid").when(consent, "consent_required").otherwise("activated")
    )
    return both.withColumn("outcome", outcome)


def publish(activated: DataFrame, batches: DataFrame, candidates: DataFrame, latest: DataFrame) -> DataFrame:
    """Candidates of activated batches (batch_id, seq) with their status: of each document the last activated batch stands, those before it are superseded."""
    at = activated.join(batches.select("batch_id", "document_id"), "batch_id")
    last = F.max("seq").over(Window.partitionBy("document_id"))
    at = at.withColumn("stands", F.col("seq") == last).select("batch_id", "document_id", "stands")
    status = F.when(F.col("action") == "exclude", REJECTED).when(F.col("stands"), APPROVED).otherwise(SUPERSEDED)
    return candidates.join(at, "batch_id").join(latest, ["batch_id", "candidate"]).select("document_id", "batch_id", "candidate", status.alias("status"))


def reject(batches: DataFrame, candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (batch_id, expected_version) with outcome, candidates rejected and the document's status.

    batches: batch_id, version, lifecycle, source_current, has_authority (an older active batch or approval of the document).
    """
    members = candidates.groupBy("batch_id").agg(F.count("*").alias("members"), F.count_if(F.col("status") != PENDING).alias("moved"))
    both = requests.join(batches, "batch_id").join(members, "batch_id", "left")
    mutable = F.col("lifecycle").isin("open", "ready_to_activate")
    outcome = F.when(~mutable | (F.col("expected_version") != F.col("version")), "stale_version").when(~F.col("source_current"), "stale_source").when(F.col("moved") > 0, "stale_candidates").otherwise("rejected")
    done = outcome == "rejected"
    return both.select("batch_id", outcome.alias("outcome"), F.when(done, F.coalesce("members", F.lit(0))).otherwise(0).alias("rejected"), F.when(done, F.when(F.col("has_authority"), "verified").otherwise("needs_reprocess")).alias("document_status"))


def promote(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """Candidates (document_id, candidate) with status and version after promotions (document_id, candidate, seq, expected_version).

    The displayed version is approved once; every approval supersedes the document's approval before it.
    """
    done = first_applied(requests, ["document_id", "candidate"], "seq", F.col("expected_version") == 1).where("outcome = 'applied'")
    last = F.max("seq").over(Window.partitionBy("document_id"))
    done = done.withColumn("stands", F.col("seq") == last).select("document_id", "candidate", "stands")
    status = F.when(F.col("stands").isNull(), PENDING).when(F.col("stands"), APPROVED).otherwise(SUPERSEDED)
    version = F.when(F.col("stands").isNull(), 1).when(F.col("stands"), 2).otherwise(3)
    return candidates.join(done, ["document_id", "candidate"], "left").select("document_id", "candidate", status.alias("status"), version.alias("version"))


def upsert_bills(requests: DataFrame) -> DataFrame:
    """issuer_id, billing_period, seq and outcome (opened, kept, replaced, conflict) of requests (verified_id, document_id).

    One open bill per issuer and month: the same verified record again keeps it; another replaces it only if it comes from the
    same document and the open bill's extraction is superseded by then (superseded_ids holds the verified ids that are).
    """

    def step(open_, row):
        if open_ is None:
            return (row["verified_id"], row["document_id"], row["superseded_later"]), ("opened", row["verified_id"])
        if open_[0] == row["verified_id"]:
            return open_, ("kept", open_[0])
        if open_[1] == row["document_id"] and open_[2]:
            return (row["verified_id"], row["document_id"], row["superseded_later"]), ("replaced", row["verified_id"])
        return open_, ("conflict", open_[0])

    return replay(requests, ["issuer_id", "billing_period"], ["seq"], lambda: None, step, "outcome string, open_id long")


def mark_paid(bills: DataFrame, requests: DataFrame, *keys: str) -> DataFrame:
    """bills with payment_status, paid_at and writes after requests (keys, seq, at): the first one pays, all others change nothing.

    A paid bill without an instant is given one once.  Superseded bills, and those without authority, are not found.
    """
    first = requests.groupBy(*keys).agg(F.min_by("at", "seq").alias("at_"), F.count("*").alias("asked_"))
    both = bills.join(first, list(keys), "left")
    found = F.col("at_").isNotNull() & ~F.col("superseded") & F.col("authority")
    writes = found & ((F.col("payment_status") != "paid") | F.col("paid_at").isNull())
    rows = both.withColumn("writes", writes.cast("int")).withColumn("not_found", F.coalesce("asked_", F.lit(0)) - F.when(found, F.coalesce("asked_", F.lit(0))).otherwise(0))
    return rows.withColumn("paid_at", F.when(F.col("writes") == 1, F.col("at_")).otherwise(F.col("paid_at"))).withColumn("payment_status", F.when(F.col("writes") == 1, "paid").otherwise(F.col("payment_status"))).drop("at_", "asked_")


def period_conflicts(cohort: DataFrame, open_bills: DataFrame) -> DataFrame:
    """Members (member_id, document_id, issuer_id, billing_period) whose issuer and month occur twice in the cohort, or belong to an open bill of another document."""
    twice = F.count("*").over(Window.partitionBy("cohort_id", "issuer_id", "billing_period")) > 1
    owned = open_bills.select("issuer_id", "billing_period", F.col("document_id").alias("owner_"))
    rows = cohort.withColumn("twice_", twice).join(owned, ["issuer_id", "billing_period"], "left")
    reason = F.when(F.col("twice_"), "duplicate_in_cohort").when(F.col("owner_").isNotNull() & (F.col("owner_") != F.col("document_id")), "owned_elsewhere")
    return rows.withColumn("reason", reason).where("reason is not null").select("member_id", "issuer_id", "billing_period", "reason")


# Canonical forms of extracted scalars, as JSON text, before they are compared with verified values.


def canonical_text(raw: Column) -> Column:
    return F.nullif(F.trim(raw), F.lit(""))


def canonical_number(raw: Column) -> Column:
    """Plain decimal text of what is a number; anything else as it stands."""
    number = F.trim(raw).try_cast("decimal(38,10)")
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(plain, raw)


def canonical_date(raw: Column) -> Column:
    """ISO text of a date without white space around it; anything else as it stands."""
    iso = F.when(raw == F.trim(raw), F.try_to_date(raw, "yyyy-M-d").cast("string"))
    return F.coalesce(iso, raw)


CANONICAL = {"date": canonical_date, "number": canonical_number, "text": canonical_text}


def corrections(verified: DataFrame, extracted: DataFrame, key: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One audit row (row_pk, field, old_value, new_value) for every field whose verified value is not the payload's canonical one.

    fields: verified column -> (name in the payload, kind).  extracted: key, payload (JSON; a value or {"value": ...}).
    """
    both = verified.join(extracted.select(F.col(key).alias("key_"), "payload"), F.col(key) == F.col("key_"), "left")

    def pair(column, name, kind):
        raw = F.coalesce(F.get_json_object("payload", f"$.{name}.value"), F.get_json_object("payload", f"$.{name}"))
        now = F.col(column).cast("string")
        return F.struct(F.lit(column).alias("field"), CANONICAL[kind](raw).alias("old_value"), (canonical_number(now) if kind == "number" else now).alias("new_value"))

    pairs = F.array(*[pair(c, *spec) for c, spec in fields.items()])
    changed = F.filter(pairs, lambda p: ~p["old_value"].eqNullSafe(p["new_value"]))
    return both.select(F.col(key).cast("string").alias("row_pk"), F.explode(changed).alias("c")).select("row_pk", "c.*")
