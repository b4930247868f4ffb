"""Deterministic bookkeeping views over the driver's tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified records: orders with their customers."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    currency = F.when(F.col("c_nationkey") % 4 == 0, "JPY").when(F.col("c_nationkey") % 4 == 1, "USD").when(F.col("c_nationkey") % 4 == 2, "VND")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderkey").alias("extracted_id"), F.to_date("o_orderdate").alias("transaction_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total_amount"), F.col("c_name").alias("counterparty"), F.col("c_mktsegment").alias("category"), currency.alias("currency"),
    )


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending_review").otherwise("superseded")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("extraction_id"), F.col("o_orderkey").alias("extraction_document_id"), status.alias("status"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("batch_id"), (F.col("o_orderkey") % 7).cast("int").alias("version"), F.col("o_orderpriority").alias("issue"),
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("active_batch_id"), F.when(F.col("o_orderkey") % 2 == 0, "active").otherwise("open").alias("lifecycle"), F.when(F.col("o_orderkey") % 5 != 0, "financial").otherwise("generic").alias("record_kind"),
    )


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bill per issuer and month."""
    return (
        table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 25).alias("issuer_id"), F.to_date(F.trunc("l_shipdate", "month")).alias("billing_period"))
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("amount"), F.sum(F.col("l_quantity").cast("decimal(18,4)")).cast("decimal(18,4)").alias("consumption_value"))
        .withColumn("consumption_unit", F.lit("kWh"))
    )


def staged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged rows of strings: one per event."""
    e = table(spark, sf_dir, "events")
    n = F.get_json_object("props", "$.k")
    return e.select(
        (F.col("user_id") % 10).alias("document_id"), F.lit(1).alias("source_version"), F.col("event_type").alias("source_location"), F.col("event_id").alias("row_index"),
        F.create_map(F.lit("k"), F.coalesce(n, F.lit("")), F.lit("value"), F.coalesce(F.round("value", 2).cast("decimal(18,2)").cast("string"), F.lit("")), F.lit("event"), F.col("event_type"), F.lit("day"), F.date_format("ts", "yyyy-MM-dd")).alias("values"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "dead").otherwise("done")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("job_type"), F.concat(F.lit("key-"), (F.col("event_id") % 997).cast("string")).alias("idempotency_key"), status.alias("status"),
        (F.col("event_id") % 5).cast("int").alias("attempts"), F.col("ts").alias("available_at"), (F.col("ts") + F.expr("interval 10 minutes")).alias("lease_expires_at"), F.col("ts").alias("created_at"),
        F.concat(F.lit("w"), (F.col("event_id") % 7).cast("string")).alias("lease_owner"), F.concat(F.lit('{"source": {"version": "'), (F.col("event_id") % 13).cast("string"), F.lit('"}, "pipeline": {"completed": '), F.when(F.col("event_id") % 3 == 0, "true").otherwise("false"), F.lit("}}")).alias("payload"),
    )


def derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of derived formats: most dead, some named as the successor of the job before them in their group."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 41 == 0, "queued").when(F.col("event_id") % 41 == 1, "done").when(F.col("event_id") % 2 == 0, "failed").otherwise("dead")
    before = F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    key = F.when((F.col("event_id") % 3 == 0) & before.isNotNull(), F.concat(F.lit("recovery:"), before.cast("string"))).otherwise(F.concat(F.lit("key-"), F.col("event_id").cast("string")))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("target"), status.alias("status"), F.col("ts").alias("created_at"), key.alias("idempotency_key"))


def cohort_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch of candidates per order: its lines."""
    o = table(spark, sf_dir, "orders")
    lines = cohort_candidates(spark, sf_dir).groupBy(F.col("batch_id").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return o.join(lines, "o_orderkey").select(
        F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("document_id"), F.lit(1).alias("version"), (F.col("n") + F.when(F.col("o_orderkey") % 17 == 0, 1).otherwise(0)).alias("declared"), (F.col("o_orderkey") % 13 != 0).alias("source_current"),
        F.when(F.col("o_orderstatus") == "F", "ready_to_activate").when(F.col("o_orderstatus") == "O", "open").otherwise("active").alias("lifecycle"),
    )


def cohort_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per line number of an order."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("candidate")).agg(F.max("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    return lines.select("batch_id", "candidate", (F.col("q") > 49).alias("issues"), F.when(F.col("q") == 1, "approved").otherwise("pending_review").alias("status"), F.when(F.col("f") == "R", "exclude").otherwise("include").alias("action"))


def cohort_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests for each batch: lines 1 to 4, then lines 3 and on, so that 3 and 4 are decided twice; some expect what no longer holds."""
    lines = cohort_candidates(spark, sf_dir).select("batch_id", "candidate", "action")
    first = lines.where("candidate <= 4").select("*", F.lit(1).alias("request"), F.lit(0).alias("expected_revision"))
    again = F.when((F.col("candidate") <= 4) & (F.col("batch_id") % 11 != 0), 1).otherwise(0)
    second = lines.where("candidate >= 3").select("*", F.lit(2).alias("request"), again.alias("expected_revision"))
    both = first.unionByName(second).groupBy("batch_id", "request").agg(F.array_sort(F.collect_list(F.struct("candidate", "expected_revision", "action"))).alias("decisions"))
    return both.withColumn("expected_batch_version", F.when((F.col("request") == 2) & (F.col("batch_id") % 7 != 0), 2).otherwise(1))


SQL_VERIFIED = """
fx_verified AS (
  SELECT o_orderkey AS id, o_orderkey AS document_id, o_orderkey AS extracted_id, CAST(o_orderdate AS DATE) AS transaction_date, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
    c_name AS counterparty, c_mktsegment AS category, CASE c_nationkey % 4 WHEN 0 THEN 'JPY' WHEN 1 THEN 'USD' WHEN 2 THEN 'VND' END AS currency
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
SQL_EXTRACTED = """
fx_extracted AS (
  SELECT o_orderkey AS extraction_id, o_orderkey AS extraction_document_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending_review' ELSE 'superseded' END AS status,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS batch_id, CAST(o_orderkey % 7 AS INTEGER) AS version, o_orderpriority AS issue FROM orders)"""
SQL_BATCHES = """
fx_batches AS (
  SELECT o_orderkey AS active_batch_id, CASE WHEN o_orderkey % 2 = 0 THEN 'active' ELSE 'open' END AS lifecycle, CASE WHEN o_orderkey % 5 <> 0 THEN 'financial' ELSE 'generic' END AS record_kind
  FROM orders WHERE o_orderkey % 3 <> 0)"""
SQL_ACTIVE = f"""{SQL_VERIFIED}, {SQL_EXTRACTED}, {SQL_BATCHES},
active AS (
  SELECT v.* FROM fx_verified v JOIN fx_extracted e ON e.extraction_id = v.extracted_id AND e.extraction_document_id = v.document_id LEFT JOIN fx_batches b ON b.active_batch_id = e.batch_id
  WHERE e.status = 'approved' AND (e.batch_id IS NULL OR (b.lifecycle = 'active' AND b.record_kind = 'financial')))"""
SQL_BILLS = """
fx_bills AS (
  SELECT l_suppkey % 25 AS issuer_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS billing_period, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS consumption_value, 'kWh' AS consumption_unit FROM lineitem GROUP BY 1, 2)"""
SQL_ROWS = """
fx_rows AS (
  SELECT user_id % 10 AS document_id, 1 AS source_version, event_type AS source_location, event_id AS row_index, coalesce(json_extract_string(props, '$.k'), '') AS k,
    coalesce(CAST(CAST(round(value, 2) AS DECIMAL(18,2)) AS VARCHAR), '') AS value, event_type AS event, strftime(ts, '%Y-%m-%d') AS day FROM events)"""
SQL_JOBS = """
fx_jobs AS (
  SELECT event_id AS id, user_id AS document_id, event_type AS job_type, 'key-' || (event_id % 997) AS idempotency_key, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'dead' ELSE 'done' END AS status,
    CAST(event_id % 5 AS INTEGER) AS attempts, ts AS available_at, ts + INTERVAL 10 MINUTE AS lease_expires_at, ts AS created_at, 'w' || (event_id % 7) AS lease_owner, CAST(event_id % 13 AS VARCHAR) AS source_version, event_id % 3 = 0 AS completed FROM events)"""
SQL_DERIVATIVES = """
fx_derivatives AS (
  SELECT event_id AS id, user_id AS document_id, event_type AS target, CASE WHEN event_id % 41 = 0 THEN 'queued' WHEN event_id % 41 = 1 THEN 'done' WHEN event_id % 2 = 0 THEN 'failed' ELSE 'dead' END AS status, ts AS created_at,
    CASE WHEN event_id % 3 = 0 AND lag(event_id) OVER w IS NOT NULL THEN 'recovery:' || lag(event_id) OVER w ELSE 'key-' || event_id END AS idempotency_key
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"""
SQL_COHORTS = """
fx_cohorts AS (
  SELECT o_orderkey AS batch_id, o_custkey AS document_id, 1 AS version, n + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS declared, o_orderkey % 13 <> 0 AS source_current,
    CASE o_orderstatus WHEN 'F' THEN 'ready_to_activate' WHEN 'O' THEN 'open' ELSE 'active' END AS lifecycle
  FROM orders JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
fx_candidates AS (
  SELECT l_orderkey AS batch_id, l_linenumber AS candidate, max(l_quantity) > 49 AS issues, CASE WHEN max(l_quantity) = 1 THEN 'approved' ELSE 'pending_review' END AS status, CASE WHEN min(l_returnflag) = 'R' THEN 'exclude' ELSE 'include' END AS action
  FROM lineitem GROUP BY 1, 2),
fx_taken AS (
  SELECT batch_id, count(*) FILTER (candidate <= 4) > 0 AS first, count(*) FILTER (candidate >= 3) > 0 AS asked,
    count(*) FILTER (candidate >= 3) > 0 AND CASE WHEN batch_id % 7 = 0 THEN 1 ELSE 2 END = 1 + CASE WHEN count(*) FILTER (candidate <= 4) > 0 THEN 1 ELSE 0 END AND (batch_id % 11 <> 0 OR count(*) FILTER (candidate IN (3, 4)) = 0) AS second
  FROM fx_candidates GROUP BY 1),
fx_latest AS (
  SELECT * FROM (SELECT c.batch_id, candidate, CAST(CASE WHEN candidate <= 4 THEN 1 ELSE 0 END + CASE WHEN candidate >= 3 AND second THEN 1 ELSE 0 END AS INTEGER) AS revision, action FROM fx_candidates c JOIN fx_taken USING (batch_id)) WHERE revision > 0)"""
