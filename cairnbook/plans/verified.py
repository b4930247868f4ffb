"""Queries over verified records: filters, joins, templates, sorts and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnbook.operators import authority, intent
from cairnbook.plans.registry import query, rows_sql
from cairnbook.sources import fixtures as fx
from cairnbook.sources.fixtures import SQL_ACTIVE, SQL_BATCHES, SQL_EXTRACTED, SQL_VERIFIED


def active(s, d):
    return authority.active(fx.verified(s, d), fx.extracted(s, d), fx.batches(s, d))


def with_batch(s, d):
    return authority.with_batch(fx.extracted(s, d), fx.batches(s, d))


A, V, X = f"WITH {SQL_ACTIVE} ", f"WITH {SQL_VERIFIED} ", f"WITH {SQL_EXTRACTED}, {SQL_BATCHES} "


@query("a1_table_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def a1(s, d):
    return fx.table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")


@query("b1_authority_filter", A + "SELECT id, document_id FROM active")
def b1(s, d):
    return active(s, d).select("id", "document_id")


@query("b2_range_conjunction", A + "SELECT id, CAST(total_amount AS DOUBLE) AS amount FROM active WHERE transaction_date >= DATE '1996-01-01' AND transaction_date <= DATE '1997-12-31' AND total_amount >= 50000 AND total_amount <= 200000")
def b2(s, d):
    f = active(s, d).where(F.col("transaction_date").between(dt.date(1996, 1, 1), dt.date(1997, 12, 31)) & F.col("total_amount").between(50000, 200000))
    return f.select("id", F.col("total_amount").cast("double").alias("amount"))


@query("b3_typed_slot_filters", A + "SELECT id FROM active WHERE category = 'BUILDING' AND transaction_date BETWEEN DATE '1996-06-01' AND DATE '1996-06-30'")
def b3(s, d):
    slots = intent.Intent("sum", dt.date(1996, 6, 1), dt.date(1996, 6, 30), category="BUILDING")
    return intent.filtered(active(s, d), slots).select("id")


@query("b4_document_listing", f"WITH {SQL_VERIFIED}, {SQL_EXTRACTED} SELECT DISTINCT v.document_id FROM fx_verified v JOIN fx_extracted e ON e.extraction_id = v.extracted_id WHERE e.status = 'approved' AND v.total_amount >= 100000")
def b4(s, d):
    v, e = fx.verified(s, d).where("total_amount >= 100000"), fx.extracted(s, d).where("status = 'approved'")
    return v.join(e, v["extracted_id"] == e["extraction_id"], "left_semi").select("document_id").distinct()


@query("b5_tuple_in", X + "SELECT extraction_id FROM fx_extracted WHERE (extraction_id, version) IN (SELECT active_batch_id, active_batch_id % 7 FROM fx_batches WHERE lifecycle = 'active')")
def b5(s, d):
    pairs = fx.batches(s, d).where("lifecycle = 'active'").select(F.col("active_batch_id").alias("a"), (F.col("active_batch_id") % 7).cast("int").alias("b"))
    return fx.extracted(s, d).join(pairs, (F.col("extraction_id") == F.col("a")) & (F.col("version") == F.col("b")), "left_semi").select("extraction_id")


@query("b6_null_tests", f"WITH {SQL_EXTRACTED} SELECT extraction_id, batch_id IS NULL AS legacy FROM fx_extracted")
def b6(s, d):
    return fx.extracted(s, d).select("extraction_id", F.col("batch_id").isNull().alias("legacy"))


@query("b7_is_distinct_from", V + "SELECT id FROM fx_verified WHERE currency IS DISTINCT FROM 'JPY'")
def b7(s, d):
    return fx.verified(s, d).where(~F.col("currency").eqNullSafe("JPY")).select("id")


@query("b8_case_projection", X + "SELECT extraction_id, CASE WHEN b.lifecycle = 'active' THEN 'live' WHEN b.lifecycle = 'open' THEN 'waiting' ELSE 'legacy' END AS state FROM fx_extracted LEFT JOIN fx_batches b ON b.active_batch_id = batch_id")
def b8(s, d):
    return with_batch(s, d).select("extraction_id", F.when(F.col("lifecycle") == "active", "live").when(F.col("lifecycle") == "open", "waiting").otherwise("legacy").alias("state"))


@query("b9_half_open_days", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")
def b9(s, d):
    ts = F.col("ts").cast("timestamp_ntz")
    return fx.table(s, d, "events").where((ts >= F.lit("2024-01-05").cast("timestamp_ntz")) & (ts < F.expr("cast('2024-01-07' as timestamp_ntz) + interval 1 day"))).select("event_id")


@query("b10_null_parameter_guard", V + "SELECT id FROM fx_verified WHERE (CAST(NULL AS DATE) IS NULL OR transaction_date >= CAST(NULL AS DATE)) AND total_amount > 150000")
def b10(s, d):
    rows, begin = fx.verified(s, d), None
    rows = rows if begin is None else rows.where(F.col("transaction_date") >= begin)
    return rows.where("total_amount > 150000").select("id")


@query("b11_json_path_predicate", "SELECT event_id FROM events WHERE regexp_full_match(json_extract_string(props, '$.k'), '[1-9][0-9]*') AND TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) = 7")
def b11(s, d):
    k = F.get_json_object("props", "$.k")
    return fx.table(s, d, "events").where(k.rlike("^[1-9][0-9]*$") & (k.try_cast("int") == 7)).select("event_id")


@query("b12_empty_array_compare", f"WITH {SQL_EXTRACTED} SELECT extraction_id FROM fx_extracted WHERE len(CASE WHEN issue LIKE '1%' THEN [issue] ELSE [] END) = 0")
def b12(s, d):
    issues = F.when(F.col("issue").startswith("1"), F.array("issue")).otherwise(F.array().cast("array<string>"))
    return fx.extracted(s, d).where(F.size(issues) == 0).select("extraction_id")


@query("b13_exceptions_only", f"WITH {SQL_EXTRACTED} SELECT extraction_id FROM fx_extracted e WHERE issue LIKE '1%' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = e.extraction_id AND l_returnflag = 'R' AND l_quantity > 45)")
def b13(s, d):
    flag = fx.table(s, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("k")).distinct().withColumn("hit", F.lit(True))
    return fx.extracted(s, d).join(flag, F.col("extraction_id") == F.col("k"), "left").where(F.col("issue").startswith("1") | F.col("hit").isNotNull()).select("extraction_id")


@query("b16_current_source_predicate", f"WITH {SQL_EXTRACTED}, m AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1) SELECT o.o_orderkey FROM orders o JOIN m ON m.o_custkey = o.o_custkey AND m.k = o.o_orderkey")
def b16(s, d):
    o = fx.table(s, d, "orders")
    return o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")).select("o_orderkey")


@query("b18_verified_projection", V + "SELECT id, CASE WHEN id % 10 = 0 THEN 'corrected' ELSE category END AS category, coalesce(CASE WHEN id % 10 = 1 THEN CAST(0 AS DOUBLE) END, CAST(total_amount AS DOUBLE)) AS amount FROM fx_verified")
def b18(s, d):
    return fx.verified(s, d).select("id", F.when(F.col("id") % 10 == 0, "corrected").otherwise(F.col("category")).alias("category"), F.coalesce(F.when(F.col("id") % 10 == 1, F.lit(0.0)), F.col("total_amount").cast("double")).alias("amount"))


@query("j1_inner_two_keys", f"WITH {SQL_VERIFIED}, {SQL_EXTRACTED} SELECT v.id, e.status FROM fx_verified v JOIN fx_extracted e ON e.extraction_id = v.extracted_id AND e.extraction_document_id = v.document_id")
def j1(s, d):
    return fx.verified(s, d).join(fx.extracted(s, d), (F.col("extracted_id") == F.col("extraction_id")) & (F.col("document_id") == F.col("extraction_document_id"))).select("id", "status")


@query("j2_left_outer", X + "SELECT extraction_id, lifecycle FROM fx_extracted LEFT JOIN fx_batches ON active_batch_id = batch_id")
def j2(s, d):
    return with_batch(s, d).select("extraction_id", "lifecycle")


@query("j3_dimension_join", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j3(s, d):
    # nation and region are fixed tables of 25 and 5 rows
    n, r = fx.table(s, d, "nation"), fx.table(s, d, "region")
    return fx.table(s, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("j4_fact_document_join", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount > 0.08")
def j4(s, d):
    return fx.table(s, d, "lineitem").where("l_discount > 0.08").join(fx.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("j5_conditional_join", A + "SELECT count(*) AS n FROM active a JOIN orders o ON o.o_orderkey = a.document_id WHERE o.o_orderpriority = '1-URGENT'")
def j5(s, d):
    documents = fx.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("doc_class"))
    return intent.filtered(active(s, d), intent.Intent("count", doc_class="1-URGENT"), documents).agg(F.count("*").alias("n"))


@query("j6_exists_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def j6(s, d):
    o = fx.table(s, d, "orders").where("o_totalprice > 150000")
    return fx.table(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("j7_not_exists_anti", f"WITH {SQL_EXTRACTED} SELECT extraction_id FROM fx_extracted WHERE status = 'approved' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = extraction_id AND l_quantity > 40)")
def j7(s, d):
    return fx.extracted(s, d).where("status = 'approved'").join(fx.table(s, d, "lineitem").where("l_quantity > 40"), F.col("extraction_id") == F.col("l_orderkey"), "left_anti").select("extraction_id")


@query("j8_scalar_count", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n FROM orders")
def j8(s, d):
    n = fx.table(s, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return fx.table(s, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j9_lateral_latest", "SELECT c_custkey, o.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o")
def j9(s, d):
    latest = fx.table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return fx.table(s, d, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("j10_groupwise_max", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN (SELECT l_orderkey AS k, max(l_linenumber) AS m FROM lineitem GROUP BY 1) ON k = l_orderkey AND m = l_linenumber")
def j10(s, d):
    rows = fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    w = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return rows.withColumn("m", w).where("l_linenumber = m").drop("m")


@query("j11_update_from", "SELECT s_suppkey, coalesce(n_name, s_name) AS s_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey = 1")
def j11(s, d):
    n = F.broadcast(fx.table(s, d, "nation").where("n_regionkey = 1"))
    return fx.table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", "s_name").alias("s_name"))


@query("j12_lookup_lists", "SELECT o_orderkey, list_sort(list(l_linenumber)) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j12(s, d):
    return fx.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("lines"))


@query("j17_three_way_outer", f"WITH {SQL_VERIFIED}, {SQL_EXTRACTED}, {SQL_BATCHES} SELECT id, status, lifecycle FROM fx_verified JOIN fx_extracted ON extraction_id = extracted_id LEFT JOIN fx_batches ON active_batch_id = batch_id")
def j17(s, d):
    return fx.verified(s, d).join(with_batch(s, d), F.col("extracted_id") == F.col("extraction_id")).select("id", "status", "lifecycle")


@query("j18_history_gather", "SELECT DISTINCT * FROM (SELECT 'orders' AS tbl, CAST(o_orderkey AS VARCHAR) AS pk FROM orders WHERE o_custkey = 1 UNION SELECT 'lineitem', CAST(l_orderkey AS VARCHAR) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 1 UNION SELECT 'customer', '1')")
def j18(s, d):
    o = fx.table(s, d, "orders").where("o_custkey = 1").select(F.col("o_orderkey").cast("string").alias("pk"))
    line = fx.table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("pk")).join(o, "pk", "left_semi")
    parts = [o.select(F.lit("orders").alias("tbl"), "pk"), line.select(F.lit("lineitem").alias("tbl"), "pk"), s.range(1).select(F.lit("customer").alias("tbl"), F.lit("1").alias("pk"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("e1_verified_total", A + "SELECT coalesce(currency, 'unspecified') AS currency, CAST(coalesce(sum(total_amount), 0) AS DOUBLE) AS amount, count(id) AS record_count FROM active GROUP BY 1")
def e1(s, d):
    return intent.plan(active(s, d), intent.Intent("sum"))


@query("e2_verified_average", A + "SELECT coalesce(currency, 'unspecified') AS currency, round(avg(CAST(total_amount AS DOUBLE)), 4) AS amount, count(id) AS record_count FROM active GROUP BY 1")
def e2(s, d):
    return intent.plan(active(s, d), intent.Intent("average"))


@query("e3_verified_count", A + "SELECT count(id) AS record_count FROM active WHERE transaction_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
def e3(s, d):
    return intent.plan(active(s, d), intent.Intent("count", dt.date(1997, 1, 1), dt.date(1997, 12, 31)))


@query("e4_by_counterparty_currency", A + "SELECT counterparty, coalesce(currency, 'unspecified') AS currency, CAST(sum(total_amount) AS DOUBLE) AS amount, count(id) AS record_count FROM active GROUP BY 1, 2")
def e4(s, d):
    return active(s, d).groupBy("counterparty", F.coalesce("currency", F.lit("unspecified")).alias("currency")).agg(F.sum("total_amount").cast("double").alias("amount"), F.count("id").alias("record_count"))


TOP = "SELECT counterparty, currency, amount, record_count, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY amount DESC, counterparty) AS place FROM (SELECT counterparty, coalesce(currency, 'unspecified') AS currency, CAST(sum(total_amount) AS DOUBLE) AS amount, count(id) AS record_count FROM active GROUP BY 1, 2)) WHERE place <= 5"


@query("w2_top_counterparties", A + TOP)
def w2(s, d):
    return intent.plan(active(s, d), intent.Intent("top_counterparties"))


@query("e6_conditional_sum", f"WITH {SQL_EXTRACTED} SELECT status, CAST(sum(CASE WHEN issue LIKE '1%' THEN 1 ELSE 0 END) AS BIGINT) AS with_issue, count(*) AS n FROM fx_extracted GROUP BY 1")
def e6(s, d):
    return fx.extracted(s, d).groupBy("status").agg(F.count_if(F.col("issue").startswith("1")).alias("with_issue"), F.count("*").alias("n"))


@query("e7_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def e7(s, d):
    return fx.table(s, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"))


@query("e8_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) = 1")
def e8(s, d):
    return fx.table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n = 1")


@query("e9_min_max", "SELECT o_custkey, min(o_orderkey) AS first_key, max(o_orderdate) AS last_day FROM orders GROUP BY 1")
def e9(s, d):
    return fx.table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderdate").alias("last_day"))


@query("e10_two_key_counts", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS excluded, count(*) FILTER (l_returnflag = 'A') AS included FROM lineitem GROUP BY 1")
def e10(s, d):
    return fx.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("excluded"), F.count_if(F.col("l_returnflag") == "A").alias("included"))


@query("e11_distinct_after_join", "SELECT DISTINCT o_orderkey, o_orderdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_tax > 0.05 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def e11(s, d):
    line = fx.table(s, d, "lineitem").where("l_tax > 0.05")
    return fx.table(s, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)


@query("e12_first_seen_distinct", "SELECT event_type, min(event_id) AS first_pos FROM events GROUP BY 1")
def e12(s, d):
    return fx.table(s, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first_pos"))


@query("e24_review_counts", f"WITH {SQL_EXTRACTED} SELECT count(*) FILTER (status = 'pending_review') AS pending, count(*) FILTER (status = 'approved') AS included, count(*) FILTER (status = 'superseded') AS excluded, count(*) FILTER (issue LIKE '1%') AS errors FROM fx_extracted")
def e24(s, d):
    at = F.col("status")
    return fx.extracted(s, d).agg(F.count_if(at == "pending_review").alias("pending"), F.count_if(at == "approved").alias("included"), F.count_if(at == "superseded").alias("excluded"), F.count_if(F.col("issue").startswith("1")).alias("errors"))


@query("w1_count_over_partition", f"WITH {SQL_EXTRACTED} SELECT extraction_id, CAST(count(*) OVER (PARTITION BY version, status) AS BIGINT) AS n FROM fx_extracted")
def w1(s, d):
    return fx.extracted(s, d).select("extraction_id", F.count("*").over(Window.partitionBy("version", "status")).alias("n"))


@query("w3_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def w3(s, d):
    e = fx.table(s, d, "events")
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.event_id", "r.event_type")


@query("w9_decision_revision", "SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS revision, lag(event_id) OVER w AS supersedes FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w9(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return fx.table(s, d, "events").select("event_id", F.row_number().over(w).alias("revision"), F.lag("event_id").over(w).alias("supersedes"))


@query("g1_newest_first", V + "SELECT id, transaction_date FROM fx_verified ORDER BY transaction_date DESC, id DESC LIMIT 100")
def g1(s, d):
    return fx.verified(s, d).select("id", "transaction_date").orderBy(F.desc("transaction_date"), F.desc("id")).limit(100)


@query("g2_case_priority_sort", X + "SELECT extraction_id, status FROM fx_extracted LEFT JOIN fx_batches ON active_batch_id = batch_id ORDER BY CASE WHEN issue LIKE '1%' THEN 0 WHEN lifecycle = 'open' THEN 1 ELSE 2 END, extraction_id LIMIT 60")
def g2(s, d):
    first = F.when(F.col("issue").startswith("1"), 0).when(F.col("lifecycle") == "open", 1).otherwise(2)
    return with_batch(s, d).orderBy(first, "extraction_id").limit(60).select("extraction_id", "status")


@query("g3_page", V + "SELECT id FROM fx_verified ORDER BY transaction_date DESC, id DESC LIMIT 25 OFFSET 50")
def g3(s, d):
    return fx.verified(s, d).orderBy(F.desc("transaction_date"), F.desc("id")).offset(50).limit(25).select("id")


@query("h1_union_distinct", "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 48 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000")
def h1(s, d):
    a, b = fx.table(s, d, "lineitem").where("l_quantity > 48").select(F.col("l_suppkey").alias("k")), fx.table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("k"))
    return a.union(b).distinct()


@query("h2_set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def h2(s, d):
    return fx.table(s, d, "customer").select("c_custkey").exceptAll(fx.table(s, d, "orders").select("o_custkey").distinct())


@query("h3_set_equality", "SELECT count(*) = 0 AS equal FROM ((SELECT DISTINCT l_orderkey AS k FROM lineitem EXCEPT SELECT o_orderkey FROM orders) UNION ALL (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem))")
def h3(s, d):
    a, b = fx.table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct(), fx.table(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    return a.join(b, "k", "left_anti").union(b.join(a, "k", "left_anti")).agg((F.count("*") == 0).alias("equal"))


@query("d7_amount_text", V + "SELECT id, coalesce(currency, 'unspecified') || ' ' || format('{:,.2f}', CAST(total_amount AS DOUBLE)) AS amount_text FROM fx_verified")
def d7(s, d):
    return fx.verified(s, d).select("id", F.concat_ws(" ", F.coalesce("currency", F.lit("unspecified")), F.format_number(F.col("total_amount").cast("double"), 2)).alias("amount_text"))


@query("l2_hybrid_total", A + "SELECT coalesce(currency, 'unspecified') AS currency, CAST(coalesce(sum(total_amount), 0) AS DOUBLE) AS amount, count(id) AS record_count FROM active WHERE document_id IN (SELECT vec_id FROM embeddings WHERE label = 3) GROUP BY 1")
def l2(s, d):
    hits = fx.table(s, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("document_id"))
    return intent.hybrid(active(s, d), hits, intent.Intent("sum"))


QUESTIONS = ["6月の食費の合計は？", "Tháng 7 năm 2026 tổng chi tiêu", "average at Sample Shop in June 2026", "how many receipts last month", "top merchants this year", "compare food and travel", "which receipt did I spend most", "what does the warranty say"]


TODAY = dt.date(2026, 7, 15)


def asked(s, questions):
    return s.createDataFrame([(q,) for q in questions], "question string")


def _month(year, month):
    return dt.date(year, month, 1), dt.date(year, month, 31 if month in (7, 12) else 30)


L1_ROWS = (
    (QUESTIONS[0], "sql", "sum", *_month(2026, 6), None, "食費", None), (QUESTIONS[1], "sql", "sum", *_month(2026, 7), None, None, None), (QUESTIONS[2], "sql", "average", *_month(2026, 6), "Sample Shop", None, None),
    (QUESTIONS[3], "sql", "count", *_month(2026, 6), None, None, "receipt"), (QUESTIONS[4], "hybrid", "none", None, None, None, None, None), (QUESTIONS[5], "sql", "unsupported", None, None, None, "食費", None),
    (QUESTIONS[6], "hybrid", "top_counterparties", None, None, None, None, "receipt"), (QUESTIONS[7], "semantic", "none", None, None, None, None, None),
)


@query("l1_route_and_intent", rows_sql("question, route, metric, date_from, date_to, counterparty, category, doc_class", *L1_ROWS))
def l1(s, d):
    """Routes and typed slots of fixed questions, as of 2026-07-15; the model's vote comes with words around it, or fails."""

    def vote(q):
        if "merchants" in q:
            return "Route: HYBRID\n"
        raise TimeoutError

    ways = s.createDataFrame([(q, intent.route(q, vote)) for q in QUESTIONS], "question string, route string")
    return intent.slots(ways, F.lit(TODAY)).select("question", "route", "metric", "date_from", "date_to", "counterparty", "category", "doc_class")


def re2(pattern: str) -> str:
    return pattern.replace("(?iu)", "(?i)").replace("'", "''")


EVERY = "e AS (SELECT text FROM conversations UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{q}')" for q in QUESTIONS) + ") t(text))"


def every(s, d):
    """Turns of conversations and the fixed questions."""
    return fx.table(s, d, "conversations").select("text").unionByName(s.createDataFrame([(q,) for q in QUESTIONS], "text string"))


@query("d1_aggregation_regex", f"WITH {EVERY} SELECT md5(text) AS k, regexp_matches(text, '{re2(intent.AGGREGATION)}') AS asks FROM e WHERE text IS NOT NULL")
def d1(s, d):
    return every(s, d).where("text is not null").select(F.md5("text").alias("k"), F.col("text").rlike(intent.AGGREGATION).alias("asks"))


METRIC = f"CASE WHEN NOT regexp_matches(text, '{re2(intent.AGGREGATION)}') THEN 'none' " + " ".join(f"WHEN regexp_matches(text, '{re2(p)}') THEN '{n}'" for n, p in intent.METRICS) + " ELSE 'sum' END"


@query("d3_metric_choice", f"WITH {EVERY} SELECT md5(text) AS k, {METRIC} AS metric FROM e WHERE text IS NOT NULL")
def d3(s, d):
    return every(s, d).where("text is not null").select(F.md5("text").alias("k"), intent.metric_of(F.col("text")).alias("metric"))


D4_ROWS = (("2026-06 total", *_month(2026, 6)), ("6月の合計", *_month(2026, 6)), ("tháng 6 năm 2025 tổng", *_month(2025, 6)), ("spent in June", *_month(2026, 6)), ("last month total", *_month(2026, 6)), ("this month total", *_month(2026, 7)), ("last year total", dt.date(2025, 1, 1), dt.date(2025, 12, 31)), ("this year total", dt.date(2026, 1, 1), dt.date(2026, 12, 31)), ("total", None, None))


@query("d4_date_slots", rows_sql("question, date_from, date_to", *D4_ROWS))
def d4(s, d):
    return intent.slots(asked(s, [r[0] for r in D4_ROWS]), F.lit(TODAY)).select("question", "date_from", "date_to")


D6_ROWS = (
    ("total at Sample Shop in June", "Sample Shop", None, None), ("合計 取引先: 東京ガス", "東京ガス", None, None), ("合計 category: 会議費.", None, "会議費", None), ("food total", None, "食費", None), ("invoice total", None, None, "invoice"),
    ("請求 total", None, None, "recurring_bill"), ("レシート total", None, None, "receipt"), ("請求書 total", None, None, "invoice"), ("no amounts here", None, None, None),
)


@query("d6_text_slots", rows_sql("question, counterparty, category, doc_class", *D6_ROWS))
def d6(s, d):
    return intent.slots(asked(s, [r[0] for r in D6_ROWS]), F.lit(TODAY)).select("question", "counterparty", "category", "doc_class")


@query("l4_templates", A + "SELECT 'sum' AS template, count(DISTINCT coalesce(currency, 'unspecified')) AS n FROM active UNION ALL SELECT 'average', count(DISTINCT coalesce(currency, 'unspecified')) FROM active UNION ALL SELECT 'count', 1 UNION ALL SELECT 'unsupported', 0")
def l4(s, d):
    """Rows that each template gives over all records with authority."""
    rows = active(s, d)
    parts = [intent.plan(rows, intent.Intent(m)).agg(F.lit(m).alias("template"), F.count("*").alias("n")) for m in ("sum", "average", "count", "unsupported")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("d2_narrowing_regex", f"WITH {EVERY} SELECT md5(text) AS k, regexp_matches(text, '{re2(intent.NARROWING)}') AS narrows FROM e WHERE text IS NOT NULL")
def d2(s, d):
    return every(s, d).where("text is not null").select(F.md5("text").alias("k"), F.col("text").rlike(intent.NARROWING).alias("narrows"))
