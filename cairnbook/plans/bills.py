"""Queries over recurring bills."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnbook.operators import review, series
from cairnbook.plans.registry import query
from cairnbook.sources import fixtures as fx
from cairnbook.sources.fixtures import SQL_BILLS

B = f"WITH {SQL_BILLS} "
DELTAS = """SELECT p.issuer_id, p.billing_period, m.amount IS NULL AS mom_missing, y.amount IS NULL AS yoy_missing, CAST(p.amount - m.amount AS DOUBLE) AS mom_amount_delta, CAST(p.amount - y.amount AS DOUBLE) AS yoy_amount_delta,
  CAST(p.consumption_value - m.consumption_value AS DOUBLE) AS mom_consumption_delta, round(CAST(p.amount AS DOUBLE) / CAST(p.consumption_value AS DOUBLE), 6) AS unit_price
FROM fx_bills p LEFT JOIN fx_bills m ON m.issuer_id = p.issuer_id AND m.billing_period = CAST(p.billing_period - INTERVAL 1 MONTH AS DATE) LEFT JOIN fx_bills y ON y.issuer_id = p.issuer_id AND y.billing_period = CAST(p.billing_period - INTERVAL 12 MONTH AS DATE)"""


def deltas(s, d, months=None):
    out = series.compare_periods(fx.bills(s, d), months)
    return out.select("issuer_id", "billing_period", "mom_missing", "yoy_missing", F.col("mom_amount_delta").cast("double"), F.col("yoy_amount_delta").cast("double"), F.col("mom_consumption_delta").cast("double"), F.round(F.col("unit_price").cast("double"), 6).alias("unit_price"))


@query("j13_calendar_offset_join", B + DELTAS)
def j13(s, d):
    return deltas(s, d)


@query("w5_last_periods", B + f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id ORDER BY billing_period DESC) AS rn FROM ({DELTAS})) WHERE rn <= 13")
def w5(s, d):
    return deltas(s, d, 13)


W = """w AS (SELECT issuer_id, billing_period, amount, list(CAST(amount AS DOUBLE)) OVER (PARTITION BY issuer_id ORDER BY billing_period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS past FROM fx_bills),
m AS (SELECT *, list_median(past) AS med FROM w WHERE len(past) >= 6)"""


@query("w4_trailing_frame", B.rstrip() + ", " + W + " SELECT issuer_id, billing_period, len(past) AS history, round(med, 4) AS trailing_median FROM m")
def w4(s, d):
    rows = series.trailing(fx.bills(s, d)).where(F.size("amount_past") >= 6)
    return rows.select("issuer_id", "billing_period", F.size("amount_past").cast("long").alias("history"), F.round(series.middle(F.col("amount_past")).cast("double"), 4).alias("trailing_median"))


@query("e15_exact_median", B + "SELECT issuer_id, round(median(CAST(amount AS DOUBLE)), 4) AS median_amount FROM fx_bills GROUP BY 1")
def e15(s, d):
    return series.exact_median(fx.bills(s, d), "amount", "m", "issuer_id").select("issuer_id", F.round(F.col("m").cast("double"), 4).alias("median_amount"))


LINES = "l AS (SELECT 'all' AS scope, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem UNION ALL SELECT l_returnflag || l_linestatus, CAST(l_extendedprice AS DECIMAL(18,2)) FROM lineitem)"


def lines(s, d):
    """Every line's price twice: under one key that holds all lines, and under its flags."""
    price = F.col("l_extendedprice").cast("decimal(18,2)").alias("price")
    rows = fx.table(s, d, "lineitem")
    return rows.select(F.lit("all").alias("scope"), price).unionByName(rows.select(F.concat("l_returnflag", "l_linestatus").alias("scope"), price))


@query("e15_median_of_hot_keys", f"WITH {LINES} SELECT scope, CAST(median(price) AS DOUBLE) AS median_price FROM (SELECT scope, CAST(price AS DOUBLE) AS price FROM l) GROUP BY 1")
def e15b(s, d):
    return series.exact_median(lines(s, d), "price", "m", "scope").select("scope", F.col("m").cast("double").alias("median_price"))


@query("e16_spread_of_hot_keys", f"WITH {LINES}, p AS (SELECT scope, CAST(price * 100 AS BIGINT) AS price FROM l), m AS (SELECT scope, median(price) AS median FROM p GROUP BY 1) SELECT scope, round(any_value(median) / 100, 4) AS median_price, round(median(abs(price - median)) / 100, 4) AS mad FROM p JOIN m USING (scope) GROUP BY scope")
def e16b(s, d):
    return series.spread(lines(s, d), "price", "scope").select("scope", F.round(F.col("median").cast("double"), 4).alias("median_price"), F.round(F.col("mad").cast("double"), 4).alias("mad"))


def _flags(column):
    return f"""SELECT issuer_id, billing_period, {column} AS x, list({column}) OVER (PARTITION BY issuer_id ORDER BY billing_period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS past FROM u"""


def _anomaly_cte(name, column):
    return f"""{name}0 AS ({_flags(column)}), {name}1 AS (SELECT *, list_median(past) AS med FROM {name}0 WHERE len(past) >= 6), {name}2 AS (SELECT *, list_median(list_transform(past, lambda v: abs(v - med))) AS mad FROM {name}1),
{name} AS (SELECT issuer_id, billing_period, '{name}' AS metric FROM {name}2 WHERE CASE WHEN mad > 0 THEN 0.6745 * abs(x - med) / mad > 3.5 ELSE abs(x - med) > 0 END)"""


E16 = B.rstrip() + ", u AS (SELECT issuer_id, billing_period, CAST(amount AS DOUBLE) AS a, CAST(consumption_value AS DOUBLE) AS c, CAST(amount AS DOUBLE) / CAST(consumption_value AS DOUBLE) AS p FROM fx_bills), " + ", ".join(_anomaly_cte(n, c) for n, c in (("consumption", "c"), ("unit_price", "p"), ("amount", "a"))) + " SELECT issuer_id, billing_period, coalesce(c.metric, p.metric, a.metric) AS metric FROM fx_bills b LEFT JOIN consumption c USING (issuer_id, billing_period) LEFT JOIN unit_price p USING (issuer_id, billing_period) LEFT JOIN amount a USING (issuer_id, billing_period) WHERE coalesce(c.metric, p.metric, a.metric) IS NOT NULL"


@query("e16_mad_anomalies", E16)
def e16(s, d):
    return series.anomalies(fx.bills(s, d)).select("issuer_id", "billing_period", "metric")


@query("w12_metric_precedence", E16.replace("SELECT issuer_id, billing_period, coalesce(c.metric, p.metric, a.metric) AS metric FROM fx_bills b", "SELECT coalesce(c.metric, p.metric, a.metric) AS metric, count(*) AS n FROM fx_bills b") + " GROUP BY 1")
def w12(s, d):
    return series.anomalies(fx.bills(s, d)).groupBy("metric").agg(F.count("*").alias("n"))


DUE = "due AS (SELECT issuer_id, billing_period, amount, CASE WHEN issuer_id % 11 <> 0 THEN CAST(billing_period + INTERVAL 40 DAY AS DATE) END AS due_date, CASE WHEN CAST(amount * 100 AS BIGINT) % 4 = 0 THEN 'paid' ELSE 'unpaid' END AS payment_status FROM fx_bills)"


def due(s, d):
    unpaid = F.when((F.col("amount") * 100).cast("long") % 4 == 0, "paid").otherwise("unpaid")
    return fx.bills(s, d).withColumn("due_date", F.when(F.col("issuer_id") % 11 != 0, F.date_add("billing_period", 40))).withColumn("payment_status", unpaid)


D10 = B.rstrip() + f", {DUE} SELECT issuer_id, billing_period, date_diff('day', DATE '1997-06-13', due_date) AS days_left, CASE WHEN due_date < DATE '1997-06-13' THEN 'overdue' ELSE 'upcoming' END AS bucket FROM due WHERE due_date IS NOT NULL AND payment_status <> 'paid' AND due_date <= DATE '1997-06-20'"


@query("d10_reminder_buckets", D10)
def d10(s, d):
    return series.reminders(due(s, d), F.lit("1997-06-13").cast("date"), 7).select("issuer_id", "billing_period", F.col("days_left").cast("long").alias("days_left"), "bucket")


@query("g7_reminder_order", f"SELECT * FROM ({D10}) ORDER BY bucket, days_left, issuer_id LIMIT 40")
def g7(s, d):
    return d10(s, d).orderBy("bucket", "days_left", "issuer_id").limit(40)


@query("d8_unit_price", B + "SELECT issuer_id, billing_period, round(CAST(amount AS DOUBLE) / CAST(consumption_value AS DOUBLE), 6) AS unit_price, CAST(billing_period + INTERVAL 1 MONTH AS DATE) AS next_period FROM fx_bills")
def d8(s, d):
    return fx.bills(s, d).select("issuer_id", "billing_period", F.round(series.unit_price(F.col("amount"), F.col("consumption_value")).cast("double"), 6).alias("unit_price"), F.add_months("billing_period", 1).alias("next_period"))


SAID = "metric, CASE WHEN mad > 0 THEN round(0.6745::DOUBLE * abs(x - med) / mad, 6) END AS robust_z, replace(metric, '_', ' ') || CASE WHEN mad = 0 THEN ' differs from a history without variation' ELSE ' is far from the median of the trailing history' END AS explanation"


@query("d9_explanation", E16.replace("'consumption' AS metric", "'consumption' AS metric, x, med, mad").replace("'unit_price' AS metric", "'unit_price' AS metric, x, med, mad").replace("'amount' AS metric", "'amount' AS metric, x, med, mad").split(" SELECT issuer_id, billing_period, coalesce(")[0] + f", f AS (SELECT 1 AS rank, * FROM consumption UNION ALL SELECT 2, * FROM unit_price UNION ALL SELECT 3, * FROM amount) SELECT issuer_id, billing_period, {SAID} FROM f QUALIFY row_number() OVER (PARTITION BY issuer_id, billing_period ORDER BY rank) = 1")
def d9(s, d):
    return series.anomalies(fx.bills(s, d)).select("issuer_id", "billing_period", "metric", F.round("robust_z", 6).alias("robust_z"), "explanation")


UPSERT = "u AS (SELECT l_suppkey % 25 AS issuer_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS billing_period, l_orderkey AS verified_id, l_orderkey % 3 AS document_id, l_orderkey % 4 < 2 AS late, row_number() OVER (PARTITION BY l_suppkey % 25, date_trunc('month', l_shipdate) ORDER BY l_orderkey, l_linenumber, l_partkey) AS seq FROM (SELECT DISTINCT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem))"


@query("i14_bill_upsert", f"""WITH RECURSIVE {UPSERT},
r AS (
  SELECT issuer_id, billing_period, seq, 'opened' AS outcome, verified_id AS open_id, document_id AS doc, late FROM u WHERE seq = 1
  UNION ALL
  SELECT u.issuer_id, u.billing_period, u.seq, CASE WHEN u.verified_id = r.open_id THEN 'kept' WHEN u.document_id = r.doc AND r.late THEN 'replaced' ELSE 'conflict' END, CASE WHEN u.document_id = r.doc AND r.late THEN u.verified_id ELSE r.open_id END,
    r.doc, CASE WHEN u.document_id = r.doc AND r.late THEN u.late ELSE r.late END
  FROM r JOIN u ON u.issuer_id = r.issuer_id AND u.billing_period = r.billing_period AND u.seq = r.seq + 1)
SELECT issuer_id, billing_period, seq, outcome, open_id FROM r""")
def i14(s, d):
    rows = fx.table(s, d, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").distinct().select((F.col("l_suppkey") % 25).alias("issuer_id"), F.to_date(F.trunc("l_shipdate", "month")).alias("billing_period"), F.col("l_orderkey").alias("verified_id"), (F.col("l_orderkey") % 3).alias("document_id"), (F.col("l_orderkey") % 4 < 2).alias("superseded_later"), "l_linenumber", "l_partkey")
    seq = F.row_number().over(Window.partitionBy("issuer_id", "billing_period").orderBy("verified_id", "l_linenumber", "l_partkey")).cast("long")
    return review.upsert_bills(rows.withColumn("seq", seq))


ASKED = "a AS (SELECT l_suppkey % 25 AS issuer_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS billing_period, min(l_shipdate) AS asked_at, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2)"


@query("i15_mark_paid", B.rstrip() + f", {DUE}, {ASKED}, f AS (SELECT due.*, asked_at, n, issuer_id % 9 <> 0 AND issuer_id % 8 <> 1 AS usable, CASE WHEN payment_status = 'paid' AND issuer_id % 2 = 0 THEN TIMESTAMP '2020-01-01' END AS had FROM due LEFT JOIN a USING (issuer_id, billing_period)), w AS (SELECT *, asked_at IS NOT NULL AND usable AND (payment_status <> 'paid' OR had IS NULL) AS wrote FROM f) SELECT issuer_id, billing_period, CASE WHEN wrote THEN 'paid' ELSE payment_status END AS payment_status, CASE WHEN wrote THEN asked_at ELSE had END AS paid_at, CAST(CASE WHEN wrote THEN 1 ELSE 0 END AS INTEGER) AS writes, CASE WHEN usable THEN 0 ELSE coalesce(n, 0) END AS not_found FROM w")
def i15(s, d):
    had = F.when((F.col("payment_status") == "paid") & (F.col("issuer_id") % 2 == 0), F.lit("2020-01-01").cast("timestamp_ntz"))
    bills = due(s, d).withColumn("paid_at", had).withColumn("superseded", F.col("issuer_id") % 9 == 0).withColumn("authority", F.col("issuer_id") % 8 != 1)
    asked = fx.table(s, d, "lineitem").where("l_linenumber = 1").select((F.col("l_suppkey") % 25).alias("issuer_id"), F.to_date(F.trunc("l_shipdate", "month")).alias("billing_period"), F.col("l_shipdate").cast("timestamp_ntz").alias("at"), F.col("l_shipdate").alias("seq"))
    return review.mark_paid(bills, asked, "issuer_id", "billing_period").select("issuer_id", "billing_period", "payment_status", "paid_at", "writes", "not_found")
