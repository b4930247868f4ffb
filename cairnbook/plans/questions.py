"""Queries over a table of questions: one for every turn of the conversations, asked on the day of an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnbook.operators import intent, questions
from cairnbook.plans.registry import query
from cairnbook.plans.verified import SQL_ACTIVE, active, re2
from cairnbook.sources import fixtures as fx

#: What is asked, by the turn's number; the last one is the turn's own text.
ASKED = 8
Q = f"""q0 AS (SELECT conv_id * 100 + turn AS question_id, conversations.text, turn % {ASKED} AS t, CAST(o_orderdate AS DATE) AS asked_on, c_name AS name, c_mktsegment AS segment
  FROM conversations JOIN orders ON o_orderkey = conv_id * 7 + turn JOIN customer ON c_custkey = o_custkey WHERE conversations.text IS NOT NULL),
q1 AS (SELECT *, CAST(date_trunc('month', asked_on) AS DATE) AS m, CAST(date_trunc('year', asked_on) AS DATE) AS y FROM q0),
q AS (SELECT question_id, text, t,
  CASE t WHEN 0 THEN 'sum' WHEN 1 THEN 'sum' WHEN 2 THEN 'average' WHEN 3 THEN 'count' WHEN 4 THEN 'sum' WHEN 5 THEN 'sum' WHEN 6 THEN 'top_counterparties' ELSE 'none' END AS metric,
  CASE WHEN t IN (0, 1, 2, 6) THEN m WHEN t = 3 THEN CAST(m - INTERVAL 1 MONTH AS DATE) WHEN t = 4 THEN y WHEN t = 5 THEN CAST(y - INTERVAL 1 YEAR AS DATE) END AS date_from,
  CASE WHEN t IN (0, 1, 2, 6) THEN last_day(m) WHEN t = 3 THEN CAST(m - INTERVAL 1 DAY AS DATE) WHEN t = 4 THEN CAST(y + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) WHEN t = 5 THEN CAST(y - INTERVAL 1 DAY AS DATE) END AS date_to,
  CASE WHEN t = 5 THEN name END AS counterparty, CASE WHEN t = 1 THEN segment END AS category FROM q1)"""


def asked(s, d):
    """question_id, question and asked_on: months and years written or relative in three languages, categories, counterparties."""
    orders, customer = fx.table(s, d, "orders"), fx.table(s, d, "customer")
    c = fx.table(s, d, "conversations").where("text is not null").withColumn("o_orderkey", F.col("conv_id") * 7 + F.col("turn"))
    rows = c.join(orders, "o_orderkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    day = F.to_date("o_orderdate")
    month = F.month(day).cast("string")
    texts = [
        F.concat(F.lit("how much did I spend in "), F.date_format(day, "MMMM"), F.lit("?")), F.concat(month, F.lit("月の合計 category: "), "c_mktsegment"), F.concat(F.lit("tháng "), month, F.lit(" trung bình")), F.lit("how many last month"),
        F.lit("total this year"), F.concat(F.lit("total at "), "c_name", F.lit(" in last year")), F.lit("which merchants had the highest expense this month"), F.col("text"),
    ]
    question = F.element_at(F.array(*texts), (F.col("turn") % ASKED + 1).cast("int"))
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), question.alias("question"), day.alias("asked_on"), (F.col("turn") % ASKED).alias("t"))


def slots(s, d):
    return intent.slots(asked(s, d), F.col("asked_on"))


@query("d4_question_slots", f"WITH {Q} SELECT question_id, metric, date_from, date_to, counterparty, category FROM q WHERE t < {ASKED - 1}")
def d4(s, d):
    """Slots of the questions, each relative to its own day (of the turns' own texts d3 has the metrics)."""
    return slots(s, d).where(F.col("t") < ASKED - 1).select("question_id", *questions.SLOTS)


@query("l1_question_routes", f"WITH {Q} SELECT question_id, CASE WHEN t < {ASKED - 1} THEN 'sql' WHEN trim(text) = '' THEN NULL WHEN NOT regexp_matches(text, '{re2(intent.AGGREGATION)}') THEN 'semantic' WHEN regexp_matches(text, '{re2(intent.NARROWING)}') THEN 'hybrid' ELSE 'sql' END AS route FROM q")
def l1(s, d):
    return asked(s, d).select("question_id", questions.route_of(F.col("question")).alias("route"))


ANSWERS = f"""WITH {SQL_ACTIVE}, {Q}, p AS (SELECT question_id, metric, coalesce(currency, 'unspecified') AS currency, a.counterparty, CAST(total_amount AS DECIMAL(38,2)) AS amount
  FROM q JOIN active a ON a.transaction_date BETWEEN q.date_from AND q.date_to AND (q.counterparty IS NULL OR q.counterparty = a.counterparty) AND (q.category IS NULL OR q.category = a.category) WHERE metric <> 'none'),
tops AS (SELECT *, row_number() OVER (PARTITION BY question_id, currency ORDER BY amount DESC, counterparty) AS place FROM (SELECT question_id, metric, currency, counterparty, sum(amount) AS amount, count(*) AS n FROM p WHERE metric = 'top_counterparties' GROUP BY question_id, metric, currency, counterparty))
SELECT question_id, metric, currency, NULL AS counterparty, round(CASE metric WHEN 'sum' THEN CAST(sum(amount) AS DOUBLE) ELSE CAST(sum(amount) AS DOUBLE) / count(*) END, 6) AS amount, count(*) AS record_count FROM p WHERE metric IN ('sum', 'average') GROUP BY question_id, metric, currency
UNION ALL SELECT question_id, metric, currency, counterparty, round(CAST(amount AS DOUBLE), 6), n FROM tops WHERE place <= {intent.TOP_K}
UNION ALL SELECT q.question_id, q.metric, NULL, NULL, NULL, count(p.question_id) FROM q LEFT JOIN p USING (question_id) WHERE q.metric = 'count' GROUP BY q.question_id, q.metric"""


@query("l2_answered_questions", ANSWERS)
def l2(s, d):
    """Every question answered, in one plan."""
    return questions.answers(slots(s, d).where(F.col("t") < ASKED - 1), active(s, d)).withColumn("amount", F.round("amount", 6))
