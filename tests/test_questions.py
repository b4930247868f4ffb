"""Questions answered together against one filter a question."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cairnbook.operators import questions


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


@pytest.fixture(scope="module")
def records():
    rng = random.Random(4)
    return [(i, rng.choice([day(rng.randint(0, 400)), day(30)]), Decimal(rng.randint(1, 10**6)) / 100, rng.choice(["JPY", "USD", None]), rng.choice(["food", "travel", None]), rng.choice(["A", "B", "C", "D", "E", "F", "G", None])) for i in range(800)] + [(900, None, Decimal(5), "JPY", "food", "A")]


def brute(asks, records, k=5):
    out = []
    for q, metric, since, until, counterparty, category in asks:
        some = [r for r in records if r[1] and (since is None or r[1] >= since) and (until is None or r[1] <= until) and counterparty in (None, r[5]) and category in (None, r[4])]
        if metric == "count":
            out.append((q, metric, None, None, None, len(some)))
        for c in {r[3] for r in some}:
            own, name = [r for r in some if r[3] == c], c or "unspecified"
            if metric in ("sum", "average"):
                value = float(sum(r[2] for r in own))
                out.append((q, metric, name, None, round(value if metric == "sum" else value / len(own), 6), len(own)))
            if metric == "top_counterparties":
                sums = {n: (sum(r[2] for r in own if r[5] == n), sum(r[5] == n for r in own)) for n in {r[5] for r in own}}
                best = sorted(sums.items(), key=lambda x: (-x[1][0], x[0] is None, x[0] or ""))[:k]
                out += [(q, metric, name, n, round(float(v), 6), m) for n, (v, m) in best]
    return sorted(out, key=repr)


def test_answers_against_filters(spark, records):
    rng = random.Random(6)
    asks = []
    for q in range(120):
        a, b = sorted((rng.randint(-60, 460), rng.randint(-60, 460)))
        since, until = (None if rng.random() < 0.2 else day(x) for x in (a, b))
        asks.append((q, rng.choice(["sum", "average", "count", "top_counterparties", "none", "unsupported"]), since, until, rng.choice([None, None, "A", "nobody"]), rng.choice([None, None, "food", "nothing"])))
    asks += [(200, "sum", day(9), day(3), None, None), (201, "count", day(9), day(3), None, None), (202, "sum", None, None, None, None), (203, "sum", None, None, None, None)]
    questioned = spark.createDataFrame(asks, "question_id long, metric string, date_from date, date_to date, counterparty string, category string")
    table = spark.createDataFrame(records, "id long, transaction_date date, total_amount decimal(18,2), currency string, category string, counterparty string")
    got = sorted([(r["question_id"], r["metric"], r["currency"], r["counterparty"], None if r["amount"] is None else round(r["amount"], 6), r["record_count"]) for r in questions.answers(questioned, table).collect()], key=repr)
    assert got == brute(asks, records)
    assert questions.answers(questioned.limit(0), table).count() == 0
    empty = questions.answers(questioned, table.limit(0)).collect()
    assert {r["metric"] for r in empty} == {"count"} and all(r["record_count"] == 0 for r in empty)


def test_routes(spark):
    rows = [("total in June", None, "sql"), ("where I spent most at the shop that I total", None, "hybrid"), ("what does it say", None, "semantic"), ("what does it say", "Way: SQL", "sql"), ("  ", "sql", None), ("hello", "none of these", "semantic")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, vote string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", questions.route_of(F.col("q"), F.col("vote"))).collect())
    assert df.select(questions.route_of(F.col("q")).alias("got")).collect()[2]["got"] == "semantic"
