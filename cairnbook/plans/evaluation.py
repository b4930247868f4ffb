"""Queries of evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnbook.operators import evaluation as ev
from cairnbook.plans.registry import query, rows_sql
from cairnbook.sources import fixtures as fx

P = "p AS (SELECT doc_id, quality, toxic, CAST(doc_id % 5 > 0 AS INTEGER) AS q, CAST(doc_id % 9 = 0 AS INTEGER) AS t FROM labels)"


def predicted(s, d):
    return fx.table(s, d, "labels").select("doc_id", "quality", "toxic", (F.col("doc_id") % 5 > 0).cast("int").alias("q"), (F.col("doc_id") % 9 == 0).cast("int").alias("t"))


@query("e19_field_accuracy", f"WITH {P} SELECT 'quality' AS field, round(avg(CAST(quality = q AS INTEGER)), 6) AS accuracy FROM p UNION ALL SELECT 'toxic', round(avg(CAST(toxic = t AS INTEGER)), 6) FROM p")
def e19(s, d):
    return ev.field_accuracy(predicted(s, d), {"quality": "q", "toxic": "t"})


RANK = "r AS (SELECT a.vec_id AS q, b.vec_id AS id, a.label AS x, b.label AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.vec_id < 20 AND b.vec_id >= 20)"


@query("e20_hit_rate", f"WITH {RANK} SELECT round(avg(hit), 6) AS hit_rate FROM (SELECT q, max(CAST(x = y AS INTEGER)) AS hit FROM r WHERE place <= 3 GROUP BY 1)")
def e20(s, d):
    e = fx.table(s, d, "embeddings")
    return ev.hit_rate(ev.ranked(e.where("vec_id < 20"), e.where("vec_id >= 20"), 3))


@query("g8_cosine_ranking", f"WITH {RANK} SELECT q, id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10")
def g8(s, d):
    e = fx.table(s, d, "embeddings")
    return ev.ranked(e.where("vec_id < 20"), e.where("vec_id >= 20"), 10).select("q", "id", "place")


@query("e21_routing_accuracy", "SELECT round(avg(CAST(lang = CASE WHEN doc_id % 4 = 0 THEN 'fr' ELSE 'en' END AS INTEGER)), 6) AS accuracy FROM documents")
def e21(s, d):
    said = F.when(F.col("doc_id") % 4 == 0, "fr").otherwise("en")
    return fx.table(s, d, "documents").agg(F.round(F.avg((F.col("lang") == said).cast("int")), 6).alias("accuracy"))


@query("e22_regression_gate", "WITH a AS (SELECT lang AS metric, avg(CAST(doc_id % 10 < 8 AS INTEGER)) AS now, avg(CAST(doc_id % 7 < 6 AS INTEGER)) AS base FROM documents GROUP BY 1) SELECT metric, round(base - now, 6) AS drop FROM a WHERE base - now > 0.02")
def e22(s, d):
    docs = fx.table(s, d, "documents").groupBy(F.col("lang").alias("metric")).agg(F.avg((F.col("doc_id") % 10 < 8).cast("int")).alias("now"), F.avg((F.col("doc_id") % 7 < 6).cast("int")).alias("base"))
    return ev.regressions(docs.select("metric", F.col("base").alias("value")), docs.select("metric", F.col("now").alias("value")))


@query("e27_benchmark_summary", "SELECT event_type, min(value) AS least, round(median(value), 6) AS middle, max(value) AS most FROM events GROUP BY 1")
def e27(s, d):
    return fx.table(s, d, "events").groupBy("event_type").agg(F.min("value").alias("least"), F.round(F.median("value"), 6).alias("middle"), F.max("value").alias("most"))


@query("e29_constrained_winner", "SELECT p_brand, arg_max(p_partkey, (p_size, -p_partkey)) AS winner FROM part WHERE p_retailprice <= 1500 GROUP BY 1")
def e29(s, d):
    return fx.table(s, d, "part").where("p_retailprice <= 1500").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("winner"))


D38_ROWS = (
    ("total_amount", "1200.4", "1200", True), ("total_amount", "1200.51", "1200", False), ("tax_8_amount", "n/a", "1", False), ("transaction_date", "2026-07-01", "2026-07-01", True), ("due_date", "2026-07-01", "2026-07-02", False), ("due_date", "July", "July", False),
    ("registration_number", "T-8700-1100-05901", "Ｔ８７００１１０００５９０１", True), ("registration_number", "T1", "T2", False), ("counterparty", "ｻﾝﾌﾟﾙ 商店", "サンプル商店", True), ("counterparty", "SHOP  a", "shop A", True), ("counterparty", "a-b", "ab", False),
    ("counterparty", None, None, True), ("counterparty", None, "", False), ("total_amount", "1", None, False),
)


@query("d38_field_equality", rows_sql("field, predicted, expected, same", *D38_ROWS))
def d38(s, d):
    rows = s.createDataFrame([r[:3] for r in D38_ROWS], "field string, predicted string, expected string")
    return rows.withColumn("same", ev.same_field(F.col("field"), F.col("predicted"), F.col("expected")))


@query("d38_money", "SELECT o_orderkey, abs(o_totalprice - (o_totalprice + CASE WHEN o_orderkey % 2 = 0 THEN 0.4 ELSE 0.7 END)) <= 0.5 AS same FROM orders")
def d38b(s, d):
    other = F.col("o_totalprice") + F.when(F.col("o_orderkey") % 2 == 0, 0.4).otherwise(0.7)
    return fx.table(s, d, "orders").select("o_orderkey", ev.same_money(F.col("o_totalprice"), other).alias("same"))


@query("j19_positional_zip", "SELECT a.event_id, b.other FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS i FROM events) a JOIN (SELECT event_id AS other, row_number() OVER (ORDER BY ts DESC, event_id) AS i FROM events) b USING (i)")
def j19(s, d):
    """Events in the order of their ids, zipped with events from the latest to the first."""
    e = fx.table(s, d, "events")
    return ev.aligned(e.select("event_id"), e.select(F.col("event_id").alias("other"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("back")), "event_id", "back").select("event_id", "other")
