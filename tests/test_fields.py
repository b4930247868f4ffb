"""Fields as columns against plain Python, and their defined cases."""

import datetime as dt
import json
import unicodedata
import urllib.parse
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cairnbook.functions import fields as fd
from cairnbook.functions import text as tx
from cairnbook.operators import evaluation as ev
from cairnbook.operators import search
from cairnbook.operators import semistructured as tree
from cairnbook.plans.catalogue import QUERIES
from cairnbook.sources import parse, policy

TEXTS = [
    "ｻﾝﾌﾟﾙ  商店", "Straße  42", "Ａ１ Shop", " a\tb ", "", None, "ＴＥＰＣＯ", "Tokyo  Gas", "市水道局", "国民健康保険課", "City Tax Office", "Sample\x1cShop", "ﬁne ﬃ", "İstanbul", " wide　　x ", "a\nb\r\n",
    "GAS co", "Ωmega", "é é", "x" * 70_000 + "　ｱ", "令和", "㋿7年",
]


def column(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")


def found(df):
    return [r[1] for r in sorted(df.collect())]


def attempt(f, *args):
    try:
        return f(*args), None
    except ValueError as e:
        return None, e


def test_text_keys_are_those_of_python(spark):
    rows = column(spark, TEXTS)
    assert found(rows.select("i", fd.text_key(F.col("v")))) == [None if t is None else tx.nfkc_key(t) for t in TEXTS]
    assert found(rows.select("i", fd.nfkc(F.col("v")))) == [None if t is None else unicodedata.normalize("NFKC", t) for t in TEXTS]


def test_only_texts_beyond_ascii_reach_python(spark):
    plan = column(spark, TEXTS).select(fd.text_key(F.col("v")).alias("k"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "CASE WHEN NOT" in plan or "if (NOT" in plan  # the worker is given null for plain texts


def test_issuers_are_those_of_python(spark):
    got = found(column(spark, TEXTS).select("i", fd.issuer(F.col("v"))))
    for text, row in zip(TEXTS, got, strict=True):
        want, error = attempt(tx.issuer, text or "")
        assert (row.name, row.kind) == (want or (None, None))
        assert (row.error is not None) == (error is not None)


LABELS = [
    "令和8年6月分", "R8.6", "Ｒ８．６", "2026年6月分", "2026-06", "2026-06-17", "r8/6", "2026年7月31日", "20260617", "2026-13", "R0.5", "令和元年5月", "2026/2/30", "2026-02-30", "R8.2.28", "令和 10 年 12 月 31 日", "2026.1.5", "2026-6-", "junk", "", "  ", None,
    "2026年6月31日", "1999/12", "R1/1/1", "２０２６年６月", "2024-02-29", "R6.2.29", "2025年2月29日", "2026-06-17T00:00",
]


@pytest.mark.parametrize(("column_of", "month_only"), [(fd.billing_period, True), (fd.due_date, False)])
def test_labels_are_those_of_python(spark, column_of, month_only):
    got = found(column(spark, LABELS).select("i", column_of(F.col("v"))))
    for label, row in zip(LABELS, got, strict=True):
        want, error = attempt(tx.period_or_date, label, month_only)
        assert (row.day, row.error is not None) == (want, error is not None), label


def test_every_day_of_ten_years_is_read_back(spark):
    days = spark.sql("SELECT explode(sequence(date'2019-05-01', date'2029-04-30')) AS day")
    reiwa = days.select("day", F.expr("concat('令和', year(day) - 2018, '年', month(day), '月', day(day), '日')").alias("label"))
    assert reiwa.where(fd.due_date(F.col("label"))["day"] != F.col("day")).count() == 0
    assert reiwa.where(fd.due_date(F.col("label"))["day"].isNull()).count() == 0


def test_consumption_is_that_of_python(spark):
    pairs = [("42.5", "kwh"), ("1,200", "m3"), ("7", "袋"), ("7", " ＫＷ/Ｈ "), ("-1", "kwh"), ("0", "kwh"), ("about", "kwh"), ("5", ""), ("5", None), ("5", "  "), (None, None), (None, ""), (None, "kwh"), ("", "kwh")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, v string, u string")
    for pair, row in zip(pairs, found(rows.select("i", fd.consumption(F.col("v"), F.col("u")))), strict=True):
        want, error = attempt(tx.consumption, *pair)
        assert (row.amount, row.unit) == (want or (None, None)), pair
        assert (row.error is not None) == (error is not None), pair
    assert found(rows.select("i", fd.consumption(F.col("v"), F.col("u"))))[1].amount == Decimal("1200")


def test_tax_ids_are_those_of_python(spark):
    values = ["T8700110005901", "Ｔ８７００１１０００５９０１", "8-7001-1000-5901", "t8700110005901", "T1234567890123", "T12", "", None, "9000000000000", "TT8700110005901", "T８700　1100\t05901\n", "87001100059012"]
    got = found(column(spark, values).select("i", fd.tax_id(F.col("v"))))
    assert [r.tax_id for r in got] == [tx.tax_id(v) for v in values]
    assert [r.valid for r in got] == [True, True, True, True, False, False, False, False, True, False, True, False]


def test_locators_and_canonical_json_are_those_of_python(spark):
    values = ["A b/c", "表 1", "a*b+c~d_-.", "", "%20", "x" * 5000, "é\n", "😀"]
    assert found(column(spark, values).select("i", fd.locator("sheet", F.col("v"), F.lit(3)))) == [tx.locator("sheet", v, 3) for v in values]
    assert urllib.parse.unquote(tx.locator("sheet", "表 1")) == "sheet/表 1"
    trees = [{"b": 1, "a": [None, "é"]}, {"a": {"y": 2, "x": 1.5}}, [], "x", None, {"": {}}, {"z": [{"b": 1, "a": True}]}]
    assert found(column(spark, [json.dumps(t, indent=1, ensure_ascii=False) for t in trees]).select("i", fd.canonical_json(F.col("v")))) == [tx.canonical_json(t) for t in trees]
    assert found(column(spark, ["{", "", None, '{"a": Infinity}', "[" * 100_000]).select("i", fd.canonical_json(F.col("v")))) == [None] * 5


def test_confidences_of_trees_of_any_shape(spark):
    payloads = [
        {"total": {"value": 1, "confidence": 0.9}, "lines": [{"name": {"value": "x", "confidence": 0.4}}, {"name": {"value": None, "confidence": 0.7}}], "note": {"value": 2, "confidence": None}},
        {"value": 1, "confidence": 0.5}, [[{"value": {"value": 1, "confidence": 0.1}, "confidence": 1}]], {}, [], 3, None, {"a": {"confidence": 0.2}, "b": {"value": 1}},
    ]
    texts = column(spark, [json.dumps(p) for p in payloads] + ["{", None]).withColumnRenamed("v", "json")
    got = {(r.i, r.path): r.confidence for r in tree.confidences(texts, "i").collect()}
    assert got == {(i, path): c for i, p in enumerate(payloads) for path, c in tx.flatten_confidence(p).items()}
    assert tree.confidences(texts.where("i < 0"), "i").collect() == []
    with pytest.raises(ValueError, match="deeper"):
        tree.confidences(column(spark, ["[" * 70 + "]" * 70]).withColumnRenamed("v", "json"), "i")


def test_contents_above_a_ceiling_are_not_kept(spark):
    rows = column(spark, ["ok", "x" * 11, None, "a\nb\nc"])
    lines = F.regexp_count("v", F.lit("\n")) + 1
    got = policy.within(rows, "v", {"chars": (F.length("v"), 10), "lines": (lines, 2)}).orderBy("i").collect()
    assert [(r.v, r.error) for r in got] == [("ok", None), (None, "chars: 11 is above 10"), (None, None), (None, "lines: 3 is above 2")]


def test_winner_by_mean_then_cost_then_name(spark):
    rows = spark.createDataFrame([("d", True, None, 2.0, 5), ("c", True, True, 3.0, 5), ("b", True, True, 3.0, 5), ("a", True, True, 9.0, 5), ("slow", True, True, 1.0, 99)], "e string, x boolean, y boolean, s double, b long")
    means = ev.recovery(rows, "e", {"x": F.col("x"), "y": F.col("y")}, F.col("s"), F.col("b"))
    assert {r.e: r["mean"] for r in means.collect()} == {"a": 1.0, "b": 1.0, "c": 1.0, "d": 0.5, "slow": 1.0}
    assert ev.winner(means, "e", {"bytes": 50, "seconds": 15}).select("e").collect()[0].e == "b"
    assert ev.winner(means, "e", {"bytes": 1}).collect() == []


def test_labels_of_orders_read_back_whole(spark):
    got = QUERIES["d31_labels_of_orders"](spark, "/root/testdata/sf0.001")
    assert got.where("period is null and period_error is null").count() == 0
    assert got.agg(F.min("due")).collect()[0][0] >= dt.date(2019, 5, 1)


def test_page_counts_are_those_of_the_parser(spark):
    pages = [
        "", None, "plain < text > on=1", "<p onclick='a' onload=b>x</p>", "<SCRIPT>var a = '<iframe src=//x>'</SCRIPT><embed>", "<!-- <script> --><a href='//x' title=\"on fire src=//y\">", "<style>p{}</style><object data=x></object>",
        "<img alt='a > b' src=https://h/x onerror=\"y\">", "<scripty></scripty><form action = 'HTTP://z'>", "<a href='/own'>t</a>" * 3000,
    ]
    got = found(column(spark, pages).select("i", fd.html_counts(F.col("v"))))
    for page, row in zip(pages, got, strict=True):
        assert row.asDict() == parse.inert_html(page or "")[2], page
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html", fd.html_counts(F.col("html")).alias("c")).collect()
    assert all(r.c.asDict() == parse.inert_html(r.html or "")[2] for r in real)


def test_a_table_above_the_limit_stops_no_other_document(spark):
    docs = spark.createDataFrame([(1, "# A\n\n" + "\n".join(f"| {'word ' * 9}| {i} |" for i in range(40))), (2, "plain"), (3, None), (None, "no id"), (2, "plain")], "id long, text string")
    got = sorted(((r.document_id, r.seq, r.text, r.error) for r in search.chunks(docs, "id", "text", 60).collect()), key=str)
    assert got == [(1, None, None, "a table below 'A' is above 60 tokens"), (2, 0, "plain", None), (2, 0, "plain", None), (None, 0, "no id", None)]
