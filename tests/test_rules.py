"""Operators on hand-made rows."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.operators import authority, dedupe, exports, intent, lifecycle, mapping, search, series, staging
from cairnbook.sources import parse


def test_intent_slots(spark):
    today = dt.date(2026, 7, 15)
    i = intent.parse("6月の食費の合計は？", today)
    assert (i.metric, i.date_from, i.date_to, i.category) == ("sum", dt.date(2026, 6, 1), dt.date(2026, 6, 30), "食費")
    assert intent.parse("THÁNG 7 năm 2026 tổng chi tiêu", today).date_from == dt.date(2026, 7, 1)
    assert intent.parse("how many receipts last month", today) == intent.Intent("count", dt.date(2026, 6, 1), dt.date(2026, 6, 30), doc_class="receipt")
    assert intent.parse("compare the highest total", today).metric == "unsupported"
    assert intent.route("which receipt did I spend most") == "hybrid"
    assert intent.route("hello", lambda q: 1 / 0) == "semantic"
    with pytest.raises(ValueError):
        intent.parse("hello", today)


def test_currency_never_mixed_and_authority(spark):
    v = spark.createDataFrame([(1, 1, 1, dt.date(2026, 6, 10), Decimal("1200.00"), "Shop", "食費", "JPY"), (2, 2, 2, dt.date(2026, 6, 11), Decimal("250000.00"), "Shop", "食費", "VND"), (3, 3, 3, dt.date(2026, 6, 12), Decimal("9999.00"), "Shop", "食費", None)], "id long, document_id long, extracted_id long, transaction_date date, total_amount decimal(18,2), counterparty string, category string, currency string")
    e = spark.createDataFrame([(1, 1, "approved", None), (2, 2, "approved", 7), (3, 3, "pending_review", None)], "extraction_id long, extraction_document_id long, status string, batch_id long")
    b = spark.createDataFrame([(7, "active", "financial")], "active_batch_id long, lifecycle string, record_kind string")
    rows = {r["currency"]: r["amount"] for r in intent.plan(authority.active(v, e, b), intent.Intent("sum")).collect()}
    assert rows == {"JPY": 1200.0, "VND": 250000.0}
    assert intent.plan(authority.active(v.limit(0), e, b), intent.Intent("count")).first()[0] == 0
    assert intent.render("total", [("JPY", 1.0, 1), ("VND", 2.0, 3)]) == "Total of verified records: JPY 1.00 (1 records); VND 2.00 (3 records). Currencies are kept apart."


BILL = "issuer_id string, billing_period date, amount decimal(18,2), consumption_value decimal(18,4), consumption_unit string"


def bills(spark, *points):
    return spark.createDataFrame([("x", d, Decimal(a), None if c is None else Decimal(c), "kWh") for d, a, c in points], BILL)


def test_period_gaps(spark):
    rows = bills(spark, (dt.date(2024, 12, 1), 100, 10), (dt.date(2025, 1, 1), 120, 12), (dt.date(2026, 1, 1), 150, 15))
    got = {r["billing_period"]: r for r in series.compare_periods(rows).collect()}
    jan = got[dt.date(2025, 1, 1)]
    assert (jan["mom_amount_delta"], jan["mom_consumption_delta"], jan["mom_unit_price_delta"], jan["yoy_missing"]) == (20, 2, 0, True)
    assert got[dt.date(2026, 1, 1)]["mom_missing"] and got[dt.date(2026, 1, 1)]["yoy_amount_delta"] == 30


@pytest.mark.parametrize(("last", "metrics"), [((100, 10), []), ((200, 20), ["consumption"]), ((200, 10), ["unit_price"])])
def test_flat_history(spark, last, metrics):
    rows = bills(spark, *[(dt.date(2025, m, 1), 100, 10) for m in range(1, 7)], (dt.date(2025, 7, 1), *last))
    got = series.anomalies(rows).collect()
    assert [r["metric"] for r in got] == metrics
    assert all(r["robust_z"] is None for r in got)


def test_reminders(spark):
    rows = spark.createDataFrame([(1, dt.date(2026, 7, 12), "unpaid"), (2, dt.date(2026, 7, 13), "unpaid"), (3, dt.date(2026, 7, 20), "unpaid"), (4, dt.date(2026, 7, 21), "unpaid"), (5, dt.date(2026, 7, 12), "paid"), (6, None, "unpaid")], "id int, due_date date, payment_status string")
    got = series.reminders(rows, F.lit(dt.date(2026, 7, 13)), 7).collect()
    assert {(r["id"], r["bucket"], r["days_left"]) for r in got} == {(1, "overdue", -1), (2, "upcoming", 0), (3, "upcoming", 7)}


def test_dedupe(spark):
    facts = spark.createDataFrame([(1, dt.date(2026, 7, 1), Decimal(1200), "Ｓｈｏｐ"), (2, dt.date(2026, 7, 2), Decimal(1200), "shop"), (3, dt.date(2026, 7, 2), Decimal(1300), "shop"), (4, dt.date(2026, 7, 4), Decimal(1200), "shop"), (5, None, None, None)], "document_id long, transaction_date date, total_amount decimal(18,2), counterparty string")
    assert [(r["document_id"], r["other_id"], r["similarity"]) for r in dedupe.business_matches(facts).collect()] == [(1, 2, 100.0)]
    hashes = spark.createDataFrame([(1, 0), (2, 255), (3, 511), (4, -1)], "document_id long, phash long")
    assert {(r["document_id"], r["other_id"], r["distance"]) for r in dedupe.near_hashes(hashes).collect()} == {(1, 2, 8), (2, 3, 1)}
    assert tx.indel_ratio("", "") == 100 and tx.indel_ratio("abcd", "abxd") == 75


def test_mapping(spark):
    rows = spark.createDataFrame([({"d": "2026年8月1日", "a": "1.234,50", "c": "円"},), ({"d": "2026年2月30日", "a": "bad", "c": "円"},)], "values map<string,string>")
    rules = [mapping.Rule("day", ("d",), kind="date", style="japanese", required=True), mapping.Rule("amount", ("a",), kind="decimal", style="comma", sign="negate"), mapping.Rule("currency", ("c",), kind="currency", value_map={"円": "JPY"})]
    got = mapping.apply_rules(rows, rules).collect()
    assert tuple(got[0]["mapped"]) == ("2026-08-01", "-1234.50", "JPY") and got[0]["issues"] == []
    assert got[1]["issues"] == ["day:invalid_date", "amount:invalid_decimal"]
    with pytest.raises(ValueError):
        mapping.validate(rules, ["d"])


def test_staging(spark):
    cells = spark.createDataFrame([("", "blank"), ("TRUE", "boolean"), ("-3", "integer"), ("2.", "number"), ("2026-02-30", "string"), ("2026-02-28", "date"), ("2026-8", "string")], "x string, kind string")
    assert all(r["k"] == r["kind"] for r in cells.withColumn("k", staging.cell_kind(F.col("x"))).collect())
    header = spark.createDataFrame([(["name", "name", ""],)], "h array<string>")
    assert header.select(staging.unique_headers(F.col("h"))).first()[0] == ["name", "name__2", "column_3"]


def test_exports(spark):
    schema = "id int, transaction_date date, total_amount decimal(18,2), counterparty string, category string, tax_8 decimal(18,2), tax_10 decimal(18,2)"
    rows = spark.createDataFrame([(1, dt.date(2026, 7, 13), Decimal(1200), "=サンプル  商店", "会議費", None, Decimal(109))], schema)
    j = exports.journal_33(rows).first()
    assert len(j) == 33 and (j[1], j[2], j[4], j[7], j[15], j[16], j[17]) == ("2026/07/13", "1", "会議費", "'=サンプル 商店", "1200", "課対仕入10%", "109")
    assert len(exports.journal_27(rows).first()) == 27
    both = rows.withColumn("tax_8", F.lit(1).cast("decimal(18,2)"))
    with pytest.raises(Exception, match="split"):
        exports.journal_33(both).collect()


def test_changes(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 3)], "k int, n string, v int")
    b = spark.createDataFrame([(1, "x", 5), (3, "z", None)], "k int, n string, v int")
    got = {(r["row_pk"], r["action"], r["field"], r["old_value"], r["new_value"]) for r in lifecycle.changes(a, b, "k", ["n", "v"], "t").collect()}
    assert got == {("1", "update", "v", None, "5"), ("2", "delete", "n", "y", None), ("2", "delete", "v", "3", None), ("3", "insert", "n", None, "z")}


def test_chunking():
    got = search.chunk("# Expenses\nlead\n## June\n| a | b |\n| 1 | 2 |\n### Notes\n領収書 paid", 60)
    assert [(s, p) for s, p, _, _ in got] == [(0, "Expenses"), (1, "Expenses > June"), (2, "Expenses > June > Notes")]
    assert search.tokens("領収書") == 3 and search.tokens("abcde x!") == 4
    assert all(search.tokens(p) <= 7 for p in search.hard_split("領収書" * 9 + " abcdefghi" * 9, 7))
    with pytest.raises(ValueError):
        search.chunk("| " + "a b " * 99 + "|", 20)


def test_labels_and_ids():
    assert tx.issuer("東京電力エナジーパートナー") == ("東京電力", "electric")
    assert tx.period_or_date("令和8年6月分", True) == tx.period_or_date("R8.6", True) == dt.date(2026, 6, 1)
    assert tx.period_or_date("2026年7月31日", False) == dt.date(2026, 7, 31)
    assert tx.consumption("42.5", "kwh") == (Decimal("42.5"), "kWh")
    assert tx.tax_id("Ｔ８７００１１０００５９０１") == "T8700110005901" and tx.tax_id("T12") is None


@pytest.mark.parametrize(("base", "digit"), [("700110005901", 8), ("000000000000", 9), ("123456789012", 7), ("999999999999", 9), ("100000000001", 6)])
def test_check_digit(spark, base, digit):
    assert spark.range(1).select(tx.check_digit(F.lit(base))).first()[0] == digit


def test_parsers():
    assert parse.delimiter("a,b;c\n") == "," and parse.decode("金額".encode("cp932"))[1] == "cp932"
    with pytest.raises(ValueError):
        parse.delimiter("abc")
    assert parse.tables_in_tree({"x": [{"a": 1}, {"b": [2]}]}) == [("$.x", ["a", "b"], [["1", ""], ["", "[2]"]])]
    with pytest.raises(ValueError):
        parse.xml_tables(b"<!DOCTYPE x><r/>")
    text, tables, counts = parse.inert_html("<p>a</p><script>b</script><table><tr><td>1</td></tr></table>")
    assert (text, tables, counts["active"]) == ("a", [[["1"]]], 1)
    with pytest.raises(ValueError):
        parse.inert_html("<table><tr><td><table></table></td></tr></table>")
    assert parse.subtables([["a", "", "b"], ["", "", ""], ["c", "", ""]]) == [[["a"]], [["b"]], [["c"]]]
