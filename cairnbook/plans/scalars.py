"""Queries of single functions: dates, identifiers, keywords, payload fields."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnbook.functions import sqlfunctions
from cairnbook.functions import text as tx
from cairnbook.operators import review
from cairnbook.plans.registry import query, rows_sql
from cairnbook.sources import fixtures as fx
from cairnbook.sources.fixtures import SQL_ROWS

# Cues of document classes and of kinds of expense.
CLASS_CUES = {
    "receipt": ("領収書", "レシート", "お買上げ", "お買い上げ", "receipt"),
    "invoice": ("請求書", "御請求", "ご請求", "invoice"),
    "bill": ("nộp thuế", "thuế thu nhập", "bảo hiểm", "tiền điện", "tiền nước", "tiền gas", "hóa đơn internet", "cước viễn thông", "tax notice", "insurance premium", "payment notice"),
    "recurring_bill": ("検針票", "ご使用量", "納入通知書", "督促", "電気料金", "ガス料金", "水道料金", "chỉ số tiêu thụ", "kỳ thanh toán"),
    "quote": ("見積書", "御見積", "quotation", "quote"),
}
KIND_CUES = {
    "retail": ("hóa đơn bán lẻ", "領収書", "レシート", "receipt"), "electricity": ("electricity bill", "electricity", "電気料金", "tiền điện"), "water": ("water bill", "water charge", "水道料金", "tiền nước"),
    "gas": ("gas bill", "ガス料金", "tiền gas"), "telecom": ("telecom", "internet", "phone bill", "cước viễn thông", "hóa đơn internet"),
    "tax": ("tax notice", "tax office", "tax payment", "nộp thuế", "thuế thu nhập", "納付書", "税金"), "insurance": ("insurance premium", "insurance", "bảo hiểm", "保険"),
    "rent": ("rent payment", "rent notice", "tiền thuê", "家賃"), "subscription": ("subscription", "membership", "定期購読", "gói đăng ký"),
}


def cue_hits(text, cues: dict[str, tuple[str, ...]]):
    """Number of cues of each class that occur in a lowered text."""
    return {name: F.size(F.filter(F.array(*[F.lit(c) for c in words]), lambda c: F.contains(text, c))) for name, words in cues.items()}


def scores(text, cues: dict[str, tuple[str, ...]]):
    """Numbers of cues by class, as an array, and whether one class alone has the most (and any)."""
    hits = F.array(*[F.coalesce(h, F.lit(0)) for h in cue_hits(text, cues).values()])
    most = F.array_max(hits)
    return hits, (most > 0) & (F.size(F.filter(hits, lambda h: h == most)) == 1)


def classify(rows, text: str = "text"):
    """rows with label and confidence: the class of the most cues in the first 2,000 characters; other at 0.2 for none or a tie."""
    hits, clear = scores(F.lower(F.substring(text, 1, 2000)), CLASS_CUES)
    rows = rows.withColumn("hits", hits).withColumn("clear", clear)
    most = F.array_max("hits")
    label = F.element_at(F.array(*[F.lit(n) for n in CLASS_CUES]), F.array_position("hits", most).cast("int"))
    return rows.withColumn("label", F.when(F.col("clear"), label).otherwise("other")).withColumn("confidence", F.when(F.col("clear"), F.least(F.lit(0.95), 0.75 + 0.1 * (most - 1))).otherwise(0.2)).drop("hits", "clear")


SAMPLES = ["領収書 合計 1200円", "Invoice 42 for electricity bill", "receipt for invoice", "電気料金 ご使用量のお知らせ", "plain note", "Quotation: membership fee", "thông báo tiền nước tháng 6"]


def samples(s, values, name="text"):
    return s.createDataFrame([(v,) for v in values], f"{name} string")


def hits_sql(cues: dict[str, tuple[str, ...]], text: str) -> str:
    """A list of the numbers of cues of each class in a lowered text."""
    return "[" + ", ".join("len(list_filter([" + ", ".join("'" + c.replace("'", "''") + "'" for c in words) + f"], lambda c: contains({text}, c)))" for words in cues.values()) + "]"


def values_sql(values):
    return "VALUES " + ", ".join("('" + v.replace("'", "''") + "')" for v in values)


D28 = f"WITH s AS (SELECT text FROM ({values_sql(SAMPLES)}) t(text) UNION ALL SELECT text FROM documents), h AS (SELECT text, {hits_sql(CLASS_CUES, 'lower(substr(text, 1, 2000))')} AS hits FROM s), m AS (SELECT *, coalesce(list_max(hits), 0) AS most FROM h), c AS (SELECT *, most > 0 AND len(list_filter(hits, lambda x: x = most)) = 1 AS clear FROM m)"


@query("d28_keyword_class", D28 + f" SELECT md5(coalesce(text, '')) AS key, CASE WHEN clear THEN {list(CLASS_CUES)!r}[list_position(hits, most)] ELSE 'other' END AS label, CASE WHEN clear THEN round(least(0.95, 0.75 + 0.1 * (most - 1)), 4) ELSE 0.2 END AS confidence FROM c")
def d28(s, d):
    rows = samples(s, SAMPLES).unionByName(fx.table(s, d, "documents").select("text"))
    return classify(rows).select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), "label", F.round("confidence", 4).alias("confidence"))


@query("e28_argmax_ties", D28 + " SELECT md5(coalesce(text, '')) AS key, hits, clear AS unique_winner FROM c")
def e28(s, d):
    """Scores of every class by its cues, and whether one class alone has the most."""
    rows = samples(s, SAMPLES).unionByName(fx.table(s, d, "documents").select("text"))
    hits, clear = scores(F.lower(F.substring("text", 1, 2000)), CLASS_CUES)
    return rows.select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), hits.alias("hits"), clear.alias("unique_winner"))


@query("d29_expense_kind", rows_sql("text, kind, span", (SAMPLES[0], "retail", "領収書"), (SAMPLES[1], "electricity", "electricity bill"), (SAMPLES[2], "retail", "receipt"), (SAMPLES[3], "electricity", "電気料金"), (SAMPLES[4], None, None), (SAMPLES[5], "subscription", "membership"), (SAMPLES[6], "water", "tiền nước"), ("WATER Bill and gas bill", None, None), ("My TELECOM", "telecom", "TELECOM")))
def d29(s, d):
    rows = samples(s, [*SAMPLES, "WATER Bill and gas bill", "My TELECOM"])
    hits, clear = scores(F.lower("text"), KIND_CUES)
    rows = rows.withColumn("kind", F.when(clear, F.element_at(F.array(*[F.lit(n) for n in KIND_CUES]), F.array_position(hits, F.array_max(hits)).cast("int"))))
    cues = F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(c).alias("cue")) for n, words in KIND_CUES.items() for c in words])
    met = F.try_element_at(F.filter(cues, lambda c: (c["kind"] == F.col("kind")) & F.contains(F.lower("text"), c["cue"])), F.lit(1))["cue"]
    return rows.withColumn("cue", met).select("text", "kind", F.expr("substring(text, locate(cue, lower(text)), length(cue))").alias("span"))


CELL = "CASE WHEN trim(x) = '' THEN 'blank' WHEN lower(trim(x)) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(trim(x), '[+-]?[0-9]+') THEN 'integer' WHEN regexp_full_match(trim(x), '[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)') THEN 'number' WHEN regexp_full_match(trim(x), '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(trim(x) AS DATE) IS NOT NULL THEN 'date' ELSE 'string' END"


@query("d5_cell_typing", f"WITH {SQL_ROWS}, c AS (SELECT row_index, unnest(['k', 'value', 'event', 'day']) AS name, unnest([k, value, event, day]) AS x FROM fx_rows) SELECT row_index, name, {CELL} AS kind FROM c")
def d5(s, d):
    from cairnbook.operators.staging import cell_kind

    return fx.staged_rows(s, d).select("row_index", F.explode("values").alias("name", "x")).select("row_index", "name", cell_kind(F.col("x")).alias("kind"))


_CJK = "぀-ヿ㐀-䶿一-鿿＀-￯"
_SPACES = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}"


@query("d27_token_estimate", f"SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[{_CJK}]')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: (length(w) + 3) // 4)), 0) + len(regexp_extract_all(text, '[^A-Za-z0-9_{_SPACES}{_CJK}]')), 0) AS BIGINT) AS tokens FROM documents")
def d27(s, d):
    return fx.table(s, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("d15_nfkc_key", rows_sql("text, key", ("ｻﾝﾌﾟﾙ  商店", "サンプル 商店"), ("Straße  42", "strasse 42"), ("Ａ１ Shop", "a1 shop"), (" a\tb ", "a b"), (None, None)) + " UNION ALL SELECT c_name, lower(c_name) FROM customer")
def d15(s, d):
    values = ["ｻﾝﾌﾟﾙ  商店", "Straße  42", "Ａ１ Shop", " a\tb ", None]
    return samples(s, values).unionByName(fx.table(s, d, "customer").select(F.col("c_name").alias("text"))).select("text", tx.nfkc_udf("text").alias("key"))


@query("d17_payload_unwrap", "SELECT event_id, coalesce(json_extract_string(props, '$.total'), json_extract_string(props, '$.k')) AS value FROM events")
def d17(s, d):
    return fx.table(s, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.total"), F.get_json_object("props", "$.k")).alias("value"))


@query("d18_lenient_decimal", "SELECT o_orderkey, CAST(TRY_CAST(regexp_replace('¥' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ',000円', '[, 円¥]', '', 'g') AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM orders")
def d18(s, d):
    from cairnbook.operators.dedupe import lenient_decimal

    raw = F.concat(F.lit("¥"), F.floor("o_totalprice").cast("long").cast("string"), F.lit(",000円"))
    return fx.table(s, d, "orders").select("o_orderkey", lenient_decimal(raw).cast("double").alias("amount"))


@query("d22_formula_safe_cell", "SELECT part.p_partkey, CASE WHEN regexp_matches(c, '^[=+@-]') THEN '''' || c ELSE c END AS cell FROM (SELECT p_partkey, trim(regexp_replace(CASE p_partkey % 5 WHEN 0 THEN '=' WHEN 1 THEN '  -' ELSE '' END || p_name || '  x', '\\s+', ' ', 'g')) AS c FROM part) part")
def d22(s, d):
    lead = F.when(F.col("p_partkey") % 5 == 0, "=").when(F.col("p_partkey") % 5 == 1, "  -").otherwise("")
    return fx.table(s, d, "part").select("p_partkey", tx.safe_cell(F.concat(lead, F.col("p_name"), F.lit("  x"))).alias("cell"))


@query("d23_canonical_digest", "SELECT canonical, sha256(canonical) AS digest FROM (" + rows_sql("canonical", ('{"a":[null,"\\u00e9"],"b":1}',), ('{"a":{"x":1,"y":2}}',), ("[]",)) + ")")
def d23(s, d):
    rows = [(tx.canonical_json(v), tx.canonical_digest(v)) for v in ({"b": 1, "a": [None, "é"]}, {"a": {"y": 2, "x": 1}}, [])]
    return s.createDataFrame(rows, "canonical string, digest string")


@query("d24_locator", rows_sql("locator", ("sheet/A%20b%2Fc/3",), ("table/%E8%A1%A8%201",), ("row/7",)))
def d24(s, d):
    return s.createDataFrame([(tx.locator("sheet", "A b/c", 3),), (tx.locator("table", "表 1"),), (tx.locator("row", 7),)], "locator string")


KEY_FIELDS = ("candidate_ordinal", "financial_subtype", "mapping_version", "normalized_item_hash", "record_kind", "source_locator", "source_sha256")


@query("d25_candidate_key", f"""WITH {SQL_ROWS} SELECT row_index, sha256('{{"candidate_ordinal":' || row_number() OVER (PARTITION BY document_id ORDER BY row_index) || ',"financial_subtype":' || CASE WHEN row_index % 3 = 0 THEN 'null' ELSE '"expense"' END || ',"mapping_version":1,"normalized_item_hash":"' || sha256(event || k) || '","record_kind":"' || CASE WHEN row_index % 3 = 0 THEN 'generic_document' ELSE 'financial' END || '","source_locator":"table/' || source_location || '","source_sha256":"' || sha256('file ' || document_id) || '"}}') AS candidate_key FROM fx_rows""")
def d25(s, d):
    """Keys of candidates over seven fields, sorted by name: the digest of their canonical JSON."""
    generic = F.col("row_index") % 3 == 0
    rows = fx.staged_rows(s, d).select(
        "row_index", F.row_number().over(Window.partitionBy("document_id").orderBy("row_index")).alias("candidate_ordinal"), F.when(~generic, "expense").alias("financial_subtype"), F.lit(1).alias("mapping_version"),
        F.sha2(F.concat(F.col("values")["event"], F.col("values")["k"]), 256).alias("normalized_item_hash"), F.when(generic, "generic_document").otherwise("financial").alias("record_kind"), F.concat(F.lit("table/"), "source_location").alias("source_locator"),
        F.sha2(F.concat(F.lit("file "), F.col("document_id").cast("string")), 256).alias("source_sha256"),
    )
    return rows.select("row_index", tx.candidate_key(*KEY_FIELDS).alias("candidate_key"))


@query("d26_confidence_flatten", rows_sql("path, confidence", ("total", 0.9), ("lines[0].name", 0.4), ("lines[1].name", 0.7)))
def d26(s, d):
    import json

    payload = {"total": {"value": 1, "confidence": 0.9}, "lines": [{"name": {"value": "x", "confidence": 0.4}}, {"name": {"value": None, "confidence": 0.7}}], "note": {"value": 2, "confidence": None}}
    flat = tx.flatten_confidence(json.loads(json.dumps(payload)))
    low = s.createDataFrame([(flat,)], "confidence map<string,double>")
    return low.select(F.explode("confidence").alias("path", "confidence"))


@query("b17_low_confidence_fields", "SELECT event_id, list_sort(list_filter(['day', 'k', 'value'], lambda f: CASE f WHEN 'day' THEN 0.9 WHEN 'k' THEN (event_id % 10) / 10.0 ELSE (event_id % 7) / 7.0 END < 0.85)) AS fields FROM events")
def b17(s, d):
    confidence = F.create_map(F.lit("day"), F.lit(0.9), F.lit("k"), (F.col("event_id") % 10) / 10.0, F.lit("value"), (F.col("event_id") % 7) / 7.0)
    return fx.table(s, d, "events").select("event_id", F.array_sort(F.map_keys(F.map_filter(confidence, lambda k, v: v < 0.85))).alias("fields"))


@query("d30_issuer_normalise", rows_sql("text, issuer", ('東京電力エナジーパートナー', '東京電力|electric'), ('ＴＥＰＣＯ', '東京電力|electric'), ('Tokyo  Gas', '東京ガス|gas'), ('市水道局', '市水道局|water'), ('国民健康保険課', '国民健康保険課|nhi'), ('City Tax Office', 'City Tax Office|tax'), ('Sample Shop', 'Sample Shop|other')))
def d30(s, d):
    return samples(s, ["東京電力エナジーパートナー", "ＴＥＰＣＯ", "Tokyo  Gas", "市水道局", "国民健康保険課", "City Tax Office", "Sample Shop"]).select("text", tx.issuer_udf("text").alias("issuer"))


JUNE, LAST_OF_JULY = dt.date(2026, 6, 1), dt.date(2026, 7, 31)


@query("d31_billing_period", rows_sql("label, day", ("令和8年6月分", JUNE), ("R8.6", JUNE), ("2026年6月分", JUNE), ("2026-06", JUNE), ("2026-06-17", JUNE), ("r8/6", JUNE), ("2026年7月31日", LAST_OF_JULY)))
def d31(s, d):
    values = ["令和8年6月分", "R8.6", "2026年6月分", "2026-06", "2026-06-17", "r8/6"]
    return s.createDataFrame([(v, tx.period_or_date(v, True)) for v in values] + [("2026年7月31日", tx.period_or_date("2026年7月31日", False))], "label string, day date")


@query("d32_consumption", rows_sql("value, unit, amount, clean_unit", ('42.5', 'kwh', 42.5, 'kWh'), ('1,200', 'm3', 1200, 'm³'), ('7', '袋', 7, '袋')))
def d32(s, d):
    return s.createDataFrame([(v, u, *tx.consumption(v, u)) for v, u in (("42.5", "kwh"), ("1,200", "m3"), ("7", "袋"))], "value string, unit string, amount decimal(18,4), clean_unit string")


@query("d33_tax_id", rows_sql("text, tax_id, valid", ('T8700110005901', 'T8700110005901', True), ('Ｔ８７００１１０００５９０１', 'T8700110005901', True), ('8-7001-1000-5901', 'T8700110005901', True), ('T1234567890123', 'T1234567890123', False), ('T12', None, False), ('', None, False), ('9000000000000', 'T9000000000000', True)))
def d33(s, d):
    values = ["T8700110005901", "Ｔ８７００１１０００５９０１", "8-7001-1000-5901", "T1234567890123", "T12", "", "9000000000000"]
    clean = samples(s, values).withColumn("tax_id", tx.tax_id_udf("text"))
    return clean.withColumn("valid", F.coalesce(F.substring("tax_id", 2, 1).cast("int") == tx.check_digit(F.substring("tax_id", 3, 12)), F.lit(False)))


@query("d33_check_digit", "SELECT c_custkey, CAST(9 - (list_sum(list_transform(range(1, 13), lambda i: CAST(substr(b, 13 - i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END)) % 9) AS INTEGER) AS digit FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 12, '0') AS b FROM customer)")
def d33b(s, d):
    return fx.table(s, d, "customer").select("c_custkey", tx.check_digit(F.lpad((F.col("c_custkey") * 7919).cast("string"), 12, "0")).cast("int").alias("digit"))


@query("d37_html_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def d37(s, d):
    return fx.table(s, d, "pages").select("page_id", tx.html_escape("html").alias("escaped"))


@query("d39_retry_delay", "SELECT n AS attempts, CAST(least(30 * pow(2, n - 1), 3600) AS BIGINT) AS seconds FROM range(1, 13) t(n)")
def d39(s, d):
    return s.range(1, 13).select(F.col("id").alias("attempts"), F.least(30 * F.pow(F.lit(2.0), F.col("id") - 1), F.lit(3600.0)).cast("long").alias("seconds"))


D40_ROWS = (
    ("2026-7-1", "2026-07-01", "2026-7-1", "2026-7-1"), (" 2026-07-01", " 2026-07-01", " 2026-07-01", "2026-07-01"), ("1200.50", "1200.50", "1200.5", "1200.50"), (" 1200 ", " 1200 ", "1200", "1200"), ("1e3", "1e3", "1000", "1e3"),
    ("about", "about", "about", "about"), ("  ", "  ", "  ", None), (None, None, None, None),
)


@query("d40_audit_canonical", rows_sql("raw, as_date, as_number, as_text", *D40_ROWS))
def d40(s, d):
    """The three canonical forms in which extracted values are compared with verified ones; what cannot be read stays as it is."""
    rows = s.createDataFrame([(r[0],) for r in D40_ROWS], "raw string")
    return rows.select("raw", review.canonical_date(F.col("raw")).alias("as_date"), review.canonical_number(F.col("raw")).alias("as_number"), review.canonical_text(F.col("raw")).alias("as_text"))


@query("d41_stable_typed_value", """SELECT o_orderkey, '{"amount":{"decimal":"' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '"},"at":{"datetime":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00"},"day":{"date":"' || strftime(o_orderdate, '%Y-%m-%d') || '"},"id":{"uuid":"' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) || '"},"key":' || o_orderkey || ',"none":null,"raw":{"bytes":"' || sha256(o_orderpriority) || '","length":' || length(o_orderpriority) || '}}' AS tagged FROM orders""")
def d41(s, d):
    """Values with their types: decimals, instants, days, ids and bytes are tagged, bytes as digest and length."""
    o = fx.table(s, d, "orders")
    fields = {
        "amount": tx.tagged("decimal", F.col("o_totalprice").cast("decimal(18,2)").cast("string")), "at": tx.tagged("datetime", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")), "day": tx.tagged("date", F.date_format("o_orderdate", "yyyy-MM-dd")),
        "id": tx.tagged("uuid", F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8)), "key": F.col("o_orderkey"), "none": F.lit(None).cast("string"), "raw": tx.tagged_bytes(F.encode("o_orderpriority", "UTF-8")),
    }
    return o.select("o_orderkey", tx.stable_json(fields).alias("tagged"))


@query("l8_sql_functions", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE trim(o_orderstatus) END AS status, 'reviewer-1' AS actor FROM orders")
def l8(s, d):
    """Functions registered for SQL text: a payload's value, its audit form, and who acts in this session."""
    sqlfunctions.register(s, actor="reviewer-1")
    priority = F.struct(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("value"), F.lit(1.0).alias("confidence"))
    payload = F.to_json(F.struct(priority.alias("priority"), F.when(F.col("o_orderkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderstatus")).alias("status")), {"ignoreNullFields": "false"})
    rows = fx.table(s, d, "orders").select("o_orderkey", payload.alias("payload"))
    return rows.selectExpr("o_orderkey", "extraction_payload_value(payload, 'priority') as priority", "audit_text(extraction_payload_value(payload, 'status')) as status", "current_audit_actor() as actor")
