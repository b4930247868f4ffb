"""Queries of fields as columns: labels, identifiers and payloads written in many ways from the given tables, read back and held to what they were written from."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnbook.functions import fields as fd
from cairnbook.operators import evaluation as ev
from cairnbook.operators import lifecycle, review
from cairnbook.operators import semistructured as tree
from cairnbook.plans.registry import query
from cairnbook.sources import fixtures as fx
from cairnbook.sources import policy

NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789#.-/"
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in NARROW)


def wide(sql: str) -> str:
    """SQL of a text in full-width characters, for Spark and DuckDB."""
    return f"translate({sql}, '{NARROW}', '{WIDE}')"


def chosen(of: str, *texts: str) -> str:
    """SQL of the text whose number is of, modulo their number."""
    return f"CASE {of} % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


NAMES = chosen("c_custkey", "c_name", wide("upper(c_name)"), "concat('  ', c_name, '　　', c_name, ' ')", "concat(c_name, ' Straße ｻﾝﾌﾟﾙ')", "''", "NULL")


@query("d15_names_by_key", "SELECT c_custkey, " + chosen("c_custkey", "lower(c_name)", "lower(c_name)", "lower(c_name || ' ' || c_name)", "lower(c_name) || ' strasse サンプル'", "''", "NULL") + " AS key FROM customer")
def d15(s, d):
    """Names in full and half width, with sharp s, doubled and wide spaces."""
    return fx.table(s, d, "customer").select("c_custkey", fd.text_key(F.expr(NAMES)).alias("key"))


ISSUERS = chosen("c_custkey", "concat('東京電力 ', c_name)", f"concat({wide(chr(39) + 'TEPCO' + chr(39))}, ' ', c_name)", "concat('Tokyo   Gas ', c_name)", "concat(c_name, ' 水道局')", "concat(c_name, '　国保')", "c_name", "' '")


@query("d30_issuers", "SELECT c_custkey, " + chosen("c_custkey", "'東京電力'", "'東京電力'", "'東京ガス'", "c_name || ' 水道局'", "c_name || ' 国保'", "c_name", "NULL") + " AS name, " + chosen("c_custkey", "'electric'", "'electric'", "'gas'", "'water'", "'nhi'", "'other'", "NULL") + " AS kind, CASE WHEN c_custkey % 7 = 6 THEN 'an issuer needs a name' END AS error FROM customer")
def d30(s, d):
    return fx.table(s, d, "customer").select("c_custkey", fd.issuer(F.expr(ISSUERS)).alias("i")).select("c_custkey", "i.*")


#: Orders 28 years later, in Reiwa years, with parts of their dates; d0 stands for both engines' own date type.
Y, R, M, D = "year(d0)", "year(d0) - 2018", "month(d0)", "day(d0)"
PERIODS = chosen("o_orderkey", f"concat('令和', {R}, '年', {M}, '月分')", wide(f"concat('R', {R}, '.', {M})"), f"concat({Y}, '年', {M}, '月分')", f"concat({Y}, '-', lpad(CAST({M} AS STRING), 2, '0'), '-', lpad(CAST({D} AS STRING), 2, '0'))", f"concat({Y}, '/', {M})", f"concat('r', {R}, '/13')", "''", f"concat(' ', {Y}, '-', lpad(CAST({M} AS STRING), 2, '0'), ' ')")
DUES = chosen("(o_orderkey + o_custkey)", f"concat('令和', {R}, '年', {M}, '月', {D}, '日')", wide(f"concat('R', {R}, '.', {M}, '.', {D})"), f"concat({Y}, '年', {M}, '月', {D}, '日')", f"concat({Y}, lpad(CAST({M} AS STRING), 2, '0'), lpad(CAST({D} AS STRING), 2, '0'))", "''", f"concat({Y}, '/2/30')", f"concat('R0.', {M}, '.', {D})")


@query(
    "d31_labels_of_orders",
    f"""WITH o AS (SELECT *, CAST(o_orderdate + INTERVAL 28 YEAR AS DATE) AS d0, o_orderkey % 8 AS a, (o_orderkey + o_custkey) % 7 AS b FROM orders)
SELECT o_orderkey, CASE WHEN a NOT IN (5, 6) THEN CAST(date_trunc('month', d0) AS DATE) END AS period, CASE a WHEN 5 THEN 'not a known month label: r' || ({R}) || '/13' WHEN 6 THEN 'a billing period is needed' END AS period_error,
  CASE WHEN b < 4 THEN d0 END AS due, CASE b WHEN 5 THEN 'not a known date label: ' || {Y} || '/2/30' WHEN 6 THEN 'not a known date label: R0.' || {M} || '.' || {D} END AS due_error FROM o""",
)
def d31(s, d):
    """Billing periods and due dates of orders, written as ISO, Gregorian and Reiwa labels, some of them impossible."""
    o = fx.table(s, d, "orders").withColumn("d0", F.to_date(F.add_months("o_orderdate", 336)))
    o = o.select("o_orderkey", fd.billing_period(F.expr(PERIODS)).alias("p"), fd.due_date(F.expr(DUES)).alias("d"))
    return o.select("o_orderkey", F.col("p.day").alias("period"), F.col("p.error").alias("period_error"), F.col("d.day").alias("due"), F.col("d.error").alias("due_error"))


LINE = "(l_orderkey + l_linenumber)"


@query(
    "d32_consumption_of_lines",
    f"""WITH l AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS x, {LINE} % 6 AS u, CASE WHEN l_orderkey % 11 = 0 THEN 'a unit needs a value' WHEN l_orderkey % 13 = 0 THEN 'consumption must be a number' WHEN {LINE} % 6 = 5 OR floor(l_extendedprice) <= 0 THEN 'consumption must be positive and have a unit' END AS error FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN error IS NULL THEN CAST(x AS DOUBLE) END AS amount, CASE WHEN error IS NULL THEN ['kWh', 'kWh', 'm³', 'm³', '袋'][u + 1] END AS unit, error FROM l""",
)
def d32(s, d):
    unit = F.expr(chosen(LINE, "'kwh'", "' KW/H'", "'ｍ３'", "'m^3'", "'袋'", "' '"))
    value = F.when(F.col("l_orderkey") % 11 == 0, None).when(F.col("l_orderkey") % 13 == 0, "about").otherwise(F.format_number(F.floor("l_extendedprice"), 0))
    lines = fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", fd.consumption(value, unit).alias("c"))
    return lines.select("l_orderkey", "l_linenumber", F.col("c.amount").cast("double").alias("amount"), "c.unit", "c.error")


DIGITS = "lpad(CAST(c_custkey * 7919 AS STRING), 12, '0')"
TAX = chosen("c_custkey", "concat('T', id)", wide("concat('T', id)"), "concat('t', substr(id, 1, 1), '-', substr(id, 2, 4), '-', substr(id, 6))", "concat('T', CAST(digit % 9 + 1 AS STRING), substr(id, 2))", "substr(id, 2)", "concat(' ', substr(id, 1, 7), '　', substr(id, 8))", "NULL")


@query(
    "d33_tax_ids",
    f"""WITH c AS (SELECT c_custkey, b, CAST(9 - (list_sum(list_transform(range(1, 13), lambda i: CAST(substr(b, 13 - i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END)) % 9) AS INTEGER) AS digit FROM (SELECT c_custkey, {DIGITS} AS b FROM customer))
SELECT c_custkey, CASE WHEN c_custkey % 7 IN (4, 6) THEN NULL WHEN c_custkey % 7 = 3 THEN 'T' || (digit % 9 + 1) || b ELSE 'T' || digit || b END AS tax_id, c_custkey % 7 NOT IN (3, 4, 6) AS valid FROM c""",
)
def d33(s, d):
    """Registration numbers in full width, with hyphens and spaces, with a wrong check digit, too short."""
    c = fx.table(s, d, "customer").withColumn("digit", fd.check_digit(F.expr(DIGITS)).cast("int")).withColumn("id", F.concat(F.col("digit").cast("string"), F.expr(DIGITS)))
    return c.select("c_custkey", fd.tax_id(F.expr(TAX)).alias("t")).select("c_custkey", "t.*")


@query(
    "d38_fields_of_orders",
    """WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS o_orderkey, 'total_amount' AS field, k % 9 <> 0 AND k % 2 = 0 AS same FROM o UNION ALL SELECT k, 'due_date', k % 9 <> 0 AND k % 3 <> 0 FROM o
UNION ALL SELECT k, 'registration_number', k % 4 <> 0 FROM o UNION ALL SELECT k, 'counterparty', k % 14 = 0 OR k % 7 <> 0 FROM o""",
)
def d38(s, d):
    """Predicted and expected texts of four kinds of fields of every order: which are the same."""
    k, price, day = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)"), F.to_date("o_orderdate")
    number = F.lpad(k.cast("string"), 13, "1")
    wide_number = F.translate(F.when(k % 4 == 0, F.reverse(F.concat(number, F.lit("x")))).otherwise(number), NARROW, WIDE)
    pairs = {
        "total_amount": (F.when(k % 9 == 0, "n/a").otherwise(price.cast("string")), (price + F.when(k % 2 == 0, F.lit("0.50").cast("decimal(3,2)")).otherwise(F.lit("0.51").cast("decimal(3,2)"))).cast("string")),
        "due_date": (F.when(k % 9 == 0, "July").otherwise(day.cast("string")), F.when(k % 9 == 0, "July").otherwise(F.date_add(day, F.when(k % 3 == 0, 1).otherwise(0)).cast("string"))),
        "registration_number": (F.concat(F.lit("T-"), number), F.concat(F.lit("Ｔ"), wide_number)),
        "counterparty": (F.when(k % 7 != 0, F.translate(F.lower("o_orderpriority"), NARROW, WIDE)), F.when(k % 14 != 0, F.concat(F.lit(" "), F.replace("o_orderpriority", F.lit(" "), F.lit("　 "))))),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), a.alias("predicted"), b.alias("expected")) for n, (a, b) in pairs.items()]))
    return fx.table(s, d, "orders").select("o_orderkey", rows.alias("r")).select("o_orderkey", "r.field", ev.same_field(F.col("r.field"), F.col("r.predicted"), F.col("r.expected")).alias("same"))


EVENT_JSON = chosen("event_id", """concat('{"z": ', props, ', "event": "', event_type, '", "a": [null, "é", {"y": 1, "x": ', event_id, '}]}')""", """concat('{"a":[null,"é",{"x":', event_id, ',"y":1}],  "event":"', event_type, '","z":', props, '}')""", "'{\"a\": NaN}'", "'{\"a\": '", "NULL")


@query("d23_digests_of_events", """SELECT event_id, canonical, sha256(canonical) AS digest FROM (SELECT event_id, CASE WHEN event_id % 5 < 2 THEN '{"a":[null,"\\u00e9",{"x":' || event_id || ',"y":1}],"event":"' || event_type || '","z":{"k":' || json_extract_string(props, '$.k') || '}}' END AS canonical FROM events)""")
def d23(s, d):
    """Payloads of events with fields in two orders: one canonical text and digest for both, none for what is no JSON."""
    rows = fx.table(s, d, "events").select("event_id", fd.canonical_json(F.expr(EVENT_JSON)).alias("canonical"))
    return rows.withColumn("digest", F.sha2("canonical", 256))


@query("d24_locators_of_pages", "SELECT page_id, 'page/' || url_encode(url) || '/' || url_encode('a*b+c ~表_' || page_id) AS locator FROM pages")
def d24(s, d):
    return fx.table(s, d, "pages").select("page_id", fd.locator("page", F.col("url"), F.concat(F.lit("a*b+c ~表_"), F.col("page_id").cast("string"))).alias("locator"))


@query(
    "d26_confidences_of_orders",
    """WITH l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)
SELECT l_orderkey, 'lines[' || i || '].item' AS path, CAST(l_linenumber / 8.0 AS DOUBLE) AS confidence FROM l WHERE l_linenumber <> 3 UNION ALL SELECT l_orderkey, 'lines[' || i || '].place.part', 0.25::DOUBLE FROM l
UNION ALL SELECT DISTINCT l_orderkey, 'total', 0.5::DOUBLE FROM l""",
)
def d26(s, d):
    """Payloads of orders, one object a line: the confidence of every field, whatever its depth, by path."""
    def field(value, confidence):
        return F.struct(value.alias("value"), confidence.alias("confidence"))

    def line(x):
        sure = F.when(x["l_linenumber"] != 3, x["l_linenumber"] / 8.0)
        return F.struct(field(x["l_partkey"], sure).alias("item"), F.struct(field(x["l_suppkey"], F.lit(0.25)).alias("part")).alias("place"))

    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), line)
    orders = fx.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.struct(field(F.count("*"), F.lit(0.5)).alias("total"), lines.alias("lines"), F.lit("x").alias("confidence")).alias("payload"))
    return tree.confidences(orders.select("l_orderkey", F.to_json("payload", {"ignoreNullFields": "false"}).alias("json")), "l_orderkey")


@query("d39_delays_of_jobs", "SELECT event_id AS id, CAST(least(30 * pow(2, event_id % 12), 3600) AS BIGINT) AS seconds, strftime(ts + to_seconds(CAST(least(30 * pow(2, event_id % 12), 3600) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS due FROM events")
def d39(s, d):
    """When failed jobs are due again, after one to twelve attempts."""
    seconds = lifecycle.retry_delay(F.col("id") % 12 + 1)
    at = F.col("available_at") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return fx.jobs(s, d).select("id", seconds.alias("seconds"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("due"))


RAW = chosen("o_orderkey", "concat(year(o_orderdate), '-', month(o_orderdate), '-', day(o_orderdate))", "concat(' ', CAST(CAST(o_orderdate AS DATE) AS STRING))", "concat(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '0')", "o_orderpriority", "'  '", "NULL")


@query(
    "d40_canonical_values",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE raw END AS as_date, CASE WHEN o_orderkey % 6 = 2 THEN regexp_replace(regexp_replace(raw, '0+$', ''), '[.]$', '') ELSE raw END AS as_number, nullif(trim(raw), '') AS as_text
FROM (SELECT *, {RAW} AS raw FROM orders)""",
)
def d40(s, d):
    """Days, amounts and notes of orders as they are written, in the forms in which audits compare them."""
    raw = F.expr(RAW)
    return fx.table(s, d, "orders").select("o_orderkey", review.canonical_date(raw).alias("as_date"), review.canonical_number(raw).alias("as_number"), review.canonical_text(raw).alias("as_text"))


KINDS = ("csv", "png", "pdf", "zip", "docx", "unknown")


@query(
    "a25_intake_of_texts",
    """WITH f AS (
  SELECT 'page' AS kind, page_id AS id, 'markup' AS family, 'html' AS format, regexp_matches(html, '(?i)<script') AS active, page_id % 3 AS intent, length(html) > 4000 AS large FROM pages
  UNION ALL SELECT 'document', doc_id, ['table', 'image', 'document', 'container', 'document', 'opaque'][doc_id % 6 + 1], ['csv', 'png', 'pdf', 'zip', 'docx', 'unknown'][doc_id % 6 + 1], false, (doc_id // 6) % 3, length(text) > 20000 FROM documents),
v AS (SELECT kind, id, CASE WHEN large THEN 'reject:upload_too_large' WHEN active THEN 'reject:active_content' WHEN intent = 1 AND NOT (family = 'image' OR format = 'pdf') THEN 'reject:intake_intent_mismatch'
  WHEN intent = 2 AND format = 'csv' THEN 'process:mapping_required' WHEN intent = 2 AND format = 'pdf' THEN 'store_unprocessed:generic_candidate_deferred' WHEN format IN ('csv', 'png', 'zip', 'html') THEN 'process:processing_queued'
  WHEN family = 'opaque' THEN 'store_unprocessed:opaque_safe_fallback' ELSE 'store_unprocessed:adapter_unavailable' END AS verdict FROM f)
SELECT kind, id, split_part(verdict, ':', 1) AS action, split_part(verdict, ':', 2) AS reason, verdict IN ('store_unprocessed:generic_candidate_deferred', 'store_unprocessed:opaque_safe_fallback', 'store_unprocessed:adapter_unavailable') AS retryable FROM v""",
)
def a25(s, d):
    """Pages, and documents as files of six formats, through the table of decisions: contents that act, sizes and intents decide."""
    def intent(n):
        return F.when(n % 3 == 1, "bill_scan").when(n % 3 == 2, "generic_file")

    def large(text, most):
        return F.when(F.length(text) > most, "upload_too_large").alias("violation")

    none = F.array().cast("array<string>")
    pages = fx.table(s, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.lit("html").alias("format"), F.when(F.rlike("html", F.lit("(?i)<script")), F.array(F.lit("risk:active_content"))).otherwise(none).alias("evidence"), intent(F.col("page_id")).alias("intent"), large("html", 4000))
    form = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 6 + 1).cast("int"))
    docs = fx.table(s, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), form.alias("format"), none.alias("evidence"), intent(F.expr("doc_id div 6")).alias("intent"), large("text", 20000))
    files = pages.unionByName(docs).withColumn("family", policy.family(F.col("format")))
    return policy.decide(files, F.array(*[F.lit(f) for f in ("csv", "png", "zip", "html")])).select("kind", "id", "action", "reason", "retryable")


@query(
    "a26_texts_within_limits",
    """WITH m AS (SELECT doc_id, text, length(text) AS chars, len(text) - len(replace(text, chr(10), '')) + 1 AS lines, len(regexp_extract_all(text, '[0-9]')) AS digits FROM documents),
e AS (SELECT *, CASE WHEN chars > 20000 THEN 'chars: ' || chars || ' is above 20000' WHEN lines > 40 THEN 'lines: ' || lines || ' is above 40' WHEN digits > 60 THEN 'digits: ' || digits || ' is above 60' END AS error FROM m)
SELECT doc_id, error, CASE WHEN error IS NULL THEN md5(text) END AS content FROM e""",
)
def a26(s, d):
    """Texts above a ceiling fail closed: a row with the measure and nothing of the text."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    rows = policy.within(fx.table(s, d, "documents").select("doc_id", "text"), "text", {"chars": (F.length("text"), 20000), "lines": (lines, 40), "digits": (F.regexp_count("text", F.lit("[0-9]")), 60)})
    return rows.select("doc_id", "error", F.md5("text").alias("content"))


ENGINES = "e AS (SELECT l_returnflag || l_linestatus AS engine, avg(CAST(l_linenumber % 3 > 0 AS INTEGER)) AS counterparty, avg(CAST(l_quantity % 5 > 0 AS INTEGER)) AS total_amount, avg(CAST(coalesce(l_partkey % 7 > 0, false) AS INTEGER)) AS transaction_date, avg(l_quantity) AS seconds, max(l_partkey) AS bytes FROM lineitem GROUP BY 1)"


def engines(s, d):
    return ev.recovery(fx.table(s, d, "lineitem").withColumn("engine", F.concat("l_returnflag", "l_linestatus")), "engine", {"counterparty": F.col("l_linenumber") % 3 > 0, "total_amount": F.col("l_quantity") % 5 > 0, "transaction_date": F.col("l_partkey") % 7 > 0}, F.col("l_quantity"), F.col("l_partkey"))


@query("e29_recovery_means", f"WITH {ENGINES} SELECT engine, round(counterparty, 6) AS counterparty, round(total_amount, 6) AS total_amount, round(transaction_date, 6) AS transaction_date, round((counterparty + total_amount + transaction_date) / 3, 4) AS mean FROM e")
def e29(s, d):
    """Shares of lines of which each field was recovered, by return flag and status, and their mean."""
    e = engines(s, d)
    return e.select("engine", *[F.round(n, 6).alias(n) for n in ("counterparty", "total_amount", "transaction_date")], "mean")


@query("e29_recovery_winner", f"WITH {ENGINES} SELECT engine, round((counterparty + total_amount + transaction_date) / 3, 4) AS mean, round(seconds, 6) AS seconds FROM e WHERE seconds <= (SELECT avg(l_quantity) FROM lineitem) ORDER BY 2 DESC, 3, 1 LIMIT 1")
def e29b(s, d):
    """Of the groups that take no longer than all lines do on average, the one of the best mean."""
    usual = fx.table(s, d, "lineitem").agg(F.avg("l_quantity").alias("usual"))
    fit = engines(s, d).join(usual, F.col("seconds") <= F.col("usual"))
    return ev.winner(fit, "engine", {}).select("engine", "mean", F.round("seconds", 6).alias("seconds"))


#: Pages with elements that act, load and listen, and with texts that only look like them, by number.
ACTING = "concat(html, " + chosen("page_id", "'<img src=\"https://a.example/x.png\" onerror=\"go()\">'", "'<!-- <iframe src=\"//a.example\"> --><p title=\"a > b onclick=1 src=//x\">t</p>'", "'<iframe src=''//b.example''></iframe><a href=\"/own\" onClick=go ONLOAD=\"x\">t</a>'", "'<script src=\"http://c.example/s.js\">document.write(\"<embed src=//d>\")</script>'", "'<form action=\"https://e.example\"><object></object></form>'") + ")"


@query("a11_page_counts", "SELECT page_id, " + ", ".join(f"CAST({base} + {chosen('page_id', *map(str, more))} AS INTEGER) AS {name}" for name, base, more in (("active", "len(regexp_extract_all(html, '<(script|iframe|object|embed)[ >]'))", (0, 0, 1, 1, 1)), ("events", "0", (1, 0, 2, 0, 0)), ("external", "0", (1, 0, 1, 1, 1)))) + " FROM pages")
def a11(s, d):
    """What could act or load in whole pages, counted by built-in functions."""
    return fx.table(s, d, "pages").select("page_id", fd.html_counts(F.expr(ACTING)).alias("c")).select("page_id", "c.*")
