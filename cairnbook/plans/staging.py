"""Queries of staging and mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnbook.operators import mapping, staging
from cairnbook.plans.registry import query, rows_sql
from cairnbook.plans.scalars import CELL
from cairnbook.sources import fixtures as fx
from cairnbook.sources.fixtures import SQL_ROWS

R = f"WITH {SQL_ROWS} "
TABLES = [
    (1, "sheet/A", ["date", "amount", "vendor"], [["2026-07-01", "1200.5", "Shop"], ["2026-07-02", "500", ""]]),
    (1, "sheet/B", ["amount", "units"], [["250", "3"], ["not-a-number", "4"]]),
    (2, "sheet/C", ["name", "name", ""], [["x", "y", "z"], ["", "", ""]]),
    (3, "sheet/D", ["date", "amount", "currency", "memo"], [["2026年8月1日", "1.234,50", "円", "<b>literal</b>"], ["2026年8月2日", "10", "円", "=1+1"], ["", "", "", ""], ["not-a-date", "bad", "円", "x"]]),
    (3, "sheet/E", ["note"], [["left out"]]),
    (3, "sheet/F", ["rest"], [["residual"]]),
]
RULES = [
    mapping.Rule("transaction_date", ("date",), kind="date", style="japanese", required=True),
    mapping.Rule("total_amount", ("amount",), kind="decimal", style="comma", sign="negate", required=True),
    mapping.Rule("currency", ("currency",), kind="currency", value_map={"円": "JPY"}),
    mapping.Rule("memo", ("memo",), trim=False),
]


def staged(s):
    return staging.staged(s.createDataFrame(TABLES, "document_id int, source_location string, header array<string>, rows array<array<string>>"))


@query("a6_unique_headers", rows_sql("header, delimited, workbook", (['name', 'name', ''], ['name', 'name__2', 'column_3'], ['name', 'name_2', 'column_3']), (['a', 'b', 'a', 'a'], ['a', 'b', 'a__2', 'a__3'], ['a', 'b', 'a_2', 'a_3']), ([' x ', None, 'x'], ['x', 'column_2', 'x__2'], ['x', 'column_2', 'x_2'])))
def a6(s, d):
    rows = s.createDataFrame([(["name", "name", ""],), (["a", "b", "a", "a"],), ([" x ", None, "x"],)], "header array<string>")
    return rows.select("header", staging.unique_headers(F.col("header")).alias("delimited"), staging.unique_headers(F.col("header"), "_").alias("workbook"))


@query("a7_workbook_headers", rows_sql("sheet, names", ("sheet/C", "name,name_2,column_3")))
def a7(s, d):
    """Headers of a workbook's sheet: repeats get one underscore."""
    tables = s.createDataFrame(TABLES, "document_id int, source_location string, header array<string>, rows array<array<string>>").where("source_location = 'sheet/C'")
    return tables.select(F.col("source_location").alias("sheet"), F.array_join(staging.unique_headers(F.col("header"), "_"), ",").alias("names"))


@query("a15_sheet_description", rows_sql("source_location, description", ("sheet/A", "date, amount, vendor; 2026-07-01 to 2026-07-02"), ("sheet/B", "amount, units"), ("sheet/C", "name, name__2, column_3"), ("sheet/D", "date, amount, currency, memo"), ("sheet/E", "note"), ("sheet/F", "rest")))
def a15(s, d):
    return staging.described(staged(s)).select("source_location", "description")


@query("w10_header_occurrence", "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS INTEGER) AS occurrence FROM events")
def w10(s, d):
    from pyspark.sql import Window

    return fx.table(s, d, "events").select("event_id", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).alias("occurrence"))


NUM = "trim(k) <> '' AND regexp_full_match(trim(k), '[+-]?([0-9]+|[0-9]+\\.[0-9]*|\\.[0-9]+)')"


@query("e5_json_column_aggregate", R + f"SELECT document_id, source_location, CAST(sum(CAST(k AS DECIMAL(24,6))) AS DOUBLE) AS total, round(CAST(sum(CAST(k AS DECIMAL(24,6))) AS DOUBLE) / count(*), 6) AS average, count(*) AS n FROM fx_rows WHERE {NUM} GROUP BY 1, 2")
def e5(s, d):
    return staging.numeric_aggregate(fx.staged_rows(s, d), "k", "document_id", "source_location")


@query("e5_numeric_total", R + f"SELECT CAST(sum(CAST(k AS DECIMAL(24,6))) AS DOUBLE) AS total, round(CAST(sum(CAST(k AS DECIMAL(24,6))) AS DOUBLE) / count(*), 6) AS average, count(*) AS n FROM fx_rows WHERE {NUM}")
def e5b(s, d):
    return staging.numeric_aggregate(fx.staged_rows(s, d), "k")


@query("e17_column_kinds", R + f", c AS (SELECT document_id, unnest(['k', 'value', 'event', 'day']) AS name, unnest([k, value, event, day]) AS x FROM fx_rows), t AS (SELECT document_id, name, {CELL} AS kind FROM c) SELECT document_id, name, CASE count(DISTINCT kind) FILTER (kind <> 'blank') WHEN 0 THEN 'blank' WHEN 1 THEN max(kind) FILTER (kind <> 'blank') ELSE 'mixed' END AS kind FROM t GROUP BY 1, 2")
def e17(s, d):
    cells = fx.staged_rows(s, d).select("document_id", F.explode("values").alias("name", "x")).select("document_id", "name", staging.cell_kind(F.col("x")).alias("kind"))
    return staging.column_kinds(cells, "document_id", "name")


M1_ROWS = ((1, 'sheet/A', '[{"pos":0,"name":"date","kind":"date"},{"pos":1,"name":"amount","kind":"mixed"},{"pos":2,"name":"vendor","kind":"string"}]'), (1, 'sheet/B', '[{"pos":0,"name":"amount","kind":"mixed"},{"pos":1,"name":"units","kind":"integer"}]'), (2, 'sheet/C', '[{"pos":0,"name":"name","kind":"string"},{"pos":1,"name":"name__2","kind":"string"},{"pos":2,"name":"column_3","kind":"string"}]'), (3, 'sheet/D', '[{"pos":0,"name":"date","kind":"string"},{"pos":1,"name":"amount","kind":"mixed"},{"pos":2,"name":"currency","kind":"string"},{"pos":3,"name":"memo","kind":"string"}]'), (3, 'sheet/E', '[{"pos":0,"name":"note","kind":"string"}]'), (3, 'sheet/F', '[{"pos":0,"name":"rest","kind":"string"}]'))


@query("m1_staged_structure", "SELECT *, sha256(columns) AS schema_digest FROM (" + rows_sql("document_id, source_location, columns", *M1_ROWS) + ")")
def m1(s, d):
    return staging.schema_fingerprint(staged(s)).select("document_id", "source_location", F.to_json("columns").alias("columns"), "schema_digest")


@query("m2_validate_mapping", rows_sql("mapping, verdict", ('good', 'accepted'), ('unknown column', "unknown columns: ['amount', 'currency', 'memo']"), ('twice', 'too many fields, or a target mapped twice')))
def m2(s, d):
    """One row per mapping tried: accepted, or why it is refused before any job runs."""
    out = []
    for name, rules, columns in (("good", RULES, ["date", "amount", "currency", "memo"]), ("unknown column", RULES, ["date"]), ("twice", [RULES[0], RULES[0]], ["date"])):
        try:
            mapping.validate(rules, columns)
            out.append((name, "accepted"))
        except ValueError as e:
            out.append((name, str(e)))
    return s.createDataFrame(out, "mapping string, verdict string")


@query("m3_apply_rules", rows_sql("row_index, transaction_date, total_amount, currency, memo, issues", (0, '2026-08-01', '-1234.50', 'JPY', '<b>literal</b>', []), (1, '2026-08-02', '-10', 'JPY', '=1+1', []), (2, None, None, None, None, ['transaction_date:required', 'total_amount:required']), (3, None, None, 'JPY', 'x', ['transaction_date:invalid_date', 'total_amount:invalid_decimal'])))
def m3(s, d):
    rows = mapping.apply_rules(staged(s).where("source_location = 'sheet/D'"), RULES)
    return rows.select("row_index", "mapped.*", "issues")


def mapped(s):
    return mapping.candidates_and_ledger(staged(s), {"sheet/D": RULES, "sheet/E": None})


@query("m4_candidates", rows_sql("document_id, source_location, row_index, payload, issues, ordinal", (1, 'sheet/A', 0, '{"date":"2026-07-01","amount":"1200.5","vendor":"Shop"}', [], 1), (1, 'sheet/A', 1, '{"date":"2026-07-02","amount":"500","vendor":""}', [], 2), (1, 'sheet/B', 0, '{"amount":"250","units":"3"}', [], 3), (1, 'sheet/B', 1, '{"amount":"not-a-number","units":"4"}', [], 4), (2, 'sheet/C', 0, '{"name":"x","name__2":"y","column_3":"z"}', [], 1), (3, 'sheet/D', 0, '{"transaction_date":"2026-08-01","total_amount":"-1234.50","currency":"JPY","memo":"<b>literal</b>"}', [], 1), (3, 'sheet/D', 1, '{"transaction_date":"2026-08-02","total_amount":"-10","currency":"JPY","memo":"=1+1"}', [], 2), (3, 'sheet/D', 3, '{"currency":"JPY","memo":"x"}', ['transaction_date:invalid_date', 'total_amount:invalid_decimal'], 3), (3, 'sheet/F', 0, '{"rest":"residual"}', [], 4)))
def m4(s, d):
    return mapped(s)[0]


@query("w7_candidate_ordinal", R + "SELECT row_index, CAST(row_number() OVER (PARTITION BY document_id ORDER BY source_location, row_index) AS INTEGER) AS ordinal FROM fx_rows WHERE k <> ''")
def w7(s, d):
    from pyspark.sql import Window

    rows = fx.staged_rows(s, d).where(F.element_at("values", F.lit("k")) != "")
    return rows.select("row_index", F.row_number().over(Window.partitionBy("document_id").orderBy("source_location", "row_index")).alias("ordinal"))


# each row's canonical text, whose digest is its fingerprint
LEDGER = ((1, 'sheet/A', 0, '{"source_location":"sheet/A","row_index":0,"padded":["2026-07-01","1200.5","Shop"]}', 'residual'), (1, 'sheet/A', 1, '{"source_location":"sheet/A","row_index":1,"padded":["2026-07-02","500",""]}', 'residual'), (1, 'sheet/B', 0, '{"source_location":"sheet/B","row_index":0,"padded":["250","3"]}', 'residual'), (1, 'sheet/B', 1, '{"source_location":"sheet/B","row_index":1,"padded":["not-a-number","4"]}', 'residual'), (2, 'sheet/C', 0, '{"source_location":"sheet/C","row_index":0,"padded":["x","y","z"]}', 'residual'), (2, 'sheet/C', 1, '{"source_location":"sheet/C","row_index":1,"padded":["","",""]}', 'residual'), (3, 'sheet/D', 0, '{"source_location":"sheet/D","row_index":0,"padded":["2026年8月1日","1.234,50","円","<b>literal</b>"]}', 'mapped'), (3, 'sheet/D', 1, '{"source_location":"sheet/D","row_index":1,"padded":["2026年8月2日","10","円","=1+1"]}', 'mapped'), (3, 'sheet/D', 2, '{"source_location":"sheet/D","row_index":2,"padded":["","","",""]}', 'blank'), (3, 'sheet/D', 3, '{"source_location":"sheet/D","row_index":3,"padded":["not-a-date","bad","円","x"]}', 'mapped'), (3, 'sheet/E', 0, '{"source_location":"sheet/E","row_index":0,"padded":["left out"]}', 'ignored'), (3, 'sheet/F', 0, '{"source_location":"sheet/F","row_index":0,"padded":["residual"]}', 'residual'))


@query("m4_ledger", "SELECT document_id, source_location, row_index, sha256(canonical) AS fingerprint, disposition FROM (" + rows_sql("document_id, source_location, row_index, canonical, disposition", *LEDGER) + ")")
def m4b(s, d):
    return mapped(s)[1]


@query("m5_ledger_violations", rows_sql("document_id, source_location, row_index, n", (3, "sheet/F", 0, 2)))
def m5(s, d):
    """A ledger in which one row was entered twice."""
    ledger = mapped(s)[1]
    return mapping.ledger_violations(ledger.unionByName(ledger.where("source_location = 'sheet/F'")))


@query("e13_disposition_counts", rows_sql("document_id, mapped, blank, ignored, residual, error", (1, 0, 0, 0, 4, 0), (2, 0, 0, 0, 2, 0), (3, 3, 1, 1, 1, 0)))
def e13(s, d):
    kinds = ["mapped", "blank", "ignored", "residual", "error"]
    return mapped(s)[1].groupBy("document_id").agg(*[F.count_if(F.col("disposition") == k).alias(k) for k in kinds])


@query("m6_preview", rows_sql("row_index, transaction_date, total_amount, currency, memo", (0, '2026-08-01', '-1234.50', 'JPY', '&lt;b&gt;literal&lt;/b&gt;'), (1, '2026-08-02', '-10', 'JPY', '=1+1'), (3, None, None, 'JPY', 'x')))
def m6(s, d):
    from cairnbook.functions.text import html_escape

    rows = mapping.apply_rules(staged(s).where("source_location = 'sheet/D'"), RULES)
    return rows.where("not blank").orderBy("row_index").limit(50).select("row_index", *[html_escape(F.col(f"mapped.{r.target}")).alias(r.target) for r in RULES])


@query("e14_preview_counts", rows_sql("valid, errors, blank, total, truncated", (2, 1, 1, 4, False)))
def e14(s, d):
    rows = mapping.apply_rules(staged(s).where("source_location = 'sheet/D'"), RULES)
    bad = F.size("issues") > 0
    return rows.agg(F.count_if(~F.col("blank") & ~bad).alias("valid"), F.count_if(~F.col("blank") & bad).alias("errors"), F.count_if("blank").alias("blank"), F.count("*").alias("total"), (F.count("*") > 50).alias("truncated"))


@query("d11_date_styles", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS iso, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS ymd, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dmy, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS mdy, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS japanese, NULL::VARCHAR AS bad FROM orders")
def d11(s, d):
    raw = {"iso": "yyyy-MM-dd", "ymd": "yyyy/M/d", "dmy": "d/M/yyyy", "mdy": "M/d/yyyy", "japanese": "yyyy'年'M'月'd'日'"}
    day = F.col("o_orderdate")
    return fx.table(s, d, "orders").select("o_orderkey", *[mapping.parse_date(F.date_format(day, f), k).alias(k) for k, f in raw.items()], mapping.parse_date(F.concat(F.date_format(day, "yyyy-MM"), F.lit("-31x")), "iso").alias("bad"))


@query("d12_decimal_styles", "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS dot, -CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS negated FROM part")
def d12(s, d):
    plain = F.format_number("p_retailprice", 2)
    comma = F.translate(F.translate(F.translate(plain, ",", "_"), ".", ","), "_", ".")
    return fx.table(s, d, "part").select("p_partkey", mapping.parse_decimal(plain, "dot").cast("double").alias("dot"), mapping.parse_decimal(comma, "comma", "negate").cast("double").alias("negated"))


@query("d13_currency_alias", "SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'JPY' WHEN 1 THEN 'USD' WHEN 2 THEN 'VND' END AS currency FROM customer")
def d13(s, d):
    raw = F.when(F.col("c_nationkey") % 4 == 0, "円").when(F.col("c_nationkey") % 4 == 1, " usd").when(F.col("c_nationkey") % 4 == 2, "đồng").otherwise("??")
    rows = fx.table(s, d, "customer").select("c_custkey", F.create_map(F.lit("c"), raw).alias("values"))
    value, _ = mapping.compile_rule(mapping.Rule("currency", ("c",), kind="currency", value_map={"円": "JPY", "đồng": "VND"}))
    return rows.select("c_custkey", value.alias("currency"))


@query("d14_rule_pipeline", "SELECT p_partkey, CASE WHEN p_brand || ' ' || p_type = 'Brand#11 x' THEN NULL ELSE trim(p_brand || ' ' || p_type) END AS label FROM part")
def d14(s, d):
    rows = fx.table(s, d, "part").select("p_partkey", F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.col("p_type")).alias("values"))
    value, _ = mapping.compile_rule(mapping.Rule("label", ("a", "b"), nulls=("", "Brand#11 x")))
    return rows.select("p_partkey", value.alias("label"))


@query("e23_currency_summary", "SELECT CASE WHEN event_type = 'view' THEN 'unspecified' ELSE event_type END AS currency, round(sum(TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE)), 4) AS amount FROM events GROUP BY 1")
def e23(s, d):
    name = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    raw = F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return fx.table(s, d, "events").groupBy(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("unspecified")).alias("currency")).agg(F.round(F.sum(raw.try_cast("double")), 4).alias("amount"))


@query("e25_delimited_evidence", rows_sql("n_rows, cells, duplicate_headers, ragged_rows", (3, 9, 1, 2)))
def e25(s, d):
    rows = s.createDataFrame([(["a", "a", "b"], [["1", "2", "3"], ["4", "5"], ["6", "7", "8", "9"]])], "header array<string>, rows array<array<string>>")
    ragged = F.size(F.filter("rows", lambda r: F.size(r) != F.size("header")))
    return rows.select(F.size("rows").alias("n_rows"), F.aggregate("rows", F.lit(0), lambda t, r: t + F.size(r)).alias("cells"), (F.size("header") - F.size(F.array_distinct("header"))).alias("duplicate_headers"), ragged.alias("ragged_rows"))


@query("a29_stage_sink", R + "SELECT document_id, count(*) AS n FROM fx_rows GROUP BY 1")
def a29(s, d):
    """Staged rows written by (document, version) partitions, so that a source is replaced as a whole, and read back."""
    from cairnbook.sources.tables import replace_partitions

    return replace_partitions(fx.staged_rows(s, d).withColumn("values", F.to_json("values")), "staged", "document_id", "source_version").groupBy("document_id").agg(F.count("*").alias("n"))


@query("a29_scale_staged", rows_sql("rows_staged, columns_staged, fingerprints", (1200, 13, 1200)))
def a29b(s, d):
    """A file of 1,200 rows and 13 columns preserved as bytes, parsed, staged under its document and version, and read back."""
    from cairnbook.sources import files
    from cairnbook.sources.tables import replace_partitions

    names = [f"synthetic_field_{c:02d}" for c in range(1, 14)]
    line = F.concat_ws(",", *[F.format_string(f"synthetic-r%04d-c{c:02d}", F.col("id").cast("int")) for c in range(1, 14)])
    body = s.range(1, 1201).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    file = body.select(F.lit("scale.csv").alias("path"), F.encode(F.concat(F.lit(",".join(names) + "\n"), F.array_join("lines", "\n"), F.lit("\n")), "UTF-8").alias("content"))
    tables = files.parse_files(file).where("cells is not null").select(F.lit(1).alias("document_id"), F.col("locator").alias("source_location"), F.element_at("cells", 1).alias("header"), F.slice("cells", 2, 1 << 20).alias("rows"))
    rows = staging.staged(tables).withColumn("values", F.to_json("values")).withColumn("source_version", F.lit(1)).drop("kinds", "names")
    kept = replace_partitions(rows, "staged", "document_id", "source_version")
    return kept.agg(F.count("*").alias("rows_staged"), F.max(F.size(F.json_object_keys("values"))).alias("columns_staged"), F.count_distinct("fingerprint").alias("fingerprints"))


@query("a30_stage_typed_rows", R + "SELECT row_index, TRY_CAST(CASE WHEN k <> '' THEN k END AS BIGINT) AS k, TRY_CAST(CASE WHEN value <> '' THEN value END AS DOUBLE) AS value, event, CAST(day AS DATE) AS day FROM fx_rows")
def a30(s, d):
    v = {c: F.nullif(F.trim(F.element_at("values", F.lit(c))), F.lit("")) for c in ("k", "value", "event", "day")}
    return fx.staged_rows(s, d).select("row_index", v["k"].try_cast("bigint").alias("k"), v["value"].try_cast("double").alias("value"), v["event"].alias("event"), F.try_to_date(v["day"], "yyyy-MM-dd").alias("day"))


@query("m7_rule_constraints", rows_sql("rule, accepted", ('nine sources', False), ('no source', False), ('style', False), ('good', True)))
def m7(s, d):
    """Rules refused when they are written: too many sources, no source, an unknown style."""
    out = []
    for name, make in (("nine sources", lambda: mapping.Rule("x", tuple("abcdefghi"))), ("no source", lambda: mapping.Rule("x")), ("style", lambda: mapping.Rule("x", ("a",), kind="date", style="?")), ("good", lambda: mapping.Rule("x", ("a",)))):
        try:
            make()
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return s.createDataFrame(out, "rule string, accepted boolean")
