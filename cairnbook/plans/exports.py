"""Queries of exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnbook.operators import exports
from cairnbook.operators.ordered import digest_sql
from cairnbook.plans.registry import SQL, query
from cairnbook.plans.verified import SQL_ACTIVE, active
from cairnbook.sources import fixtures as fx

ACCOUNT = "CASE category WHEN 'HOUSEHOLD' THEN '消耗品費' WHEN 'MACHINERY' THEN '会議費' ELSE '雑費' END"
LEDGER = f"WITH {SQL_ACTIVE}, r AS (SELECT id, transaction_date, floor(total_amount) AS yen, counterparty, category, CASE WHEN id % 3 = 0 THEN floor(total_amount / 11) END AS t10, CASE WHEN id % 3 = 1 THEN floor(total_amount / 12) END AS t8 FROM active WHERE currency = 'JPY' AND total_amount >= 100)"
TAX = "CASE WHEN t8 > 0 THEN '課対仕入8%' WHEN t10 > 0 THEN '課対仕入10%' ELSE '対象外' END"


def records(s, d):
    category = F.when(F.col("category") == "HOUSEHOLD", "Household").when(F.col("category") == "MACHINERY", "Food").otherwise(F.col("category"))
    third = F.col("id") % 3
    rows = active(s, d).where("currency = 'JPY' and total_amount >= 100")
    return rows.select("id", "transaction_date", F.floor("total_amount").cast("decimal(18,2)").alias("total_amount"), "counterparty", category.alias("category"), F.when(third == 1, F.floor(F.col("total_amount") / 12).cast("decimal(18,2)")).alias("tax_8"), F.when(third == 0, F.floor(F.col("total_amount") / 11).cast("decimal(18,2)")).alias("tax_10"))


@query("a31_journal_33", LEDGER + f" SELECT strftime(transaction_date, '%Y/%m/%d') AS day, CAST(row_number() OVER (ORDER BY transaction_date, CAST(id AS VARCHAR)) AS VARCHAR) AS voucher, {ACCOUNT} AS account, CAST(CAST(yen AS BIGINT) AS VARCHAR) AS amount, {TAX} AS tax, coalesce(CAST(CAST(coalesce(t8, t10) AS BIGINT) AS VARCHAR), '') AS tax_amount, counterparty || ' [record:' || id || ']' AS summary FROM r")
def a31(s, d):
    j = exports.journal_33(records(s, d))
    names = dict(zip(("日付", "伝票番号", "借方勘定科目", "借方金額", "借方税区分", "借方税額", "摘要"), ("day", "voucher", "account", "amount", "tax", "tax_amount", "summary"), strict=True))
    return j.select(*[F.col(k).alias(v) for k, v in names.items()])


JOURNAL = {0: "'[明細行]'", 1: "strftime(transaction_date, '%Y/%m/%d')", 2: "CAST(row_number() OVER (ORDER BY transaction_date, CAST(id AS VARCHAR)) AS VARCHAR)", 4: ACCOUNT, 7: "counterparty", 15: "CAST(CAST(yen AS BIGINT) AS VARCHAR)", 16: TAX, 17: "coalesce(CAST(CAST(coalesce(t8, t10) AS BIGINT) AS VARCHAR), '')", 18: "'未払金'", 29: "CAST(CAST(yen AS BIGINT) AS VARCHAR)", 30: "'対象外'", 32: "counterparty || ' [record:' || id || ']'"}


@query("a31_journal_33_all_columns", LEDGER + " SELECT " + ", ".join(f"""{JOURNAL.get(i, "''")} AS \"{name}\"""" for i, name in enumerate(exports.JOURNAL_HEADER)) + " FROM r")
def a31b(s, d):
    return exports.journal_33(records(s, d))


@query("a32_journal_27", LEDGER + f" SELECT strftime(transaction_date, '%Y/%m/%d') AS c04, {ACCOUNT} AS c05, {TAX} AS c08, CAST(CAST(yen AS BIGINT) AS VARCHAR) AS c09, substr(counterparty || ' [record:' || id || ']', 1, 30) AS c17, substr(counterparty, 1, 15) AS c26 FROM r")
def a32(s, d):
    return exports.journal_27(records(s, d)).select("c04", "c05", "c08", "c09", "c17", "c26")


@query("a32_shift_jis")
def a32b(s, d):
    lines = exports.journal_27(records(s, d)).select(F.concat_ws(",", *[f"c{i + 1:02d}" for i in range(27)]).alias("line"))
    return exports.shift_jis(lines, "line").select(F.length("bytes").alias("n_bytes"), F.md5("bytes").alias("digest"))


@query("w6_voucher_number", LEDGER + " SELECT id, row_number() OVER (ORDER BY transaction_date, CAST(id AS VARCHAR)) AS voucher FROM r")
def w6(s, d):
    return exports.with_voucher(records(s, d)).select("id", "voucher")


@query("d19_account_map", f"WITH {SQL_ACTIVE} SELECT id, {ACCOUNT} AS account FROM active")
def d19(s, d):
    mapped = F.when(F.col("category") == "HOUSEHOLD", "Household").when(F.col("category") == "MACHINERY", " Food ").otherwise(F.col("category"))
    return active(s, d).select("id", exports.account(mapped).alias("account"))


@query("d20_tax_treatment", LEDGER + f" SELECT id, {TAX} AS tax FROM r")
def d20(s, d):
    return records(s, d).select("id", exports.tax_treatment(F.col("tax_8"), F.col("tax_10"))[0].alias("tax"))


@query("d21_whole_yen", LEDGER + " SELECT id, CAST(CAST(yen AS BIGINT) AS VARCHAR) AS amount FROM r")
def d21(s, d):
    return records(s, d).select("id", exports.whole_yen(F.col("total_amount"), "total").alias("amount"))


AUDIT = "SELECT event_id AS audit_id, ts AS \"at\", 'user ' || user_id AS actor, 'orders' AS table_name, CAST(user_id AS VARCHAR) AS row_pk, event_type AS action, '=' || event_type AS field, NULL::VARCHAR AS old_value, props AS new_value FROM events"


@query("a33_audit_csv", f"SELECT CAST(audit_id AS VARCHAR) AS audit_id, strftime(\"at\", '%Y-%m-%dT%H:%M:%S+00:00') AS \"at\", actor, table_name, row_pk, action, '''' || field AS field, '' AS old_value, trim(regexp_replace(new_value, '\\s+', ' ', 'g')) AS new_value FROM ({AUDIT}) WHERE \"at\" >= TIMESTAMP '2024-01-03' AND \"at\" < TIMESTAMP '2024-01-06'")
def a33(s, d):
    e = fx.table(s, d, "events")
    entries = e.select(F.col("event_id").alias("audit_id"), F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("actor"), F.lit("orders").alias("table_name"), F.col("user_id").alias("row_pk"), F.col("event_type").alias("action"), F.concat(F.lit("="), F.col("event_type")).alias("field"), F.lit(None).cast("string").alias("old_value"), F.col("props").alias("new_value"))
    return exports.audit_rows(entries, F.lit("2024-01-03").cast("date"), F.lit("2024-01-05").cast("date"))


def written(s, df, order, header, charset, drop=()):
    """df written by tasks as ordered parts, committed, and read back."""
    from cairnbook.sources import sink
    from cairnbook.sources.tables import shared_folder

    path = f"{shared_folder(s)}/export-{uuid.uuid4().hex}"
    sink.write_parts(df, path, order, header, charset, drop)
    return sink.read_parts(s, path, [c for c in df.columns if c not in drop])


@query("a31_written_journal", SQL["a31_journal_33_all_columns"])
def a31c(s, d):
    return written(s, exports.journal_33(records(s, d)), [F.col("伝票番号").cast("long")], True, "utf-8")


YAYOI = {0: "'2000'", 3: "strftime(transaction_date, '%Y/%m/%d')", 4: ACCOUNT, 7: TAX, 8: "CAST(CAST(yen AS BIGINT) AS VARCHAR)", 9: "coalesce(CAST(CAST(coalesce(t8, t10) AS BIGINT) AS VARCHAR), '')", 10: "'未払金'", 13: "'対象外'", 14: "CAST(CAST(yen AS BIGINT) AS VARCHAR)", 16: "substr(counterparty || ' [record:' || id || ']', 1, 30)", 19: "'0'", 22: "'0'", 23: "'0'", 24: "'no'", 25: "substr(counterparty, 1, 15)"}


@query("a32_written_shift_jis", LEDGER + " SELECT " + ", ".join(f"""{YAYOI.get(i, "''")} AS c{i + 1:02d}""" for i in range(27)) + " FROM r")
def a32c(s, d):
    return written(s, exports.journal_27(records(s, d)), ["c04", "c17"], False, "shift_jis")


@query("a33_written_audit", SQL["a33_audit_csv"])
def a33b(s, d):
    return written(s, a33(s, d), [F.col("audit_id").cast("long")], True, "utf-8")


TABLES = {"customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]), "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]), "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_size"])}


def _inventory_sql(name, key, columns):
    text = " || '|' || ".join(f"'=' || coalesce(CAST({c} AS VARCHAR), 'null')" for c in columns)
    return f"SELECT '{name}' AS tbl, (SELECT count(*) FROM {name}) AS n, ({digest_sql(name, key, f'CAST({key} AS VARCHAR)')}) AS identity_digest, ({digest_sql(name, key, text)}) AS content_digest"


@query("a34_inventory", " UNION ALL ".join(_inventory_sql(t, *spec) for t, spec in TABLES.items()))
def a34(s, d):
    parts = [exports.inventory(fx.table(s, d, t), t, key, columns) for t, (key, columns) in TABLES.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("e18_ordered_digest", digest_sql("(SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem)", "l_orderkey, l_linenumber, l_partkey", "l_orderkey || ':' || l_linenumber", ["l_suppkey"]))
def e18(s, d):
    rows = fx.table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").distinct()
    return exports.ordered_digest(rows, ["l_orderkey", "l_linenumber", "l_partkey"], F.concat_ws(":", "l_orderkey", "l_linenumber"), "l_suppkey")


@query("a35_scale_table", "SELECT CAST(r AS INTEGER) AS row_number, 'synthetic-r' || lpad(CAST(r AS VARCHAR), 4, '0') || '-c01' AS synthetic_field_01, 'synthetic-r' || lpad(CAST(r AS VARCHAR), 4, '0') || '-c13' AS synthetic_field_13 FROM range(1, 1201) t(r)")
def a35(s, d):
    cells = [F.format_string(f"synthetic-r%04d-c{c:02d}", F.col("id").cast("int")).alias(f"synthetic_field_{c:02d}") for c in range(1, 14)]
    return s.range(1, 1201).select(F.col("id").cast("int").alias("row_number"), *cells).select("row_number", "synthetic_field_01", "synthetic_field_13")
