"""Journal and audit exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.functions.text import safe_cell
from cairnbook.operators.ordered import digest_tree, numbered

# The import formats' header, accounts and constants.
JOURNAL_HEADER = (
    "[表題行]", "日付", "伝票番号", "決算整理仕訳", "借方勘定科目", "借方科目コード", "借方補助科目", "借方取引先", "借方取引先コード", "借方部門", "借方品目",
    "借方メモタグ", "借方セグメント1", "借方セグメント2", "借方セグメント3", "借方金額", "借方税区分", "借方税額", "貸方勘定科目", "貸方科目コード", "貸方補助科目", "貸方取引先",
    "貸方取引先コード", "貸方部門", "貸方品目", "貸方メモタグ", "貸方セグメント1", "貸方セグメント2", "貸方セグメント3", "貸方金額", "貸方税区分", "貸方税額", "摘要",
)
ACCOUNTS = {
    "会議費": "会議費", "接待交際費": "接待交際費", "消耗品費": "消耗品費", "旅費交通費": "旅費交通費", "水道光熱費": "水道光熱費", "通信費": "通信費", "福利厚生費": "福利厚生費",
    "新聞図書費": "新聞図書費", "地代家賃": "地代家賃", "租税公課": "租税公課", "雑費": "雑費", "Food": "会議費", "Transportation": "旅費交通費", "Entertainment": "接待交際費",
    "Utilities": "水道光熱費", "Healthcare": "福利厚生費", "Clothing": "消耗品費", "Electronics": "消耗品費", "Household": "消耗品費", "Office": "消耗品費",
}
OTHER_ACCOUNT, PAYABLE, EXEMPT = "雑費", "未払金", "対象外"
AUDIT_HEADER = ("audit_id", "at", "actor", "table_name", "row_pk", "action", "field", "old_value", "new_value")


def account(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ACCOUNTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.trim(category)), F.lit(OTHER_ACCOUNT))


def whole_yen(amount: Column, name: str) -> Column:
    """Text of a whole amount of at least one; an error for any other."""
    good = (amount == F.floor(amount)) & (amount >= 1)
    return F.when(amount.isNull() | good, amount.cast("decimal(18,0)").cast("string")).otherwise(F.raise_error(F.lit(f"{name} must be a whole amount of at least 1")))


def tax_treatment(tax_8: Column, tax_10: Column) -> tuple[Column, Column]:
    """(category, amount) of the one rate present; an error for both."""
    a, b = F.coalesce(tax_8 > 0, F.lit(False)), F.coalesce(tax_10 > 0, F.lit(False))
    category = F.when(a & b, F.raise_error(F.lit("a record with two tax rates must be split"))).when(a, "課対仕入8%").when(b, "課対仕入10%").otherwise(EXEMPT)
    return category, F.when(a, whole_yen(tax_8, "tax")).when(b, whole_yen(tax_10, "tax")).otherwise("")


def summary(tag: str) -> Column:
    return safe_cell(F.concat(F.col("counterparty"), F.lit(f" [{tag}:"), F.col("id").cast("string"), F.lit("]")))


def with_voucher(records: DataFrame) -> DataFrame:
    """records with voucher, 1 .. n by date, then id as text; no task holds more than a range of dates."""
    return numbered(records.withColumn("id_text_", F.col("id").cast("string")), "voucher", "transaction_date", "id_text_").drop("id_text_")


def journal_33(records: DataFrame, tag: str = "record") -> DataFrame:
    """33 columns with header; records: id, transaction_date, total_amount, counterparty, category, tax_8, tax_10."""
    tax, tax_amount = tax_treatment(F.col("tax_8"), F.col("tax_10"))
    amount = whole_yen(F.col("total_amount"), "total")
    cells = {0: F.lit("[明細行]"), 1: F.date_format("transaction_date", "yyyy/MM/dd"), 2: F.col("voucher").cast("string"), 4: account(F.col("category")), 7: safe_cell(F.col("counterparty")), 15: amount, 16: tax, 17: tax_amount, 18: F.lit(PAYABLE), 29: amount, 30: F.lit(EXEMPT), 32: summary(tag)}
    return with_voucher(records).select(*[cells.get(i, F.lit("")).alias(name) for i, name in enumerate(JOURNAL_HEADER)])


def journal_27(records: DataFrame, tag: str = "record") -> DataFrame:
    """27 columns without header, for a Shift_JIS file; texts cut to 30 and 15 characters."""
    tax, tax_amount = tax_treatment(F.col("tax_8"), F.col("tax_10"))
    amount = whole_yen(F.col("total_amount"), "total")
    cells = {0: F.lit("2000"), 3: F.date_format("transaction_date", "yyyy/MM/dd"), 4: account(F.col("category")), 7: tax, 8: amount, 9: tax_amount, 10: F.lit(PAYABLE), 13: F.lit(EXEMPT), 14: amount, 16: F.substring(summary(tag), 1, 30), 19: F.lit("0"), 22: F.lit("0"), 23: F.lit("0"), 24: F.lit("no"), 25: F.substring(safe_cell(F.col("counterparty")), 1, 15)}
    return records.select(*[cells.get(i, F.lit("")).alias(f"c{i + 1:02d}") for i in range(27)], F.col("transaction_date").alias("_date"), F.col("id").cast("string").alias("_id")).orderBy("_date", "_id").drop("_date", "_id")


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """One ordered UTF-8 file with CRLF line ends: what an accounting program imports is one file, of a size that it can read."""
    df.coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").option("emptyValue", "").csv(path, header=header, quote='"', escape='"')


def shift_jis(lines: DataFrame, column: str) -> DataFrame:
    """lines with the column's Shift_JIS bytes; a character outside it is an error."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.BinaryType())
    def run(s):
        return s.map(lambda v: None if v is None else v.encode("shift_jis"))

    return lines.withColumn("bytes", run(F.col(column)))


def audit_rows(entries: DataFrame, date_from: Column, date_to: Column, table: str | None = None) -> DataFrame:
    """Nine text cells of the entries of whole UTC days, inclusive, in order."""
    at = F.col("at")
    rows = entries.where((at >= date_from.cast("timestamp")) & (at < F.date_add(date_to, 1).cast("timestamp")))
    rows = rows if table is None else rows.where(F.col("table_name") == table)
    cells = {c: safe_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in AUDIT_HEADER[2:]}
    return rows.select(F.col("audit_id").cast("string").alias("audit_id"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("at"), *[v.alias(c) for c, v in cells.items()])


def ordered_digest(rows: DataFrame, order: list[str], cells: Column, *keys: str) -> DataFrame:
    """keys and digest: sha256 of each key's rows in order, as a tree of bounded groups.

    Rows are numbered by ranges of keys and order, so that a key of many rows is many ranges; a key's own numbers begin at its first.
    """
    placed = numbered(rows, "all_", *keys, *order)
    firsts = placed.groupBy(*keys).agg(F.min("all_").alias("first_")).select(*[F.col(k).alias(f"of_{k}") for k in keys], "first_")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    placed = placed.join(firsts, same).withColumn("place_", F.col("all_") - F.col("first_") + 1)
    return digest_tree(placed, "place_", cells, *keys)


def inventory(table: DataFrame, name: str, key: str, columns: list[str]) -> DataFrame:
    """One row: table name, number of rows, digest of its ids in order, digest of its contents (columns as text) in order."""
    rows = numbered(table, "place_", key)
    text = F.concat_ws("|", *[F.concat(F.lit("="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns])
    ids, contents = (digest_tree(rows, "place_", cells).select(F.col("digest").alias(n)) for cells, n in ((F.col(key).cast("string"), "identity_digest"), (text, "content_digest")))
    counted = rows.agg(F.count("*").alias("n"))
    # each side is one row
    return counted.join(F.broadcast(ids), F.lit(True), "left").join(F.broadcast(contents), F.lit(True), "left").select(F.lit(name).alias("tbl"), "n", "identity_digest", "content_digest")
