"""Staged tables: header names, cell and column types, fingerprints, numeric aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_kind(x: Column) -> Column:
    """blank, boolean, integer, number, date (strict ISO) or string."""
    t = F.trim(x)
    iso = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(t, "yyyy-MM-dd").isNotNull()
    return (
        F.when(x.isNull() | (t == ""), "blank").when(F.lower(t).isin("true", "false"), "boolean").when(t.rlike(r"^[+-]?[0-9]+$"), "integer")
        .when(t.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)$"), "number").when(iso, "date").otherwise("string")
    )


def column_kinds(cells: DataFrame, *by: str) -> DataFrame:
    """Kind of each column from its cells (columns by, kind): the one kind that is not blank, mixed, or blank."""
    kinds = F.array_remove(F.collect_set("kind"), "blank")
    return cells.groupBy(*by).agg(kinds.alias("k")).select(*by, F.when(F.size("k") == 0, "blank").when(F.size("k") == 1, F.element_at("k", 1)).otherwise("mixed").alias("kind"))


def unique_headers(header: Column, joint: str = "__") -> Column:
    """Names of a header array: blank gives column_n, the n-th repeat gets joint and n."""
    named = F.transform(header, lambda h, i: F.when(F.trim(F.coalesce(h, F.lit(""))) == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(F.trim(h)))
    return F.transform(named, lambda h, i: F.when(F.size(F.filter(F.slice(named, 1, i + 1), lambda x: x == h)) > 1, F.concat(h, F.lit(joint), F.size(F.filter(F.slice(named, 1, i + 1), lambda x: x == h)).cast("string"))).otherwise(h))


def numeric_aggregate(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """Sum, average and count of a staged column over cells typed integer or number; six places, half to even."""
    cell = F.col("values")[column]  # read off the map's own entries where the map is made in the same plan
    number = F.when(cell_kind(cell).isin("integer", "number"), F.trim(cell).try_cast("decimal(24,6)"))
    out = rows.select(*by, number.alias("number")).where("number is not null").groupBy(*by).agg(F.sum("number").alias("total"), F.count("*").alias("n"))
    if not by:  # nothing to add up is an error, not a zero
        out = out.select("total", F.when(F.col("n") == 0, F.raise_error(F.lit(f"no numeric cell in column {column}")).cast("long")).otherwise(F.col("n")).alias("n"))
    return out.select(*by, F.bround("total", 6).cast("double").alias("total"), F.round(F.bround((F.col("total") / F.col("n")).cast("decimal(38,10)"), 6).cast("double"), 6).alias("average"), "n")


def staged(tables: DataFrame) -> DataFrame:
    """Rows of tables (document_id, source_location, header, rows): values by unique header, blank flag, fingerprint."""
    names = unique_headers(F.col("header"))
    rows = tables.select("document_id", "source_location", names.alias("names"), F.posexplode("rows").alias("row_index", "cells"))
    padded = F.transform("names", lambda n, i: F.coalesce(F.try_element_at("cells", i + 1), F.lit("")))
    rows = rows.withColumn("padded", padded).withColumn("values", F.map_from_arrays("names", "padded"))
    blank = F.forall("padded", lambda c: F.trim(c) == "")
    return rows.select("document_id", "source_location", "row_index", "values", blank.alias("blank"), F.sha2(F.to_json(F.struct("source_location", "row_index", "padded")), 256).alias("fingerprint"), F.transform("padded", cell_kind).alias("kinds"), "names")


def schema_fingerprint(staged_rows: DataFrame) -> DataFrame:
    """One row per table: ordered headers with their inferred kinds, and a digest of both."""
    cells = staged_rows.select("document_id", "source_location", F.posexplode(F.arrays_zip("names", "kinds")).alias("pos", "c")).select("document_id", "source_location", "pos", F.col("c.names").alias("name"), F.col("c.kinds").alias("kind"))
    kinds = column_kinds(cells, "document_id", "source_location", "pos", "name")
    out = kinds.groupBy("document_id", "source_location").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "kind"))).alias("columns"))
    return out.withColumn("schema_digest", F.sha2(F.to_json("columns"), 256))


def described(staged_rows: DataFrame, most: int = 25, length: int = 1000) -> DataFrame:
    """document_id, source_location, description: up to most headers, and the range of the table's ISO dates."""
    cells = staged_rows.select("document_id", "source_location", "names", F.filter(F.transform(F.map_values("values"), F.trim), lambda x: cell_kind(x) == "date").alias("days"))
    out = cells.groupBy("document_id", "source_location").agg(F.first("names").alias("names"), F.min(F.array_min("days")).alias("a"), F.max(F.array_max("days")).alias("b"))
    head = F.array_join(F.slice("names", 1, most), ", ")
    return out.select("document_id", "source_location", F.substring(F.concat(head, F.coalesce(F.concat(F.lit("; "), F.col("a"), F.lit(" to "), F.col("b")), F.lit(""))), 1, length).alias("description"))
