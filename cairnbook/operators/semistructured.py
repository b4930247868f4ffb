"""JSON texts as VARIANT values: tables found in trees of any shape, cells, headers, schemas, numbers by key.

A table is a list that is not empty and holds objects only, wherever it stands in a tree; nothing is looked for inside of it.
Trees are opened level by level, all at once, with variant_explode: no path and no schema is given.  VARIANT keeps the fields of an
object by name, so that a header lists the keys in the order of the first row that has them, those of one row by name.

Cases: a text that is not JSON, or null, has no tables (readable tells which); scalars and lists of anything else are no tables; an
empty object is a row without cells; a null field is an empty cell, as is one that a row lacks; nested values are cells of JSON text;
trees deeper than DEPTH raise an error, as they do when files are admitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnbook.sources.tables import stored

DEPTH = 64


def readable(texts: DataFrame, text: str = "json") -> DataFrame:
    """texts with whether each is JSON."""
    return texts.withColumn("readable", F.try_parse_json(text).isNotNull())


def is_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_table(v: Column) -> Column:
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce((F.size(items) > 0) & F.forall(items, lambda x: x.isNotNull() & is_object(x)), F.lit(False))


def exploded(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """A row for each field or item of a VARIANT column: prefix_pos, prefix_key (null in lists), prefix_value."""
    parts = rows.sparkSession.tvf.variant_explode(F.col(column).outer()).toDF(*[f"{prefix}_{c}" for c in ("pos", "key", "value")])
    return rows.lateralJoin(parts)


def tables(texts: DataFrame, key: str, text: str = "json") -> DataFrame:
    """key, path and value (VARIANT) of every table; path: root, then names of fields and numbers of items from 1, by slashes."""
    level = texts.select(F.col(key), F.lit("root").alias("path"), F.try_parse_json(text).alias("value")).where("value is not null")
    found = []
    for _ in range(DEPTH):
        # each level is written once and read twice; nothing is shuffled
        level = stored(level.withColumn("table", is_table(F.col("value"))), "json-level")
        found.append(level.where("table").drop("table"))
        open_ = level.where(~F.col("table") & (is_object(F.col("value")) | is_list(F.col("value"))))
        if not open_.limit(1).count():
            break
        step = F.coalesce(F.col("in_key"), (F.col("in_pos") + 1).cast("string"))
        level = exploded(open_, "value", "in").select(key, F.concat_ws("/", "path", step).alias("path"), F.col("in_value").alias("value")).where("value is not null")
    else:
        raise ValueError(f"a tree is deeper than {DEPTH} levels")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cell_text(v: Column) -> Column:
    """A scalar as text, a nested value as JSON, null as an empty text."""
    return F.when(v.isNull() | F.is_variant_null(v), "").when(is_object(v) | is_list(v), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def cells(found: DataFrame, key: str) -> DataFrame:
    """key, path, row_index (from 0), column, text of every field of every row of the tables."""
    rows = exploded(found, "value", "row").select(key, "path", F.col("row_pos").alias("row_index"), F.col("row_value").alias("fields"))
    return exploded(rows, "fields", "cell").select(key, "path", "row_index", F.col("cell_key").alias("column"), cell_text(F.col("cell_value")).alias("text"))


def headers(found: DataFrame, key: str) -> DataFrame:
    """key, path, header (keys in the order in which rows first have them) and n_rows of the tables."""
    first = cells(found, key).groupBy(key, "path", "column").agg(F.min("row_index").alias("row_index"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("row_index", "column"))), lambda x: x["column"])
    named = first.groupBy(key, "path").agg(names.alias("header"))
    sizes = found.select(key, "path", F.size(F.try_variant_get("value", "$", "array<variant>")).alias("n_rows"))
    return sizes.join(named, [key, "path"], "left").select(key, "path", F.coalesce("header", F.array().cast("array<string>")).alias("header"), "n_rows")


def schemas(texts: DataFrame, text: str, *by: str) -> DataFrame:
    """by and the schema that all readable texts of a group have in common."""
    return texts.groupBy(*by).agg(F.schema_of_variant_agg(F.try_parse_json(text)).alias("schema"))


def numbers(texts: DataFrame, text: str, *by: str) -> DataFrame:
    """by, column, total, average and n of the numbers that the objects hold, whatever their fields."""
    fields = exploded(texts.select(*by, F.try_parse_json(text).alias("value")).where(is_object(F.col("value"))), "value", "in")
    kind = F.schema_of_variant("in_value")
    number = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get("in_value", "$", "decimal(38,6)"))
    out = fields.select(*by, F.col("in_key").alias("column"), number.alias("number")).where("number is not null").groupBy(*by, "column").agg(F.sum("number").alias("total"), F.count("*").alias("n"))
    return out.select(*by, "column", F.col("total").cast("double").alias("total"), F.round((F.col("total") / F.col("n")).cast("double"), 6).alias("average"), "n")


def confidences(texts: DataFrame, key: str, text: str = "json", name: str = "confidence") -> DataFrame:
    """key, path and number of every object that has a value and a confidence, wherever it stands; path: fields by dots, items as [i].

    Nothing is looked for inside of such an object.  A null confidence gives no row, nor does one that is no number.
    """
    level = texts.select(F.col(key), F.lit("").alias("path"), F.try_parse_json(text).alias("node")).where("node is not null")
    found = []
    for _ in range(DEPTH):
        fields = F.try_variant_get("node", "$", "map<string,variant>")
        leaf = F.coalesce(F.map_contains_key(fields, "value") & F.map_contains_key(fields, name), F.lit(False))
        level = stored(level.withColumn("leaf", leaf), "json-level")
        found.append(level.where("leaf").select(key, "path", F.try_variant_get("node", f"$.{name}", "double").alias(name)).where(F.col(name).isNotNull()))
        open_ = level.where(~F.col("leaf") & (is_object(F.col("node")) | is_list(F.col("node"))))
        if not open_.limit(1).count():
            break
        step = F.when(F.col("in_key").isNull(), F.concat("path", F.lit("["), F.col("in_pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("in_key")).otherwise(F.concat_ws(".", "path", "in_key"))
        level = exploded(open_, "node", "in").select(key, step.alias("path"), F.col("in_value").alias("node")).where("node is not null")
    else:
        raise ValueError(f"a tree is deeper than {DEPTH} levels")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
