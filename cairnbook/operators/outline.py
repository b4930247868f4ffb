"""Sections and blocks of marked-up texts as tables: gaps and islands over their lines.

Lines go to rows; a section is the lines between two headings, a block the lines between blank ones (a table, whose lines begin with |
and hold another, ends where its lines end).  Both are numbered by running counts of their beginnings.  A section's heading path is the
path before it, cut to one less than the heading's level, and the heading: a fold over a document's headings alone.

Cases: a null text has no lines; what stands before the first heading has an empty path; sections of blank lines only are left out; all line
ends of str.splitlines are line ends; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
HEADING = r"^(#{1,6})\s+(.*\S)\s*$"
EDGES = r"^\s+|\s+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """document_id, at, line, level (of a heading, else 0), title, section (headings up to here)."""
    parts = F.split(F.col(text_col), LINE_END)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)  # a line end at the end begins no line
    rows = docs.select(F.col(id_col).alias("document_id"), F.posexplode(parts).alias("at", "line"))
    rows = rows.withColumn("level", F.length(F.regexp_extract("line", HEADING, 1))).withColumn("title", F.regexp_extract("line", HEADING, 2))
    upto = Window.partitionBy("document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(upto))


def paths(rows: DataFrame) -> DataFrame:
    """document_id, section, heading_path of every heading."""
    heads = rows.where("level > 0").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("section", "level", "title"))).alias("heads"))
    kind = "array<struct<section:bigint,path:array<string>>>"

    def step(done, head):
        before = F.when(F.size(done) > 0, F.element_at(done, -1)["path"]).otherwise(F.array().cast("array<string>"))
        path = F.concat(F.slice(before, F.lit(1), head["level"] - 1), F.array(head["title"]))
        return F.concat(done, F.array(F.struct(head["section"].alias("section"), path.alias("path"))))

    folded = heads.select("document_id", F.explode(F.aggregate("heads", F.array().cast(kind), step)).alias("h"))
    return folded.select("document_id", "h.section", F.array_join("h.path", " > ").alias("heading_path"))


def sections(rows: DataFrame) -> DataFrame:
    """document_id, section, heading_path, n_lines, text of the sections that hold anything."""
    body = rows.where("level = 0").groupBy("document_id", "section").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"), F.count("*").alias("n_lines"), F.bool_or(stripped(F.col("line")) != "").alias("any"))
    text = F.array_join(F.transform("x", lambda p: p["line"]), "\n")
    return body.where("any").join(paths(rows), ["document_id", "section"], "left").select("document_id", "section", F.coalesce("heading_path", F.lit("")).alias("heading_path"), "n_lines", text.alias("text"))


def blocks(rows: DataFrame) -> DataFrame:
    """document_id, section, block (from 1), is_table, text of the paragraphs and tables."""
    line = stripped(F.col("line"))
    table = line.startswith("|") & (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) > 1)
    own = Window.partitionBy("document_id", "section").orderBy("at")
    marked = rows.where("level = 0").withColumn("blank", line == "").withColumn("is_table", table)
    begins = ~F.col("blank") & (F.coalesce(F.lag("blank").over(own), F.lit(True)) | (F.lag("is_table").over(own) != F.col("is_table")))
    marked = marked.withColumn("begins", begins).withColumn("block", F.sum(F.col("begins").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    made = marked.where("not blank").groupBy("document_id", "section", "block", "is_table").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    return made.select("document_id", "section", "block", "is_table", stripped(F.array_join(F.transform("x", lambda p: p["line"]), "\n")).alias("text"))
