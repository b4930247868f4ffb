"""Rows dealt by ranges of doc_id, each range sorted.

Cases: an empty table has no bounds and no rows; rows without id form the first range, and a range of one id, null too, that is too large for a
task is cut by the hash of its texts.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnbook.llm.shared import shuffle_partitions


def range_cuts(rows: DataFrame, n: int) -> list[int]:
    """At most n - 1 bounds of ranges of about equal numbers of rows, from a quantile sketch of doc_id."""
    return sorted(set(rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []))


def range_of(col: Column, cuts: list[int]) -> Column:
    """Number of bounds not above col; 0 for null.  Two steps of about sqrt(bounds) comparisons."""
    if not cuts:
        return F.lit(0)
    k = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + k] for i in range(0, len(cuts), k)]

    def longs(values):
        return F.array(*[F.lit(int(c)).cast("long") for c in values])

    group = F.size(F.filter(longs([g[0] for g in groups]), lambda c: c <= col))
    inside = F.size(F.filter(F.element_at(F.array(*[longs(g) for g in groups]), F.greatest(group, F.lit(1))), lambda c: c <= col))
    return F.when(col.isNull() | (group == 0), 0).otherwise((group - 1) * k + inside).cast("int")


def parts_of_rows(rows: DataFrame, n: int) -> tuple[Column, bool]:
    """Part (0 to n - 1) of rows (doc_id, text) in ascending order of doc_id, nulls first, and whether texts decide it too.

    Ranges of doc_id hold about equal numbers of rows.  An id that fills several of them, or null if it does, is cut by
    equal steps of the hash of its texts, so that an id with a third of all rows is a third of all parts; rows alike in
    id and text share a part.  Only ids are read for the cuts, and at most n of them reach the driver.

    Cases: an empty table and one whose ids are all null have no cuts between ids.
    """
    total, nulls = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    empty = min(n - 1, round(n * nulls / total)) if total > nulls else n if total else 0
    own = n - empty
    cuts = rows.agg(F.percentile_approx("doc_id", [i / own for i in range(1, own)], 100 * own)).first()[0] or [] if own > 1 else []
    values = sorted(set(cuts))
    times = [cuts.count(v) for v in values]
    last = [empty, *(empty + k for k in accumulate(times))]
    hashed = empty > 1 or max(times, default=1) > 1
    group = range_of(F.col("doc_id"), values)

    def step(parts: Column) -> Column:
        share = F.xxhash64("text").cast("double") / 2.0**64 + 0.5
        return F.least(F.floor(share * parts), parts - 1).cast("int")

    def at_group(numbers: list[int], kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(int(x)).cast(kind) for x in numbers]), group + 1)

    part = at_group(last, "int")
    if max(times, default=1) > 1:
        many = at_group([1, *times], "int")
        back = many - 1 - step(many)
        part = F.when((group > 0) & (F.col("doc_id") == at_group([0, *values], "long")), part - back).otherwise(part)
    null = step(F.lit(empty)) if empty > 1 else F.lit(0)
    return F.when(F.col("doc_id").isNull(), null).otherwise(part).cast("int"), hashed


def in_ranges(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, doc_id, text) in ascending doc_id order over partitions and inside each; nulls first, equal ids by text hash.  One shuffle."""
    n = shuffle_partitions(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part, _ = parts_of_rows(rows, n)
    return rows.select(part.alias("part"), "doc_id", "text").repartitionById(n, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
