"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.functions.fields import text_key
from cairnbook.functions.text import cosine
from cairnbook.operators.ordered import numbered

TOLERANCE = 0.02


def same_money(a: Column, b: Column, slack: float = 0.5) -> Column:
    return F.abs(a - b) <= slack


def same_field(field: Column, predicted: Column, expected: Column) -> Column:
    """Whether a predicted text is the expected one, by field: money within half a unit, dates by day, registration numbers without hyphens,
    all other fields by NFKC, case and white space; null is like null only."""
    amount = [x.try_cast("decimal(38,6)") for x in (predicted, expected)]
    day = [F.try_to_date(x, "yyyy-MM-dd") for x in (predicted, expected)]
    plain = [F.replace(text_key(x), F.lit(" "), F.lit("")) for x in (predicted, expected)]
    bare = [F.replace(x, F.lit("-"), F.lit("")) for x in plain]
    by_kind = (
        F.when(field.isin("total_amount", "tax_8_amount", "tax_10_amount"), F.coalesce(F.abs(amount[0] - amount[1]) <= 0.5, F.lit(False))).when(F.endswith(field, F.lit("date")), F.coalesce(day[0] == day[1], F.lit(False)))
        .when(field == "registration_number", bare[0] == bare[1]).otherwise(plain[0] == plain[1])
    )
    return F.when(predicted.isNull() | expected.isNull(), predicted.isNull() & expected.isNull()).otherwise(by_kind)


def aligned(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of both sides at equal places of their orders; an error if they are not equally many."""
    if (n := left.count()) != (m := right.count()):
        raise ValueError(f"{n} predictions for {m} labels")
    return numbered(left, "place_", left_order).join(numbered(right, "place_", right_order), "place_").drop("place_")


def field_accuracy(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, accuracy): share of rows whose label column equals the predicted one; one pass."""
    means = rows.agg(*[F.round(F.avg(F.col(a).eqNullSafe(F.col(b)).cast("int")), 6).alias(a) for a, b in fields.items()])
    return means.select(F.explode(F.array(*[F.struct(F.lit(a).alias("field"), F.col(a).alias("accuracy")) for a in fields])).alias("r")).select("r.*")


def ranked(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """q, id, labels x and y, place <= k by cosine.  queries is an evaluation set of a few rows (at most 1,000), sent to all tasks."""
    if queries.limit(1001).count() > 1000:
        raise ValueError("an evaluation set has at most 1,000 queries")
    q = queries.select(F.col("vec_id").alias("q"), F.col("label").alias("x"), F.col("embedding").alias("e"))
    both = candidates.join(F.broadcast(q), F.lit(True)).withColumn("distance", cosine(F.col("embedding"), F.col("e")))
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec_id"))
    return both.select("q", F.col("vec_id").alias("id"), "x", F.col("label").alias("y"), place.alias("place")).where(F.col("place") <= k)


def hit_rate(rows: DataFrame) -> DataFrame:
    return rows.groupBy("q").agg(F.max((F.col("x") == F.col("y")).cast("int")).alias("hit")).agg(F.round(F.avg("hit"), 6).alias("hit_rate"))


def regressions(base: DataFrame, now: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Metrics that fell by more than tolerance."""
    both = base.join(now.withColumnRenamed("value", "now"), "metric")
    return both.where(F.col("value") - F.col("now") > tolerance).select("metric", F.round(F.col("value") - F.col("now"), 6).alias("drop"))


def recovery(rows: DataFrame, engine: str, fields: dict[str, Column], seconds: Column, bytes_: Column) -> DataFrame:
    """engine, the share of rows of which each field was recovered, their mean, seconds a row and peak bytes; one pass.

    A row whose field says neither (null) is not recovered; an engine without rows has no row."""
    shares = [F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in fields.items()]
    out = rows.groupBy(engine).agg(*shares, F.avg(seconds).alias("seconds"), F.max(bytes_).alias("bytes"))
    return out.withColumn("mean", F.round(sum(F.col(n) for n in fields) / len(fields), 4))


def winner(engines: DataFrame, engine: str, limits: dict[str, float], better: str = "mean", cheaper: str = "seconds", *by: str) -> DataFrame:
    """Of the engines within all limits (column -> highest value) the one of the best mean, then of the least cost, then the first by name; one row for each by."""
    fit = engines
    for column, most in limits.items():
        fit = fit.where(F.col(column) <= most)
    first = F.min_by(F.struct(engine, better, cheaper), F.struct(-F.col(better), F.col(cheaper), F.col(engine)))
    return fit.groupBy(*by).agg(first.alias("w")).where("w is not null").select(*by, "w.*")
