"""A table of questions answered in one plan over verified records.

Questions that ask for the same are one (an ask: metric, interval, counterparty, category).  Totals, averages and counts of an interval come
from a cube of running sums by day for each currency and category, and for all categories together: two look-ups by
equal keys for each ask, however many records lie between.  Asks for a counterparty, or for the top ones, meet records summed by
day in the months that their interval touches, so that they are joined by equal keys too.

Cases: an open end of an interval is the end of the records; a question that is no aggregate, or a comparison, has no rows; sums and
averages have a row for each currency with records, counts one row (0 where nothing fits); a null currency is "unspecified"; null categories
and counterparties fit no filter but count without one; ties among top counterparties go by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.operators.intent import AGGREGATION, NARROWING, TOP_K
from cairnbook.sources.tables import stored

SLOTS = ("metric", "date_from", "date_to", "counterparty", "category")
KIND = "decimal(38,2)"


def route_of(text: Column, vote: Column | None = None) -> Column:
    """sql or hybrid for aggregates, else the way that the vote names, else semantic; null for what is empty."""
    named = F.nullif(F.regexp_extract(F.lower(F.coalesce(vote, F.lit(""))), r"\b(sql|semantic|hybrid)\b", 1), F.lit("")) if vote is not None else F.lit(None)
    return F.when(F.trim(text) != "", F.when(text.rlike(AGGREGATION), F.when(text.rlike(NARROWING), "hybrid").otherwise("sql")).otherwise(F.coalesce(named, F.lit("semantic"))))


def daily(records: DataFrame, *by: str) -> DataFrame:
    """Sums and numbers of records by day: by, currency, category, day, amount, n."""
    return records.where("transaction_date is not null").groupBy(*by, F.coalesce("currency", F.lit("unspecified")).alias("currency"), "category", F.col("transaction_date").alias("day")).agg(F.sum(F.col("total_amount").cast(KIND)).alias("amount"), F.count("id").alias("n"))


def cube(days: DataFrame, last: Column) -> DataFrame:
    """slice ("*" for all, "=" and a category), currency, day, amount and n of all days up to and including it, for every day from a slice's first to the last."""
    sliced = days.where("category is not null").withColumn("slice", F.concat(F.lit("="), "category")).unionByName(days.withColumn("slice", F.lit("*")))
    sums = sliced.groupBy("slice", "currency", "day").agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))
    by_day = Window.partitionBy("slice", "currency").orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(by_day), 1), last)
    upto = by_day.rowsBetween(Window.unboundedPreceding, 0)
    running = sums.select("slice", "currency", "day", F.sum("amount").over(upto).alias("amount"), F.sum("n").over(upto).alias("n"), until.alias("until"))
    return running.select("slice", "currency", F.explode(F.sequence("day", "until")).alias("day"), "amount", "n")


def answers(questions: DataFrame, records: DataFrame, k: int = TOP_K) -> DataFrame:
    """question_id, metric, currency, counterparty, amount, record_count.

    questions: question_id and SLOTS (as slots() of a table of questions gives them); records: id, transaction_date, total_amount, currency,
    category, counterparty, all with authority.
    """
    days = stored(daily(records, "counterparty"), "daily")
    low, high = days.agg(F.min("day"), F.max("day")).first()
    low, high = (F.lit(x).cast("date") for x in (low, high))
    asked = questions.where(F.col("metric").isin("sum", "average", "count", "top_counterparties")).select("question_id", *SLOTS).withColumn("ask", F.to_json(F.struct(*SLOTS), {"ignoreNullFields": "false"}))
    asked = stored(asked, "asked")
    asks = asked.select("ask", *SLOTS).distinct().withColumn("since", F.coalesce("date_from", low)).withColumn("until", F.least(F.coalesce("date_to", high), high))
    plain = F.col("counterparty").isNull() & (F.col("metric") != "top_counterparties")

    running = stored(cube(days.groupBy("currency", "category", "day").agg(F.sum("amount").alias("amount"), F.sum("n").alias("n")), high), "cube")
    looked = asks.where(plain & (F.col("since") <= F.col("until"))).select("ask", "metric", F.coalesce(F.concat(F.lit("="), "category"), F.lit("*")).alias("slice"), F.date_sub("since", 1).alias("before"), F.col("until").alias("day"))
    ends = looked.join(running, ["slice", "day"])
    starts = running.select("slice", "currency", F.col("day").alias("before"), F.col("amount").alias("amount_before"), F.col("n").alias("n_before"))
    looked = ends.join(starts, ["slice", "currency", "before"], "left").select("ask", "metric", "currency", F.lit(None).cast("string").alias("counterparty"), (F.col("amount") - F.coalesce("amount_before", F.lit(0))).alias("amount"), (F.col("n") - F.coalesce("n_before", F.lit(0))).alias("n"))

    months = F.explode(F.sequence(F.trunc("since", "month"), F.trunc("until", "month"), F.expr("interval 1 month"))).alias("month")
    rest = asks.where(~plain & (F.col("since") <= F.col("until"))).select("ask", "metric", "counterparty", "category", "since", "until", months)
    lines = days.select(F.trunc("day", "month").alias("month"), "day", "currency", F.col("counterparty").alias("of"), F.col("category").alias("kind"), "amount", "n")
    fits = F.col("day").between(F.col("since"), F.col("until")) & (F.col("category").isNull() | (F.col("category") == F.col("kind")))
    named = rest.where("counterparty is not null").withColumn("of", F.col("counterparty")).join(lines, ["month", "of"]).where(fits)
    every = rest.where("counterparty is null").join(lines, "month").where(fits)
    met = named.select("ask", "metric", "currency", "of", "amount", "n").unionByName(every.select("ask", "metric", "currency", "of", "amount", "n"))
    by_name = F.when(F.col("metric") == "top_counterparties", F.col("of"))
    summed = met.groupBy("ask", "metric", "currency", by_name.alias("counterparty")).agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))

    found = stored(looked.unionByName(summed), "answers").where("n > 0")
    place = F.row_number().over(Window.partitionBy("ask", "currency").orderBy(F.desc("amount"), F.col("counterparty").asc_nulls_last()))
    sums = found.where("metric in ('sum', 'average')").withColumn("value", F.when(F.col("metric") == "sum", F.col("amount").cast("double")).otherwise(F.col("amount").cast("double") / F.col("n")))
    top = found.where("metric = 'top_counterparties'").withColumn("place", place).where(F.col("place") <= k).withColumn("value", F.col("amount").cast("double")).drop("place")
    counts = asks.where("metric = 'count'").select("ask", "metric").join(found.where("metric = 'count'").groupBy("ask").agg(F.sum("n").alias("n")), "ask", "left")
    counts = counts.select("ask", "metric", F.lit(None).cast("string").alias("currency"), F.lit(None).cast("string").alias("counterparty"), F.lit(None).cast("double").alias("value"), F.coalesce("n", F.lit(0)).alias("n"))
    said = reduce(DataFrame.unionByName, [x.select("ask", "metric", "currency", "counterparty", "value", "n") for x in (sums, top, counts)])
    return asked.select("question_id", "ask").join(said, "ask").select("question_id", "metric", "currency", "counterparty", F.col("value").alias("amount"), F.col("n").alias("record_count"))
