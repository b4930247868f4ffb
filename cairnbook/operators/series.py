"""Recurring-bill time series: calendar comparisons, robust anomalies, reminders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.sources.tables import stored

#: Bins of a range of values, and ranges (two for each key) that go to all tasks; beyond that rows and ranges are joined by key.
BINS, SENT_RANGES = 1024, 100_000
TRAILING, LEAST_HISTORY, THRESHOLD, SCALE = 12, 6, "3.5", "0.6745"


def unit_price(amount: Column, consumption: Column) -> Column:
    """Amount per unit; null without consumption."""
    return F.when(consumption.isNotNull() & (consumption != 0), amount / consumption)


def compare_periods(points: DataFrame, months: int | None = None) -> DataFrame:
    """Differences to the month before and the same month a year before, by calendar: a missing month is missing, not skipped.

    points: issuer_id, billing_period (unique per issuer), amount, consumption_value, consumption_unit.  Both other points are
    found by frames over month numbers in one sort of an issuer's points; keeping only the last months happens after the comparison.
    """
    number = F.year("billing_period") * 12 + F.month("billing_period")
    out = points.withColumn("unit_price", unit_price(F.col("amount"), F.col("consumption_value"))).withColumn("month_", number)
    by_month = Window.partitionBy("issuer_id").orderBy("month_")
    point = F.struct("amount", "consumption_value", "consumption_unit", "unit_price")
    for name, back in (("mom", 1), ("yoy", 12)):
        out = out.withColumn(f"{name}_", F.first(point).over(by_month.rangeBetween(-back, -back)))
    for name in ("mom", "yoy"):
        other = F.col(f"{name}_")
        same = F.col("consumption_unit").eqNullSafe(other["consumption_unit"])
        out = (
            out.withColumn(f"{name}_missing", other["amount"].isNull()).withColumn(f"{name}_amount_delta", F.col("amount") - other["amount"])
            .withColumn(f"{name}_consumption_delta", F.when(same, F.col("consumption_value") - other["consumption_value"])).withColumn(f"{name}_unit_price_delta", F.when(same, F.col("unit_price") - other["unit_price"]))
        )
    out = out.drop("mom_", "yoy_", "month_")
    if months is not None:
        last = F.row_number().over(Window.partitionBy("issuer_id").orderBy(F.desc("billing_period")))
        out = out.withColumn("place", last).where(F.col("place") <= months).drop("place")
    return out


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, with value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def middle(ordered: Column) -> Column:
    """Median of a sorted decimal array, without going through floating point."""

    def of(a):
        n = F.size(a)
        half = F.floor(n / 2).cast("int")
        return F.when(n == 0, None).when(n % 2 == 1, F.element_at(a, half + 1)).otherwise((F.element_at(a, F.greatest(half, F.lit(1))) + F.element_at(a, half + 1)) / 2)

    return let(ordered, of)


def exact_median(rows: DataFrame, column: str, name: str, *keys: str) -> DataFrame:
    """Exact median of a numeric column by keys (of all rows without keys), by selection: no key's values are gathered or sorted.

    Each middle rank is looked for among the values of a range, at first all of its key: a histogram of BINS bins, counted where the rows
    are, tells the bin that holds the rank, and the least and greatest value of that bin are the next range, until they are equal.
    A range's ends fall in different bins, so that every round narrows it; of decimals of d digits that takes some d / 3 rounds, of few
    different values one.  Null keys are keys; null values do not count, and a key without others has a null median.
    """
    value, own = F.col("v_"), [f"k{i}_" for i in range(len(keys))]
    rows = rows.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(column).alias("v_"))
    sizes = stored(rows.groupBy(*own).agg(F.count("v_").alias("n"), F.min("v_").alias("lo"), F.max("v_").alias("hi")), "median-sizes")
    ranks = F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))
    found = sizes.where("n > 0").select(*own, F.posexplode(ranks).alias("side", "rank"), "lo", "hi")
    done, open_ = [found.where("lo = hi")], stored(found.where("lo < hi"), "median-ranges")
    while n := open_.count():
        ranges = open_.select(*[F.col(o).alias(f"r{o}") for o in own], "side", "rank", "lo", "hi")
        same = F.lit(True)
        for o in own:
            same = same & F.col(o).eqNullSafe(F.col(f"r{o}"))
        ranges = F.broadcast(ranges) if n <= SENT_RANGES else ranges
        place = (value - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double") * BINS
        inside = rows.join(ranges, same).where(value.between(F.col("lo"), F.col("hi")))
        bins = inside.groupBy(*own, "side", "rank", F.floor(place).alias("bin")).agg(F.count("*").alias("n"), F.min("v_").alias("lo"), F.max("v_").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*own, "side").orderBy("bin"))
        held = bins.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        held = stored(held.select(*own, "side", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi"), "median-ranges")
        done.append(held.where("lo = hi"))
        open_ = held.where("lo < hi")
    middles = done[0]
    for more in done[1:]:
        middles = middles.unionByName(more)
    middles = middles.groupBy(*own).agg(F.min("lo").alias("a_"), F.max("lo").alias("b_"), F.lit(True).alias("there"))
    # keys of null values alone have no middle
    rest = sizes.where("n = 0").select(*own, *[F.lit(None).cast(sizes.schema["lo"].dataType).alias(c) for c in ("a_", "b_")], F.lit(True).alias("there"))
    out = middles.unionByName(rest).select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], ((F.col("a_") + F.col("b_")) / 2).alias(name))
    return out


def spread(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, median and mad (median of the distances to the median), both by selection."""
    middles = stored(exact_median(rows, column, "median", *keys), "medians")
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(middles[k])
    apart = rows.join(middles, same).select(*[rows[k].alias(k) for k in keys], F.abs(rows[column] - middles["median"]).alias("apart"))
    mads = exact_median(apart, "apart", "mad", *keys)
    both = F.lit(True)
    for k in keys:
        both = both & middles[k].eqNullSafe(mads[k])
    return middles.join(mads, both).select(*[middles[k].alias(k) for k in keys], "median", "mad")


METRICS = (("consumption", "consumption_value"), ("unit_price", "unit_price"), ("amount", "amount"))
KIND = "decimal(28,10)"


def trailing(points: DataFrame, window: int = TRAILING) -> DataFrame:
    """points with the sorted values of up to window points before each, of every metric: one frame, each array sorted once."""
    w = Window.partitionBy("issuer_id").orderBy("billing_period").rowsBetween(-window, -1)
    rows = points.withColumn("unit_price", unit_price(F.col("amount"), F.col("consumption_value")))
    rows = rows.withColumn("past_", F.collect_list(F.struct(*[F.when(F.col("consumption_unit").isNotNull() | F.lit(n == "amount"), F.col(c).cast(KIND)).alias(n) for n, c in METRICS])).over(w))
    return rows.select("*", *[F.sort_array(F.filter(F.col(f"past_.{n}"), lambda x: x.isNotNull())).alias(f"{n}_past") for n, _ in METRICS]).drop("past_")


def anomalies(points: DataFrame, window: int = TRAILING, least: int = LEAST_HISTORY, threshold: str = THRESHOLD) -> DataFrame:
    """Robust-z flags against the trailing window, current point excluded: consumption before unit price before amount.

    A point with MAD 0 is flagged if it differs at all (its score is null).  Points without enough history in any metric
    go before anything is computed for them.
    """
    rows = trailing(points, window)

    def judged(name, column):
        value, past = F.col(column).cast(KIND), F.col(f"{name}_past")

        def said(median, mad):
            gap = F.abs(value - median)
            z = F.when(mad > 0, F.lit(float(SCALE)) * gap.cast("double") / mad.cast("double"))
            flagged = F.when(mad > 0, z > float(threshold)).otherwise(gap > 0)
            return F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), median.cast("double").alias("median"), mad.cast("double").alias("mad"), z.alias("robust_z"), explanation(name, mad == 0).alias("explanation"), flagged.alias("flagged"))

        return F.when(F.size(past) >= least, let(middle(past).cast(KIND), lambda m: let(middle(F.sort_array(F.transform(past, lambda x: F.abs(x - m).cast(KIND)))).cast(KIND), lambda mad: said(m, mad))))

    # the first flagged metric of a point; a generator computes its array once, whatever is asked of the rows afterwards
    flags = F.filter(F.array(*[judged(n, c) for n, c in METRICS]), lambda x: F.coalesce(x["flagged"], F.lit(False)))
    return rows.select("issuer_id", "billing_period", F.inline(F.slice(flags, 1, 1))).drop("flagged")


def explanation(metric: str, flat: Column) -> Column:
    said = metric.replace("_", " ")
    return F.when(flat, F.lit(f"{said} differs from a history without variation")).otherwise(F.lit(f"{said} is far from the median of the trailing history"))


def reminders(bills: DataFrame, as_of: Column, days_ahead: int) -> DataFrame:
    """Unpaid bills with a due date: overdue before as_of, upcoming up to days_ahead after it, others left out."""
    left = F.datediff("due_date", as_of)
    bucket = F.when(left < 0, "overdue").when(left <= days_ahead, "upcoming")
    return bills.where(F.col("due_date").isNotNull() & (F.col("payment_status") != "paid")).withColumn("days_left", left).withColumn("bucket", bucket).where("bucket is not null")
