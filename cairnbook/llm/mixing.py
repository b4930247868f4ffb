"""Mixing sources to target weights by Pareto order sampling (operator 5), DataFrame functions only.

A document's size is its number of words.  Sources, by code point with null last, weigh 1, 2, 3, 1, 2, 3, ...
and share the sum of all sizes; a target stops at REPEAT times its source's size and the excess goes to
the others by weight (water filling, solved in one ordered pass over one row per source).

A source of S words and a target of t words takes floor(t / S) whole copies of every document for certain.
The rest, r words, is sampled: document i has the inclusion probability p_i = f + d * z_i, where f = r / S,
z_i leans to longer documents and is zero on average over words, so that sum(p_i * size_i) = r.  Its rank key
is odds(u_i) / odds(p_i) with a fixed random u_i of its id: Pareto order sampling.  Documents enter in
order of the key until r words are taken; the one at the limit gives its first words only.  The limit is
found by cumulating sizes over 1,024 bins of the key, then over 1,024 bins inside one bin, then over the
rows of that last bin, so that no task ever orders all rows of a source.

Tables of one row per source are sent to all tasks if they have at most SENT rows, so that no source's rows gather;
beyond that they are joined by the source.

Cases: a null or empty text has size 0 and is taken 0 times; a null source is a source; a null id
draws by its text; rows with equal keys go by id and size; no document exceeds REPEAT copies; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnbook.llm.shared import documents, stored

REPEAT, LEAN, SEED = 3, 512, "mix-1"
BINS, SENT = 1 << 10, 20_000
WORD = r"[^\x20\x09-\x0D]+"


def sized(df: DataFrame, id_col: str, source_col: str, text_col: str, *keep: str) -> DataFrame:
    """doc_id, source, size and the fixed random number of each row: of its id, or without one of its text."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.col(id_col).cast("long").cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), name.alias("name_"), *keep)
    digest = F.sha2(F.concat_ws("|", F.lit(SEED), F.col("name_"), F.col("size").cast("string")), 256)
    return rows.withColumn("u", (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)).drop("name_")


def targets(rows: DataFrame, repeat: int = REPEAT) -> DataFrame:
    """One row for each source: source_size, target, and how its words are taken."""
    lean = F.expr(f"(1000 * size) div (size + {LEAN})")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * lean).alias("leaned"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("source_size") * repeat / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (
        sums.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum(F.col("source_size") * repeat).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("fill", (F.col("total") - F.col("full")) / F.col("left"))
        .withColumn("fits", F.col("fill") * F.col("weight") <= F.col("source_size") * repeat)
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") * repeat / F.col("weight"), F.col("source").isNull(), "source", "fill"))).over(everything)["fill"])
    )
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("source_size") * float(repeat)), F.col("source_size") * float(repeat))
    out = level.select("source", "source_size", "leaned", target.alias("target")).withColumn("want", F.round("target").cast("long"))
    whole = F.when(F.col("source_size") > 0, F.expr("want div source_size")).otherwise(F.lit(0))
    return out.withColumn("whole", whole).withColumn("rest", F.col("want") - F.col("whole") * F.col("source_size"))


def _sent(by_source: DataFrame) -> DataFrame:
    """A table of one row per source, for a join: sent to all tasks where its size allows."""
    return F.broadcast(by_source) if by_source.limit(SENT + 1).count() <= SENT else by_source


def _with_key(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan and the Pareto key, scaled to 0 .. 1, as key and bin."""
    both = rows.join(_sent(plan.withColumnRenamed("source", "source_")), F.col("source").eqNullSafe(F.col("source_")), "inner").drop("source_")
    f = F.col("rest") / F.col("source_size")
    z = (F.expr(f"(1000 * size) div (size + {LEAN})") - F.col("leaned") / F.col("source_size")) / 1000.0
    p = f + z * F.least(f, 1.0 - f) * 0.5
    odds = F.col("u") / (1.0 - F.col("u")) * ((1.0 - p) / p)
    key = F.when((F.col("rest") > 0) & (F.col("size") > 0), odds / (1.0 + odds)).otherwise(1.0)
    return both.withColumn("key", key).withColumn("bin", F.least(F.floor(F.col("key") * float(BINS * BINS)), F.lit(BINS * BINS - 1)))


def _crossing(sums: DataFrame, by: str, keep: list[str]) -> DataFrame:
    """The bin of each source in which its cumulated size passes rest, and the size before it."""
    w = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("run", F.sum("s").over(w) + F.col("before"))
    return run.where((F.col("run") > F.col("rest")) & (F.col("run") - F.col("s") <= F.col("rest"))).select("source", *keep, F.col(by).alias(by + "_cut"), (F.col("run") - F.col("s")).alias("before"))


def mixed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of sized() with source_size, target, whole and extra (words taken besides whole copies)."""
    keyed = _with_key(rows, plan)
    coarse = keyed.where("rest > 0").withColumn("hi", F.expr(f"bin div {BINS}")).groupBy("source", "hi", "rest").agg(F.sum("size").alias("s"))
    first = stored(_crossing(coarse.withColumn("before", F.lit(0)), "hi", ["rest"]).select(F.col("source").alias("source_"), F.col("rest").alias("rest_"), "hi_cut", "before"), "mix-coarse")
    inside = keyed.select("source", "size", "bin").join(_sent(first), F.col("source").eqNullSafe(F.col("source_")) & (F.expr(f"bin div {BINS}") == F.col("hi_cut")))
    fine = inside.groupBy("source", F.col("rest_").alias("rest"), "before", "bin").agg(F.sum("size").alias("s"))
    cut = _crossing(fine, "bin", []).select(F.col("source").alias("source_"), "bin_cut", "before")
    plan_cut = stored(plan.join(cut, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_"), "mix-cuts")
    out = _with_key(rows, plan_cut)
    easy = out.where("bin_cut is null or bin <> bin_cut").withColumn("extra", F.when(F.col("bin") < F.col("bin_cut"), F.col("size")).otherwise(F.lit(0)))
    w = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("size").over(w), F.lit(0)) + F.col("before")
    edge = out.where("bin = bin_cut").withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - ahead)))
    return easy.unionByName(edge)


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, size, source, source_size, target, taken."""
    rows = stored(sized(df, id_col, source_col, text_col), "mix-sizes")
    plan = stored(targets(rows), "mix-targets")
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long")
    return mixed(rows, plan).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def remix(df: DataFrame) -> DataFrame:
    """Rows of df, with all their columns, as often as the mix takes them.

    That is every whole copy, and the sampled copy where at least half of it is taken.  df needs doc_id, source and text.
    Rows meet their numbers by id, source, size and random number; rows equal in these are taken alike, as the first of them.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_")
    rows = stored(sized(df, "doc_id", "source", "text"), "mix-sizes")
    plan = stored(targets(rows), "mix-targets")
    once_more = ((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size"))).cast("int")
    times = mixed(rows, plan).groupBy("doc_id", "source", "size", "u").agg(F.max(F.col("whole") + once_more).cast("int").alias("times")).where("times > 0")
    times = times.select(F.struct("doc_id", "source", "size", "u").alias("key_"), F.col("times").alias("times_"))
    own = sized(df.select("doc_id", "source", "text", row), "doc_id", "source", "text", "row_").select("row_", F.struct("doc_id", "source", "size", "u").alias("own_"))
    picked = own.join(times, F.col("own_").eqNullSafe(F.col("key_")))
    return picked.select("row_", F.explode(F.sequence(F.lit(1), F.col("times_"))).alias("copy_")).select("row_.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), 'null ' || md5(coalesce(text, ''))) AS name FROM documents),
u AS (
  SELECT *, (CAST('0x' || substr(sha256('{SEED}|' || name || '|' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u,
    (1000 * size) // (size + {LEAN}) AS lean FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * lean) AS BIGINT) AS leaned FROM u GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
f AS (
  SELECT *, (total - coalesce(CAST(sum(source_size * {REPEAT}) OVER (ORDER BY source_size * {REPEAT} / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
    / CAST(sum(weight) OVER (ORDER BY source_size * {REPEAT} / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS fill FROM w),
l AS (SELECT fill FROM f WHERE fill * weight <= source_size * {REPEAT} ORDER BY source_size * {REPEAT} / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, leaned, least((SELECT fill FROM l) * weight, source_size * {REPEAT}.0::DOUBLE) AS target FROM f),
p AS (SELECT *, CAST(round(target) AS BIGINT) AS want, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
k AS (
  SELECT u.doc_id, u.size, u.u, p.*, p.want - p.whole * p.source_size AS rest, u.lean FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source),
q AS (
  SELECT *, rest / source_size + (lean - leaned / source_size) / 1000.0::DOUBLE * least(rest / source_size, 1.0::DOUBLE - rest / source_size) * 0.5::DOUBLE AS pr FROM k),
o AS (SELECT *, u / (1.0::DOUBLE - u) * ((1.0::DOUBLE - pr) / pr) AS odds FROM q),
r AS (
  SELECT *, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN rest > 0 AND size > 0 THEN odds / (1.0::DOUBLE + odds) ELSE 1.0 END, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS ahead FROM o)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM r
"""
