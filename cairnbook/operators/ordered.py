"""Work in a given order without gathering a table or a key in one task: numbering, digests, replay of requests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairnbook.sources.tables import stored

FAN, LEVELS = 1000, 3


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with 1 .. n by the order in column name.

    Rows are dealt by ranges of the order and numbered inside them; the numbers of rows of earlier ranges (one row for each
    shuffle partition) are added.  The order must tell all rows apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(df.repartitionByRange(n, *order).withColumn("part_", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("part_").agg(F.count("*").alias("size_"))
    before = sizes.withColumn("before_", F.coalesce(F.sum("size_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size_")
    place = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return parts.withColumn("in_part_", place).join(F.broadcast(before), "part_").withColumn(name, (F.col("in_part_") + F.col("before_")).cast("long")).drop("part_", "in_part_", "before_")


def digest_tree(rows: DataFrame, place: str, cells: Column, *keys: str) -> DataFrame:
    """keys and digest: sha256 of the rows' texts in the order of place (1 .. n in each key), by groups of FAN.

    LEVELS levels, and more until every key has one group left.  No rows give no digest.
    """
    level, done = rows.select(*keys, (F.col(place) - 1).alias("at"), cells.alias("d")), 0
    while done < LEVELS or level.where("at > 0").limit(1).count():
        groups = level.groupBy(*keys, F.expr(f"at div {FAN}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "d"))).alias("x"))
        level, done = groups.select(*keys, F.col("up").alias("at"), F.sha2(F.array_join(F.transform("x", lambda r: r["d"]), "|"), 256).alias("d")), done + 1
        if done >= LEVELS:
            level = stored(level, "digests")
    return level.select(*keys, F.col("d").alias("digest"))


def digest_sql(source: str, order: str, cells: str, keys: Sequence[str] = ()) -> str:
    """The same as SQL, for up to FAN**LEVELS rows a key."""
    by = ", ".join(keys)
    over = f"PARTITION BY {by} ORDER BY {order}" if keys else f"ORDER BY {order}"
    out = f"SELECT {by + ', ' if keys else ''}row_number() OVER ({over}) - 1 AS pos, {cells} AS d FROM {source}"
    for _ in range(LEVELS):
        out = f"SELECT {by + ', ' if keys else ''}pos // {FAN} AS pos, sha256(string_agg(d, '|' ORDER BY pos)) AS d FROM ({out}) GROUP BY ALL"
    return f"SELECT {by + ', ' if keys else ''}d AS digest FROM ({out})"


def replay(requests: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable, step: Callable, outcome: str) -> DataFrame:
    """keys, order columns and outcome of every request, each key's requests taken one after the other.

    step(state, request) returns the next state and a tuple of outcome (a schema string); start() gives a key's first
    state.  A key's requests pass through one task in order and are not held, only its state is.
    """
    kept = [*keys, *order]
    out = T.StructType([*[requests.schema[c] for c in kept], *T.StructType.fromDDL(outcome).fields])
    names = [f.name for f in out.fields[len(kept) :]]
    arrow = to_arrow_schema(out)

    def run(batches):
        key, state = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    key, state = own, start()
                state, said = step(state, row)
                rows.append({c: row[c] for c in kept} | dict(zip(names, said, strict=True)))
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return requests.repartition(*keys).sortWithinPartitions(*kept).mapInArrow(run, out)
