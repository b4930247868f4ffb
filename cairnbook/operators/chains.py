"""Whole chains of retries by pointer doubling: from every job to its first and its last attempt.

Each row points to another row of its chain; in a round a pointer becomes its target's pointer, so that it reaches twice as far,
and a chain of n links takes log2(n) rounds of one join, not n.  Rows that have arrived take no further part.  A pointer that has not
arrived when it has passed as many links as there are rows runs in a circle.

Cases: a parent that is not in the table is none; a row that is its own parent is a circle of one; of several successors the newest
(by order, then key) is the chain's next; an empty table gives no rows; keys must be unique and not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnbook.sources.tables import stored


def followed(links: DataFrame) -> DataFrame:
    """key, end, steps of (key, to): the row without a pointer that a key's pointers lead to, and how many they are; null end in or before a circle."""
    known = links.select(F.col("key").alias("known"))
    rows = links.join(known, F.col("to") == F.col("known"), "left").select("key", F.col("known").alias("to"))
    state = stored(rows.select("key", F.coalesce("to", "key").alias("at"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("to").isNull().alias("there")), "chain")
    n, reach = state.count(), 1
    while reach <= n and state.where("not there").limit(1).count():
        ahead = state.select(F.col("key").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("there").alias("there2"))
        moved = state.where("not there").join(ahead, "at").select("key", F.col("at2").alias("at"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("there2").alias("there"))
        state, reach = stored(state.where("there").unionByName(moved), "chain"), 2 * reach
    return state.select("key", F.when(F.col("there"), F.col("at")).alias("end"), F.when(F.col("there"), F.col("steps")).alias("steps"))


def chains(jobs: DataFrame, key: str, parent: str, order: Column) -> DataFrame:
    """key, root, leaf, depth (links from the root), length (links of the chain from here on), circular."""
    links = stored(jobs.select(F.col(key).alias("key"), F.col(parent).alias("to"), order.alias("order")), "links")
    up = followed(links.select("key", "to"))
    after = links.where("to is not null").groupBy(F.col("to").alias("key")).agg(F.max_by("key", F.struct("order", "key")).alias("to"))
    down = followed(links.select("key").join(after, "key", "left"))
    both = up.select("key", F.col("end").alias("root"), F.col("steps").alias("depth")).join(down.select("key", F.col("end").alias("leaf"), F.col("steps").alias("length")), "key")
    return both.select(F.col("key").alias(key), "root", "leaf", "depth", "length", F.col("root").isNull().alias("circular"))


def current_errors(jobs: DataFrame, ends: DataFrame, key: str, failed: Column) -> DataFrame:
    """root, leaf and attempts of every chain whose last attempt failed: an error that a later attempt resolved is none."""
    heads = ends.where((F.col(key) == F.col("root")) & F.col("leaf").isNotNull()).select("root", "leaf", (F.col("length") + 1).alias("attempts"))
    bad = jobs.where(failed).select(F.col(key).alias("leaf"))
    return heads.join(bad, "leaf").select("root", "leaf", "attempts")
