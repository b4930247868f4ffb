"""Queries of whole retry chains over events: in every thousand of them chains of another length, and in every fifth circles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnbook.operators import chains as ch
from cairnbook.plans.registry import query
from cairnbook.sources import fixtures as fx

LINKS = """b AS (SELECT event_id, event_type, event_id // 1000 AS block, event_id % 1000 AS i, max(event_id % 1000) OVER (PARTITION BY event_id // 1000) AS last FROM events),
links AS (SELECT event_id, event_type, CASE WHEN i >= step THEN event_id - step WHEN block % 5 = 4 THEN block * 1000 + last - (last - i) % step END AS parent FROM (SELECT *, CASE WHEN block % 11 = 10 THEN 1001 ELSE 1 + block % 10 END AS step FROM b)),
r(event_id, root, depth) AS (SELECT event_id, event_id, CAST(0 AS BIGINT) FROM links WHERE parent IS NULL UNION ALL SELECT l.event_id, r.root, r.depth + 1 FROM r JOIN links l ON l.parent = r.event_id),
ends AS (SELECT root, arg_max(event_id, depth) AS leaf, max(depth) AS most FROM r GROUP BY root)"""


def links(s, d):
    """Each event with the one before it in its chain; a circle's first one follows its last."""
    e = fx.table(s, d, "events").select("event_id", "event_type", F.expr("event_id div 1000").alias("block"), (F.col("event_id") % 1000).alias("i"))
    e = e.join(e.groupBy("block").agg(F.max("i").alias("last")), "block")
    e = e.withColumn("step", F.when(F.col("block") % 11 == 10, 1001).otherwise(1 + F.col("block") % 10))
    around = F.col("block") * 1000 + F.col("last") - (F.col("last") - F.col("i")) % F.col("step")
    return e.select("event_id", "event_type", F.when(F.col("i") >= F.col("step"), F.col("event_id") - F.col("step")).when(F.col("block") % 5 == 4, around).alias("parent"))


@query("i20_chain_ends", f"WITH RECURSIVE {LINKS} SELECT event_id, r.root, leaf, depth, most - depth AS length, r.root IS NULL AS circular FROM links LEFT JOIN r USING (event_id) LEFT JOIN ends ON ends.root = r.root")
def i20(s, d):
    """First and last attempt of every job, along chains of up to a thousand links; jobs in circles are reported."""
    return ch.chains(links(s, d), "event_id", "parent", F.col("event_id"))


@query("i22_chain_errors", f"WITH RECURSIVE {LINKS} SELECT ends.root, leaf, most + 1 AS attempts FROM ends JOIN links ON links.event_id = leaf WHERE event_type = 'error'")
def i22(s, d):
    jobs = links(s, d)
    return ch.current_errors(jobs, ch.chains(jobs, "event_id", "parent", F.col("event_id")), "event_id", F.col("event_type") == "error")
