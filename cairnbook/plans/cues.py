"""Queries of texts and a table of cues: all runs of four words of the benchmark's items, each item a class."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnbook.operators import cues as ac
from cairnbook.plans.registry import query
from cairnbook.sources import fixtures as fx

WORDS = r"[^\x20\x09-\x0D]+"
CUES = rf"""w AS (SELECT item_id AS class, regexp_extract_all(text, '{WORDS}') AS w FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT DISTINCT class, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS cue FROM w WHERE len(w) >= 4),
h AS (SELECT doc_id, cue, CAST(instr(text, cue) AS BIGINT) AS first FROM documents, (SELECT DISTINCT cue FROM c) WHERE contains(text, cue)),
s AS (SELECT doc_id, class, count(*) AS hits, min(first) AS first, arg_min(cue, (first, -len(cue), cue)) AS cue FROM h JOIN c USING (cue) GROUP BY doc_id, class)"""


def cues(s, d):
    words = F.regexp_extract_all("text", F.lit(f"({WORDS})"), F.lit(1))
    items = fx.table(s, d, "benchmark").where("text is not null").select(F.col("item_id").alias("class"), words.alias("w")).where("size(w) >= 4")
    return items.select("class", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " "))).alias("cue")).distinct()


def scored(s, d):
    some = cues(s, d)
    return ac.scores(ac.found(fx.table(s, d, "documents"), "doc_id", "text", some), "doc_id", some)


@query("d28_cue_table", f"WITH {CUES} SELECT doc_id, class, hits FROM s")
def d28(s, d):
    """How many cues of every class each document holds, among over a thousand."""
    return scored(s, d).select("doc_id", "class", "hits")


@query("d29_first_cue", f"WITH {CUES} SELECT doc_id, class, first, cue FROM s")
def d29(s, d):
    """Where each class shows itself first in a document, and by which cue."""
    return scored(s, d).select("doc_id", "class", "first", "cue")


@query("e28_cue_winner", f"WITH {CUES}, r AS (SELECT *, max(hits) OVER (PARTITION BY doc_id) AS most FROM s) SELECT doc_id, any_value(class) AS class, any_value(hits) AS hits FROM r WHERE hits = most GROUP BY doc_id HAVING count(*) = 1")
def e28(s, d):
    """The class with the most cues of each document; ties have none."""
    return ac.winners(scored(s, d), "doc_id")
