"""Classes of texts by a table of cues, found by an Aho-Corasick automaton.

All cues of a block are one automaton, built once in a task; a text is read once, however many cues there are.  Cues go
to the tasks in blocks of at most BLOCK characters (one longer cue excepted), and every block reads all texts once.

Cases: a null text has no hits; empty and null cues are none; a cue of several classes counts for each; a cue that ends
inside another one, or overlaps it, is found too; texts are read whole and compared as they are (lower both sides before, if wanted).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.sources.tables import stored

BLOCK = 1 << 22


def blocks(cues: DataFrame) -> Iterator[list[str]]:
    """The different cues, at most BLOCK characters at a time; read a partition at a time."""
    held, size = [], 0
    for row in cues.where("cue <> ''").select("cue").distinct().toLocalIterator():
        if held and size + len(row["cue"]) > BLOCK:
            yield held
            held, size = [], 0
        held.append(row["cue"])
        size += len(row["cue"])
    if held:
        yield held


def automaton(cues: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, cue in enumerate(cues):
        out.add_word(cue, i)
    out.make_automaton()
    return out


def found(texts: DataFrame, key: str, text: str, cues: DataFrame) -> DataFrame:
    """key, cue, first (place of its first character, from 1) and times (overlapping ones too) of every cue in every text."""
    spark = texts.sparkSession
    rows = texts.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")
    out = []
    for block in blocks(cues):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            own = sent.value
            tree = automaton(own)
            for batch in batches:
                at, which, first, times = [], [], [], []
                for i, value in enumerate(batch.column("text")):
                    hits: dict[int, list[int]] = {}
                    for end, cue in tree.iter(value.as_py()):
                        hits.setdefault(cue, []).append(end)
                    at += [i] * len(hits)
                    which += [own[c] for c in hits]
                    first += [ends[0] - len(own[c]) + 2 for c, ends in hits.items()]
                    times += [len(ends) for ends in hits.values()]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(which, pa.string()), pa.array(first, pa.int64()), pa.array(times, pa.int64())], ["key", "cue", "first", "times"])

        out.append(stored(rows.mapInArrow(run, "key long, cue string, first long, times long"), "cue-hits"))
        sent.destroy()
    if not out:
        return spark.createDataFrame([], f"{key} long, cue string, first long, times long")
    hits = out[0]
    for more in out[1:]:
        hits = hits.unionByName(more)
    return hits.withColumnRenamed("key", key)


def scores(hits: DataFrame, key: str, cues: DataFrame) -> DataFrame:
    """key, class, hits (different cues), first (the earliest place) and cue (found there, the longest one) of every class with a cue in a text."""
    of = cues.where("cue <> ''").select("class", "cue").distinct()
    best = F.min_by("cue", F.struct("first", -F.length("cue"), "cue"))
    return hits.join(of, "cue").groupBy(key, "class").agg(F.count("*").alias("hits"), F.min("first").alias("first"), best.alias("cue"))


def winners(scored: DataFrame, key: str) -> DataFrame:
    """The class of each text that has more hits than every other; texts whose best classes tie are left out."""
    place = Window.partitionBy(key).orderBy(F.desc("hits"), "class")
    top = scored.withColumn("place", F.row_number().over(place)).where("place <= 2")
    best = top.groupBy(key).agg(F.max_by(F.struct("class", "hits"), -F.col("place")).alias("r"), F.count_if(F.col("place") == 2).alias("more"), F.min("hits").alias("least"))
    return best.where((F.col("more") == 0) | (F.col("least") < F.col("r.hits"))).select(key, "r.class", "r.hits")
