"""Chains against walks along single links."""

import random

import pytest
from pyspark.sql import functions as F

from cairnbook.operators import chains as ch


def walk(rows):
    parent = {k: p if p in {x for x, _, _ in rows} else None for k, p, _ in rows}
    order = {k: (o, k) for k, _, o in rows}
    after = {}
    for k, p in parent.items():
        if p is not None and (p not in after or order[k] > order[after[p]]):
            after[p] = k
    out = set()
    for k in parent:
        def end(table, k=k):
            seen, n = {k}, 0
            while table.get(k) is not None:
                k, n = table[k], n + 1
                if k in seen:
                    return None, None
                seen.add(k)
            return k, n

        (root, depth), (leaf, length) = end(parent), end(after)
        out.add((k, root, leaf, depth, length, root is None))
    return out


def some(kind):
    rng = random.Random(8)
    if kind == "line":
        return [(i, i - 1 if i else None, i) for i in range(300)]
    if kind == "star":
        return [(i, 0 if i else None, i % 7) for i in range(200)]
    if kind == "circles":
        return [(i, (i + 1) % 5, 0) for i in range(5)] + [(10, 3, 0), (11, 10, 1), (20, 20, 0), (21, 20, 5), (30, 999, 0), (31, 30, 0)]
    return [(i, rng.choice([None, *range(60)]), rng.randint(0, 3)) for i in range(60)] if kind == "random" else []


@pytest.mark.parametrize("kind", ["line", "star", "circles", "random", "none"])
def test_chains_against_walks(spark, kind):
    rows = some(kind)
    df = spark.createDataFrame(rows, "id long, parent long, at int")
    assert {tuple(r) for r in ch.chains(df, "id", "parent", F.col("at")).collect()} == walk(rows)


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    calls = []
    kept = ch.stored
    monkeypatch.setattr(ch, "stored", lambda df, name: calls.append(name) or kept(df, name))
    ch.followed(spark.range(1000).select(F.col("id").alias("key"), F.when(F.col("id") > 0, F.col("id") - 1).alias("to"))).count()
    assert len(calls) <= 12


def test_resolved_errors_are_none(spark):
    rows = [(1, None, "error"), (2, 1, "done"), (3, None, "error"), (4, 3, "error"), (5, None, "done")]
    df = spark.createDataFrame(rows, "id long, parent long, status string")
    got = ch.current_errors(df, ch.chains(df, "id", "parent", F.col("id")), "id", F.col("status") == "error").collect()
    assert [tuple(r) for r in got] == [(3, 4, 2)]
