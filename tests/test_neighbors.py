"""Filtered neighbours of many queries against comparison with all vectors."""

import numpy as np
import pytest

from cairnbook.operators import neighbors as nb

ROWS = "id long, v array<float>, label int, extra string"


def clustered(seed, n, of=12, width=8, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(of, width))
    which = rng.integers(0, of, n)
    return (centres[which] + spread * rng.normal(size=(n, width))).astype(np.float32), which


def brute(queries, rows, k):
    def unit(v):
        v = np.asarray(v, np.float64)
        return v / np.linalg.norm(v)

    units = np.array([unit(r[1]) for r in rows])
    out = []
    for q, v, admits in queries:
        away = np.round(np.maximum(1 - units @ unit(v), 0), 9)
        some = sorted((away[i], r[0]) for i, r in enumerate(rows) if admits is None or (r[2] is not None and r[2] in admits))[:k]
        out += [(q, i + 1, key, float(a)) for i, (a, key) in enumerate(some)]
    return sorted(out)


def test_equals_all_pairs_in_small_parts(spark, monkeypatch):
    """Parts of four rows, slices of a few queries, copies of one vector for a third of the rows, null labels."""
    monkeypatch.setattr(nb, "PART_BYTES", 256)
    monkeypatch.setattr(nb, "SLICE_BYTES", 8 * 1024 * 3)
    v, which = clustered(1, 240)
    v[:80] = v[0]
    rows = [(i, v[i].tolist(), None if i % 17 == 0 else int(which[i] % 4), "x") for i in range(240)]
    queries = [(i, v[i].tolist(), None if i % 3 == 0 else [int(which[i] % 4), 9] if i % 3 == 1 else []) for i in range(0, 240, 7)]
    lists = nb.build(spark.createDataFrame(rows, ROWS), "id", "v", "label")
    assert lists.table.selectExpr("sum(size(id))").first()[0] == 240 and lists.table.count() > 30
    got = nb.nearest_of_many(spark.createDataFrame(queries, "id long, v array<float>, a array<long>"), "id", "v", lists, 5, "a")
    assert sorted(tuple(r) for r in got.collect()) == brute(queries, rows, 5)


def test_reads_few_vectors_of_clusters(spark):
    v, _ = clustered(2, 3000, of=50, spread=0.02)
    df = spark.createDataFrame([(i, x.tolist(), 0, "") for i, x in enumerate(v)], ROWS)
    lists = nb.build(df, "id", "v")
    asked = df.where("id % 50 = 0")
    read = nb.vectors_read(nb.hits(asked, "id", "v", lists, 8, counted=True)).selectExpr("sum(n_read)", "count(*)").first()
    assert read[1] == 60 and read[0] < 0.25 * 60 * 3000
    want = brute([(i, v[i], None) for i in range(0, 3000, 50)], [(i, x, 0) for i, x in enumerate(v)], 8)
    assert sorted(tuple(r) for r in nb.nearest_of_many(asked, "id", "v", lists, 8).collect()) == want


def test_centres_of_a_sample_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(nb, "SAMPLE", 20)
    v, which = clustered(3, 300)
    rows = [(i, v[i].tolist(), int(which[i]), "") for i in range(300)]
    queries = [(i, v[i].tolist(), None) for i in range(0, 300, 30)]
    lists = nb.build(spark.createDataFrame(rows, ROWS), "id", "v", "label")
    got = nb.nearest_of_many(spark.createDataFrame(queries, "id long, v array<float>, a array<long>"), "id", "v", lists, 3, "a")
    assert sorted(tuple(r) for r in got.collect()) == brute(queries, rows, 3)


def test_vectors_without_direction_and_empty_tables(spark):
    good = [(1, [1.0, 0.0], 1, ""), (1, [1.0, 0.0], 1, ""), (2, [0.0, 2.0], None, ""), (3, [1e38, 1e38], 2, "")]
    bad = [(4, None, 1, ""), (5, [], 1, ""), (6, [0.0, 0.0], 1, ""), (7, [float("nan"), 1.0], 1, ""), (8, [float("inf"), 1.0], 1, ""), (9, [None, 1.0], 1, "")]
    df = spark.createDataFrame(good + bad, ROWS)
    lists = nb.build(df, "id", "v", "label")
    asked = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0])], "id long, v array<float>")
    got = nb.nearest_of_many(asked, "id", "v", lists, 8).orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(1, 1), (1, 1), (1, 3), (1, 2)] and got[3]["distance"] == 1.0
    assert nb.build(df.limit(0), "id", "v", "label") is None and nb.nearest_of_many(asked, "id", "v", None, 8).count() == 0
    assert nb.nearest_of_many(asked.limit(0), "id", "v", lists, 8).count() == 0
    with pytest.raises(ValueError, match="components"):
        nb.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<float>"), "id", "v")
    with pytest.raises(ValueError, match="components"):
        nb.nearest_of_many(spark.createDataFrame([(1, [1.0])], "id long, v array<float>"), "id", "v", lists, 8)
    with pytest.raises(ValueError, match="k is"):
        nb.nearest_of_many(asked, "id", "v", lists, 0)
