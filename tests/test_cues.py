"""Cues in texts against plain searches."""

import random

import pytest

from cairnbook.operators import cues as ac


@pytest.mark.parametrize("block", [1 << 22, 9, 1])
def test_cues_against_plain_searches(spark, monkeypatch, block):
    monkeypatch.setattr(ac, "BLOCK", block)
    rng = random.Random(2)
    texts = ["", None, "aaaa", "日本 aab", "b" * 5000 + "ab"] + ["".join(rng.choices("ab 日", k=rng.randint(0, 30))) for _ in range(40)]
    table = [(1, "a"), (1, "aa"), (2, "aa"), (2, "ab"), (3, "日"), (3, "b 日"), (4, "nowhere"), (5, ""), (5, None), (6, "bab")]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    given = spark.createDataFrame(table, "class int, cue string")
    want = {(i, c): (t.index(c) + 1, sum(t.startswith(c, k) for k in range(len(t)))) for i, t in enumerate(texts) if t for c in {c for _, c in table if c} if c in t}
    hits = ac.found(df, "id", "text", given)
    assert {(r["id"], r["cue"]): (r["first"], r["times"]) for r in hits.collect()} == want
    by = {}
    for k, c in {(k, c) for k, c in table if c}:
        for i in range(len(texts)):
            if (i, c) in want:
                by.setdefault(i, {}).setdefault(k, set()).add(c)
    scored = ac.scores(hits, "id", given)
    assert {(r["id"], r["class"]): (r["hits"], r["first"]) for r in scored.collect()} == {(i, k): (len(c), min(want[i, x][0] for x in c)) for i, ks in by.items() for k, c in ks.items()}
    clear = {}
    for i, ks in by.items():
        most = max(map(len, ks.values()))
        best = [k for k, c in ks.items() if len(c) == most]
        if len(best) == 1:
            clear[i] = (best[0], most)
    assert {r["id"]: (r["class"], r["hits"]) for r in ac.winners(scored, "id").collect()} == clear


def test_no_cues_and_no_texts(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    given = spark.createDataFrame([(1, "a")], "class int, cue string")
    assert ac.found(df, "id", "text", given.limit(0)).count() == 0 and ac.found(df.limit(0), "id", "text", given).count() == 0
