"""Joins whose pairs grow as the square of the rows: nothing but the rows themselves is shuffled or stored."""

import datetime as dt
import itertools
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cairnbook.functions.text import edits_within, indel_ratio, indel_ratios, signatures, similarity_of_edits
from cairnbook.operators import dedupe, names
from cairnbook.plans.catalogue import QUERIES


@pytest.mark.parametrize("blocks", [1, 7])
def test_near_hashes_in_blocks(spark, monkeypatch, blocks):
    """Frequent values of a part fill several blocks; pairs are in no shuffle."""
    monkeypatch.setattr(dedupe, "LEAST_BLOCK", 1)
    monkeypatch.setattr(dedupe, "BLOCKS", blocks)
    r = np.random.default_rng(5)
    rows = [int(x) for x in r.integers(-(1 << 63), 1 << 63, 120)]
    rows += [rows[0] ^ 1 << int(a) ^ 1 << int(b) for a, b in r.integers(40, 63, (150, 2))]  # the low 40 bits are one value
    rows = list(dict.fromkeys(rows))
    want = {(a, b): (x ^ y).bit_count() for (a, x), (b, y) in itertools.combinations(enumerate(rows), 2) if ((x ^ y) & (1 << 64) - 1).bit_count() <= 8}
    found = dedupe.near_hashes(spark.createDataFrame(list(enumerate(rows)), "document_id long, phash long"))
    got = [(p["document_id"], p["other_id"], p["distance"]) for p in found.collect()]
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "HashJoin" not in plan


def test_text_hashes_shuffle_no_pairs(spark):
    plan = QUERIES["j15_text_hashes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "HashJoin" not in plan


def test_names_of_other_lengths_bring_no_candidates(spark):
    """Texts of 16 characters are for pairs of 17 and 18: two names of 18 don't meet in them."""
    rows = [(i, f"customer#{i:09}") for i in range(1500)] + [(9000 + i, f"supplier#{i:08}") for i in range(20)]
    seen = Observation()
    found = names.near_names(spark.createDataFrame(rows, "id long, name string"), 90.0, seen).count()
    assert 0 < seen.get["scored"] <= 2 * found


def test_surrogates_and_pads_in_similarities():
    a, b = ["a\0b", "\0", "😀" * 9, "x" * 64, ""], ["ab", "", "é😀é" * 9, "\0" + "x" * 63, "\0"]
    assert indel_ratios(a, b).tolist() == [indel_ratio(x, y) for x, y in zip(a, b, strict=True)]


def test_few_fuzzy_facts_are_scored(spark):
    """Facts of one cell whose names hold other characters are not scored."""
    r = np.random.default_rng(4)
    day = dt.date(2026, 6, 1)
    named = [(i, day + dt.timedelta(int(r.integers(0, 3))), Decimal(5), f"Customer#{r.integers(0, 10**9):09}") for i in range(700)]
    named += [(1000 + i, d, a, n[:-1] + "x") for i, d, a, n in named[:50]]
    facts = spark.createDataFrame(named, "document_id long, transaction_date date, total_amount decimal(18,2), counterparty string")
    for days in (0, 1, 2, 5):
        seen = Observation()
        got = {(r["document_id"], r["other_id"], r["similarity"]) for r in dedupe.business_matches(facts, days=days, seen=seen).collect()}
        near = [(a, b, x, y) for (a, d, _, x), (b, e, _, y) in itertools.combinations(named, 2) if abs((d - e).days) <= days]
        scores = indel_ratios([x.lower() for *_, x, _ in near], [y.lower() for *_, y in near])
        assert got == {(a, b, round(s, 6)) for (a, b, _, _), s in zip(near, scores, strict=True) if s >= 90}
        assert len(got) >= 50 and seen.get["scored"] <= 0.05 * len(near)


def test_signatures_and_edits_bound_the_similarity(spark):
    r = np.random.default_rng(6)
    texts = ["", "a", "ab", "ba", "日本", "日x本", "shop 12", "shop 21", "shop 1", *["".join(map(str, r.integers(0, 10, 9))) for _ in range(20)]]
    two = [(x, y) for x in texts for y in texts]
    want = [indel_ratio(x, y) for x, y in two]
    apart = np.bitwise_count(np.repeat(signatures(texts), len(texts)) ^ np.tile(signatures(texts), len(texts)))
    changes = [(len(x) + len(y)) * (1 - s / 100) for (x, y), s in zip(two, want, strict=True)]
    assert (apart <= np.array(changes) + 1e-9).all()
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate([*two, (None, "a")])], "i int, x string, y string")
    got = {r["i"]: r["s"] for r in rows.select("i", similarity_of_edits(F.col("x"), F.col("y"), F.levenshtein("x", "y")).alias("s")).collect()}
    assert [got[i] for i in range(len(want))] == want and got[len(want)] is None
    plain = F.levenshtein("x", "y")
    for most in (0, 2, 3, 4, 7):
        here = rows.where("x is not null").select(plain.alias("e"), edits_within(F.col("x"), F.col("y"), F.lit(most)).alias("w")).collect()
        assert all(r["w"] == ([r["e"]] if r["e"] <= most else []) for r in here)
