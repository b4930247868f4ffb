"""Folds of requests, numbering, digests, duplicate detection on hand-made rows."""

import datetime as dt
import hashlib
import itertools
import re
import statistics
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cairnbook.functions.text import indel_ratio
from cairnbook.operators import dedupe, exports, lifecycle, names, ordered, review, search, series, staging


def test_numbered_is_the_order(spark):
    rows = [(i * 7919 % 1000, f"v{i % 3}") for i in range(1000)]
    got = ordered.numbered(spark.createDataFrame(rows, "k int, v string").repartition(5), "n", "v", F.desc("k")).collect()
    want = {r: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], -r[0])))}
    assert {(r["k"], r["v"]): r["n"] for r in got} == want
    assert ordered.numbered(spark.createDataFrame([], "k int"), "n", "k").count() == 0


def test_digest_tree(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FAN", 3)
    rows = [("a", i) for i in range(100)] + [("b", 0), (None, 5)]  # more than one full set of levels
    found = exports.ordered_digest(spark.createDataFrame(rows, "k string, i int"), ["i"], F.concat(F.lit("x"), F.col("i").cast("string")), "k").collect()
    got = {r["k"]: r["digest"] for r in found}
    assert len(found) == 3
    for k in ("a", "b", None):
        level, done = [f"x{i}" for x, i in rows if x == k], 0
        while done < ordered.LEVELS or any(len([f"x{i}" for x, i in rows if x == q]) > 3**done for q in ("a", "b", None)):
            done += 1
            level = [hashlib.sha256("|".join(level[i : i + 3]).encode()).hexdigest() for i in range(0, len(level), 3)]
        assert got[k] == level[0]


def test_decisions_are_taken_whole_or_not(spark):
    d = "struct<candidate:int,expected_revision:int,action:string>"
    rows = [
        (1, 1, 1, [(1, 0, "include"), (2, 0, "exclude")]), (1, 2, 2, [(1, 1, "exclude"), (3, 1, "include")]), (1, 3, 2, [(1, 1, "exclude")]), (1, 4, 3, [(1, 2, "include"), (1, 2, "exclude")]), (1, 5, 3, []),
        (2, 1, 1, [(i, 0, "include") for i in range(101)]), (2, 2, 1, [(i, 0, "include") for i in range(100)]), (3, 1, 2, [(1, 0, "include")]),
    ]
    asked = spark.createDataFrame(rows, f"batch_id int, request int, expected_batch_version int, decisions array<{d}>")
    taken = review.decide(asked)
    assert {(r["batch_id"], r["request"]): r["accepted"] for r in taken.collect()} == {(1, 1): True, (1, 2): False, (1, 3): True, (1, 4): False, (1, 5): False, (2, 1): False, (2, 2): True, (3, 1): False}
    revisions = {(r["candidate"], r["revision"]): (r["supersedes"], r["action"]) for r in review.decision_revisions(asked, taken).where("batch_id = 1").collect()}
    assert revisions == {(1, 1): (None, "include"), (2, 1): (None, "exclude"), (1, 2): (1, "exclude")}


def test_bills_of_one_month(spark):
    rows = [(1, dt.date(2026, 6, 1), i, *x) for i, x in enumerate([(10, 5, True), (10, 5, True), (11, 6, False), (12, 5, False), (13, 5, False)])]
    got = review.upsert_bills(spark.createDataFrame(rows, "issuer_id int, billing_period date, seq int, verified_id long, document_id long, superseded_later boolean")).orderBy("seq").collect()
    assert [(r["outcome"], r["open_id"]) for r in got] == [("opened", 10), ("kept", 10), ("conflict", 10), ("replaced", 12), ("conflict", 12)]


def test_replay_of_many_keys_in_order(spark):
    rows = [(k, i) for k in range(30) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(7)
    got = ordered.replay(df, ["k"], ["i"], list, lambda s, r: ([*s, r["i"]], (len(s),)), "n int").collect()
    assert len(got) == len(rows) and all(r["n"] == r["i"] for r in got)


def test_retries_and_leases(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [(1, "d", "a", "dead", t, "k"), (2, "d", "a", "failed", t + dt.timedelta(1), "recovery:1"), (3, "d", "b", "dead", t, "k"), (4, "d", "b", "queued", t, "recovery:3"), (5, "d", "c", "dead", t, "k"), (6, "x", "z", "done", t, "recovery:5")]
    jobs = spark.createDataFrame(rows, "id long, document_id string, target string, status string, created_at timestamp_ntz, idempotency_key string")
    assert [tuple(r) for r in lifecycle.retry_targets(jobs, "document_id", "target").collect()] == [("d", "a", 2, "recovery:2")]


def test_hamming_parts_miss_nothing(spark, monkeypatch):
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(0, 1 << 63, 40)]
    rows = [(i, h) for i, h in enumerate(base)] + [(100, base[0])]
    for i in range(120):
        h = int(r.choice(base))
        for bit in r.choice(63, int(r.integers(0, 11)), replace=False):
            h ^= 1 << int(bit)
        rows.append((200 + i, h))
    first = {}
    for i, h in rows:
        first.setdefault(h, i)
    want = {(min(a, b), max(a, b)): (x ^ y).bit_count() for (x, a), (y, b) in itertools.combinations(first.items(), 2) if (x ^ y).bit_count() <= 8}
    df = spark.createDataFrame(rows, "document_id long, phash long")
    chosen = dedupe.hash_parts
    for pretended in (1, 1_000, 10**5, 10**7, 10**9):  # the parts of larger tables miss nothing either
        monkeypatch.setattr(dedupe, "hash_parts", lambda rows, bits, distance, sample, n=pretended: chosen(n, bits, distance, sample))
        got = [(x["document_id"], x["other_id"], x["distance"]) for x in dedupe.near_hashes(df).collect()]
        assert len(got) == len(set(got)) and {(a, b): n for a, b, n in got} == want
    monkeypatch.undo()
    few = spark.createDataFrame([(i, 1 << 62 | (i * 37 % 64) << 20) for i in range(40)], "document_id long, phash long")  # six bits vary, fewer than may differ
    assert dedupe.near_hashes(few).count() == 40 * 39 // 2
    same = spark.createDataFrame([(1, -5), (2, -5)], "document_id long, phash long")
    assert dedupe.near_hashes(same).count() == 0 and dedupe.near_hashes(same.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 8, 9, 20, 34, 64])
def test_radii_cover_the_distance(bits):
    for parts in dedupe.divisions(bits, 8):
        assert bits <= 8 or sum(p.radius + 1 for p in parts) > 8  # so many bits differ at least where no part meets
        assert all(0 <= p.radius <= p.width and dedupe.neighbours(p.width, p.radius) <= dedupe.MOST_AROUND for p in parts)
        ends = [(p.first, p.first + p.width) for p in parts]
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(ends)) and ends[-1][1] <= bits


def test_parts_follow_rows_and_spread():
    r = np.random.default_rng(3)
    even = r.integers(0, 1 << 64, 500, dtype=np.uint64)
    assert len(dedupe.hash_parts(100, 64, 8, even)) > len(dedupe.hash_parts(10**9, 64, 8, even))
    near = even[0] ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64))
    assert dedupe.share_met(near, dedupe.divisions(64, 8)[-1]) > 100 * dedupe.share_met(even, dedupe.divisions(64, 8)[-1])
    assert dedupe.share_met(even[:1], [dedupe.Part(0, 64, 0)]) == 0


def test_hamming_candidates_are_few(spark):
    r = np.random.default_rng(7)
    rows = [(i, int(h)) for i, h in enumerate(r.integers(-(1 << 63), 1 << 63, 3000))]
    rows += [(5000 + i, h ^ 1 << i % 64 if i % 64 < 63 else h ^ 1) for i, (_, h) in enumerate(rows[:300])]
    seen = Observation()
    found = dedupe.near_hashes(spark.createDataFrame(rows, "document_id long, phash long"), seen=seen).count()
    assert found >= 300 and seen.get["candidates"] <= 0.1 * seen.get["rows"] * (seen.get["rows"] - 1) / 2


def test_simhash_is_the_sign_of_word_bits(spark):
    from cairnbook.functions.text import simhash_udf

    texts = ["", None, " \t", "one", "one two\nthree  three", "ünï 日本 a\u00a0b", "w " * 5000 + "x"]

    def plain(text):
        words, out = re.findall(r"[^\x20\x09-\x0D]+", text), 0
        for i in range(64):
            if sum(1 if int(hashlib.md5(w.encode()).hexdigest()[:16], 16) >> i & 1 else -1 for w in words) > 0:
                out |= 1 << i
        return out - (1 << 64) if out >> 63 else out

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", simhash_udf("t").alias("h")).collect()
    assert {r["i"]: r["h"] for r in got} == {i: None if t is None else plain(t) for i, t in enumerate(texts)}


def test_fuzzy_facts_against_all_pairs(spark):
    r = np.random.default_rng(2)
    names = ["Sample Shop Tokyo", "Sample Shop Tokyoo", "Sample Shop", "Other Store 12", "Other Store 13", "短い"]
    rows = [(i, dt.date(2026, 6, 1) + dt.timedelta(int(r.integers(0, 6))), Decimal(int(r.integers(1, 3))), str(r.choice(names))) for i in range(80)]
    facts = spark.createDataFrame(rows, "document_id long, transaction_date date, total_amount decimal(18,2), counterparty string")
    first = {}
    for i, day, amount, name in rows:
        first.setdefault((day, amount, name.casefold()), i)
    for least in (90.0, 100.0):
        want = {(min(a, b), max(a, b)) for (x, a), (y, b) in itertools.combinations(first.items(), 2) if x[1] == y[1] and abs((x[0] - y[0]).days) <= 1 and indel_ratio(x[2], y[2]) >= least}
        got = [(x["document_id"], x["other_id"]) for x in dedupe.business_matches(facts, least=least).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def old_tokens(text):
    found = re.findall(r"[぀-ヿ㐀-䶿一-鿿＀-￯]|[A-Za-z0-9_]+|\S", text)
    return sum(-(-len(t) // 4) if t.isascii() and (t[0].isalnum() or t[0] == "_") else 1 for t in found)


def test_token_counts_and_packing():
    for text in ("", " a　b\x1c", "領収書 abc_def12345 é!", "x" * 9 + "ｱ…", "a.b,c\n\n  d"):
        assert search.tokens(text) == old_tokens(text)
    body = "\n\n".join(["word " * 30 + "end."] * 9 + ["長い文。" * 60])
    out = search.chunk(body, 100)
    assert all(n == search.tokens(t) <= 100 for _, _, t, n in out) and "".join("".join(t for _, _, t, _ in out).split()) == "".join(body.split())


def test_nothing_numeric_is_an_error(spark):
    rows = spark.createDataFrame([({"a": "x"},)], "values map<string,string>")
    with pytest.raises(Exception, match="no numeric cell"):
        staging.numeric_aggregate(rows, "a").collect()


def some_names():
    r = np.random.default_rng(11)
    base = ["", "a", "ab", "ba", "aa", "abc", "customer#000000123", "日本商事株式会社", "ＡＢＣ", "x" * 70, "the long name of a company that has its seat somewhere in the north", "aaaaaaaaaaaaaaaa"]
    base += ["".join(r.choice(list("abcdefgh "), int(n))) for n in r.integers(3, 40, 40)]
    out = list(base)
    for name in base * 4:
        t = list(name)
        for _ in range(int(r.integers(1, 4))):
            at = int(r.integers(0, len(t) + 1))
            kind = int(r.integers(0, 3))
            if kind == 0:
                t.insert(at, str(r.choice(list("abx"))))
            elif t and kind == 1:
                del t[min(at, len(t) - 1)]
            elif t:
                t[min(at, len(t) - 1)] = "z"
        out.append("".join(t))
    return out


def plain_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *itertools.accumulate(range(len(b)), lambda left, j, row=row, x=x: row[j] + 1 if x == b[j] else max(left, row[j + 1]), initial=0)][1:]
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_vectorised_similarity():
    from cairnbook.functions.text import indel_ratios

    own = some_names()
    pairs = [(a, b) for a in own[::3] for b in own[::7]]
    assert np.allclose(indel_ratios(*map(list, zip(*pairs, strict=True))), [plain_ratio(a, b) for a, b in pairs])
    assert len(indel_ratios([], [])) == 0


@pytest.mark.parametrize("least", [60.0, 75.0, 90.0, 100.0])
def test_near_names_against_all_pairs(spark, least):
    own = some_names()
    rows = [(i, n) for i, n in enumerate(own)] + [(900, None), (901, own[6])]
    first = {}
    for i, n in enumerate(own):
        first.setdefault(n, i)
    want = {(min(i, j), max(i, j)) for (a, i), (b, j) in itertools.combinations(first.items(), 2) if a and b and plain_ratio(a, b) >= least}
    df = spark.createDataFrame(rows, "id long, name string")
    got = [(r["id"], r["other_id"]) for r in names.near_names(df, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert names.near_names(df.limit(0), least).count() == 0


def test_few_names_are_scored(spark):
    rows = [(i, f"customer#{i:09}") for i in range(3000)]
    seen = Observation()
    names.near_names(spark.createDataFrame(rows, "id long, name string"), 90.0, seen).count()
    assert seen.get["scored"] <= 0.05 * 3000 * 2999 / 2


@pytest.mark.parametrize("bins", [2, 1024])
def test_medians_by_selection(spark, monkeypatch, bins):
    monkeypatch.setattr(series, "BINS", bins)
    r = np.random.default_rng(5)
    groups = {"one": [Decimal("3.10")], "two": [Decimal("1.00"), Decimal("2.01")], None: [Decimal("-5.00")] * 4, "even": [Decimal(int(x)) / 100 for x in r.integers(-(10**12), 10**12, 200)], "odd": [Decimal(int(x)) / 100 for x in r.integers(0, 50, 301)], "none": []}
    groups["far"] = [Decimal("0.01")] * 30 + [Decimal("9999999999999999.99")] * 31
    rows = [(k, v) for k, some in groups.items() for v in [*some, None]]
    df = spark.createDataFrame(rows, "k string, v decimal(18,2)").repartition(5)
    got = {x["k"]: x["m"] for x in series.exact_median(df, "v", "m", "k").collect()}
    assert got == {k: statistics.median(v) if v else None for k, v in groups.items()}
    every = [v for some in groups.values() for v in some]
    assert [x["m"] for x in series.exact_median(df, "v", "m").collect()] == [statistics.median(every)]
    mads = {x["k"]: (x["median"], x["mad"]) for x in series.spread(df, "v", "k").collect()}
    assert {k: v for k, v in mads.items() if groups[k]} == {k: (m := statistics.median(v), statistics.median([abs(x - m) for x in v])) for k, v in groups.items() if v}
    assert series.exact_median(df.limit(0), "v", "m", "k").count() == 0


def test_selection_gathers_no_values(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("decimal(18,2)").alias("v"))
    assert "collect_list" not in series.exact_median(df, "v", "m", "k")._jdf.queryExecution().toString()
