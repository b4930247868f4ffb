"""Stages of the corpus pipeline: the smallest tables, edge cases, brute force."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnbook.llm.shared import stored

DIR = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, DIR), f"test-{name}")
        assert after.columns == columns
        if name != "mixture":
            assert after.count() <= before.count() and after.join(before, columns, "left_anti").count() == 0
        if name == "near_duplicates":
            assert brute_kept([(r["doc_id"], r["text"]) for r in before.collect()]) == sorted([(r["doc_id"], r["text"]) for r in after.collect()], key=repr)
        assert after.count() > 0.5 * before.count()
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, DIR)
    assert pieces.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_kept(rows):
    """Rows (id, text) that stay: all pairs compared, components by relabelling."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    groups = {}
    for i, k in enumerate(label):
        groups.setdefault(k, []).append(rows[i])
    out = []
    for members in groups.values():
        ids = [m for m in members if m[0] is not None]
        least = min(m[0] for m in ids) if ids else None
        out.append([m for m in members if m[0] == least])
    assert all(len({t for _, t in m}) == 1 for m in out)  # of one id with several texts the hash decides; not in these rows
    return sorted([m[0] for m in out], key=repr)


BASE = [f"b{i}" for i in range(120)]
NEAR = " ".join(["x", *BASE[1:]])
ROWS = [
    (5, " ".join(BASE), "en", "s1"), (3, NEAR, "en", "s1"), (3, NEAR, "en", "s2"), (None, " ".join(BASE), "en", "s1"), (None, "alone of no id at all here", "en", "s1"), (None, "alone of no id at all here", "en", "s1"), (7, None, "en", None), (7, "", None, "s1"), (8, " \t", "en", "s3"),
    (9, "short text", "en", "s1"), (9, "quite another text of the same id", "de", "s2"), (10, "Short  TEXT", "en", "s1"), (11, "long " * 30_000 + "tail", "fr", "s2"),
]
CLASH = ["tie", "sid", "row", "a_", "id_", "score", "key", "n", "size", "rest", "text_n", "vote", "keep", "rows", "part"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("extra").alias(c) for c in CLASH]).cache()


def test_near_duplicates_of_edge_cases(spark, docs):
    got = STAGES["near_duplicates"](spark, docs, DIR)
    assert got.columns == docs.columns
    kept = sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=repr)
    want = [(3, NEAR), (None, ROWS[4][1]), (7, None), (7, ""), (8, " \t"), (9, "short text"), (9, ROWS[10][1]), (11, ROWS[12][1])]
    assert kept == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["language", "toxicity", "near_duplicates", "mixture", "packing"])
def test_every_stage_takes_edge_cases(spark, docs, name):
    got = STAGES[name](spark, docs, DIR)
    rows = got.collect()
    if name == "packing":
        ids = sum(r["length"] for r in rows)
        assert ids == sum({(r["doc_id"], r["doc_tokens"]): r["doc_tokens"] for r in rows}.values()) + sum(r["doc_tokens"] for r in rows if r["start"] == 0) - sum({(r["doc_id"], r["doc_tokens"]): r["doc_tokens"] for r in rows}.values())
    else:
        assert got.columns == docs.columns
    if name == "mixture":
        assert {r["doc_id"] for r in rows} <= {r[0] for r in ROWS}
    assert STAGES[name](spark, docs.limit(0), DIR).count() == 0


def test_packed_ids_are_those_of_the_texts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, text, _, _ in ROWS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault((i, len(ids)), []).append(ids)
    for r in STAGES["packing"](spark, docs, DIR).collect():
        assert r["ids_crc32"] in {zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for ids in want[r["doc_id"], r["doc_tokens"]]}


def test_packing_sends_no_python_rows(spark, docs, monkeypatch):
    """Rows of Python objects would start a second pool of Python workers on each executor."""
    want = sorted([tuple(r) for r in STAGES["packing"](spark, docs, DIR).collect()], key=repr)

    def refused(*_, **__):
        raise AssertionError("parallelize")

    monkeypatch.setattr(spark.sparkContext, "parallelize", refused)
    assert sorted([tuple(r) for r in STAGES["packing"](spark, docs, DIR).collect()], key=repr) == want


def test_keys_that_are_joined_instead_of_sent(spark, docs, monkeypatch):
    """Above SENT keys near_duplicates and the mixture join by key; the rows are the same."""
    from cairnbook.llm import mixing

    def rows(df):
        return sorted([tuple(r) for r in df.collect()], key=repr)

    real = spark.read.parquet(f"{DIR}/documents.parquet")
    few = [rows(STAGES[n](spark, d, DIR)) for n in ("near_duplicates", "mixture") for d in (docs, real)]
    monkeypatch.setattr(corpus_pipeline, "SENT", 0)
    monkeypatch.setattr(mixing, "SENT", 0)
    assert [rows(STAGES[n](spark, d, DIR)) for n in ("near_duplicates", "mixture") for d in (docs, real)] == few
    taken = [rows(mixing.mix(d)) for d in (docs, real)]
    monkeypatch.undo()
    assert [rows(mixing.mix(d)) for d in (docs, real)] == taken


def test_near_duplicates_shuffles_each_set_twice(spark):
    from test_operators import shuffle_writes

    texts = [[*[f"g{g}w{i}" for i in range(500 + 9 * k)], f"e{g}x{k}", *[f"g{g}w{i}" for i in range(500 + 9 * k, 2000)]] for g in range(60) for k in range(3)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to be sent
    try:
        before = set(shuffle_writes(spark))
        got = STAGES["near_duplicates"](spark, df, DIR).select("doc_id").collect()
        written = [x for stage, x in shuffle_writes(spark).items() if stage not in before]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r["doc_id"] for r in got) == list(range(0, len(texts), 3))
    sets = 8 * sum(len(w) - 4 for w in texts)  # a shingle has 8 bytes; no other record than a whole set is as long
    assert sets < sum(size for size, records in written if size > 1000 * records) < 2.5 * sets
