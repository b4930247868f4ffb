"""Operators on small tables: edge cases, brute force, round trips."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnbook.llm import ans, brown, fingerprints, jaccard, kdtree, langid, mixing, packing, toxicity, warc
from cairnbook.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (0, "", "s1"), (1, None, None), (2, BASE, "s1"), (2, BASE, "s1"), (3, BASE + " tail", "s2"), (None, "x y", "s2"), (5, "Ab c", "s1"), (6, "aB  c", "s3"), (7, " \t", "s1"),
    (8, "long " * 9000, "s2"), (9, BASE.replace("w30", "q"), "s3"), (10, " ".join(f"v{i}" for i in range(200)), "s1"),
]
CLASH = ["part", "sid", "row", "score", "h", "key", "size", "rest", "rid", "lang", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, s) for i, t, s in ROWS], "doc_id long, text string, source string")
    return df.select("*", *[F.lit("en").alias(c) for c in CLASH]).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def test_fingerprints(docs, none):
    got = fingerprints.edited_neighbours(docs).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))] == [r[0] for r in order]
    for (i, text, _), after in zip(order, [*order[1:], order[0]], strict=True):
        t, a = text or "", after[1] or ""
        edited = t[: len(t) - len(t) // 4] + a[: len(t) // 4]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        assert any(r["doc_id"] == i and r["edited_sha256"] == digest and r["n_chars"] == len(t) for r in got)
    by = {r["doc_id"]: r for r in fingerprints.fingerprint(docs).collect()}
    assert by[0]["fingerprint"] == by[1]["fingerprint"] == "" and by[5]["fingerprint"] == by[6]["fingerprint"]
    assert fingerprints.edited_neighbours(none).count() == 0 and fingerprints.fingerprint(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 10, 17])
def test_ranges(spark, n):
    from cairnbook.llm.ordered import range_of

    cuts = [10 * i for i in range(n)]
    got = spark.range(-5, 200).withColumn("r", range_of(F.col("id"), cuts)).collect()
    assert all(r["r"] == sum(c <= r["id"] for c in cuts) for r in got)
    assert spark.range(1).select(range_of(F.lit(None).cast("long"), cuts)).first()[0] == 0


@pytest.mark.parametrize("hot", [None, 7, 0, -3, 59])
def test_a_hot_id_is_cut_by_its_texts(spark, hot):
    """Half of all rows share an id: their parts hold about a like number of rows, ordered by id and text hash."""
    from cairnbook.llm.ordered import parts_of_rows

    rows = [(hot, f"text {i}") for i in range(600)] + [(i % 60, f"other {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    part, hashed = parts_of_rows(df, 16)
    got = df.select("doc_id", "text", F.xxhash64("text").alias("h"), part.alias("part")).collect()
    key = [(r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["part"]) for r in got]
    assert hashed and [k[3] for k in sorted(key)] == sorted(k[3] for k in key) and {k[3] for k in key} <= set(range(16))
    assert max(sum(r["part"] == p for r in got) for p in range(16)) < 240
    for n in (1, 2, 3):
        part, _ = parts_of_rows(df, n)
        key = [(r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["part"]) for r in df.select("doc_id", F.xxhash64("text").alias("h"), part.alias("part")).collect()]
        assert [k[3] for k in sorted(key)] == sorted(k[3] for k in key) and {k[3] for k in key} <= set(range(n))


@pytest.mark.parametrize("hot", [None, 7])
def test_documents_of_a_hot_id_in_order(spark, hot):
    """op4 and op7 over an id of most rows: each row once, neighbours and starts those of one global order."""
    rows = [(hot, f"t{i} " * (1 + i % 7)) for i in range(60)] + [(i, f"other {i} words here") for i in range(20)] + [(hot, "same")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"]) for r in df.withColumn("h", F.xxhash64("text")).collect())
    texts = [x[3] for x in order]
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 4] + a[: len(t) // 4]).encode()).hexdigest() for t, a in zip(texts, [*texts[1:], texts[0]], strict=True))
    assert sorted(r["edited_sha256"] for r in fingerprints.edited_neighbours(df).collect()) == want
    got = sorted(((r["start"], r["n_tokens"], r["ids_crc32"]) for r in ans.round_trip(df).collect()))
    at, expected = 0, []
    for text in texts:
        ids = [*reference_ids(text), 1]
        expected.append((at, len(ids), crc(ids)))
        at += len(ids)
    assert got == expected


def test_single_document_follows_itself(spark):
    row = fingerprints.edited_neighbours(spark.createDataFrame([(4, "a b c d e f g h")], "doc_id long, text string")).first()
    assert row["near_next"] == 1.0 and row["n_chars"] == 15


def brute_components(rows, n, num, den):
    sets = []
    for _, text, _ in rows:
        w = words(text)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [b if x == a else x for x in up]
    out = []
    for i, (d, _, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if up[j] == up[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(group) if group else None))
    return sorted(out, key=repr)


def test_jaccard(docs, none):
    for n, num in ((4, 85), (5, 80)):
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_components(docs, n=n, num=num, den=100).collect()), key=repr)
        assert got == brute_components(ROWS, n, num, 100)
    assert jaccard.link_components(none).count() == 0


def test_jaccard_chains_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = np.random.default_rng(1)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(90)]
        for _ in range(25):
            w = list(base)
            for at in r.integers(0, 90, r.integers(0, 4)):
                w[at] = f"e{r.integers(0, 1 << 30)}"
            rows.append((len(rows), " ".join(w), "s"))
    got = jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got.collect()), key=repr) == brute_components(rows, 4, 85, 100)


def test_jaccard_texts_without_id_link(spark):
    base = [f"b{i}" for i in range(200)]
    a, b = (" ".join(f"{k}{i}" if i in at else w for i, w in enumerate(base)) for k, at in (("x", (20, 60, 100)), ("y", (40, 80, 120))))
    rows = [(4, a), (None, " ".join(base)), (9, b), (None, "alone without id"), (11, "other text of some words")]  # 4 and 9 meet through the row without id only
    got = jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == sorted([(4, 4), (None, 4), (9, 4), (None, None), (11, 11)], key=repr)


def test_jaccard_with_hot_shingles(spark, monkeypatch):
    for name, value in (("EVERY", 2), ("SEEN", 2), ("SALT", 3)):
        monkeypatch.setattr(jaccard, name, value)
    r = np.random.default_rng(6)
    common = [f"c{i}" for i in range(40)]
    rows = []
    for g in range(40):
        base = [*common, *[f"g{g}w{i}" for i in range(int(r.integers(1, 150)))]]
        for _ in range(3):
            w = list(base)
            for at in r.integers(0, len(w), int(r.integers(0, 4))):
                w[at] = f"e{r.integers(0, 1 << 30)}"
            rows.append((len(rows), " ".join(w), "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sets = jaccard._scan(df.select("doc_id", "text", F.xxhash64("text").alias("tie")), 4, 85, 100)
    assert len(jaccard._hot(sets)[0]) > 3
    got = jaccard.link_components(df)
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got.collect()), key=repr) == brute_components(rows, 4, 85, 100)


def shuffle_writes(spark) -> dict[int, tuple[int, int]]:
    """Bytes and records that each stage so far has written for shuffles."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): (stages.apply(i).shuffleWriteBytes(), stages.apply(i).shuffleWriteRecords()) for i in range(stages.size())}


def test_jaccard_shuffles_each_set_twice(spark):
    r = np.random.default_rng(8)
    rows = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(3000)]
        rows += [(len(rows) + k, " ".join([*base[: 1500 + 10 * k], f"e{r.integers(0, 1 << 30)}", *base[1500 + 10 * k :]])) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to be sent
    try:
        before = set(shuffle_writes(spark))
        got = jaccard.link_components(df).collect()
        written = [x for stage, x in shuffle_writes(spark).items() if stage not in before]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((x["doc_id"], x["component_id"]) for x in got) == [(i, i - i % 4) for i, _ in rows]
    # no other record than a whole set is as long; a shingle has 8 bytes
    whole = sum(size for size, records in written if size > 1000 * records)
    sets = 8 * sum(len(t.split(" ")) - 3 for _, t in rows)
    assert sets < whole < 2.5 * sets


def test_structured_words(spark):
    from test_kernels import thue_morse

    rows = [(2 * i + k, f"{w} x y z {w} end", "s") for i, n in enumerate((1024, 2048, 4096)) for k, w in enumerate(thue_morse(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard.link_components(df).collect()), key=repr) == brute_components(rows, 4, 85, 100)
    assert len({x["fingerprint"] for x in fingerprints.fingerprint(df).collect()}) == len(rows)
    assert {(x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in ans.round_trip(df).collect()} == {(i, len(x := [*reference_ids(t), 1]), crc(x)) for i, t, _ in rows}
    assert {(x["doc_id"], x["ids_crc32"]) for x in packing.pack(df).collect() if x["length"] == x["doc_tokens"]} <= {(i, crc([*reference_ids(t), 2])) for i, t, _ in rows}
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    known = {w for i, t, _ in rows if i not in held for w in t.split()}
    assert {(x["doc_id"], x["n_known"]) for x in brown.score_texts(df).collect()} == {(i, sum(w in known for w in t.split()) + 1) for i, t, _ in rows}


def test_components(spark, monkeypatch):
    from cairnbook.llm import components as c

    monkeypatch.setattr(c, "PER_TASK", 40)
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 150, (100, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    a, b = c.contract(*np.array([e for e in edges if e[0] != e[1]]).T)
    want = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert got == want | {v: v for v in want.values()}


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    total = sum(len(words(t)) for _, t, _ in ROWS)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (size, target), taken in by.items():
        assert target <= 3 * size + 1e-6 and abs(sum(taken) - target) <= 1
    assert abs(sum(t for _, t in by) - total) < 1e-6
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=repr)
    assert mixing.mix(none).count() == 0
    assert mixing.remix(docs).columns == docs.columns and mixing.remix(none).count() == 0


def test_longer_documents_are_likelier(spark):
    rows = [(i, "w " * (1 if i % 2 else 400), "a" if i < 5000 else "b") for i in range(10_000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("target < source_size").collect()
    share = [np.mean([r["taken"] / r["size"] for r in got if (r["size"] == 1) == short]) for short in (True, False)]
    assert share[1] > share[0]


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(docs, none):
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in ans.round_trip(docs).collect()), key=lambda r: r[1])
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted((i, len(x := [*reference_ids(t), 1]), crc(x)) for i, t, _ in ROWS if i is not None)
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    assert got[0][0] is None and [r[0] for r in got[1:]] == sorted(i for i, _, _ in ROWS if i is not None)
    assert ans.round_trip(none).count() == 0


def test_small_segments(docs):
    files = ans.write_ids(docs, segment=300)
    assert files.count() > 3
    assert ans.read_ids(files).count() == len(ROWS)


@pytest.mark.parametrize("window", [64, 4096])
def test_packing(docs, none, window):
    got = [r.asDict() for r in packing.pack(docs, window=window).collect()]
    ids = {}
    for i, t, _ in ROWS:
        ids.setdefault(i, []).append([*reference_ids(t), 2])
    for i, texts in ids.items():
        pieces = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == sum(map(len, texts))
        assert all(r["ids_crc32"] in {crc(x[r["start"] : r["start"] + r["length"]]) for x in texts} and r["doc_tokens"] in map(len, texts) for r in pieces)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert packing.pack(none).count() == 0


def test_language_model(spark, docs, none):
    got = brown.score_texts(docs).collect()
    held = {i for i, _, _ in ROWS if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    train = [w for i, t, _ in ROWS if i not in held for w in [*words(t), "</s>"]]
    n, v = len(train), len(set(train))
    counts = {w: train.count(w) for w in set(train)}
    want = []
    for i, t, _ in ROWS:
        w = [*words(t), "</s>"]
        want.append((i, i in held, len(w), sum(x in counts for x in w), float(sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w))))
    have = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=repr)
    want.sort(key=repr)
    assert [r[:4] for r in have] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in have], [r[4] for r in want])
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert brown.score_texts(none).count() == 0


def test_rare_words_are_joined(spark, docs, monkeypatch):
    want = sorted((tuple(r) for r in brown.score_texts(docs).select("doc_id", "n_known", F.round("base_score", 6)).collect()), key=repr)
    monkeypatch.setattr(brown, "FREQUENT", 20)
    assert sorted((tuple(r) for r in brown.score_texts(docs).select("doc_id", "n_known", F.round("base_score", 6)).collect()), key=repr) == want


def test_words_beyond_the_top_have_their_own_class(spark, monkeypatch):
    r = np.random.default_rng(12)
    a, b = ([f"{k}{i}xyz" for i in range(700)] for k in "pq")  # equal endings, and two kinds of words that alternate
    texts = [(i, " ".join(w for x, y in zip(r.choice(a, 60), r.choice(b, 60), strict=True) for w in (x, y))) for i in range(1, 400)]
    df = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    odd = spark.createDataFrame([(7_000_000 + i, " ".join(np.r_[r.choice(a, 60), r.choice(b, 60)])) for i in range(40)], "doc_id long, text string")
    held = [f"crc32(encode(cast(doc_id as string), 'UTF-8')) % 7 {x} 2" for x in ("<>", "=")]
    both = df.unionByName(odd.where(held[1]))
    scores = {}
    for frequent in (brown.FREQUENT, 1000):  # below: some words are joined, not broadcast
        monkeypatch.setattr(brown, "FREQUENT", frequent)
        got = [x for x in brown.score_texts(both).collect() if x["held_out"]]
        scores[frequent] = sorted((x["doc_id"], round(x["score"], 6)) for x in got)
        usual, unusual = ([x["score"] - x["base_score"] for x in got if (x["doc_id"] >= 7_000_000) == k] for k in (False, True))
        assert len(unusual) and min(usual) > max(unusual) + 30
    first, second = scores.values()
    assert first == second
    train = df.where(held[0]).select("text")
    counts = brown.word_counts(train).cache()
    known = brown.fit(train, counts)[2]
    assert known.where("c >= 2 and cls is null").count() == 0 and known.where("cls is not null").count() > 2 * brown.TOP


def test_insert_finds_the_best_class():
    r = np.random.default_rng(2)
    k = brown.CLASSES
    cells = r.poisson(9, (k, k)).astype(float)
    sizes, code, n = [], [], []
    for g in (5, 17, 40):  # words with the neighbours of class g, taken from class 3
        cells[g, g + 1] += 400
        cells[g + 2, g] += 400
        sizes.append(2)
        code += [g + 2 + 2 * k * 3, k + g + 1 + 2 * k * 3]
        n += [7, 7]
    assert brown.insert(cells, np.array(sizes), np.array(code), np.array(n)).tolist() == [5, 17, 40]


def test_search(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in r.normal(0, 0.3, 6)]) for i in range(450)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (600, None), (700, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (800, [float("nan")] * 6), (900, [1.0, 2.0]), (None, rows[1][1]), (100, rows[2][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("dim", F.lit("x"))
    got = {}
    for x in kdtree.top_k(df).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    good = [(n, i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i in (0, 200, 500):
        n, _, q = next(g for g in good if g[1] == i)
        want = sorted((-int(q @ v), j) for m, j, v in good if m != n and len(v) == len(q))[:10]
        assert [(s, j) for _, j, s in sorted(got[i])] == [(-a, j) for a, j in want]
    assert len(got[100]) == 20 and 900 not in got and 600 not in got  # two rows of one id; no partner of its length; null
    assert kdtree.top_k(df.limit(0)).count() == 0


def sections(rows):
    """Records of replicas as they stand: each file's offsets leave no gap."""
    for a, b in zip(sorted(rows), sorted(rows)[1:], strict=False):
        assert (b[1] == a[1] + a[2]) if a[0] == b[0] else b[1] == 0


@pytest.mark.parametrize("fan", [2, 16])
def test_warc(spark, monkeypatch, fan):
    monkeypatch.setattr(warc, "FAN", fan)
    rows = [(i, f"http://h/{i}", "<p>é</p>" * (i % 7)) for i in range(200)] + [(None, None, None), (5, "http://h/5", "x"), (7, "u", "same"), (7, "u", "same"), *[(50, f"v{i}", "hot") for i in range(300)]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1)).withColumn("key", F.lit("x"))
    kept = warc.records(pages, per_file=30).cache()
    where = kept.select("file", "offset", "length").collect()
    sections(map(tuple, where))
    assert len(where) == len(rows) and max(sum(r["file"] == f for r in where) for f in {r["file"] for r in where}) <= 30
    assert warc.audit(warc.leaves(kept), warc.leaves(kept)).count() == 0
    # records 60 and 130 are lost and the rest laid out without them, 5 (two records), 61 and the one of no id changed
    lost = kept.where("doc_id is null or doc_id not in (60, 130)").withColumnRenamed("slot", "old").drop("offset")
    changed = F.when(F.col("doc_id").isin(5, 61) | F.col("doc_id").isNull(), F.concat("record", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("record"))
    other = warc.laid(lost, "old").withColumn("record", changed)
    for one, two, gone in ((kept, other, "missing"), (other, kept, "added")):
        got = sorted(((r["doc_id"], r["status"]) for r in warc.audit(warc.leaves(one), warc.leaves(two)).collect()), key=repr)
        assert got == sorted([(60, gone), (130, gone), (5, "differs"), (5, "differs"), (61, "differs"), (None, "differs")], key=repr)
    # a whole file is lost
    file = kept.where("doc_id = 100").first()["file"]
    got = warc.audit(warc.leaves(kept), warc.leaves(kept.where(F.col("file") != file))).collect()
    assert len(got) == kept.where(F.col("file") == file).count() and {r["status"] for r in got} == {"missing"}
    empty = warc.leaves(warc.records(pages.limit(0)))
    assert warc.audit(empty, empty).count() == 0


def test_language(spark, docs):
    texts = {"en": "the of and to in that with from", "de": "der die und nicht schule über zwischen", "fr": "le la les école être où très"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(t.split() * 5)), k, "s") for i, (k, t) in enumerate(list(texts.items()) * 8)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    pages = spark.createDataFrame(
        [(1, "http://a.example.de/de/x", "<html lang='de'><script>the the the</script><p>der die und nicht</p></html>"), (2, None, None), (3, "bad", "<p>école être très</p>"), (4, "http://b.example.com/", "<p>12 34 !!</p>"), (4, "http://b.example.com/", "<p>the of and</p>")],
        "page_id long, url string, html string",
    )
    got = {(r["page_id"], r["text_n"] > 0): (r["lang"], r["accepted"]) for r in langid.identify_pages(pages, model).collect()}
    assert got[1, True] == ("de", True) and got[3, True] == ("fr", True) and got[4, True] == ("en", True)
    assert not got[2, False][1] and not got[4, False][1]
    assert langid.identify_pages(pages.limit(0), model).count() == 0
    found = langid.identify_documents(docs, model)
    assert found.count() == len(ROWS) and found.select("row.*").columns == docs.columns
    assert langid.identify_documents(docs.limit(0), langid.train(docs.limit(0))).count() == 0


def test_posterior_by_hand(spark):
    """fuse() against the formulas of its module, one page at a time in plain Python."""
    r = np.random.default_rng(3)
    names = ["de", "en", "fr", "und"]
    rows = []
    for i in range(60):
        logs = [float(x) for x in r.normal(0, 2, 4)]
        rows.append((i, int(r.integers(0, 3)) * 10, logs, *[None if r.random() < 0.2 else str(r.choice(list(v))) for v in ("xyz", "pq", "abc", "mn")]))
    df = spark.createDataFrame(rows, "page_id long, text_n long, text_logs array<double>, d string, s string, h string, dom string")
    got = {x["page_id"]: x for x in langid.fuse(df, names, {"declared": "d", "suffix": "s", "host": "h", "domain": "dom"}).collect()}
    vote = {x[0]: int(np.argmax(x[2])) if x[1] > 0 else None for x in rows}
    every = [sum(v == k for v in vote.values()) for k in range(4)]
    for row in rows:
        total = np.array(row[2])
        for at in (3, 4):
            if row[at] is not None:
                n = np.array([sum(vote[x[0]] == k for x in rows if x[at] == row[at] and x[0] != row[0]) for k in range(4)], float)
                share = (n.sum() + 1) / (sum(every) + 2)
                total += np.log((n + langid.SMOOTH * share) / (np.array(every) + langid.SMOOTH))
        prior = (np.array(every) + 1) / (sum(every) + 4)
        for at in (6, 5):
            if row[at] is not None:
                n = np.array([sum(vote[x[0]] == k for x in rows if x[at] == row[at] and x[0] != row[0]) for k in range(4)], float)
                prior = (n + langid.SMOOTH * prior) / (n.sum() + langid.SMOOTH)
        total += np.log(prior)
        p = np.exp(total - total.max())
        best = int(np.argmax(total))
        x = got[row[0]]
        assert x["lang"] == names[best] and abs(x["posterior"] - 1 / p.sum()) < 1e-9
        assert x["accepted"] == (row[1] > 0 and best != 3 and 1 / p.sum() >= langid.LEAST)


def test_markup_and_host_decide_where_the_text_does_not(spark):
    words_ = {"de": "der die und nicht schule haus in so war", "en": "the of and that with house in so war"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(t.split() * 4)), k, "s") for i, (k, t) in enumerate(list(words_.items()) * 10)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    pages = [(i, f"http://{k}.example.{k}/{k}/{i}", f"<html lang='{k}'><nav>{t}</nav></html>") for i, (_, t, k, _) in enumerate(rows)]
    unclear = "in so war"  # as much of either language
    pages += [(100 + i, f"http://{k}.example.{k}/{k}/x", f"<html lang='{k}'>{unclear}</html>") for i, k in enumerate(words_)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("lang", F.lit("x"))
    got = {x["page_id"]: x["lang"] for x in langid.identify_pages(df, model).collect()}
    assert got[100] == "de" and got[101] == "en" and all(got[i] == r[2] for i, r in enumerate(rows))
    entity = spark.createDataFrame([(1, "&Uuml;ber&nbsp;&#252;ber"), (2, "\u00dcber\u00a0\u00fcber"), (3, None)], "page_id long, html string").withColumn("url", F.lit(None).cast("string"))
    found = {x["page_id"]: (x["text_n"], x["text_logs"]) for x in langid.text_evidence(langid.page_evidence(entity), model, entities=True).collect()}
    assert found[1] == found[2] and found[1][0] > 0 and found[3][0] == 0


def test_every_language_is_learnt(spark):
    r = np.random.default_rng(9)
    lexica = {f"l{i:02}": ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(4)] for i in range(70)}
    rows = [(n, " ".join(r.choice(lex, 25)), lang, "s") for n, (lang, lex) in enumerate(list(lexica.items()) * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    model = langid.train(df)
    assert model.languages == [*sorted(lexica), "und"]
    plain = df.select("doc_id", "text", F.col("lang").alias("truth"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))
    got = langid.identify_documents(plain, model).select("row.truth", "lang_found", "accepted").collect()
    assert len(got) == len(rows) and all(x["truth"] == x["lang_found"] and x["accepted"] for x in got)


def test_toxicity(spark, docs, none):
    r = np.random.default_rng(4)
    rows = [(i, " ".join([*r.choice([f"n{k}" for k in range(99)], 50), *(["awfulword"] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(200)]
    many = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = many.select("doc_id", "toxic").unionByName(spark.createDataFrame([(1000, None), (None, 1)], "doc_id long, toxic int"))
    net = toxicity.fit(many.select("doc_id", "text"), labels)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(many.select("doc_id", "text"), net).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows]) > 0.95
    edge = toxicity.score(docs, net).collect()
    assert len(edge) == len(ROWS) and all(0 <= x["score"] <= 1 for x in edge)
    assert toxicity.score(none, net).count() == 0
    assert {x["score"] for x in toxicity.score(docs, toxicity.fit(none, labels)).collect()} == {0.0}


def exact_likeness(a, b):
    x, y = (brute_shingles(t) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_fingerprints_of_small_texts_are_exact(spark):
    r = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    texts = ["", " ", "a b", "A  B", *[" ".join(r.choice(base[:12], int(r.integers(1, 100)))) for _ in range(20)], " ".join(base), " ".join([*base[:50], "x", *base[51:]])]
    rows = [(10 * i, t) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x for x in fingerprints.edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for k, (i, t) in enumerate(rows):
        after = texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert abs(got[i]["near_next"] - exact_likeness(t, after)) < 1e-12 and abs(got[i]["near_edited"] - exact_likeness(t, edited)) < 1e-12
        assert got[i]["n_shingles"] == len(brute_shingles(t))
    same = {}
    for i, t in rows:
        assert same.setdefault(frozenset(brute_shingles(t)), got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert len(set(same.values())) == len(same)


def test_fingerprints_of_large_texts_are_near(spark):
    r = np.random.default_rng(9)
    rows = []
    for i in range(12):
        a = [f"v{x}" for x in r.integers(0, 900, 1500)]
        b = [f"u{i}" if r.random() < 0.004 * i else x for x in a]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = {x["doc_id"]: x["near_next"] for x in fingerprints.edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    error = [got[2 * i] - exact_likeness(rows[2 * i][1], rows[2 * i + 1][1]) for i in range(12)]
    assert max(map(abs, error)) < 0.2 and abs(np.mean(error)) < 0.06


def test_score_by_hand(spark):
    """The class model's probabilities, from the classes that the fit found, one token at a time."""
    r = np.random.default_rng(13)
    vocabulary = [f"{k}{i}" for k in "abc" for i in range(40)]
    rows = [(i, " ".join(r.choice(vocabulary, int(r.integers(0, 40))))) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = df.where("crc32(encode(cast(doc_id as string), 'UTF-8')) % 7 <> 2").select("text")
    counts = brown.word_counts(train).cache()
    _, label, known, _, _, _, _ = brown.fit(train, counts)
    cls = {x["h"]: x["cls"] for x in known.collect()}
    from cairnbook.llm import words as w_

    def class_of(word):
        import pyarrow as pa

        (chunk,) = w_.chunks(pa.array([word]))
        own = cls.get(int(chunk.hashes.view(np.int64)[0]))
        return own if own is not None else int(label[1 + brown.TOP + brown._endings(chunk)[0]])

    texts = [x["text"].split() for x in train.collect()]
    tokens_ = [[*t, "</s>"] for t in texts]
    n = sum(map(len, tokens_))
    count = {}
    for t in tokens_:
        for x in t:
            count[x] = count.get(x, 0) + 1
    k = brown.CLASSES
    of = {x: 0 if x == "</s>" else class_of(x) for x in {*count, *[x for _, t in rows for x in t.split()]}}
    cells, types = np.zeros((k, k)), np.zeros(k)
    for t in tokens_:
        for a, b in zip(["</s>", *t], t, strict=False):
            cells[of[a], of[b]] += 1
    for x in count:
        types[of[x]] += 1
    unseen = np.zeros(k)
    unseen[label[1 + brown.TOP :]] = 1
    size = cells.sum(0)
    prior = (size + 1) / (size.sum() + k)
    for x in brown.score_texts(df).collect():
        t = [*dict(rows)[x["doc_id"]].split(), "</s>"]
        total = 0.0
        for a, b in zip(["</s>", *t], t, strict=False):
            step = (cells[of[a], of[b]] + k * prior[of[b]]) / (cells[of[a]].sum() + k)
            emit = size[of[b]] + types[of[b]] + unseen[of[b]]
            total += np.log10((count.get(b, 0) + 1) * (brown.LAMBDA * step / max(emit, 1) + (1 - brown.LAMBDA) / (n + len(count) + 1)))
        assert abs(total - x["score"]) < 1e-6


def test_training_takes_long_texts(spark):
    r = np.random.default_rng(14)
    rows = [(i, " ".join([*r.choice([f"n{k}" for k in range(300)], 3000), *(["awfulword", "awfulthing"] * 3 if i % 3 == 0 else []), *r.choice([f"n{k}" for k in range(300)], 500)]), int(i % 3 == 0)) for i in range(60)]
    many = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.fit(many.select("doc_id", "text"), many.select("doc_id", "toxic"))
    got = {x["doc_id"]: x["score"] for x in toxicity.score(many.select("doc_id", "text"), net).collect()}
    assert net.trained and np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows]) > 0.95
    # a label table far wider than the documents: what is drawn has texts all the same
    wider = many.select("doc_id", "toxic").unionByName(spark.range(10_000, 60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic")))
    drawn = toxicity.fit(many.select("doc_id", "text"), wider, sample=40)
    alone = toxicity.fit(many.select("doc_id", "text"), many.select("doc_id", "toxic"), sample=40)
    assert drawn.trained and all((drawn.p[k] == alone.p[k]).all() for k in drawn.p)
    small = toxicity.fit(many.select("doc_id", "text"), many.select("doc_id", "toxic"), chars=10)
    assert small.trained  # one text of each label in any case


def test_search_refuses_what_has_no_integer(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e18, 0.0])]
    with pytest.raises(Exception, match="no 64-bit integer"):
        kdtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
