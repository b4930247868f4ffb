"""Merkle dataset manifest: level by level in plain Python against superblocks."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cairnbook.llm import manifest

ROWS = [
    *[(i, "hot", "en", i * 7, f"Text Number {i}" * (i % 4)) for i in range(150)], *[(i, f"s{i % 3}", "de", i, "ÄÖ Mixed Case\n") for i in range(150, 190)],
    (None, "hot", "en", 3, "No Id A"), (None, "hot", None, None, "No Id B"), (None, None, "en", 1, None), (7, "hot", "en", 49, "Again Of 7"), *[(500, "hot", "en", 5, "Same Same")] * 40,
    (501, None, "fr", None, ""), (502, "alone", "fr", 9, "A" * 200_000), (503, "", "fr", 0, "empty source"), (1 << 60, "s1", "en", 2, "Far id"),
]
CLASH = ["key", "id", "leaf", "tampered", "i", "size", "task", "hash", "block", "root", "before"]


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return H("".join(map(encoded, row)))


def lowered(row):
    return (*row[:4], row[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))


def tree(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][a : a + fan])) for a in range(0, len(levels[-1]), fan)])
    return levels


def path(levels, i, fan):
    out = []
    for level in levels[:-1]:
        a = i // fan * fan
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + fan])))
        i //= fan
    return out


def brute(rows, fan):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]], fan)
    top = tree([trees[s][-1][0] for s in order], fan)
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            steps = path(trees[s], i, fan) + path(top, k, fan)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            at = leaf(lowered(r)) if tampered else leaf(r)
            for b, a in steps:
                at = H(b + at + a)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], H("".join(b + a for b, a in steps)), at, at == top[-1][0]))
    return sorted(out, key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.mark.parametrize(("fan", "levels"), [(16, 3), (2, 1), (2, 3), (3, 2)])
def test_manifest_against_brute_force(spark, fan, levels):
    got = manifest.manifest(manifest.leaves(frame(spark, ROWS)), fan, levels).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(ROWS, fan)
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)


@pytest.mark.parametrize("rows", [[], [ROWS[0]], [(None, None, None, None, None)], [(3, "a", "en", 1, "Q")] * 17])
def test_small_tables(spark, rows):
    got = manifest.manifest(manifest.leaves(frame(spark, rows))).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, 16)


def test_more_sources_than_one_superblock(spark):
    rows = [(i, f"source {i}", "en", i, f"T{i}") for i in range(70)]
    got = manifest.manifest(manifest.leaves(frame(spark, rows)), 2, 2).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, 2)


def test_a_superblock_stops_where_its_source_has_one_node():
    assert [len(x) for x in manifest.collapse(["a"], 1, 16, 3)] == [1]
    assert [len(x) for x in manifest.collapse(["a"] * 17, 17, 16, 3)] == [17, 2, 1]
    assert [len(x) for x in manifest.collapse(["a"], 4097, 16, 3)] == [1, 1, 1, 1]
