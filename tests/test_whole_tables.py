"""Queries that once covered a part of their table only, against Python on whole tables."""

import html
from collections import defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from cairnbook.plans.catalogue import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


def rows(table, *columns):
    return list(zip(*(pq.read_table(f"{DIR}/{table}.parquet", columns=list(columns))[c].to_pylist() for c in columns), strict=True))


def test_html_escape_takes_whole_pages(spark):
    want = {i: None if x is None else html.escape(x) for i, x in rows("pages", "page_id", "html")}
    assert any(len(x) > 400 for x in want.values())
    assert {r["page_id"]: r["escaped"] for r in QUERIES["d37_html_escape"](spark, DIR).collect()} == want


def test_lookup_lists_of_all_orders(spark):
    want = defaultdict(list)
    for order, line in rows("lineitem", "l_orderkey", "l_linenumber"):
        want[order].append(line)
    known = {o for (o,) in rows("orders", "o_orderkey")}
    want = {o: sorted(x) for o, x in want.items() if o in known}
    assert max(want) >= 500
    assert {r["o_orderkey"]: r["lines"] for r in QUERIES["j12_lookup_lists"](spark, DIR).collect()} == want


def test_hamming_join_of_all_parts(spark):
    hashes = []
    for (p,) in rows("part", "p_partkey"):
        x = p * 2654435761 % 2**32 * 3
        hashes += [(p, x), (p + 1000000, x ^ 1 << p % 20)]
    pairs = {(a, b): (x ^ y).bit_count() for a, x in hashes for b, y in hashes if a < b}
    want = {p: n for p, n in pairs.items() if n <= 8}
    got = QUERIES["j15_hamming_join"](spark, DIR).collect()
    assert {(r["document_id"], r["other_id"]): r["distance"] for r in got} == want and len(got) == len(want)
    assert all(abs(r["score"] - (1 - r["distance"] / 64)) < 1e-12 for r in got)


def test_unit_vectors_keep_the_sign_of_zero(spark, tmp_path):
    vectors = [[1.0, -1e-7, 0.0, -0.0], [-3.0, 4.0], [1.0, -4e-7, -6e-7], None]
    table = pa.table({"vec_id": pa.array(range(4), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    want = duckdb.from_arrow(table).query("embeddings", SQL["d34_l2_normalise"]).fetchall()
    got = {r["vec_id"]: r["unit"] for r in QUERIES["d34_l2_normalise"](spark, str(tmp_path)).collect()}
    assert {i: repr(x) for i, x in want} == {i: repr(x) for i, x in got.items()} and "-0.0" in repr(got[0])
