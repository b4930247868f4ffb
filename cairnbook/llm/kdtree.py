"""Exact top-k inner-product search by KD-trees per shard (operator 2).

Vectors become integers, floor(1024 * x).  Candidates are dealt to shards of about SHARD rows; each shard is a
KD-tree: median splits of the widest coordinate down to LEAF rows, every node with its tight bounding box and
its smallest id.  For a box (low, high) and a query q no score in it exceeds

    sum over coordinates of max(q_i, 0) * high_i + min(q_i, 0) * low_i.

Each query walks a tree best bound first and stops when no open box can beat its k-th result.  Queries come in
blocks of BLOCK.  A block first searches one home shard; the k-th scores found there go along to all other
shards, and inside a task each shard starts from the best of what the shards before it gave.

Cases: vectors that are null or hold null, NaN or infinite components, and rows with a null id, take no part;
a query meets candidates of its own number of components only; rows of one id are candidates each, and the
query's own row alone is left out; ties go to the smaller id; fewer than k candidates give all of them.
Scores are exact below 2**63 (floating-point products are used only where all sums stay below 2**53); a finite
component whose integer does not fit 63 bits has no score to return and raises ValueError.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnbook.llm.shared import stored

K, EVERY, SCALE = 10, 100, 1024
SHARD, LEAF, BLOCK = 8192, 32, 1024


class Tree:
    """A KD-tree over rows (ids, uids, integer vectors)."""

    def __init__(self, ids, uids, vectors, spans, kids, low, high, least):
        self.ids, self.uids, self.vectors = ids, uids, vectors
        self.spans, self.kids, self.low, self.high, self.least = spans, kids, low, high, least

    @classmethod
    def build(cls, ids: np.ndarray, uids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(ids))
        spans, kids, low, high = [], [], [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, which = stack.pop()
            node = len(spans)
            some = vectors[order[a:b]]
            spans.append((a, b))
            kids.append([-1, -1])
            low.append(some.min(0) if b > a else np.zeros(vectors.shape[1], np.int64))
            high.append(some.max(0) if b > a else np.zeros(vectors.shape[1], np.int64))
            if parent >= 0:
                kids[parent][which] = node
            if b - a > leaf and vectors.shape[1] and (spread := high[-1] - low[-1]).max() > 0:
                widest = int(np.argmax(spread))
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(some[:, widest], half)]
                stack += [(a + half, b, node, 1), (a, a + half, node, 0)]
            elif b - a > leaf:  # all alike: by id
                order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
        least = np.array([ids[order[a:b]].min() if b > a else 0 for a, b in spans])
        return cls(ids[order], uids[order], vectors[order], np.array(spans), np.array(kids), np.array(low), np.array(high), least)

    _parts = (("ids", "<i8"), ("uids", "<i8"), ("vectors", "<i8"), ("spans", "<i8"), ("kids", "<i8"), ("low", "<i8"), ("high", "<i8"), ("least", "<i8"))

    def to_bytes(self) -> bytes:
        small = "<i4" if not self.vectors.size or np.abs(self.vectors).max() < 1 << 31 else "<i8"
        kinds = [small if name in ("vectors", "low", "high") else kind for name, kind in self._parts]
        head = struct.pack("<QQQQ", len(self.ids), self.vectors.shape[1], len(self.spans), small == "<i4")
        return head + b"".join(getattr(self, name).astype(kind).tobytes() for (name, _), kind in zip(self._parts, kinds, strict=True))

    @classmethod
    def from_bytes(cls, data) -> Tree:
        n, d, m, small = struct.unpack_from("<QQQQ", data, 0)
        shapes = {"ids": (n,), "uids": (n,), "vectors": (n, d), "spans": (m, 2), "kids": (m, 2), "low": (m, d), "high": (m, d), "least": (m,)}
        at, out = 32, []
        for name, kind in cls._parts:
            kind = "<i4" if small and name in ("vectors", "low", "high") else kind
            part = np.frombuffer(data, kind, int(np.prod(shapes[name])), at).reshape(shapes[name])
            at += part.nbytes
            out.append(part.astype(np.int64))
        return cls(*out)

    def search(self, queries: np.ndarray, uids: np.ndarray, best: list[list[tuple[int, int, int]]], floor: np.ndarray, k: int) -> int:
        """Improve best, for each query up to k tuples (score, -id, -uid), a heap with the worst first; floor: a score that k results are known to reach.

        Returns the number of leaves read.
        """
        if not len(self.ids) or not len(queries):
            return 0
        exact = float(np.abs(queries).max(initial=0)) * float(max(np.abs(self.high).max(initial=0), np.abs(self.low).max(initial=0))) * max(1, queries.shape[1]) < 2**53
        kind = np.float64 if exact else object
        q, vectors = queries.astype(kind), self.vectors.astype(kind)
        bounds = np.maximum(q, 0) @ self.high.astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T
        read = 0
        for i in range(len(q)):
            heap, own, low = best[i], bounds[i], floor[i]
            if len(heap) == k:
                low = max(low, heap[0][0])
            open_ = [(-own[0], 0)]
            while open_:
                bound, node = heapq.heappop(open_)
                bound = -bound
                if bound < low:
                    break
                if len(heap) == k and (bound, -self.least[node]) < heap[0][:2]:
                    if bound < heap[0][0]:
                        break
                    continue
                left, right = self.kids[node]
                if left >= 0:
                    for kid in (left, right):
                        if own[kid] >= low:
                            heapq.heappush(open_, (-own[kid], kid))
                    continue
                read += 1
                a, b = self.spans[node]
                scores = vectors[a:b] @ q[i]
                some = np.flatnonzero(scores >= low)
                if len(some) > 2 * k:  # the k best of the leaf by score, then id
                    some = some[np.lexsort((self.uids[a:b][some], self.ids[a:b][some], -scores[some].astype(np.int64)))][: k + 1]
                for j in some.tolist():
                    uid = int(self.uids[a + j])
                    if uid == uids[i]:
                        continue
                    item = (int(scores[j]), -int(self.ids[a + j]), -uid)
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
                if len(heap) == k:
                    low = max(low, heap[0][0])
        return read


def _vectors(column, n: int) -> np.ndarray:
    """Integer vectors of an Arrow list column without nulls, n rows of one length."""
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    scaled = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if np.abs(scaled).max(initial=0) >= float(1 << 63):
        raise ValueError(f"a vector component exceeds {(1 << 63) // SCALE} and has no 64-bit integer")
    return scaled.astype(np.int64).reshape(n, -1)


def _index(rows: DataFrame) -> DataFrame:
    """(dim, shard, tree) of groups of about SHARD rows."""

    def build(table: pa.Table) -> pa.Table:
        tree = Tree.build(table["vec_id"].to_numpy(), table["uid"].to_numpy(), _vectors(table["embedding"], table.num_rows))
        return pa.table({"dim": table["dim"][:1], "shard": table["shard"][:1], "tree": pa.array([tree.to_bytes()], pa.binary())})

    return rows.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary")


def _blocks(rows: DataFrame) -> DataFrame:
    """(dim, block, queries) of groups of about BLOCK query rows."""

    def gather(table: pa.Table) -> pa.Table:
        parts = (table["vec_id"].to_numpy(), table["uid"].to_numpy(), _vectors(table["embedding"], table.num_rows))
        data = struct.pack("<QQ", table.num_rows, parts[2].shape[1]) + b"".join(p.astype("<i8").tobytes() for p in parts)
        return pa.table({"dim": table["dim"][:1], "block": table["block"][:1], "queries": pa.array([data], pa.binary())})

    return rows.groupBy("dim", "block").applyInArrow(gather, "dim int, block int, queries binary")


def _read_block(data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, d = struct.unpack_from("<QQ", data, 0)
    ids, uids = np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "<i8", n, 16 + 8 * n)
    return ids, uids, np.frombuffer(data, "<i8", n * d, 16 + 16 * n).reshape(n, d)


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """Results of (dim, block, shard, queries, floors, tree) rows: at most k for each query, block and run of shards."""

    def run(batches):
        held = None  # dim and block, (ids, uids, vectors), best, floor

        def results():
            rows = [(int(i), int(u), -v, s) for i, u, heap in zip(held[1][0], held[1][1], held[2], strict=True) for s, v, _ in heap]
            a, b, c, d = ([r[j] for r in rows] for j in range(4))
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]] * len(rows), pa.int32()), pa.array([held[0][1]] * len(rows), pa.int32()), *[pa.array(x, pa.int64()) for x in (a, b, c, d)]], ["dim", "block", "query_id", "uid", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column("dim")[i].as_py(), batch.column("block")[i].as_py())
                if held is None or held[0] != key:
                    if held:
                        yield results()
                    ids, uids, vectors = _read_block(batch.column("queries")[i].as_buffer())
                    floors = dict(zip(*[(batch.column("floors")[i].as_py() or {}).get(x) or [] for x in ("uids", "scores")], strict=True))
                    held = (key, (ids, uids, vectors), [[] for _ in ids], np.array([floors.get(u, -(1 << 63)) for u in uids.tolist()], object))
                Tree.from_bytes(batch.column("tree")[i].as_buffer()).search(held[1][2], held[1][1], held[2], held[3], k)
        if held:
            yield results()

    return pairs.sortWithinPartitions("dim", "block").mapInArrow(run, "dim int, block int, query_id long, uid long, vec_id long, score long")


_FLOORS = "struct<uids:array<long>,scores:array<long>>"


def top_k(df: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query: rows with an id divisible by every."""
    dim = F.size(vector_col)
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(usable).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("vec_id"), dim.alias("dim"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = stored(rows, "knn-vectors")
    is_query = F.col("vec_id") % every == 0
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"))
    sizes = stored(sizes.select("dim", F.expr(f"cast((n + {SHARD} - 1) div {SHARD} as int)").alias("shards"), F.expr(f"cast(greatest(1, (q + {BLOCK} - 1) div {BLOCK}) as int)").alias("blocks")), "knn-sizes")
    placed = rows.join(F.broadcast(sizes), "dim") if sizes.count() <= 1000 else rows.join(sizes, "dim")
    index = stored(_index(placed.withColumn("shard", F.pmod(F.xxhash64("uid"), F.col("shards")).cast("int"))), "knn-index")
    blocks = _blocks(placed.where(is_query).withColumn("block", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("blocks")).cast("int")))
    blocks = stored(blocks.join(sizes, "dim").select("dim", "block", "queries", "shards"), "knn-blocks")
    home = F.pmod(F.col("block"), F.col("shards")).cast("int")
    first = blocks.withColumn("shard", home).withColumn("floors", F.lit(None).cast(_FLOORS)).join(index, ["dim", "shard"]).select("dim", "block", "queries", "floors", "tree")
    seeds = stored(_search(first, k), "knn-seeds")
    kth = seeds.groupBy("dim", "block", "uid").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= k)
    floors = kth.groupBy("dim", "block").agg(F.struct(F.collect_list("uid").alias("uids"), F.collect_list("score").alias("scores")).alias("floors"))
    others = F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: s != home)
    rest = blocks.join(floors, ["dim", "block"], "left").withColumn("shard", F.explode(others)).join(index, ["dim", "shard"]).select("dim", "block", "queries", "floors", "tree")
    found = seeds.unionByName(_search(rest, k)).select("query_id", "uid", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
