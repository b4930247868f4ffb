"""Ranked lexical search by dual-sorted wavelet trees per shard (operator 12).

Terms are maximal runs of ASCII letters and digits and of non-ASCII characters, A-Z lowered.  A document's impact for a term is
(10**9 * tf) div (1000 * tf + 12 * m) with m = 75 + (25 * n * N) div L; a term's weight is floor(1000 * ln((2N + 2) / (2df + 1))).

A shard is a run of rows of one scan task.  Its posting lists stand one after the other, each by descending impact, as one sequence
of documents (numbered by ascending id), and that sequence is kept as a wavelet tree over the bits of those numbers: a stable
partition by each bit in turn.  So every list is sorted both ways: a list's interval in a node starts with the list's best
impact among the node's documents, and descending the bits visits documents in the order of ids.

A query takes its lists' intervals down the tree together, best node first.  No document below a node can score more than the sum of
weight * first impact over its intervals, so a node below the k-th result so far is left; at a leaf that sum is the score.  Nodes are
taken up to WIDTH at a time to work on arrays; the results of a shard bound the search of the task's next ones, and those of a first
part of the shards bound all others.  The index is stored and holds every row; queries pass in blocks of bounded size.

Cases: a null text has no terms; texts without terms are no documents of the statistics and never results; rows of one id are documents
each, in any order; null ids come after all others of equal score; items are rows, whatever their ids, and an item without terms, or whose
terms no document holds, has no rows; texts and items of any length are read whole (a text longer than SHARD_BYTES is a shard alone);
empty tables give no rows; columns besides those named take no part.  Terms meet by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnbook.llm.shared import documents, stored, trimmed
from cairnbook.llm.words import Words, chunks

K = 20
SHARD_ROWS, SHARD_BYTES = 4096, 1 << 23
#: Terms of the items that are sent to all tasks at once (16 bytes each), one longer item excepted.
BLOCK = 1 << 18
#: Nodes opened at once, and one in so many shards is searched before the others to bound them.
WIDTH, FIRST = 64, 16
NO_ID = (1 << 63) - 1

IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(column) -> Iterator[Words]:
    return chunks(column, SHARD_BYTES, is_word=IS_TERM)


def statistics(df: DataFrame, text_col: str) -> tuple[int, int]:
    """N, the rows with a term, and L, all their terms."""

    def run(batches):
        for batch in trimmed(batches):
            for part in terms(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array([int((part.counts > 0).sum())]), pa.array([int(part.counts.sum())])], ["n", "l"])

    row = df.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return int(row[0] or 0), int(row[1] or 0)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 25 + (25 * n_docs * n) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Shard:
    """The dual-sorted lists of some documents.

    ids: of the documents with terms, ascending, NO_ID for none; vocabulary: ascending hashes of terms; begins: of their lists;
    bits: of each level, of the documents in that level's order; impact: of the postings, in the first level's order.
    """

    def __init__(self, ids: np.ndarray, vocabulary: np.ndarray, begins: np.ndarray, bits: list[np.ndarray], impact: np.ndarray):
        self.ids, self.vocabulary, self.begins, self.bits, self.impact = ids, vocabulary, begins, bits, impact

    @classmethod
    def build(cls, ids: np.ndarray, counts: np.ndarray, hashes: np.ndarray, n_docs: int, n_terms: int) -> Shard:
        """ids and numbers of terms of the rows, and the hashes of their terms one row after the other."""
        place = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), np.int64)
        some = place[counts[place] > 0]
        number[some] = np.arange(len(some))
        vocabulary, term = np.unique(hashes, return_inverse=True)
        width = max(1, len(some))
        pair, tf = np.unique(term * width + np.repeat(number, counts), return_counts=True)
        term, doc = pair // width, pair % width
        impact = impacts(tf, counts[some][doc], n_docs, n_terms)
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order], impact[order]
        bits, level = [], doc
        for shift in range(max(0, len(some) - 1).bit_length() - 1, -1, -1):
            bit = (level >> shift & 1).astype(bool)
            bits.append(bit)
            level = np.concatenate((level[~bit], level[bit]))
        return cls(ids[some], vocabulary, np.searchsorted(term, np.arange(len(vocabulary) + 1)), bits, impact)

    def columns(self) -> list[bytes]:
        """The vocabulary, the lengths of its lists, and the rest, as bytes."""
        rest = struct.pack("<QQQ", len(self.ids), len(self.impact), len(self.bits)) + self.ids.astype("<i8").tobytes() + self.impact.astype("<u4").tobytes()
        return [self.vocabulary.astype("<u8").tobytes(), np.diff(self.begins).astype("<u4").tobytes(), rest + b"".join(np.packbits(b).tobytes() for b in self.bits)]

    @classmethod
    def read(cls, vocabulary, sizes, rest) -> Shard:
        n, p, height = struct.unpack_from("<QQQ", rest, 0)
        at = 24 + 8 * n + 4 * p
        wide = -(-p // 8)
        bits = [np.unpackbits(np.frombuffer(rest, np.uint8, wide, at + i * wide), count=p).astype(bool) for i in range(height)]
        begins = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))))
        return cls(np.frombuffer(rest, "<i8", n, 24), np.frombuffer(vocabulary, "<u8"), begins, bits, np.frombuffer(rest, "<u4", p, 24 + 8 * n).astype(np.int64))

    def opened(self) -> Shard:
        """Makes the tables that searches read: ones before each place of a level, and impacts in each level's order."""
        p, height = len(self.impact), len(self.bits)
        self.ones, self.zeros = np.zeros((max(1, height), p + 1), np.int32), np.zeros(max(1, height), np.int64)
        self.level = np.zeros((height + 1, p + 1), np.int32)
        self.level[0, :p] = now = self.impact.astype(np.int32)
        for i, bit in enumerate(self.bits):
            np.cumsum(bit, out=self.ones[i, 1:])
            self.zeros[i] = p - self.ones[i, p]
            self.level[i + 1, :p] = now = np.concatenate((now[~bit], now[bit]))
        return self

    def lists(self, hashes: np.ndarray) -> np.ndarray:
        """The list of each term, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1) if len(self.vocabulary) else np.full(len(hashes), -1)

    def search(self, lists: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], floor: int, k: int) -> int:
        """Improve best, up to k pairs (score, -id), a heap with the worst first; floor: a score that k results are known to reach.

        Returns the number of nodes opened.
        """
        has = (lists >= 0) & (weights > 0)
        if not has.any():
            return 0
        lists, weights = lists[has], weights[has]
        height, opened = len(self.bits), 0
        low, high = self.begins[lists][None, :], self.begins[lists + 1][None, :]
        pool = [(low, high)]
        heap = [(-int((self.level[0, low[0]] * weights).sum()), 0, 0, 0, 0)]  # -bound, first document, level, chunk, row
        floor = max(floor, 1)

        def hopeless(bound: int, first: int) -> bool:
            return bound < floor or (len(best) == k and (bound, -int(self.ids[first])) < best[0])

        while heap:
            taken = []
            while heap and len(taken) < WIDTH:
                bound, first, level, chunk, row = heapq.heappop(heap)
                if hopeless(-bound, first):
                    if -bound < floor or -bound < best[0][0]:
                        heap = []
                    continue
                if level == height:
                    item = (-bound, -int(self.ids[first]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    else:
                        heapq.heapreplace(best, item)
                    if len(best) == k:
                        floor = max(floor, best[0][0])
                else:
                    taken.append((level, first, chunk, row))
            if not taken:
                continue
            opened += len(taken)
            level = np.array([t[0] for t in taken])
            low, high = (np.concatenate([pool[c][side][r : r + 1] for _, _, c, r in taken]) for side in (0, 1))
            ones_low, ones_high = self.ones[level[:, None], low], self.ones[level[:, None], high]
            zeros = self.zeros[level][:, None]
            low, high = np.concatenate((low - ones_low, zeros + ones_low)), np.concatenate((high - ones_high, zeros + ones_high))
            below = np.concatenate((level, level)) + 1
            bounds = (np.where(high > low, self.level[below[:, None], low], 0) * weights).sum(1)
            firsts = np.array([t[1] for t in taken])
            firsts = np.concatenate((firsts, firsts + (1 << (height - 1 - level))))
            keep = np.flatnonzero((bounds >= floor) & (firsts < len(self.ids)))
            pool.append((low[keep], high[keep]))
            for row, (b, f, lv) in enumerate(zip(bounds[keep].tolist(), firsts[keep].tolist(), below[keep].tolist(), strict=True)):
                heapq.heappush(heap, (-b, f, lv, len(pool) - 1, row))
        return opened


def index(df: DataFrame, id_col: str, text_col: str, n_docs: int, n_terms: int) -> DataFrame:
    """(shard, vocabulary, sizes, rest): every row of df in one shard, stored."""

    def run(batches):
        for batch in trimmed(batches):
            ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for part in terms(batch.column("text")):
                at = np.concatenate(([0], np.cumsum(part.counts)))
                for a in range(0, len(part.counts), SHARD_ROWS):
                    b = min(a + SHARD_ROWS, len(part.counts))
                    if at[b] > at[a]:
                        made = Shard.build(ids[part.first + a : part.first + b], part.counts[a:b], part.hashes[at[a] : at[b]], n_docs, n_terms)
                        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made.columns()], ["vocabulary", "sizes", "rest"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = rows.mapInArrow(run, "vocabulary binary, sizes binary, rest binary")
    return stored(made.select(F.monotonically_increasing_id().alias("shard"), "*"), "lexical-index")


def frequencies(shards: DataFrame) -> DataFrame:
    """(term, df) over all shards."""

    def run(batches):
        for batch in trimmed(batches):
            for v, n in zip(batch.column("vocabulary"), batch.column("sizes"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(v.as_buffer(), "<i8")), pa.array(np.frombuffer(n.as_buffer(), "<u4").astype(np.int64))], ["term", "df"])

    return shards.select("vocabulary", "sizes").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weighted(items: DataFrame, shards: DataFrame, n_docs: int, id_col: str, text_col: str) -> DataFrame:
    """(uid, item_id, terms, weights) of the items that hold a term of the corpus: weight times occurrences in the item."""

    def run(batches):
        for batch in trimmed(batches):
            for part in terms(batch.column("text")):
                owner = np.repeat(np.arange(part.first, part.first + len(part.counts)), part.counts)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(owner)) for c in ("uid", "item_id")] + [pa.array(part.hashes.view(np.int64))], ["uid", "item_id", "term"])

    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "lexical-items")
    of = rows.mapInArrow(run, "uid long, item_id long, term long").groupBy("uid", "item_id", "term").agg(F.count("*").alias("n"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    held = of.join(frequencies(shards), "term").select("uid", "item_id", F.struct("term", (weight * F.col("n")).alias("weight")).alias("t"))
    held = held.groupBy("uid", "item_id").agg(F.collect_list("t").alias("t"))
    return stored(held.select("uid", "item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")), "lexical-queries")


def blocks(queries: DataFrame, size: int) -> Iterator[tuple[list[tuple[int, int | None]], np.ndarray, np.ndarray, np.ndarray]]:
    """Items, hashes, weights and ends of their terms, at most size terms at a time or one item; read a partition at a time."""
    held, n = [], 0

    def made():
        ends = np.cumsum([len(r["terms"]) for r in held])
        return [(r["uid"], r["item_id"]) for r in held], np.concatenate([np.array(r["terms"], np.int64) for r in held]).view(np.uint64), np.concatenate([np.array(r["weights"], np.int64) for r in held]), ends

    for row in queries.toLocalIterator():
        if held and n + len(row["terms"]) > size:
            yield made()
            held, n = [], 0
        held.append(row)
        n += len(row["terms"])
    if held:
        yield made()


_FOUND = "uid long, item_id long, doc_id long, score long"


def _search(shards: DataFrame, sent, floors, k: int) -> DataFrame:
    """The k best documents of each item among the shards of each task."""

    def run(batches):
        items, hashes, weights, ends = sent.value
        least = floors.value if floors else {}
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for batch in trimmed(batches):
            for i in range(batch.num_rows):
                shard = Shard.read(*[batch.column(c)[i].as_buffer() for c in ("vocabulary", "sizes", "rest")]).opened()
                lists, at = shard.lists(hashes), 0
                for (uid, _), end, own in zip(items, ends.tolist(), best, strict=True):
                    shard.search(lists[at:end], weights[at:end], own, least.get(uid, 0), k)
                    at = end
        rows = [(uid, item, None if doc == -NO_ID else -doc, score) for (uid, item), own in zip(items, best, strict=True) for score, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], ["uid", "item_id", "doc_id", "score"])

    return shards.select("vocabulary", "sizes", "rest").mapInArrow(run, _FOUND)


def ranked(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = K, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item with a score above 0."""
    spark = df.sparkSession
    n_docs, n_terms = statistics(df, text_col)
    shards = index(df, id_col, text_col, n_docs, n_terms)
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    early = F.pmod(F.xxhash64("shard"), F.lit(first)) == 0
    parts = []
    for query in blocks(weighted(items, shards, n_docs, item_col, item_text_col), block):
        sent = spark.sparkContext.broadcast(query)
        seeds = stored(_search(shards.where(early), sent, None, k), "lexical-seeds")
        kth = seeds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("uid", "score")
        floors = spark.sparkContext.broadcast({r["uid"]: r["score"] for r in kth.collect()})  # a number for each item of the block
        rest = stored(_search(shards.where(~early), sent, floors, k), "lexical-found")
        parts += [seeds, rest]
        sent.destroy()
        floors.destroy()
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, {_TERMS} AS ts FROM documents),
size AS (SELECT u, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM size),
tf AS (SELECT u, t, count(*) AS tf FROM (SELECT u, unnest(ts) AS t FROM d) GROUP BY u, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total),
q AS (SELECT v, item_id, t, count(*) AS c FROM (SELECT v, item_id, unnest(ts) AS t FROM (SELECT row_number() OVER () AS v, item_id, {_TERMS} AS ts FROM benchmark)) GROUP BY v, item_id, t),
s AS (SELECT v, item_id, u, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // l)))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN size USING (u), total GROUP BY v, item_id, u, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY v ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}
"""
