"""N-gram Jaccard join by count-vector R-trees (operator 8).

A text's set holds the hashes of its distinct n-word shingles (one shingle of all words for a shorter
text; nothing for a text without words).  Two texts link when their sets' Jaccard similarity reaches
num / den.  The result is one row per document with its set's size and the smallest doc_id that links
reach.  No candidate is left out at any step:

1. Texts of equal sets are one set with many members; only sets go on.
2. Sets that link share one of the first size - ceil(threshold * size) + 1 shingles in any one order
   (prefix filter).  The order here: shingles whose hash lies in the lowest 2 * (1 - threshold) of all hashes
   come first, by the number of sets that have them, then all others by hash.  Every set reports all its shingles
   of that zone, so that the number is exact but for the HOT most frequent shingles: these, found in one of EVERY
   sets, have an estimate (any order serves, as long as all sets share it), and their reports are salted, so that
   no shingle's reports gather in one task.  A set of mostly unshared text has a prefix of unshared shingles and
   drops out; passages of many documents come late.  Sets that share a prefix shingle and could link by their
   sizes, directly or through others, form a cluster; each link lies inside a cluster.
3. Each cluster is joined by an R-tree of count vectors (see rtree).  A cluster of more than BLOCK sets is cut
   into blocks of BLOCK, each with the cluster's smallest set as hub; afterwards, pairs of blocks are
   joined unless all their sets are in one component by then, in component order, so that a large group of
   near copies costs few pairs of blocks.

Cases: a null or empty text is its own component of size 0; repeated rows and equal texts are one
component; a null id takes the component's smallest id (null if none has one).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnbook.llm import rtree, words
from cairnbook.llm.components import components
from cairnbook.llm.shared import documents, sliced, stored, trimmed

SHINGLE_WORDS, NUM, DEN = 4, 85, 100
BLOCK = 512
BLOOM_BITS = 1 << 26
HOT, EVERY, SEEN, SALT = 1 << 16, 64, 16, 64


def _sets(column, n: int):
    """For each text of an Arrow column its sorted distinct shingle hashes."""
    for chunk in words.chunks(column):
        for hashes in words.shingles(chunk.hashes, chunk.counts, n):
            yield np.unique(hashes)


def _identity(values: np.ndarray) -> int:
    """64 bits that name a set; 0 for the empty set."""
    if not len(values):
        return 0
    total = np.array([words.mix(values).sum(), np.bitwise_xor.reduce(values), len(values)], np.uint64)
    return int(words.mix((total * words._SHINGLE[:3]).sum(keepdims=True)).view(np.int64)[0]) or 1


def _zone(num: int, den: int) -> int:
    """Upper end of the zone of hashes whose shingles are counted."""
    return (2 * (den - num) << 64) // den


def _prefix(n, num: int, den: int):
    """Length of the prefix of a set of n shingles."""
    return n - -(-num * n // den) + 1


def _scan(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, hash of the text, set id, set size, shingles in the zone) of each row; of one in EVERY sets the shingles themselves, once per task."""
    top = np.uint64(min(_zone(num, den), (1 << 64) - 1))

    def run(batches):
        seen: set[int] = set()
        for batch in sliced(batches):
            got, some = [], []
            for x in _sets(batch.column("text"), n):
                sid, zone = _identity(x), int(np.searchsorted(x, top))
                got.append((sid, len(x), zone))
                drawn = sid and sid % EVERY == 0 and sid not in seen
                if drawn:
                    seen.add(sid)
                some.append(x[: max(_prefix(len(x), num, den), zone)].view(np.int64) if drawn else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), *[pa.array([g[i] for g in got], pa.int64()) for i in range(3)], pa.array(some, pa.list_(pa.int64()))], ["doc_id", "tie", "sid", "n", "zone", "some"])

    return rows.mapInArrow(run, "doc_id long, tie long, sid long, n long, zone long, some array<long>")


def _hot(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most HOT shingles that SEEN or more of the drawn sets report, ascending, and the estimated number of their sets."""
    drawn = docs.where("some is not null").groupBy("sid").agg(F.first("some").alias("some"))
    counts = drawn.select(F.explode("some").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= SEEN)
    got = counts.orderBy(F.desc("c"), "key").limit(HOT).toArrow()
    key, c = got["key"].to_numpy().view(np.uint64), got["c"].to_numpy() * EVERY
    order = np.argsort(key)
    return key[order], c[order]


def _reports(rows: DataFrame, n: int, num: int, den: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(sid, key, mark): of each set once per task its zone's shingles, and as many more by hash as the prefix needs.

    mark: of hot shingles SALT times their number of sets, plus a salt; 0 of all others.
    """
    top = np.uint64(min(_zone(num, den), (1 << 64) - 1))
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        seen: set[int] = set()
        hot_keys, hot_df = shared.value
        for batch in sliced(batches):
            ids, sizes, out = [], [], []
            for values in _sets(batch.column("text"), n):
                if not len(values) or (sid := _identity(values)) in seen:
                    continue
                seen.add(sid)
                length = max(_prefix(len(values), num, den), int(np.searchsorted(values, top)))
                ids.append(sid)
                sizes.append(length)
                out.append(values[:length])
            flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
            mark = np.zeros(len(flat), np.int64)
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, flat), len(hot_keys) - 1)
                salt = np.repeat(np.array(ids, np.int64), sizes) % SALT
                mark = np.where(hot_keys[at] == flat, hot_df[at] * SALT + salt, 0)
            kinds = pa.StructArray.from_arrays([pa.array(flat.view(np.int64)), pa.array(mark)], ["key", "mark"])
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), kinds)], ["sid", "keys"])

    return rows.mapInArrow(run, "sid long, keys array<struct<key:long,mark:long>>").select("sid", F.inline("keys"))


def _candidates(rows: DataFrame, docs: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) between sets that share a prefix shingle: each set to the smallest of its size's neighbourhood."""
    # the reports are shuffled once; what only one set reports is left out before the next shuffle
    of_key = Window.partitionBy("key", "mark")
    met = _reports(rows, n, num, den, _hot(docs)).withColumn("low", F.min("sid").over(of_key)).withColumn("high", F.max("sid").over(of_key)).withColumn("found", F.count("*").over(of_key))
    met = met.where("mark > 0 or low <> high").select("sid", "key", "mark", "found").distinct().select("sid", "key", F.when(F.col("mark") > 0, F.expr(f"mark div {SALT}")).otherwise(F.col("found")).alias("df"))
    # unsigned order of the hash: the zone is [0, top)
    top = min(_zone(num, den), (1 << 64) - 1)
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    outside = unsigned >= F.lit(top - (1 << 63))
    some = met.join(sets.select("sid", "n", "zone"), "sid").withColumn("outside", outside)
    by_set = Window.partitionBy("sid")
    ordered = by_set.orderBy("outside", F.when(F.col("outside"), 0).otherwise(F.col("df")), unsigned)
    length = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1
    # shared shingles of the zone come after its unshared ones; those outside it stand at a place known to be inside the prefix
    first = F.col("zone") - F.count_if(~F.col("outside")).over(by_set)
    kept = some.withColumn("place", F.row_number().over(ordered) + first).where(F.col("outside") | (F.col("place") <= length))
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num) * (1 + 1e-9)))
    posting = kept.select("sid", "key", F.explode(F.array(size_class, size_class + 1)).alias("size"))
    low = posting.groupBy("key", "size").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low <> high")
    return posting.join(low, ["key", "size"]).where("sid <> low").select(F.col("sid").alias("a"), F.col("low").alias("b")).distinct()


def _bloom_cells(doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = words.mix(doc.view(np.uint64))
    return (x % np.uint64(bits)).astype(np.int64), ((x >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def _bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the doc_ids, of BLOOM_BITS at most; it only spares work (false hits are joined away)."""
    n = ids.count()
    bits = min(BLOOM_BITS, 1 << max(13, (16 * n).bit_length()))

    def run(batches):
        mask = np.zeros(bits, bool)
        for batch in trimmed(batches):
            for cells in _bloom_cells(batch.column(0).to_numpy(), bits):
                mask[cells] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(mask).tobytes()], pa.binary())], ["mask"])

    out = np.zeros(bits // 8, np.uint8)
    for row in ids.coalesce(4).mapInArrow(run, "mask binary").toLocalIterator():
        out |= np.frombuffer(row["mask"], np.uint8)
    return out


def _members(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(sid, tokens) once of the wanted (doc_id, sid) and of a few other sets; the texts are read again, most stop at a Bloom filter.

    Sets without any id are looked for among all rows without id.  Rows are dealt by sid, so that a join by sid, which drops
    the sets that were not wanted, shuffles no tokens.
    """
    mask = rows.sparkSession.sparkContext.broadcast(_bloom(wanted.where("doc_id is not null").select("doc_id")))
    nameless = wanted.where("doc_id is null").limit(1).count() > 0

    def run(batches):
        bits = len(mask.value) * 8
        for batch in sliced(batches):
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            a, b = _bloom_cells(batch.column("doc_id").fill_null(0).to_numpy(), bits)
            hit = (mask.value[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & (mask.value[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1
            some = np.flatnonzero(np.where(null, nameless, hit))
            part = batch.take(pa.array(some))
            got = list(_sets(part.column("text"), n))
            yield pa.RecordBatch.from_arrays([pa.array([_identity(x) for x in got], pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())], ["sid", "tokens"])

    return rows.mapInArrow(run, "sid long, tokens binary").dropDuplicates(["sid"])


def _joined(tasks: DataFrame, num: int, den: int) -> DataFrame:
    """Links found inside each task: groups of rows (task, side, sid, label, tokens) of bounded size."""

    def run(table: pa.Table) -> pa.Table:
        sids, at = np.unique(table["sid"].to_numpy(), return_index=True)
        tokens = table["tokens"].take(pa.array(at)).to_pylist()
        side = table["side"].take(pa.array(at)).to_numpy()
        found = rtree.link([np.frombuffer(t, np.uint64) for t in tokens], table["label"].take(pa.array(at)).to_numpy(), num, den, side if (side >= 0).all() else None)
        a, b = (np.array([p[i] for p in found], np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(sids[a], pa.int64()), "b": pa.array(sids[b], pa.int64())})

    return tasks.groupBy("task", "task2", "task3").applyInArrow(run, "a long, b long")


def link_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id."""
    docs, sets, linked = _linked(df, id_col, text_col, n, num, den)
    lowest = stored(linked.groupBy("root").agg(F.min("doc_id").alias("component")), "jaccard-lowest")
    copied = sets.where("copies > 1").join(linked.select("sid"), "sid", "left_anti").select(F.col("sid").alias("of"), F.col("doc_id").alias("component"))
    names = stored(linked.join(lowest, "root").select(F.col("sid").alias("of"), "component").unionByName(copied), "jaccard-names")
    return docs.join(names, docs["sid"] == names["of"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("of").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, tie, rows, keep) of all rows of components of several rows; tie: xxhash64 of the text, rows: rows equal in both.

    Of each component the row of the smallest id is kept (rows without id come last; of one id the smallest tie): of rows equal
    in both, one.  Rows that are not listed are alone and stay.
    """
    docs, sets, linked = _linked(df, id_col, text_col, n, num, den)
    copied = sets.where("copies > 1").join(linked.select("sid"), "sid", "left_anti").select("sid", F.col("sid").alias("root"))
    several = stored(linked.select("sid", "root").unionByName(copied), "jaccard-several")
    kinds = stored(docs.join(several, "sid").groupBy("root", "doc_id", "tie").agg(F.count("*").alias("rows")), "jaccard-kinds")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    best = stored(kinds.groupBy("root").agg(F.min(order).alias("best")), "jaccard-best")
    return kinds.join(best, "root").select("doc_id", "tie", "rows", (order == F.col("best")).alias("keep"))


def _linked(df: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, tie, sid, n), sets (sid, doc_id, copies) and linked sets (sid, doc_id, root: smallest set that links reach)."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = stored(_scan(rows.withColumn("tie", F.xxhash64("text")), n, num, den), "jaccard-scan")
    # sets with their first member
    sets = docs.where("sid <> 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("zone").alias("zone"), F.count("*").alias("copies"))
    sets = stored(sets, "jaccard-named")
    edges = _candidates(rows, docs, sets, n, num, den)
    cluster = stored(components(edges, name="jaccard-clusters"), "jaccard-cluster")
    member = stored(cluster.join(sets, cluster["node"] == sets["sid"]).select("sid", "doc_id", F.col("root").alias("cluster")), "jaccard-members")
    # blocks of a cluster; a cluster's smallest set is the hub of each of its blocks
    size = member.groupBy("cluster").agg(F.count("*").alias("size"), F.min("sid").alias("hub"))
    blocks = F.greatest(F.lit(1), F.expr(f"(size + {BLOCK // 2} - 1) div {BLOCK // 2}"))
    placed = member.join(size, "cluster").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")))
    at = F.when((F.col("sid") == F.col("hub")) & (F.col("blocks") > 1), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.col("block").cast("long")))
    first = placed.select("sid", "cluster", F.explode(at).alias("task2"))
    # tokens, most of all bytes, are shuffled twice, by set and by block, and stored nowhere: the few of open clusters are read again
    tasks = first.join(_members(rows, member, n), "sid").select(F.col("cluster").alias("task"), "task2", F.lit(0).cast("long").alias("task3"), F.lit(-1).alias("side"), "sid", F.col("sid").alias("label"), "tokens")
    links = stored(_joined(tasks, num, den), "jaccard-links")
    # pairs of blocks of large clusters that have more than one component still
    large = placed.where("blocks > 1").select("sid", "cluster")
    if large.limit(1).count():
        known = components(links, name="jaccard-part") if links.limit(1).count() else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        labelled = stored(large.join(known, large["sid"] == known["node"], "left").select("sid", "cluster", F.coalesce("root", "sid").alias("label")), "jaccard-labels")
        open_ = labelled.groupBy("cluster").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).where("x <> y")
        if open_.limit(1).count():
            again = _members(rows, member.join(open_.select("cluster"), "cluster", "left_semi"), n)
            links = links.unionByName(stored(_pairs(labelled, open_, again, num, den), "jaccard-more"))
    found = components(links, name="jaccard-found") if links.limit(1).count() else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # a component's name is needed for linked sets and for sets of several rows only; tables are stored, so that joins on a hot group or set can be split
    linked = stored(sets.join(found, sets["sid"] == found["node"]).select("sid", "doc_id", "root"), "jaccard-components")
    return docs, sets, linked


def _pairs(labelled: DataFrame, open_: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """Links between different blocks of clusters with several components.

    Blocks hold sets of like component: those of the largest components in one range of blocks, so that pairs of
    blocks inside one component are left out, and the pairs grow with the number of sets outside it.
    """
    sizes = labelled.join(open_.select("cluster"), "cluster").groupBy("cluster", "label").agg(F.count("*").alias("members"))
    w = Window.partitionBy("cluster").orderBy(F.desc("members"), "label")
    spans = sizes.where(F.col("members") > BLOCK // 4).withColumn("parts", F.expr(f"(members + {BLOCK // 2} - 1) div {BLOCK // 2}")).withColumn("from", F.sum("parts").over(w) - F.col("parts"))
    ends = spans.groupBy("cluster").agg(F.sum("parts").alias("base"))
    rest = sizes.where(F.col("members") <= BLOCK // 4).groupBy("cluster").agg(F.sum("members").alias("small"))
    one = labelled.join(open_.select("cluster"), "cluster").join(spans.select("cluster", "label", "parts", "from"), ["cluster", "label"], "left").join(ends, "cluster", "left").join(rest, "cluster", "left")
    small_parts = F.expr(f"greatest(1, (coalesce(small, 0) + {BLOCK // 2} - 1) div {BLOCK // 2})")
    block = F.when(F.col("parts").isNotNull(), F.col("from") + F.pmod(F.xxhash64("sid"), F.col("parts"))).otherwise(F.coalesce("base", F.lit(0)) + F.pmod(F.xxhash64("label"), small_parts))
    whole = F.coalesce("base", F.lit(0)) + F.when(F.coalesce("small", F.lit(0)) > 0, small_parts).otherwise(0)
    placed = stored(one.select("cluster", "sid", "label", block.cast("long").alias("block"), whole.cast("long").alias("whole"), F.when(F.col("parts").isNotNull(), F.col("label")).alias("span")), "jaccard-placed")
    by_block = placed.groupBy("cluster", "block", "whole").agg(F.max("span").alias("span"))
    other = by_block.select(F.col("cluster").alias("c"), F.col("block").alias("o"), F.col("span").alias("other_span"))
    pairs = by_block.join(other, (F.col("cluster") == F.col("c")) & (F.col("o") >= F.col("block"))).where("not (span <=> other_span) or span is null")
    sided = pairs.select("cluster", "block", "o").withColumn("same", F.col("block") == F.col("o"))
    left = sided.select("cluster", "block", F.col("block").alias("task2"), F.col("o").alias("task3"), F.when(F.col("same"), -1).otherwise(0).alias("side"))
    right = sided.where("not same").select("cluster", F.col("o").alias("block"), F.col("block").alias("task2"), F.col("o").alias("task3"), F.lit(1).alias("side"))
    dealt = placed.select("cluster", "sid", "label", "block").join(left.unionByName(right), ["cluster", "block"])
    tasks = dealt.join(tokens, "sid").select(F.col("cluster").alias("task"), "task2", "task3", "side", "sid", "label", "tokens")
    return _joined(tasks, num, den)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(documents(spark, sf_dir))


_W = r"[^\x20\x09-\x0D]+"
OP8_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+3], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
