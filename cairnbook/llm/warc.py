"""Merkle fixity audit of WARC replicas (operator 3).

A WARC file holds the records of a range of ids, one after the other.  Each record is hashed (sha256 of its length
and bytes).  The records of a file, in the order of their offsets, are cut into ranges, and those into longer
ranges: a range of level k begins at each record whose key hashes to a multiple of FAN**k, so that ranges nest, hold
FAN parts on average, and a record that a replica lost or gained moves no cut but its own.  A range's hash is that of
its parts' hashes in the order of offsets; the root covers the file.  Two replicas are compared from the roots: only
below ranges that differ does the audit go on to the next level, so that a clean file costs one comparison and a
damaged one a path of some FAN comparisons per level for each damaged place.  Hashes do not hold offsets, as all
records after a lost one stand elsewhere: every range carries its offsets in either replica to be reported.

A record's key is its id, with its url and its number among the records of both in the file.

All steps are DataFrame operations.  Files hold at most PER_FILE records, whatever ids they have; files and levels
spread over all tasks, however large one host is.

Cases: a null url or payload is written as empty; a null id is a record of the first range of ids; rows of one id
are ordered by url and payload; rows alike in all columns are records each, in any order; records missing from either replica,
or added, are reported as such; an empty table has no files and no findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnbook.llm.ordered import range_cuts, range_of
from cairnbook.llm.shared import shuffle_partitions, stored

FAN, LEVELS, PER_FILE = 16, 2, 512
CRLF = "\r\n"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """(file, slot, offset, length, doc_id, url, record): WARC/1.1 resource records of pages, by ranges of the id.

    The ranges are as many as shuffle partitions (cuts from a quantile sketch); one that holds more than twice the mean, as
    an id with a third of all rows does, is dealt to several writers.  A writer begins a new file every per_file records.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    part = range_of(F.col("doc_id"), range_cuts(rows, shuffle_partitions(pages.sparkSession)))
    sizes = {r["part"]: r["n"] for r in rows.select(part.alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    mean = max(per_file, sum(sizes.values()) // max(1, len(sizes)))
    body = F.encode("payload", "UTF-8")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " "), F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")),
        F.lit(f">{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.length(body).cast("string"), F.lit(f"{CRLF}{CRLF}"),
    )
    made = rows.select(part.cast("long").alias("part"), "doc_id", "url", F.xxhash64("url", "payload").alias("tie"), F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit(CRLF + CRLF), "UTF-8")).alias("record")).withColumn("length", F.length("record").cast("long"))
    writers = F.lit(1)
    for number, n in sizes.items():
        if n > 2 * mean:
            writers = F.when(F.col("part") == number, F.lit(-(-n // mean))).otherwise(writers)
    made = made.withColumn("writer", F.floor(F.rand(3) * writers))
    w = Window.partitionBy("part", "writer").orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    file = F.col("part") * (1 << 44) + F.col("writer") * (1 << 28) + F.expr(f"(row_number - 1) div {per_file}")
    return laid(made.withColumn("row_number", F.row_number().over(w)).withColumn("file", file.cast("long")), "row_number", "part", "writer").select("file", "slot", "offset", "length", "doc_id", "url", "record")


def laid(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """rows with slot and offset in their file, records in the given order without gaps; keys: columns that rows are dealt by already."""
    w = Window.partitionBy(*keys, "file").orderBy(order)
    return rows.withColumn("slot", (F.row_number().over(w) - 1).cast("long")).withColumn("offset", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def leaves(replica: DataFrame) -> DataFrame:
    """(file, key, hash, offset, length, doc_id, n1 ... nLEVELS) of each record: n-k names its range of level k, by the key that begins it."""
    digest = F.sha2(F.concat(F.encode(F.concat(F.length("record").cast("string"), F.lit(":")), "UTF-8"), F.col("record")), 256)
    among = Window.partitionBy("file", "doc_id", "url").orderBy("offset")
    rows = replica.select("file", "doc_id", "url", digest.alias("hash"), "offset", "length").withColumn("number", F.row_number().over(among))
    rows = rows.select("file", F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("number").cast("string"), F.col("url")).alias("key"), "hash", "offset", "length", "doc_id")
    upto = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.xxhash64("key")
    return rows.select("*", *[F.coalesce(F.last(F.when(F.pmod(begins, F.lit(FAN**k)) == 0, F.col("key")), ignorenulls=True).over(upto), F.lit("")).alias(f"n{k}") for k in range(1, LEVELS + 1)])


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels of the trees, leaves first, roots last: (file, node, up, hash, begin, end); up: the range above."""
    names = [f"n{k}" for k in range(1, LEVELS + 1)]
    level = leaf.select("file", F.col("key").alias("node"), F.col("n1").alias("up"), *names[1:], "hash", F.col("offset").alias("begin"), (F.col("offset") + F.col("length")).alias("end"))
    out = [level.select("file", "node", "up", "hash", "begin", "end")]
    for k in range(1, LEVELS + 2):
        above = [F.first(n).alias(n) for n in names[k:]]
        parts = F.array_sort(F.collect_list(F.struct("begin", "hash")))
        digest = F.sha2(F.array_join(F.transform(parts, lambda p: p["hash"]), "|"), 256)
        level = level.groupBy("file", F.col("up").alias("node")).agg(digest.alias("hash"), F.min("begin").alias("begin"), F.max("end").alias("end"), *above)
        level = level.withColumn("up", F.col(names[k]) if k < LEVELS else F.lit(""))
        out.append(level.select("file", "node", "up", "hash", "begin", "end"))
    return out


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Damaged, missing or added records of two replicas (leaves): file, key, doc_id, offset and length in the first (or else the second), offset_second, status."""
    one, two = stored(first, "warc-leaves"), stored(second, "warc-leaves")
    trees = [[stored(x, "warc-tree") for x in tree(t)[1:]] for t in (one, two)]
    trees = [[tree(t)[0], *levels] for t, levels in zip((one, two), trees, strict=True)]
    open_ = None
    for level in range(len(trees[0]) - 1, -1, -1):
        a, b = (t[level].select("file", "node", "up", F.col("hash").alias(f"hash_{s}"), F.col("begin").alias(f"begin_{s}"), F.col("end").alias(f"end_{s}")) for t, s in zip(trees, "ab", strict=True))
        if open_ is not None:
            below = open_.select("file", F.col("node").alias("up"))
            a, b = (x.join(below, ["file", "up"], "left_semi") for x in (a, b))
        both = a.drop("up").join(b.drop("up"), ["file", "node"], "full")
        open_ = stored(both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b"))), "warc-open")
    said = F.when(F.col("hash_a").isNull(), "added").when(F.col("hash_b").isNull(), "missing").otherwise("differs")
    found = open_.select("file", F.col("node").alias("key"), F.coalesce("begin_a", "begin_b").alias("offset"), (F.coalesce("end_a", "end_b") - F.coalesce("begin_a", "begin_b")).alias("length"), F.col("begin_b").alias("offset_second"), said.alias("status"))
    name = F.substring_index("key", "#", 1)
    return found.withColumn("doc_id", F.when(name != "none", name.cast("long"))).select("file", "key", "doc_id", "offset", "length", "offset_second", "status")


def damaged(replica: DataFrame, every: int = 97, at: int = 5) -> DataFrame:
    """A replica that lost the records of ids 3, 3 + 10 * every, ... before it was laid out, with one byte of those of ids at, at + every, ... changed."""
    hit = F.col("doc_id") % every == at
    changed = F.concat(F.expr("substring(record, 1, length - 5)"), F.encode(F.lit("#"), "UTF-8"), F.expr("substring(record, length - 3, 4)"))
    left = replica.where(F.coalesce(F.col("doc_id") % (10 * every) != 3, F.lit(True))).withColumnRenamed("slot", "slot_").drop("offset")
    return laid(left, "slot_").drop("slot_").withColumn("record", F.when(hit, changed).otherwise(F.col("record")))


def op3_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits two replicas of all pages, the second with damage at known places; one row per page with what the audit says of it."""
    kept = stored(records(spark.read.parquet(f"{sf_dir}/pages.parquet")), "warc-records")
    one = stored(leaves(kept), "warc-first")
    found = audit(one, leaves(damaged(kept))).select("file", "key", "status")
    sound = one.select("file", "key", "doc_id", "length").join(found, ["file", "key"], "left")
    return sound.select(F.col("doc_id").alias("page_id"), "length", F.coalesce("status", F.lit("sound")).alias("status"))


OP3_SQL = f"""
SELECT page_id,
  CAST(strlen('WARC/1.1__WARC-Type: resource__WARC-Target-URI: ' || coalesce(url, '') || '__WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none')
    || '>__Content-Type: text/html__Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || '____' || coalesce(html, '') || '____') AS BIGINT) AS length,
  CASE WHEN page_id % 970 = 3 THEN 'missing' WHEN page_id % 97 = 5 THEN 'differs' ELSE 'sound' END AS status
FROM pages
"""
