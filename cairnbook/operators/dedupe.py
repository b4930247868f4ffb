"""Duplicate detection: equal bytes, near perceptual hashes, same business facts."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cairnbook.functions.text import edits_within, nfkc_udf, signature_udf, similarity_of_edits
from cairnbook.operators import hamming
from cairnbook.sources.tables import stored

HASH_DISTANCE, HASH_BITS, FUZZY, DAYS = 8, 64, 90.0, 1
FACT = ["transaction_date", "total_amount", "name_key"]
#: Values that a hash may ask for in one part.
MOST_AROUND = 4096
#: Hashes from which the division is chosen.
SAMPLE = 1024
#: Hashes of a block: at most, at least, and blocks that a smaller table is cut into; blocks of one side in a task at once; tasks at least.
BLOCK, LEAST_BLOCK, BLOCKS, HELD, LEAST_TASKS = 16_384, 1024, 24, 64, 32


def lenient_decimal(raw: Column) -> Column:
    return F.regexp_replace(raw, "[, 円¥]", "").try_cast("decimal(18,2)")


def duplicate_classes(files: DataFrame, key: str = "sha256") -> DataFrame:
    """Each document with the smallest document of equal key, and their number: n copies are n rows, not a pair for every two."""
    return files.join(files.groupBy(key).agg(F.min("document_id").alias("class_id"), F.count_distinct("document_id").alias("copies")), key).select("document_id", "class_id", "copies")


def exact_matches(files: DataFrame) -> DataFrame:
    """document_id, other_id, score, reason: every copy with its class's smallest document; two copies of a class are linked through it."""
    rows = duplicate_classes(files.select("document_id", "sha256").distinct())
    return rows.where("document_id <> class_id").select("document_id", F.col("class_id").alias("other_id"), F.lit(1.0).alias("score"), F.lit("exact_sha256").alias("reason"))


def candidates_of(files: DataFrame, document_id: int) -> DataFrame:
    """The other documents with the bytes of one document, as a review shows them: by falling score, then id."""
    own = files.where(F.col("document_id") == document_id).select("sha256").distinct()
    rows = files.where(F.col("document_id") != document_id).join(own, "sha256", "left_semi")
    return rows.select("document_id", F.lit(1.0).alias("score"), F.lit("exact_sha256").alias("reason")).distinct().orderBy(F.desc("score"), "document_id")


class Part(NamedTuple):
    """A run of bits of a hash, and how many of them may differ for two hashes to meet in it."""

    first: int
    width: int
    radius: int


def neighbours(width: int, radius: int) -> int:
    """Values at most radius bits away from one of width bits."""
    return sum(math.comb(width, i) for i in range(radius + 1))


def divisions(bits: int, distance: int) -> list[list[Part]]:
    """The ways to cut hashes of so many bits into parts, one for each number of parts, that miss no pair at most distance bits apart.

    With distance = q * parts + r, the first r + 1 parts have radius q and the others q - 1: were all exceeded, more than
    distance bits would differ.  A part of radius -1 is not looked at.
    """
    if bits <= distance:
        return [[Part(0, bits, bits)]]

    def of(parts: int) -> list[Part]:
        q, r = divmod(distance, parts)
        cuts = [bits * i // parts for i in range(parts + 1)]
        made = [Part(a, b - a, min(b - a, q if i <= r else q - 1)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        return [p for p in made if p.radius >= 0]

    every = [of(n) for n in range(1, min(bits, distance + 1) + 1)]
    return [parts for parts in every if max(neighbours(p.width, p.radius) for p in parts) <= MOST_AROUND] or every[-1:]


def share_met(sample: np.ndarray, parts: list[Part]) -> float:
    """Pairs that meet in a part, of all pairs of the sample (uint64), summed over parts."""
    met = 0
    for p in parts:
        value = sample >> np.uint64(p.first) & np.uint64((1 << p.width) - 1)
        met += sum(int((np.bitwise_count(value[i + 1 :] ^ value[i]) <= p.radius).sum()) for i in range(len(value)))
    return 2 * met / max(1, len(sample) * (len(sample) - 1))


def hash_parts(rows: int, bits: int, distance: int, sample: np.ndarray) -> list[Part]:
    """Of the divisions the one of least work for so many hashes: the values that all hashes ask for, and the pairs that then meet.

    sample: some of the hashes; hashes of texts are not spread evenly, and that decides how many parts are best.  Any choice is exact.
    """

    def work(parts: list[Part]) -> float:
        return rows * sum(neighbours(p.width, p.radius) + 1 for p in parts) + rows * rows / 2 * share_met(sample, parts)

    return min(divisions(bits, distance), key=work)


def _dense(hashes: DataFrame) -> tuple[Column, int]:
    """The bits that are not the same in all hashes, side by side, and their number; one row reaches the driver."""
    some, every = hashes.agg(F.bit_or("phash"), F.bit_and("phash")).first()
    varying = ((some or 0) ^ (every or 0)) & ((1 << HASH_BITS) - 1)
    out, width, bit = F.lit(0).cast("long"), 0, 0
    while bit < HASH_BITS:
        run = 0
        while bit + run < HASH_BITS and varying >> (bit + run) & 1:
            run += 1
        if run:
            part = F.shiftrightunsigned("phash", bit)
            part = part if run == HASH_BITS else part.bitwiseAND(F.lit((1 << run) - 1).cast("long"))
            out, width = out.bitwiseOR(F.shiftleft(part, width)), width + run
        bit += run + 1
    return out, width


def near_hashes(hashes: DataFrame, distance: int = HASH_DISTANCE, seen: Observation | None = None) -> DataFrame:
    """document_id, other_id, distance, score: pairs of different 64-bit perceptual hashes at most distance bits apart, named by the smallest document of each hash.

    Multi-index hashing: hashes are cut into the parts of hash_parts over the bits that vary at all.  For each part they are sorted by
    its value and packed into blocks; every two blocks of a part meet in one row of a product that no shuffle holds, and in it only
    hashes whose values are within the part's radius are compared.  So disk holds each hash a few times a part, whatever
    the number of pairs, and a task holds a few blocks.  A pair counts in the first part only in which it can meet.  Documents of one
    hash are a class (duplicate_classes by phash), not pairs.

    hashes: document_id, phash long; null hashes take no part.  seen: gets rows (different hashes) and candidates (pairs compared).
    """
    own = stored(hashes.where("phash is not null").groupBy("phash").agg(F.min("document_id").alias("document_id")), "hashes")
    dense, bits = _dense(own)
    rows = own.count()
    own = own.withColumn("dense", dense)
    sample = own.select("dense").orderBy(F.xxhash64("phash")).limit(SAMPLE).collect()
    parts = hash_parts(rows, bits, distance, np.array([r["dense"] for r in sample], np.int64).view(np.uint64))

    def value(part: Part) -> Column:
        cut = F.shiftrightunsigned("dense", part.first)
        return cut if part.width == HASH_BITS else cut.bitwiseAND(F.lit((1 << part.width) - 1).cast("long"))

    size = min(BLOCK, max(LEAST_BLOCK, -(-rows // BLOCKS)))
    placed = own.select("document_id", "dense", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), value(p).alias("at")) for i, p in enumerate(parts)])).alias("p")).select("*", "p.*")
    # the hash too, so that a frequent value fills several ranges
    ranges = max(1, -(-rows * len(parts) // (16 * BLOCK)))
    sorted_ = placed.repartitionByRange(ranges, "part", "at", "dense").sortWithinPartitions("part", "at", "dense").select("part", "dense", "document_id")
    blocks = stored(sorted_.mapInArrow(lambda batches: hamming.packed(batches, size), "part int, block long, dense binary, ids binary"), "blocks")
    many = blocks.count()
    one = blocks.repartition(max(1, min(many, LEAST_TASKS), -(-many // 4)))
    other = blocks.select(F.col("part").alias("other_part"), F.col("block").alias("other_block"), F.col("dense").alias("other_dense"), F.col("ids").alias("other_ids")).repartition(max(1, -(-many // HELD)))
    met = one.join(other.hint("shuffle_replicate_nl"), F.expr("part = other_part and block <= other_block"))
    met = met.select("part", F.expr("block = other_block").alias("same"), "dense", "ids", "other_dense", "other_ids")
    pairs = met.mapInArrow(lambda batches: hamming.pairs(batches, parts, distance), "document_id long, other_id long, distance int")
    if seen is not None:
        pairs = pairs.observe(seen, F.coalesce(F.sum(F.when(F.col("document_id").isNull(), F.col("other_id"))), F.lit(0)).alias("candidates"), F.lit(rows).alias("rows"))
    return pairs.where("document_id is not null").select("document_id", "other_id", "distance", F.greatest(F.lit(0.0), 1 - F.col("distance") / HASH_BITS).alias("score"))


def business_matches(facts: DataFrame, days: int = DAYS, least: float = FUZZY, seen: Observation | None = None) -> DataFrame:
    """Pairs of facts of equal amounts, dates at most days apart and alike counterparties, named by their smallest documents.

    facts: document_id, transaction_date, total_amount, counterparty.  Documents of one amount, date and name key are one fact
    (business_classes), so that a frequent fact is one row.  The earlier of two facts meets its own bucket of dates and the
    next ones; at 100 names meet if they are equal, else if their lengths, the characters they hold (signatures) and a bounded number of edits
    allow the similarity, all looked at inside the join.  seen: gets scored (pairs whose similarity was computed).
    """
    wide = max(1, (days + 1) // 2)
    rows = _named(facts).groupBy(*FACT).agg(F.min("document_id").alias("id")).withColumn("bucket", F.floor(F.unix_date("transaction_date") / wide))
    if least < 100:
        rows = rows.withColumn("signature", signature_udf("name_key"))
    later = rows.select(F.col("id").alias("id2"), F.col("transaction_date").alias("date2"), "total_amount", F.col("name_key").alias("key2"), "bucket", *([F.col("signature").alias("signature2")] if least < 100 else []))
    earlier = rows.withColumn("bucket", F.explode(F.array(*[F.col("bucket") + i for i in range(-(-days // wide) + 1)])))
    on = ["total_amount", "bucket"]
    if least >= 100:
        later, on = later.withColumnRenamed("key2", "name_key"), [*on, "name_key"]
    near = earlier.join(later, on).where((F.datediff("date2", "transaction_date").between(0, days)) & (F.col("id") != F.col("id2")) & ((F.col("date2") > F.col("transaction_date")) | (F.col("id") < F.col("id2"))))
    if least >= 100:
        scored = near.withColumn("similarity", F.lit(100.0))
    else:
        m, n = F.length("name_key"), F.length("key2")
        fits = 200.0 * F.least(m, n) >= least * (m + n)  # the longest common subsequence is no longer than the shorter name
        changes = m + n - 2 * F.ceil(least * (m + n) / 200 - 1e-9)  # characters that may go or come
        near = near.where(fits & (F.bit_count(F.col("signature").bitwiseXOR(F.col("signature2"))) <= changes))
        near = near.select("id", "id2", "name_key", "key2", F.explode(edits_within(F.col("name_key"), F.col("key2"), changes)).alias("edits"))
        if seen is not None:
            near = near.observe(seen, F.count("*").alias("scored"))
        scored = near.withColumn("similarity", similarity_of_edits(F.col("name_key"), F.col("key2"), F.col("edits"))).where(F.col("similarity") >= least)
    return scored.select(F.least("id", "id2").alias("document_id"), F.greatest("id", "id2").alias("other_id"), F.round("similarity", 6).alias("similarity"), (F.col("similarity") / 100).alias("score"), F.lit("fuzzy").alias("reason"))


def _named(facts: DataFrame) -> DataFrame:
    return facts.where("transaction_date is not null and total_amount is not null and counterparty is not null").withColumn("name_key", nfkc_udf("counterparty"))


def business_classes(facts: DataFrame) -> DataFrame:
    """document_id, class_id, copies and the fact (transaction_date, total_amount, name_key) of documents that have all three."""
    rows = _named(facts)
    return rows.join(rows.groupBy(*FACT).agg(F.min("document_id").alias("class_id"), F.count("*").alias("copies")), FACT).select("document_id", "class_id", "copies", *FACT)


def upsert_flags(flags: DataFrame, found: DataFrame) -> DataFrame:
    """Flags after a detector's runs: the last evidence of each pair, and whether the pair was there before (update) or not (insert)."""
    last = found.groupBy("document_id", "other_id").agg(F.max_by(F.struct("reason", "score"), "run").alias("new"), F.count("*").alias("writes"))
    both = flags.withColumn("was", F.lit(True)).join(last, ["document_id", "other_id"], "full")
    action = F.when(F.col("new").isNull(), "keep").when(F.col("was").isNull(), "insert").otherwise("update")
    return both.select("document_id", "other_id", F.coalesce("new.reason", "reason").alias("reason"), F.coalesce("new.score", "score").alias("score"), action.alias("action"), F.coalesce("writes", F.lit(0)).alias("writes"))


def fingerprints(verified: DataFrame, extractions: DataFrame) -> DataFrame:
    """document_id, origin, transaction_date, total_amount, counterparty: the verified facts, else those of the newest extraction that can be read.

    extractions: document_id, extraction_id, created, payload (JSON of values or {"value": ...}, several names a field).  An
    extraction whose date, amount or counterparty cannot be read is passed over, whatever its age.
    """

    def field(*names):
        return F.coalesce(*[F.coalesce(F.get_json_object("payload", f"$.{n}.value"), F.get_json_object("payload", f"$.{n}")) for n in names])

    read = extractions.select("document_id", "extraction_id", "created", F.try_to_date(F.trim(field("transaction_date", "issue_date")), "yyyy-M-d").alias("d"), lenient_decimal(field("total_amount", "amount")).alias("a"), F.nullif(F.trim(field("counterparty", "issuer")), F.lit("")).alias("c"))
    best = read.where("d is not null and a is not null and c is not null").groupBy("document_id").agg(F.max_by(F.struct("d", "a", "c"), F.struct("created", "extraction_id")).alias("e"))
    v = verified.select("document_id", F.struct(F.col("transaction_date").alias("d"), F.col("total_amount").cast("decimal(18,2)").alias("a"), F.col("counterparty").alias("c")).alias("v"))
    both = v.join(best, "document_id", "full").withColumn("f", F.coalesce("v", "e"))
    return both.select("document_id", F.when(F.col("v").isNotNull(), "verified").otherwise("extraction").alias("origin"), F.col("f.d").alias("transaction_date"), F.col("f.a").alias("total_amount"), F.col("f.c").alias("counterparty"))
