"""Bottom-k sketches of word-shingle hashes (operator 4).

A fingerprint keeps the k smallest distinct hashes of a text's five-word shingles,
as sorted 48-bit numbers, base64.  Fingerprints of parts merge into the fingerprint
of the union; two of them estimate resemblance and containment, one the number of
distinct shingles.  Sets of fewer than k shingles are held whole, so that small texts
are compared exactly.

Cases: a null text is empty; an empty text (or one without words) has no shingle and the
empty fingerprint; two empty fingerprints resemble with 1.0, an empty and another with
0.0.  Equal texts have equal fingerprints.  A text of one to four words is one shingle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.llm import words
from cairnbook.llm.ordered import parts_of_rows
from cairnbook.llm.shared import documents, shuffle_partitions

K, SHINGLE_WORDS = 128, 5
_SPACE = float(1 << 48)
_DROP = np.uint64(16)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct 48-bit hashes, ascending."""
    return np.unique(hashes >> _DROP)[:k]


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of the sketched sets."""
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.zeros(0, np.uint64)


def encode(values: np.ndarray) -> str:
    wide = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    return base64.b64encode(wide[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    narrow = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, 2:] = narrow
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def distinct_count(values: np.ndarray, k: int = K) -> float:
    """Exact below k, else the bottom-k estimate."""
    return float(len(values)) if len(values) < k else (k - 1) * _SPACE / (float(values[k - 1]) + 1)


def _shared(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    """Size of the union's sketch, and how many of its values both have."""
    both = np.concatenate((a, b))
    if not len(both):
        return 0, 0
    both.sort()
    twice = np.append(both[1:] == both[:-1], False)
    first = np.append(True, both[1:] != both[:-1])
    union = both[first][:k]
    return len(union), int(twice[: np.searchsorted(both, union[-1], side="right")].sum())


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    union, common = _shared(a, b, k)
    return common / union if union else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1.0 for an empty a."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k=k), k)
    return min(1.0, both / distinct_count(a, k))


def sketches(texts, k: int = K, n: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """A sketch for each text of an Arrow column."""
    for chunk in words.chunks(texts):
        for hashes in words.shingles(chunk.hashes, chunk.counts, n):
            yield sketch(hashes, k)


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, n: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of df: doc_id, n_chars, fingerprint.  No shuffle."""

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_chars"), pa.array([encode(x) for x in sketches(column, k, n)], pa.string())],
                ["doc_id", "n_chars", "fingerprint"],
            )

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt by ranges of doc_id, each partition ending with the first row of the next one (last = 1).

    Ranges come from a quantile sketch and one number for each range reaches the driver: at most
    the number of shuffle partitions.  The texts are shuffled once.  An id of several ranges (null too) is cut by text hashes.
    """
    n = shuffle_partitions(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bucket, hashed = parts_of_rows(rows, n)
    # rows of one id share a range unless texts decide it, which are then hashed for the first rows too
    tie = F.xxhash64("text") if hashed else F.lit(0).cast("long")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("there"), F.col("doc_id"), tie.alias("tie")))
    firsts = [(r["b"], r["f"]["doc_id"], r["f"]["tie"]) for r in rows.select("doc_id", *["text"] * hashed, bucket.alias("b")).groupBy("b").agg(first.alias("f")).orderBy("b").collect()]
    own = F.struct(bucket.alias("part"), F.lit(0).alias("last"))
    also = F.array().cast("array<struct<part:int,last:int>>")
    if firsts:
        at = {b: (doc, tie_, firsts[i - 1][0]) for i, (b, doc, tie_) in enumerate(firsts)}
        lists = [F.array(*[F.lit(at.get(b, (None, None, None))[j]).cast("long") for b in range(n)]) for j in range(3)]
        doc, tie_, before = (F.element_at(x, bucket + 1) for x in lists)
        also = F.when(F.col("doc_id").eqNullSafe(doc) & (tie == tie_), F.array(F.struct(before.cast("int").alias("part"), F.lit(1).alias("last")))).otherwise(also)
    dealt = rows.select("doc_id", "text", F.explode(F.concat(F.array(own), also)).alias("p")).select("doc_id", "text", "p.part", "p.last")
    return dealt.repartitionById(n, "part").sortWithinPartitions("part", "last", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))


def edited_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, n: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of each text, of the text whose last quarter gives way to the next document's start, and likenesses.

    Order: ascending doc_id, nulls first, rows of one doc_id by their text's hash; after the last comes the first.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches):
        held = None  # (doc_id, text, sketch) of a row whose next is not there yet

        def finish(group):
            """Rows for the documents of group but the last; group: (doc_id, text, last flag, sketch)."""
            edited = []
            for (_, text, _, _), (_, after, _, _) in zip(group, group[1:], strict=False):
                cut = len(text) // 4
                edited.append(text[: len(text) - cut] + after[:cut])
            out = [[] for _ in names]
            for i, (changed, marks) in enumerate(zip(edited, sketches(pa.array(edited, pa.large_string()), k, n), strict=True)):
                doc, text, _, own = group[i]
                for column, value in zip(out, (doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), encode(own), encode(marks), resemblance(own, marks, k), resemblance(own, group[i + 1][3], k), distinct_count(own, k)), strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

        for batch in batches:
            at = 0
            sizes = np.diff(words.text_buffers(batch.column("text"))[0])
            while at < batch.num_rows:  # a few MB of text at a time
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), 4 * words.CHUNK)))
                part = batch.slice(at, to - at)
                at = to
                group = list(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("last").to_pylist(), sketches(part.column("text"), k, n), strict=True))
                if held:
                    group.insert(0, held)
                if 1 in (flags := [g[2] for g in group]):
                    group = group[: flags.index(1) + 1]
                    held = None if len(group) == 1 else group[-1]
                else:
                    held = group[-1]
                if len(group) > 1:
                    yield finish(group)
                if held and held[2]:
                    held = None
                    for _ in batches:
                        pass
                    return

    return _in_order(df, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double")


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_neighbours(documents(spark, sf_dir))
