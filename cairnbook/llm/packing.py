"""Packing token sequences by non-negative least squares over length combinations (operator 6).

A document's ids are cut at multiples of WINDOW; each full window is a sequence of its own.  The remainders
(below WINDOW) are packed from their histogram, at most WINDOW numbers on the driver whatever the input:

1. Enumerate combinations of one to four present lengths that fill a window up to SLACK ids.
2. Solve repeat counts x >= 0 minimising |A x - histogram| (multiplicative updates), round down, and take
   the PATTERNS largest in falling order of x as long as the histogram has their lengths.
3. Pack what is left greedily: the longest remainder, then the longest that still fits, and so on, each
   pattern repeated as often as the histogram allows.
4. Patterns of step 3 that leave more than GAP ids are given up: their remainders are cut into powers of two,
   which fill windows without a gap in falling order; the last window is itself cut at powers of two.

Every remainder takes its place from its rank among those of its length (rank inside its task plus the
numbers of earlier tasks), so that nothing is sorted and no length gathers in one task.

Cases: a null or empty text has the end id only; repeated rows are packed each; a null id is kept.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnbook.llm import tokens
from cairnbook.llm.shared import documents, stored, trimmed

WINDOW, END = 4096, 2
SLACK, GAP, FAN, ROUNDS, PATTERNS = 16, 24, 12, 120, 16_384


def combinations(present: np.ndarray, counts: np.ndarray, window: int = WINDOW, slack: int = SLACK, fan: int = FAN) -> list[tuple[int, ...]]:
    """Non-increasing tuples of one to four present lengths with sums in window - slack .. window."""
    out: set[tuple[int, ...]] = set()
    heavy = present[np.argsort(-counts, kind="stable")]

    def best(left: int) -> int:
        """The longest present length up to left, or 0."""
        at = int(np.searchsorted(present, left, side="right")) - 1
        return int(present[at]) if at >= 0 else 0

    def add(*some: int):
        left = window - sum(some)
        last = best(left) if left > slack else 0
        if last and left - last <= slack or left <= slack and left >= 0:
            out.add(tuple(sorted((*some, last) if last else some, reverse=True)))

    for a in present.tolist():
        add(a)
        seconds = heavy[heavy <= window - a][:fan].tolist()
        for b in seconds:
            if a + b <= window - slack:
                add(a, b)
                for c in (best((window - a - b) // 2), best((window - a - b) // 3)):
                    if c:
                        add(a, b, c)
    return sorted(out, reverse=True)


def least_squares(patterns: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that nearly minimises |A x - histogram|, A the length counts of the patterns."""
    sizes = np.array([len(p) for p in patterns])
    column = np.repeat(np.arange(len(patterns)), sizes)
    row = np.concatenate([np.array(p) for p in patterns])
    target = np.bincount(column, histogram[row], minlength=len(patterns))
    x = target / np.maximum(1, sizes) / np.maximum(1, np.bincount(row, minlength=len(histogram)))[[p[0] for p in patterns]] + 1e-9
    for _ in range(rounds):
        covered = np.bincount(row, x[column], minlength=len(histogram))
        x *= target / np.maximum(np.bincount(column, covered[row], minlength=len(patterns)), 1e-12)
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Patterns with their repeats, and how many remainders of each length are cut into powers of two."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    present = np.flatnonzero(left)
    if len(present) and (patterns := combinations(present, left[present], window)):
        x = least_squares(patterns, left.astype(float))
        for i in np.argsort(-x, kind="stable")[:PATTERNS]:
            if x[i] < 1:
                break
            times = min(int(x[i]), *(int(left[n]) // k for n, k in Counter(patterns[i]).items()))
            if times > 0:
                out.append((patterns[i], times))
                for n in patterns[i]:
                    left[n] -= times
    cut = np.zeros_like(left)
    while len(present := np.flatnonzero(left)):
        some, room, free = [], window, left.copy()
        while room > 0 and (at := int(np.searchsorted(present, room, side="right"))):
            n = int(present[at - 1])
            while at and not free[n]:
                at -= 1
                n = int(present[at - 1]) if at else 0
            if not at:
                break
            some.append(n)
            free[n] -= 1
            room -= n
        uses = Counter(some)
        times = min(int(left[n]) // k for n, k in uses.items())
        if room > GAP and (window - room) & (window - room - 1):
            for n, k in uses.items():
                cut[n] += k * times
        else:
            out.append((tuple(some), times))
        for n, k in uses.items():
            left[n] -= k * times
    return out, cut


def _slots(histogram: np.ndarray, window: int) -> tuple[list[tuple], list[tuple[int, int, int]]]:
    """Rows (rest, low, high, first, step, offset, cut bases) that place ranks low .. high - 1 of a length, and the last cut window's parts."""
    patterns, cut = plan(histogram, window)
    used, rows, sequence = np.zeros_like(histogram), [], 0
    for lengths, times in patterns:
        offset, seen = 0, Counter()
        for n in lengths:
            low = int(used[n]) + seen[n] * times
            rows.append((n, low, low + times, sequence, offset, None))
            seen[n] += 1
            offset += n
        for n, k in seen.items():
            used[n] += k * times
        sequence += times
    bits = [1 << b for b in range(window.bit_length() - 1, -1, -1)]
    total = {b: sum(int(c) for n, c in enumerate(cut.tolist()) if c and n & b) * b for b in bits}
    base, at = {}, 0
    for b in bits:
        base[b], at = at, at + total[b]
    for n in np.flatnonzero(cut).tolist():
        bases = []
        for b in bits:
            if n & b:
                bases.append(base[b] + sequence * window)
                base[b] += int(cut[n]) * b
        rows.append((n, int(used[n]), int(used[n] + cut[n]), -1, 0, bases))
    # the last, partial window of cut pieces: one sequence for each power of two
    begin, parts, number = sequence * window + at // window * window, [], sequence + at // window
    for b in bits:
        if (at % window) & b:
            parts.append((begin, begin + b, number))
            begin, number = begin + b, number + 1
    return rows, parts


def _scan(rows: DataFrame, window: int, end: int, path: str | None) -> DataFrame:
    """One row per document: length, task, rank of its remainder in the task, first sequence of its full windows, checksums."""
    names = ["doc_id", "n", "rest", "task", "rank", "whole", "full_crc", "rest_crc", "cut_crc"]

    def run(batches):
        task, seen, full = TaskContext.get().partitionId(), Counter(), 0
        for batch in trimmed(batches, tokens.HELD):
            out = [[] for _ in names]
            for ids in tokens.documents_ids(batch.column("text"), end, path):
                raw, n = ids.astype("<u4"), len(ids)
                wholes, rest = divmod(n, window)
                at, parts = n - rest, []
                for b in (1 << k for k in range(window.bit_length() - 1, -1, -1)):
                    if rest & b:
                        parts.append(zlib.crc32(raw[at : at + b].tobytes()))
                        at += b
                row = (n, rest, task, seen[rest], ((task + 1) << 40) + full, [zlib.crc32(raw[i * window : (i + 1) * window].tobytes()) for i in range(wholes)], zlib.crc32(raw[n - rest :].tobytes()), parts)
                seen[rest] += 1
                full += wholes
                for column, value in zip(out[1:], row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out[1:], kinds, strict=True)]], names)

    return rows.mapInArrow(run, "doc_id long, n long, rest int, task int, rank long, whole long, full_crc array<long>, rest_crc long, cut_crc array<long>")


_SLOT = {"slot_rest": pa.int32(), "low": pa.int64(), "high": pa.int64(), "first": pa.int64(), "at": pa.int64(), "bases": pa.list_(pa.int64())}


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scanned = stored(_scan(rows, window, end, path), "pack-scan")
    by_task = scanned.groupBy("rest", "task").agg(F.count("*").alias("m"))
    histogram = np.zeros(window, np.int64)
    for r in by_task.groupBy("rest").agg(F.sum("m").alias("m")).collect():
        histogram[r["rest"]] = r["m"]
    slots, parts = _slots(histogram, window)
    w = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("rest", "task", F.coalesce(F.sum("m").over(w), F.lit(0)).alias("before"))
    full = scanned.where(F.size("full_crc") > 0).select("doc_id", "n", "whole", F.posexplode("full_crc").alias("k", "ids_crc32"))
    full = full.select("doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (F.col("whole") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    ranked = scanned.where("rest > 0").select("doc_id", "n", "rest", "task", "rank", "rest_crc", "cut_crc").join(before, ["rest", "task"]).withColumn("place", F.col("rank") + F.col("before"))
    # four slots for each of PATTERNS patterns, and those of at most WINDOW greedy patterns, whatever the input
    # (as an Arrow table: Python rows would start a second pool of Python workers)
    columns = zip(*slots, strict=True) if slots else [()] * len(_SLOT)
    slot = F.broadcast(spark.createDataFrame(pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, _SLOT.items(), strict=True)})))
    placed = ranked.join(slot, (F.col("rest") == F.col("slot_rest")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
    first = F.col("n") - F.col("rest")
    kept = placed.where("bases is null").select("doc_id", first.alias("start"), F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("first") + F.col("place") - F.col("low")).alias("sequence_id"), F.col("at").alias("offset"))
    powers = [1 << b for b in range(window.bit_length() - 1, -1, -1)]
    own = F.filter(F.array(*[F.lit(b) for b in powers]), lambda b: F.col("rest").bitwiseAND(b) > 0)
    pieces = placed.where("bases is not null").withColumn("powers", own).select("doc_id", "n", "rest", "place", "low", "powers", F.posexplode(F.arrays_zip("powers", "bases", "cut_crc")).alias("k", "p"))
    done = F.aggregate(F.slice("powers", 1, F.col("k")), F.lit(0), lambda s, b: s + b)
    pieces = pieces.withColumn("size", F.col("p.powers").cast("long")).withColumn("at", F.col("p.bases") + (F.col("place") - F.col("low")) * F.col("size"))
    sequence, offset = F.expr(f"at div {window}"), F.col("at") % window
    for low, high, number in parts:
        inside = (F.col("at") >= low) & (F.col("at") < high)
        sequence, offset = F.when(inside, F.lit(number)).otherwise(sequence), F.when(inside, F.col("at") - low).otherwise(offset)
    pieces = pieces.select("doc_id", (first + done).cast("long").alias("start"), F.col("size").alias("length"), F.col("p.cut_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
    return full.unionByName(kept).unionByName(pieces)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
