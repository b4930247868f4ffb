"""Exact filtered nearest neighbours of a table of query vectors: inverted lists under the triangle inequality.

Vectors count by their direction, distances are cosine distances rounded to 9 places before they are compared (so that
the order of summation decides no tie), ties go to the smaller id.  A list holds the vectors next to one centre that lie
in one ring around it.  Lists hold about PART_BYTES, as a query
is sent to each list within its reach: centres first, then rings, then parts of a ring are as many as that asks for.  Inside a part rows are sorted by label and by
distance from the centre, so that a query reads, of the labels that it admits only, the rows whose distance from the
centre differs from its own by no more than its k-th distance.  That k-th distance comes from the PROBES lists next to
the query; lists that cannot hold anything nearer are not visited.

Centres are fitted on at most SAMPLE vectors (SAMPLE_BYTES); every vector is in a list, and results do not depend on the
centres.  The driver holds centres and rings: at most CELLS vectors and CELLS * RINGS rows, whatever the tables hold.

Cases: vectors that are null, empty or of no length, or hold a null or non-finite component take no part, on either side;
vectors of different lengths raise an error.  Without a label column every query must admit all.  A query that admits
null is one without a filter; an empty list of labels admits none; a null label is admitted only without a filter.
Repeated rows are hits of their own; query rows that share an id share one ranking.  Fewer than k hits give fewer rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.sources.tables import stored

CELLS, LEAST_CELLS, RINGS, PROBES, SWEEPS = 1024, 16, 8, 2, 6
SAMPLE, SAMPLE_BYTES, PART_BYTES, SLICE_BYTES = 1 << 14, 1 << 26, 1 << 20, 1 << 22
PLACES, SLACK = 9, 1e-7
HITS = "query_id long, id long, distance double, n_read long"
VISITS = "cell int, ring int, part int, q array<long>, unit binary, apart array<double>, bound array<double>, admits array<array<long>>"


def _usable(v: Column) -> Column:
    """Whether v has a direction."""
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & sound & F.exists(v, lambda x: x != 0)


def _units(column) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows."""
    flat = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _packed(units: np.ndarray) -> pa.Array:
    wide = units.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(units), [None, pa.py_buffer(np.arange(0, (len(units) + 1) * wide, wide, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(units))])


def _apart(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances of all units from all centres."""
    return np.sqrt(np.maximum((units * units).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * units @ centres.T, 0))


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of a few sweeps of k-means; a centre that loses all its vectors stays where it is."""
    own = sample[np.random.default_rng(0).choice(len(sample), cells, replace=False)]
    for _ in range(SWEEPS):
        near = np.concatenate([_apart(part, own).argmin(axis=1) for part in np.array_split(sample, len(sample) // 1024 + 1)])
        size = np.bincount(near, minlength=cells)
        total = np.zeros_like(own)
        np.add.at(total, near, sample)
        own = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], own)
    return own


@dataclass
class Lists:
    """table: a row for each part of a list.  rings: cell, ring, least and greatest distance from the centre, parts."""

    table: DataFrame
    centres: np.ndarray
    rings: np.ndarray
    rows: int

    @property
    def width(self) -> int:
        return self.centres.shape[1]


def _sliced(batches, width: int):
    step = max(1, SLICE_BYTES // (8 * max(width, CELLS)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _width(rows: DataFrame) -> tuple[int, int]:
    n, low, high = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} components")
    return n, low or 0


def build(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> Lists | None:
    """Lists of all usable vectors, None without any.  Two shuffles: ring sizes (pre-aggregated) and the rows to their parts."""
    label = F.col(label_col) if label_col else F.lit(None)
    given = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(_usable(F.col("v")))
    n, width = _width(given)
    if not n:
        return None
    share = max(1, PART_BYTES // (8 * width))
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    chance = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) / (1 << 30)
    drawn = given.where(chance < most / n).select("v").limit(2 * most).toArrow() if n > most else given.select("v").toArrow()
    if not len(drawn):
        drawn = given.select("v").limit(1).toArrow()
    sample = _units(drawn.column("v").combine_chunks())
    sample = sample[np.lexsort(sample.T[::-1])]
    centres = _centres(sample, max(1, min(CELLS, max(LEAST_CELLS, n // share), math.isqrt(n), len(sample) // 4)))
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in _sliced(batches, width):
            units = _units(batch.column("v"))
            cell = _apart(units, shared.value).argmin(axis=1)
            far = np.sqrt(((units - shared.value[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(cell.astype(np.int32)), pa.array(far), _packed(units)], ["id", "label", "cell", "far", "unit"])

    placed = stored(given.mapInArrow(assign, "id long, label long, cell int, far double, unit binary"), "neighbor-rows")
    shared.destroy()
    cuts = placed.groupBy("cell").agg(F.percentile_approx("far", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts"), F.least(F.lit(RINGS), F.ceil(F.count("*") / share)).cast("int").alias("wanted"))
    # at most CELLS rows, and CELLS * RINGS below
    cuts = F.broadcast(stored(cuts, "neighbor-cuts"))
    ringed = placed.withColumn("row", F.monotonically_increasing_id()).join(cuts, "cell").withColumn("ring", F.floor(F.size(F.filter("cuts", lambda c: c <= F.col("far"))) * F.col("wanted") / RINGS).cast("int"))
    rings = ringed.groupBy("cell", "ring").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.ceil(F.count("*") / share).alias("parts"))
    rings = stored(rings, "neighbor-rings")
    parted = ringed.drop("cuts", "wanted").join(F.broadcast(rings.select("cell", "ring", "parts")), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    def pack(table):
        label = table.column("label").combine_chunks()
        order = np.lexsort((table.column("far").to_numpy(), label.fill_null(0).to_numpy(), label.is_null().to_numpy(zero_copy_only=False)))
        table = table.take(pa.array(order))
        one = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("cell", "ring", "part")]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), table.column(c).combine_chunks()) for c in ("id", "label", "far")]
        return pa.table([*one, *lists, pa.array([b"".join(table.column("unit").to_pylist())], pa.binary())], ["cell", "ring", "part", "id", "label", "far", "units"])

    table = stored(parted.select("cell", "ring", "part", "id", "label", "far", "unit").groupBy("cell", "ring", "part").applyInArrow(pack, "cell int, ring int, part int, id array<long>, label array<long>, far array<double>, units binary"), "neighbor-lists")
    return Lists(table, centres, np.array([tuple(r) for r in rings.orderBy("cell", "ring").collect()]), n)


def _visits(queries: DataFrame, lists: Lists, first: bool) -> DataFrame:
    """A row for each part that some of a slice of queries must read: those of the nearest lists, or, with the bounds known, all others within reach."""
    shared = queries.sparkSession.sparkContext.broadcast((lists.centres, lists.rings))
    width = lists.width

    def run(batches):
        centres, rings = shared.value
        cell = rings[:, 0].astype(np.int64)
        used = np.unique(cell)
        for batch in _sliced(batches, width):
            units = _units(batch.column("v"))
            apart = _apart(units, centres)
            rank = np.argsort(apart[:, used], axis=1, kind="stable")[:, :PROBES]
            near = np.zeros(apart.shape, bool)
            np.put_along_axis(near, used[rank], True, axis=1)
            mine = apart[:, cell]
            bound = np.full(len(units), np.inf)
            if first:
                go = near[:, cell]
            else:
                kth = np.asarray(batch.column("kth").fill_null(np.inf))
                bound = np.sqrt(2 * (kth + 10.0**-PLACES)) + SLACK
                go = ~near[:, cell] & (np.maximum(mine - rings[:, 3], rings[:, 2] - mine) <= bound[:, None])
            rows, held = [], 0
            for ring in np.flatnonzero(go.any(axis=0)):
                some = np.flatnonzero(go[:, ring])
                take = pa.array(some)
                entry = (batch.column("q").take(take).to_pylist(), units[some].tobytes(), mine[some, ring].tolist(), bound[some].tolist(), batch.column("admits").take(take).to_pylist())
                for part in range(int(rings[ring, 4])):
                    rows.append((int(cell[ring]), int(rings[ring, 1]), part, *entry))
                    held += len(entry[1])
                    if held > SLICE_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    return queries.mapInArrow(run, VISITS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 3 + [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int64()))]
    names = ["cell", "ring", "part", "q", "unit", "apart", "bound", "admits"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _read(visits: DataFrame, lists: Lists, k: int, counted: bool) -> DataFrame:
    """At most k hits of each query in each part, none beyond its bound; counted: also a row without id that holds how many vectors it read there."""
    width = lists.width

    def scan(ids, labels, far, units, q, unit, apart, bound, admits):
        known = labels.is_valid().to_numpy(zero_copy_only=False)
        values = labels.fill_null(0).to_numpy()
        edge = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (known[1:] != known[:-1]), True])
        runs = [(int(values[a]) if known[a] else None, a, z) for a, z in zip(edge[:-1], edge[1:], strict=True)]
        for i, admitted in enumerate(admits):
            spans = []
            for label, a, z in runs:
                if admitted is None or (label is not None and label in admitted):
                    low = a + np.searchsorted(far[a:z], apart[i] - bound[i])
                    high = a + np.searchsorted(far[a:z], apart[i] + bound[i], side="right")
                    if low < high:
                        spans.append(np.arange(low, high))
            if not spans:
                continue
            at = np.concatenate(spans)
            away = np.round(np.maximum(1 - units[at] @ unit[i], 0), PLACES)
            keep = np.flatnonzero(away <= min(bound[i] ** 2 / 2, np.partition(away, k - 1)[k - 1] if len(at) > k else np.inf))
            best = keep[np.lexsort((ids[at[keep]], away[keep]))[:k]]
            yield q[i], ids[at[best]], away[best], len(at)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a = {c: batch.column(c)[r] for c in batch.schema.names}
                units = np.frombuffer(a["units"].as_buffer(), np.float64).reshape(-1, width)
                unit = np.frombuffer(a["unit"].as_buffer(), np.float64).reshape(-1, width)
                out = [[], [], [], []]
                for q, ids, away, n in scan(a["id"].values.to_numpy(), a["label"].values, a["far"].values.to_numpy(), units, a["q"].values.to_numpy(zero_copy_only=False), unit, a["apart"].as_py(), a["bound"].as_py(), a["admits"].as_py()):
                    out[0] += [int(q)] * (len(ids) + counted)
                    out[1] += [*ids.tolist(), *[None] * counted]
                    out[2] += [*away.tolist(), *[None] * counted]
                    out[3] += [*[None] * len(ids), *[n] * counted]
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["query_id", "id", "distance", "n_read"])

    met = visits.join(lists.table, ["cell", "ring", "part"]).select("id", "label", "far", "units", "q", "unit", "apart", "bound", "admits")
    return met.mapInArrow(run, HITS)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.where("id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hits(queries: DataFrame, id_col: str, vector_col: str, lists: Lists | None, k: int, admits_col: str | None = None, counted: bool = False) -> DataFrame:
    """Stored hits, more than are needed: the nearest lists first, whose k-th distances then bound what else is read.  counted: for vectors_read."""
    if not 1 <= k <= 100:
        raise ValueError("k is 1 to 100")
    admits = F.col(admits_col) if admits_col else F.lit(None)
    asked = queries.select(F.col(id_col).cast("long").alias("q"), admits.cast("array<long>").alias("admits"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = asked.where(_usable(F.col("v")) & F.col("q").isNotNull())
    if lists is None:
        return queries.sparkSession.createDataFrame([], HITS)
    n, width = _width(asked)
    if n and width != lists.width:
        raise ValueError(f"queries of {width} components, vectors of {lists.width}")
    near = stored(_read(_visits(asked, lists, True), lists, k, counted), "neighbor-hits")
    kth = _top(near, k).groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("kth"))
    bounded = asked.join(kth.withColumnRenamed("query_id", "q"), "q", "left")
    return near.union(stored(_read(_visits(bounded, lists, False), lists, k, counted), "neighbor-hits"))


def nearest_of_many(queries: DataFrame, id_col: str, vector_col: str, lists: Lists | None, k: int, admits_col: str | None = None) -> DataFrame:
    """query_id, rank (from 1), id, distance of the k nearest admitted vectors of each query."""
    return _top(hits(queries, id_col, vector_col, lists, k, admits_col), k).select("query_id", "rank", "id", "distance")


def vectors_read(found: DataFrame) -> DataFrame:
    """query_id and how many vectors were compared with it; found: counted hits."""
    return found.where("n_read IS NOT NULL").groupBy("query_id").agg(F.sum("n_read").alias("n_read"))
