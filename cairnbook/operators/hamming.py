"""Pairs of hashes few bits apart, between blocks of hashes sorted by the value of one part (dedupe.near_hashes)."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Comparisons of one step; a value with at least so many is taken alone.
STEP, ALONE = 1 << 18, 1 << 13
#: Pairs of an output batch.
OUT = 1 << 16
#: Leading bits of a value by which flips are chosen.
LEADING = 8


def packed(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, dense, document_id) as blocks of at most size of one part: part, block (rising in a part), dense and ids as bytes."""
    from pyspark import TaskContext

    number = itertools.count(TaskContext.get().partitionId() << 32)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    part = None

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            dense, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([next(number)], pa.int64()), pa.array([dense.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary())], ["part", "block", "dense", "ids"])

    for batch in batches:
        parts, dense, ids = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        at = 0
        while at < len(parts):
            if part != parts[at]:
                yield from flush()
                part = int(parts[at])
            end = min(int(np.searchsorted(parts, part, "right")), at + size - sum(len(x) for x, _ in held))
            held.append((dense[at:end].copy(), ids[at:end].copy()))
            if sum(len(x) for x, _ in held) == size:
                yield from flush()
            at = end
    yield from flush()


def flips(width: int, radius: int) -> np.ndarray:
    """The values whose exclusive or with a part's value gives those around it, sorted."""
    return np.array(sorted(sum(1 << i for i in some) for n in range(radius + 1) for some in itertools.combinations(range(width), n)), np.uint64)


class Values:
    """The values of one part in a block, and where each begins."""

    def __init__(self, dense: np.ndarray, part):
        value = dense >> np.uint64(part.first) & np.uint64((1 << part.width) - 1)
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        self.value, self.begin, self.count = value[first], first, np.diff(np.r_[first, len(value)])
        lead = self.value >> np.uint64(max(0, part.width - LEADING))
        cut = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
        self.groups = [(int(lead[a]), a, b) for a, b in zip(cut, [*cut[1:], len(lead)], strict=True)]


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each count, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def looked_up(one: Values, other: Values, around: dict[int, np.ndarray], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in one's values and in other's that are within the part's radius; same: of one block, each two once."""
    for lead, a, b in one.groups:
        for lead2, a2, b2 in other.groups:
            some = around.get(lead ^ lead2)
            if some is None or same and lead2 < lead:
                continue
            if (b - a) * (b2 - a2) <= 8 * (b - a) * len(some):  # few values: all against all
                radius = around["radius"]
                step = max(1, STEP // (b2 - a2))
                for c in range(a, b, step):
                    x, y = np.nonzero(np.bitwise_count(one.value[c : min(b, c + step), None] ^ other.value[None, a2:b2]) <= radius)
                    yield x + c, y + a2
                continue
            step = max(1, STEP // len(some))
            for c in range(a, b, step):
                asked = (one.value[c : min(b, c + step), None] ^ some[None, :]).ravel()
                y = np.searchsorted(other.value[a2:b2], asked)
                y[y == b2 - a2] = 0
                hit = np.flatnonzero(other.value[a2:b2][y] == asked)
                yield hit // len(some) + c, y[hit] + a2


def compared(dense: np.ndarray, dense2: np.ndarray, part, around: dict, distance: int, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Comparisons made, and places in both blocks of hashes at most distance bits apart."""
    one, other = Values(dense, part), Values(dense2, part)
    for x, y in looked_up(one, other, around, same):
        if same:
            x, y = x[x <= y], y[x <= y]
        if not len(x):
            continue
        # x rises; pairs of values of one x stand together
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        total = np.add.reduceat(other.count[y], first)
        large = one.count[x[first]] * total >= ALONE
        bounds = np.r_[first, len(x)]
        for g in np.flatnonzero(large):
            at, us = x[bounds[g]], y[bounds[g] : bounds[g + 1]]
            place2 = ranges(other.begin[us], other.count[us])
            theirs = dense2[place2]
            begin, end = one.begin[at], one.begin[at] + one.count[at]
            wide = min(len(theirs), STEP)
            tall = max(1, STEP // wide)
            for r in range(begin, end, tall):
                mine = dense[r : min(end, r + tall), None]
                for c in range(0, len(theirs), wide):
                    apart = np.bitwise_count(mine ^ theirs[None, c : c + wide]) <= distance
                    found = np.flatnonzero(apart)
                    i, j = np.divmod(found, apart.shape[1])
                    yield from kept(apart.size, i + r, place2[j + c], same)
        few = np.repeat(~large, np.diff(bounds))
        x, y = x[few], y[few]
        size = one.count[x] * other.count[y]
        ends = np.cumsum(size)
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            n, m = size[at:to], other.count[y[at:to]]
            inside = ranges(np.zeros(len(n), np.int64), n)
            wide = np.repeat(m, n)
            i = np.repeat(one.begin[x[at:to]], n) + inside // wide
            j = np.repeat(other.begin[y[at:to]], n) + inside % wide
            near = np.flatnonzero(np.bitwise_count(dense[i] ^ dense2[j]) <= distance)
            yield from kept(len(i), i[near], j[near], same)
            at = to


def kept(n: int, i: np.ndarray, j: np.ndarray, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    yield (n, i[i < j], j[i < j]) if same else (n, i, j)


def pairs(batches: Iterable[pa.RecordBatch], parts: Sequence, distance: int) -> Iterator[pa.RecordBatch]:
    """document_id, other_id, distance of rows (part, same, dense, ids, other_dense, other_ids); a row without document_id holds the comparisons made."""
    known: dict[int, dict] = {}
    held: list[tuple[np.ndarray, ...]] = []
    made = n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal n
        if held:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            for at in range(0, n, OUT):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + OUT]) for c in columns], ["document_id", "other_id", "distance"])
            n = 0

    for batch in batches:
        for row in range(batch.num_rows):
            number, same, *parts_of = (c[row] for c in batch.columns)
            number, same = number.as_py(), same.as_py()
            dense, ids, dense2, ids2 = (np.frombuffer(c.as_buffer(), t) for c, t in zip(parts_of, (np.uint64, np.int64) * 2, strict=True))
            part = parts[number]
            if number not in known:
                every = flips(part.width, part.radius)
                lead = every >> np.uint64(max(0, part.width - LEADING))
                known[number] = {int(v): every[lead == v] for v in np.unique(lead)} | {"radius": part.radius}
            for count, i, j in compared(dense, dense2, part, known[number], distance, same):
                made += count
                if not len(i):
                    continue
                apart = dense[i] ^ dense2[j]
                first = np.ones(len(i), bool)  # the first part in which the two meet
                for p in parts[:number]:
                    first &= np.bitwise_count(apart >> np.uint64(p.first) & np.uint64((1 << p.width) - 1)) > p.radius
                first &= ids[i] != ids2[j]
                a, b = ids[i[first]], ids2[j[first]]
                held.append((np.minimum(a, b), np.maximum(a, b), np.bitwise_count(apart[first]).astype(np.int32)))
                n += len(a)
                if n >= OUT:
                    yield from flush()
    yield from flush()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([made], pa.int64()), pa.array([0], pa.int32())], ["document_id", "other_id", "distance"])
