"""Vectorised word hashing over Arrow text columns.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z lowered.
A text is read as UTF-8 bytes; all separators are ASCII, so this is the same as
matching ``[^\\x20\\x09-\\x0D]+`` on code points.  Every word gets a 64-bit hash: each eight
bytes, with their place in the word, are mixed by themselves (multiplications and shifts, so that
no arithmetic relation between bytes survives), then summed and mixed with the length.
``equal`` compares the bytes themselves where a meeting of hashes must not be taken for equality.

Cases: a null or empty text, or one of separators only, has no words; a column without rows gives no chunks; a text longer than a chunk is one
of its own, read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 20
PIECE = 1 << 22
_SPACES = (32, 9, 10, 11, 12, 13)

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(_SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([0, *[(1 << 8 * i) - 1 for i in range(1, 9)]], np.uint64)  # of so many bytes of eight
_PLACE, _LENGTH = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words(NamedTuple):
    """Words of consecutive rows: counts per row, and hash, first and last byte of each word in data."""

    first: int
    counts: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (length + 1) and bytes of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs, raw


def eights(data: np.ndarray, padded: bool = False) -> np.ndarray:
    """The eight bytes from each byte on as one number; a view of a copy with zeros after the end, or of data itself but for its last eight bytes."""
    data = data if padded else np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def _blocks(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of more than eight bytes, their first block, and word and number of each of their blocks after the first."""
    some = np.flatnonzero(size > 8)
    n = (size[some] - 1) >> 3
    first = np.cumsum(n) - n
    return some, first, np.repeat(some, n), np.arange(int(n.sum())) - np.repeat(first, n) + 1


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    wide, size = eights(data), ends - starts
    total = mix((wide[starts] & _KEEP[np.minimum(size, 8)]) ^ _PLACE)
    some, first, owner, k = _blocks(size)
    if len(some):
        block = wide[starts[owner] + 8 * k] & _KEEP[np.minimum(size[owner] - 8 * k, 8)]
        total[some] += np.add.reduceat(mix(block ^ (k + 1).astype(np.uint64) * _PLACE), first)
    return mix(total + size.astype(np.uint64) * _LENGTH)


def equal(a: np.ndarray, starts_a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, starts_b: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Whether the bytes of each word of one side are those of its partner on the other; a, b: eights() of their data."""
    out = sizes_a == sizes_b
    out &= (a[starts_a] ^ b[starts_b]) & _KEEP[np.minimum(sizes_a, 8)] == 0
    some, first, owner, k = _blocks(np.where(out, sizes_a, 0))
    if len(some):
        other = (a[starts_a[owner] + 8 * k] ^ b[starts_b[owner] + 8 * k]) & _KEEP[np.minimum(sizes_a[owner] - 8 * k, 8)]
        out[some] = np.bitwise_or.reduceat(other, first) == 0
    return out


def _split(data: np.ndarray, breaks: np.ndarray, fold: bool = True, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and hash of each word; breaks: offsets where a word ends in any case."""
    inside = is_word[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    edge = breaks[(breaks > 0) & (breaks < len(data))]
    begin[edge] = inside[edge]
    stop[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, _hash(_LOWER[data] if fold else data, starts, ends)


def _long(data: np.ndarray, fold: bool, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_split of one very long text, piece by piece, cut at separators."""
    parts, at = [], 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data) and is_word[data[to]]:
            inside = is_word[data[to : to + PIECE]]
            to += len(inside) if inside.all() else int(np.argmin(inside))
        s, e, h = _split(data[at:to], np.zeros(0, np.int64), fold, is_word)
        parts.append((s + at, e + at, h))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def chunks(column, size: int = CHUNK, fold: bool = True, is_word: np.ndarray = IS_WORD) -> Iterator[Words]:
    """Words of a text column in groups of rows of about size bytes; a row is never divided.  fold: A-Z hash as a-z; is_word: of each byte."""
    offs, raw = text_buffers(column)
    n, row = len(offs) - 1, 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + size, side="right")) - 1)
        data, local = raw[offs[row] : offs[to]], offs[row : to + 1] - offs[row]
        if len(data) == 0:
            starts = ends = np.zeros(0, np.int64)
            hashes = np.zeros(0, np.uint64)
        elif to == row + 1 and len(data) > PIECE:
            starts, ends, hashes = _long(data, fold, is_word)
        else:
            starts, ends, hashes = _split(data, local, fold, is_word)
        yield Words(row, np.diff(np.searchsorted(starts, local)), hashes, starts, ends, data)
        row = to


def joined(parts: list[Words]) -> Words:
    """The words of consecutive groups of rows as one group."""
    at = np.cumsum([0, *[len(p.data) for p in parts]])
    moved = [(p.starts + a, p.ends + a) for p, a in zip(parts, at, strict=False)]
    return Words(parts[0].first, *[np.concatenate([getattr(p, n) for p in parts]) for n in ("counts", "hashes")], *[np.concatenate([m[i] for m in moved]) for i in (0, 1)], np.concatenate([p.data for p in parts]))


_SHINGLE = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row the hashes of its n-word shingles in order, repeats kept.

    A row of fewer words than n has one shingle, the whole sequence; a row without words has none.
    """
    if len(hashes) >= n:
        total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
        for i in range(n):
            total += hashes[i : len(hashes) - n + 1 + i] * _SHINGLE[i]
        total = mix(total)
    at = 0
    for count in counts.tolist():
        if count >= n:
            yield total[at : at + count - n + 1]
        elif count:
            yield mix((hashes[at : at + count] * _SHINGLE[:count]).sum(keepdims=True) + U64(count))
        else:
            yield hashes[:0]
        at += count
