"""Token-id files coded by a static range asymmetric numeral system (operator 7).

A file holds the documents of one range of doc_ids, at most SEGMENT tokens unless one document is longer::

    magic, number of documents and tokens
    frequency table: symbols and their shares of 2**16, shared by all blocks
    documents: doc_ids and token counts
    checkpoints: for each block its number of tokens, place in the words, crc32 of its ids, and the
                 LANES states from which decoding starts
    words: 16-bit units of all blocks

A block of BLOCK tokens is coded by LANES interleaved states and needs nothing but the table and its
checkpoint, so that blocks (and files) can be decoded in any order, and apart.  Here all blocks of a file
advance together, one vector operation for a step of all their lanes.

Spark has no writer of plain binary files, so files are stored as rows (part, segment, file) of a table in
the shared folder; encode_file and decode_file work on bytes alone.

Cases: a null or empty text has the end id only; an empty table gives no files; rows of one doc_id
stay apart, in the order of their texts' hashes; a null doc_id comes first.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnbook.llm import tokens
from cairnbook.llm.ordered import in_ranges
from cairnbook.llm.shared import documents, stored, trimmed

END = 1
BITS, LANES, STEPS, SEGMENT = 16, 64, 256, 1 << 22
BLOCK = LANES * STEPS
LOW = np.uint64(1 << 16)
MAGIC = b"RANS1\0\0\0"


def table(ids: np.ndarray) -> np.ndarray:
    """Shares of 2**BITS by symbol: at least 1 for each that occurs, largest remainders corrected on the most frequent."""
    counts = np.bincount(ids, minlength=1)
    share = np.where(counts > 0, np.maximum(1, counts * (1 << BITS) // max(1, counts.sum())), 0)
    over = int(share.sum()) - (1 << BITS)
    if counts.sum() == 0:
        return share
    order = np.argsort(-share, kind="stable")
    if over < 0:
        share[order[0]] -= over
    while over > 0:
        for s in order:
            give = min(over, int(share[s]) // 2 if share[s] > 1 else 0)
            share[s] -= give
            over -= give
            if not over or share[s] <= 1:
                break
    return share


def _encode(ids: np.ndarray, share: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """States (blocks, lanes) and the words of each block of ids (blocks, steps, lanes)."""
    blocks, steps, lanes = ids.shape
    x = np.full((blocks, lanes), LOW)
    words_ = np.zeros((steps, blocks, lanes), np.uint16)
    wrote = np.zeros((steps, blocks, lanes), bool)
    for t in range(steps - 1, -1, -1):
        f = share[ids[:, t]]
        over = x >= (f << np.uint64(16))
        words_[t], wrote[t] = x & np.uint64(0xFFFF), over
        x = np.where(over, x >> np.uint64(16), x)
        q = x // f
        x = (q << np.uint64(BITS)) + (x - q * f) + start[ids[:, t]]
    return x, [words_[:, b][wrote[:, b]] for b in range(blocks)]


def _decode(states: np.ndarray, steps: int, words_: np.ndarray, place: np.ndarray, share: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """ids (blocks, steps, lanes) from states (blocks, lanes); place: first word of each block."""
    x, at = states.astype(np.uint64), place.astype(np.int64).copy()
    out = np.zeros((len(x), steps, x.shape[1]), np.uint16)
    padded = np.concatenate((words_, np.zeros(1, np.uint16))).astype(np.uint64)
    for t in range(steps):
        slot = x & np.uint64((1 << BITS) - 1)
        s = symbol[slot]
        out[:, t] = s
        x = share[s] * (x >> np.uint64(BITS)) + slot - start[s]
        low = x < LOW
        rank = np.cumsum(low, axis=1)
        word = padded[np.where(low, at[:, None] + rank - 1, len(words_))]
        x = np.where(low, (x << np.uint64(16)) | word, x)
        at += rank[:, -1]
    return out


def encode_file(doc_ids: list, docs: list[np.ndarray]) -> bytes:
    """The file of documents' token ids; doc_ids may hold None."""
    ids = np.concatenate(docs).astype(np.uint16) if docs else np.zeros(0, np.uint16)
    share = table(ids)
    wide, start = share.astype(np.uint64), (np.cumsum(share) - share).astype(np.uint64)
    fill = int(np.argmax(share))
    cut = len(ids) // BLOCK * BLOCK
    blocks = []  # (tokens, state, words)
    if cut:
        states, streams = _encode(ids[:cut].reshape(-1, STEPS, LANES), wide, start)
        blocks += [(BLOCK, s, w) for s, w in zip(states, streams, strict=True)]
    if rest := len(ids) - cut:
        steps = -(-rest // LANES)
        last = np.full(steps * LANES, fill, np.uint16)
        last[:rest] = ids[cut:]
        states, streams = _encode(last.reshape(1, steps, LANES), wide, start)
        blocks.append((rest, states[0], streams[0]))
    some = np.flatnonzero(share)
    place = np.cumsum([0] + [len(w) for _, _, w in blocks])
    crc = [zlib.crc32(ids[i * BLOCK : i * BLOCK + n].astype("<u4").tobytes()) for i, (n, _, _) in enumerate(blocks)]
    parts = [
        MAGIC, struct.pack("<QQQQQ", len(docs), len(ids), len(some), len(blocks), int(place[-1])),
        some.astype("<u2").tobytes(), (share[some] - 1).astype("<u2").tobytes(),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(d) for d in docs], "<i8").tobytes(),
        np.array([n for n, _, _ in blocks], "<u4").tobytes(), place[:-1].astype("<u8").tobytes(), np.array(crc, "<u4").tobytes(),
        np.concatenate([s for _, s, _ in blocks]).astype("<u4").tobytes() if blocks else b"", np.concatenate([w for _, _, w in blocks]).astype("<u2").tobytes() if blocks else b"",
    ]
    return b"".join(parts)


def decode_file(data: bytes, only: int | None = None):
    """(doc_ids, token counts, ids) of a file; only: the ids of that block alone.  A block that fails its checksum raises."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    n_docs, n_ids, n_some, n_blocks, n_words = struct.unpack_from("<QQQQQ", data, 8)
    at = 48

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    some, values = take("<u2", n_some), take("<u2", n_some)
    there, docs, sizes = take("u1", n_docs), take("<i8", n_docs), take("<i8", n_docs)
    tokens_, place, crc = take("<u4", n_blocks), take("<u8", n_blocks), take("<u4", n_blocks)
    states, words_ = take("<u4", n_blocks * LANES).reshape(-1, LANES), take("<u2", n_words)
    share = np.zeros(1 << 16, np.uint64)
    share[some] = values.astype(np.uint64) + np.uint64(1)
    start = np.cumsum(share) - share
    symbol = np.repeat(np.arange(1 << 16), share.astype(np.int64)).astype(np.uint16)
    which = np.arange(n_blocks) if only is None else np.array([only])
    ids = []
    for steps in (STEPS, None):
        full = tokens_[which] == BLOCK
        group = which[full] if steps else which[~full]
        for part in [group] if steps else group.reshape(-1, 1):
            if len(part):
                n = steps or -(-int(tokens_[part[0]]) // LANES)
                ids.append(_decode(states[part], n, words_, place[part], share, start, symbol).reshape(-1)[: int(tokens_[part].sum())])
    out = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    at_id = 0
    for b in which.tolist():
        n = int(tokens_[b])
        if zlib.crc32(out[at_id : at_id + n].astype("<u4").tobytes()) != crc[b]:
            raise ValueError(f"block {b} does not match its checksum")
        at_id += n
    return [int(d) if t else None for d, t in zip(docs, there, strict=True)], sizes, out


def write_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END, segment: int = SEGMENT) -> DataFrame:
    """Files (part, segment, n_docs, n_tokens, file) of all texts' ids in ascending doc_id order, stored in the shared folder."""

    def run(batches):
        docs, ids, held, number, part = [], [], 0, 0, 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64()), pa.array([encode_file(docs, ids)], pa.binary())], ["part", "segment", "n_docs", "n_tokens", "file"])

        for batch in trimmed(batches, tokens.HELD):
            for doc, where, own in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), tokens.documents_ids(batch.column("text"), end, path), strict=True):
                if held and (where != part or held + len(own) > segment):
                    yield flush()
                    docs, ids, held, number = [], [], 0, number + 1
                part = where
                docs.append(doc)
                ids.append(own)
                held += len(own)
        if held:
            yield flush()

    return stored(in_ranges(df, id_col, text_col).mapInArrow(run, "part int, segment int, n_docs long, n_tokens long, file binary"), "token-ids")


def read_ids(files: DataFrame) -> DataFrame:
    """(part, segment, doc_id, before, n_tokens, ids_crc32) of each document, decoded from files; before: ids in its file before it."""

    def run(batches):
        for batch in trimmed(batches):
            for part, segment, file in zip(batch.column("part").to_pylist(), batch.column("segment").to_pylist(), batch.column("file"), strict=True):
                docs, sizes, ids = decode_file(file.as_buffer())
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["part", "segment", "doc_id", "before", "n_tokens", "ids_crc32"])

    return files.select("part", "segment", "file").mapInArrow(run, "part int, segment int, doc_id long, before long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of df from the files written: doc_id, start, n_tokens, ids_crc32."""
    files = write_ids(df, id_col, text_col, path)
    w = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", "segment", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("base"))
    read = read_ids(files).join(bases, ["part", "segment"])
    return read.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
