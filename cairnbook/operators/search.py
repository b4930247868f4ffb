"""Chunking of marked-up text and filtered exact vector search."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnbook.functions.text import cosine
from cairnbook.operators.intent import is_aggregation

MAX_TOKENS, TOP_K, BATCH = 480, 8, 16
REFUSAL = "amounts are answered from verified records only"
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
_WORD = re.compile(r"[A-Za-z0-9_]+")
_SPACE = re.compile(r"\s+")


def tokens(text: str) -> int:
    """CJK characters 1, words of letters, digits and _ a quarter of their length (rounded up), other characters 1."""
    sizes = [len(w) for w in _WORD.findall(text)]
    blank = sum(map(len, _SPACE.findall(text)))
    return sum((n + 3) >> 2 for n in sizes) + len(text) - sum(sizes) - blank


def sections(body: str) -> Iterable[tuple[str, list[str]]]:
    """(heading path, lines) of each part below a heading; parts of blank lines only are left out."""
    path, lines = [], []
    for line in [*body.splitlines(), None]:
        mark = _HEADING.match(line) if line is not None else None
        if line is not None and not mark:
            lines.append(line)
            continue
        if any(x.strip() for x in lines):
            yield " > ".join(path), lines
        if mark:
            path, lines = [*path[: len(mark[1]) - 1], mark[2].strip()], []


def blocks(lines: list[str]) -> list[tuple[str, bool]]:
    """Paragraphs and tables (True); a table's lines begin with | and hold another."""
    out: list[tuple[list[str], bool]] = []
    fresh = True
    for line in lines:
        text = line.strip()
        if not text:
            fresh = True
            continue
        table = text.startswith("|") and text.count("|") > 1
        if fresh or out[-1][1] != table:
            out.append(([], table))
        out[-1][0].append(line)
        fresh = False
    return [("\n".join(part).strip(), table) for part, table in out]


def _pack(pieces: Iterable[tuple[str, int]], limit: int, joint: str) -> list[tuple[str, int]]:
    """Neighbouring pieces (text, tokens) together up to limit tokens; each joint costs one.  Texts with their tokens, counted anew only where joined."""
    out: list[list[tuple[str, int]]] = []
    used = 0
    for piece in pieces:
        if out and used + 1 + piece[1] <= limit:
            out[-1].append(piece)
            used += 1 + piece[1]
        else:
            out.append([piece])
            used = piece[1]
    # joints are white space, so that the tokens of the whole are those of its parts
    return [(joint.join(t for t, _ in p), sum(n for _, n in p)) for p in out]


def hard_split(text: str, limit: int) -> list[str]:
    """Pieces of at most limit tokens, cut between characters; linear in the text."""
    out, start, used, word = [], 0, 0, 0
    for i, c in enumerate(text):
        part = c.isascii() and (c.isalnum() or c == "_")
        cost = 0 if c.isspace() else (1 if word % 4 == 0 else 0) if part else 1
        word = word + 1 if part else 0
        if used + cost > limit and i > start:
            out.append(text[start:i])
            start, used, word = i, 0 if c.isspace() else 1, int(part)
        else:
            used += cost
    out.append(text[start:])
    return [p.strip() for p in out if p.strip()]


def split_paragraph(text: str, limit: int) -> list[tuple[str, int]]:
    """(text, tokens) by sentences, packed; sentences above the limit by characters."""
    sentences = [p.strip() for p in re.split(r"(?<=[。！？.!?])\s*", text) if p.strip()]
    if len(sentences) < 2:
        return [(p, tokens(p)) for p in hard_split(text, limit)]
    out, run = [], []
    for sentence in sentences:
        n = tokens(sentence)
        if n <= limit:
            run.append((sentence, n))
            continue
        out += _pack(run, limit, " ") + [(p, tokens(p)) for p in hard_split(sentence, limit)]
        run = []
    return out + _pack(run, limit, " ")


def chunk(body: str, limit: int = MAX_TOKENS) -> list[tuple[int, str, str, int]]:
    """(seq, heading path, text, tokens); tables stay whole and raise ValueError above the limit."""
    out = []
    for path, lines in sections(body):
        pieces = []
        for text, table in blocks(lines):
            n = tokens(text)
            if n <= limit:
                pieces.append((text, n))
            elif table:
                raise ValueError(f"a table below {path or 'the beginning'!r} is above {limit} tokens")
            else:
                pieces += split_paragraph(text, limit)
        out += [(path, text, n) for text, n in _pack(pieces, limit, "\n\n")]
    return [(i, *c) for i, c in enumerate(out)]


def chunks(docs: DataFrame, id_col: str, text_col: str, limit: int = MAX_TOKENS) -> DataFrame:
    """Chunks of every document, Arrow batch by batch, without a shuffle.

    A document that cannot be cut (a table above the limit) gives one row with the reason in error and no chunk, and stops no other document.
    Cases: a null or empty text has no chunks; a null id is an id; repeated rows are chunked each.
    """
    names = ["document_id", "seq", "heading_path", "text", "tokens", "error"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]

    def cut(i, text):
        try:
            return [(i, *c, None) for c in chunk(text or "", limit)]
        except ValueError as e:
            return [(i, None, None, None, None, str(e))]

    def run(batches):
        for batch in batches:
            rows = [r for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in cut(i, text)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "document_id long, seq int, heading_path string, text string, tokens int, error string")


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> DataFrame:
    """rows with embedding from an injected embedder, batch texts a call, one retry, order kept."""

    def run(batches):
        for pdf in batches:
            out = []
            for i in range(0, len(pdf), batch):
                part = pdf["text"].iloc[i : i + batch].tolist()
                try:
                    out += embedder(part)
                except Exception:  # noqa: BLE001  one retry, whatever failed
                    out += embedder(part)
            yield pdf.assign(embedding=out)

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def nearest(chunks_: DataFrame, query: Column, k: int = TOP_K, *ties: str) -> DataFrame:
    """The k nearest by cosine distance, exact; 1 to 100.  One pass, k rows per task meet at the end."""
    if not 1 <= k <= 100:
        raise ValueError("k is 1 to 100")
    return chunks_.withColumn("distance", cosine(F.col("embedding"), query)).orderBy("distance", *ties).limit(k)


def answer(question: str, hits: DataFrame, hybrid: bool = False) -> DataFrame:
    """question, refused and passage (text with its citation) of a semantic answer; arithmetic is refused unless a verified total goes with it."""
    refused = is_aggregation(question) and not hybrid
    if refused:
        one = hits.sparkSession.range(1)
        return one.select(F.lit(question).alias("question"), F.lit(True).alias("refused"), F.lit(REFUSAL).alias("passage"))
    cited = F.concat(F.col("text"), F.lit(" [source "), F.col("document_id").cast("string"), F.lit(":"), F.col("seq").cast("string"), F.lit("]"))
    return hits.select(F.lit(question).alias("question"), F.lit(False).alias("refused"), cited.alias("passage"))
