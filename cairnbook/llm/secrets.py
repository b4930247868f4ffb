"""Secret scans by a trigram inverted index (operator 13).

From each rule's regular expression a Boolean query of trigrams is derived that every match satisfies: a sequence needs all
trigrams of its literals, an alternation one of its branches' queries, an optional part nothing.  Texts are indexed with A-Z
lowered, and so are the literals, so that one index serves rules of either case.  A shard of rows is indexed as
postings (trigram -> ascending rows); a rule's query intersects and unites postings, and only the rows it leaves are searched
with the expression itself.  A rule whose query is empty, as one of character classes alone, searches every row.

A shard is built, queried and dropped inside one task, so that nothing is shuffled or stored; it holds the postings of the trigrams
that some rule asks for.  Its size is bounded by SHARD_BYTES of text, a single longer text excepted, which is a shard alone.

Rules: the first three are fixed by the contract; the others add known formats of keys.  Matches are leftmost and do not
overlap within a kind; those whose group is shorter than its minimum are dropped.  Positions count code points.

Cases: a null text is empty; an empty text has no spans, and base_sha256 is that of the empty string; texts of any length are searched
whole; rows of one id, or without id, are scanned each; an empty table gives no rows; columns besides the two named take no part.
"""

from __future__ import annotations

import hashlib
import re
from re import _constants as ops, _parser as parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.llm.shared import documents, trimmed
from cairnbook.llm.words import text_buffers

SHARD_BYTES, SHARD_ROWS = 1 << 22, 4096
#: Sets of literals beyond these sizes are cut down to what every one of them begins and ends with.
EXACT, ENDS = 64, 32


class Rule(NamedTuple):
    """A kind of secret; fold: letters in either case; group and least: a match counts if this group has so many characters."""

    kind: str
    pattern: str
    fold: bool = False
    group: int = 0
    least: int = 0


#: Fixed values of the contract.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    Rule("hex", r"[0-9a-f]+", False, 0, 24),
)
#: Formats of keys as their issuers publish them.
KNOWN = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"(?:gh[opsur]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255})"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,255}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,255}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"://[^\s/:@]{1,255}:[^\s/:@]{1,255}@"),
)
RULES = BASE + KNOWN


# --- Boolean trigram queries: True (no demand), a trigram, ("and", parts) or ("or", parts)


def _all(*parts):
    flat = {q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p]) if q is not True}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _any(*parts):
    if any(p is True for p in parts):
        return True
    flat = {q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "or" else [p])}
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _of(literals) -> object:
    """The query of texts that hold one of the literals (bytes)."""
    return _any(*[_all(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in literals]) if literals else True


class Part(NamedTuple):
    """What is known of the texts that a part of an expression matches: all of them if few, else how they begin and end, and a query."""

    exact: frozenset | None
    begin: frozenset
    end: frozenset
    query: object


NOTHING = frozenset([b""])
FREE = Part(None, NOTHING, NOTHING, True)


def _some(literals) -> Part:
    literals = frozenset(literals)
    return Part(literals, literals, literals, True)


def _short(ends: frozenset, front: bool) -> frozenset:
    """At most ENDS beginnings (or endings), shortened alike as far as that takes."""
    n = max(map(len, ends), default=0)
    while len(ends) > ENDS:
        n -= 1
        ends = frozenset(e[:n] if front else e[len(e) - n :] if len(e) > n else e for e in ends)
    return ends


def _loose(p: Part) -> Part:
    """p without its exact set."""
    return p if p.exact is None else Part(None, _short(p.exact, True), _short(p.exact, False), _all(p.query, _of(p.exact)))


def _after(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= EXACT:
        return _some(x + y for x in a.exact for y in b.exact)
    a, b = (x if x.exact is not None and len(x.exact) <= ENDS else _loose(x) for x in (a, b))
    across = _of({x + y for x in a.end for y in b.begin})
    begin = _short(frozenset(x + y for x in a.exact for y in b.begin), True) if a.exact is not None else a.begin
    end = _short(frozenset(x + y for x in a.end for y in b.exact), False) if b.exact is not None else b.end
    return Part(None, begin, end, _all(a.query, b.query, across, *[_of(x.exact) for x in (a, b) if x.exact is not None]))


def _either(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= EXACT:
        return _some(a.exact | b.exact)
    a, b = _loose(a), _loose(b)
    return Part(None, _short(a.begin | b.begin, True), _short(a.end | b.end, False), _any(a.query, b.query))


def _letters(items) -> Part:
    """A character class: its members if they are few ASCII characters."""
    out: set[int] = set()
    for op, value in items:
        if op is ops.LITERAL:
            out.add(value)
        elif op is ops.RANGE and value[1] - value[0] < 2 * EXACT:
            out.update(range(value[0], value[1] + 1))
        else:
            return FREE
    return _some(_lowered(chr(c)) for c in out) if len(out) <= EXACT // 4 else FREE


def _lowered(text: str) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())


def _read(tree) -> Part:
    out = _some([b""])
    for op, value in tree:
        if op is ops.LITERAL:
            one = _some([_lowered(chr(value))])
        elif op is ops.IN:
            one = _letters(value)
        elif op is ops.SUBPATTERN:
            one = _read(value[3])
        elif op is ops.BRANCH:
            one, *more = map(_read, value[1])
            for m in more:
                one = _either(one, m)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            low, high, inner = value
            inner = _read(inner)
            if low == 0:
                one = _either(inner, _some([b""])) if high == 1 else FREE
            else:
                one = inner
                for _ in range(min(low, 8) - 1):
                    one = _after(one, inner)
                if high != low or low > 8:  # more may stand between the first and the last ones
                    one = _loose(one)
        elif op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
            continue
        else:
            one = FREE
        out = _after(out, one)
    return out


def trigram_query(rule: Rule) -> object:
    """The Boolean query that every text with a match of the rule satisfies; True where none is mandatory."""
    return _loose(_read(parser.parse(rule.pattern))).query


def trigrams(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


# --- the index


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Postings:
    """Trigram -> ascending rows of one shard, for the trigrams that wanted marks."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, wanted: np.ndarray):
        data = _LOWER[data[offsets[0] : offsets[-1]]].astype(np.uint32)
        ends = offsets[1:] - offsets[0]
        self.rows, self.lists = len(ends), {}
        if len(data) < 3:
            return
        code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        at = np.flatnonzero(wanted[code])
        row = np.searchsorted(ends, at, side="right")
        inside = at + 2 < ends[row]  # a trigram lies in one text
        pair = np.unique(code[at[inside]].astype(np.int64) << 32 | row[inside])
        codes, rows = pair >> 32, pair & 0xFFFFFFFF
        some, first = np.unique(codes, return_index=True)
        self.lists = dict(zip(some.tolist(), np.split(rows, first[1:]), strict=True)) if len(some) else {}

    def find(self, query) -> np.ndarray:
        """Rows that satisfy a query, ascending."""
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, bytes):
            return self.lists.get(_code(query), np.zeros(0, np.int64))
        if query[0] == "or":
            return np.unique(np.concatenate([self.find(q) for q in query[1]]))
        out = None
        for found in sorted((self.find(q) for q in query[1]), key=len):
            out = found if out is None else np.intersect1d(out, found, assume_unique=True)
            if not len(out):
                break
        return out


def wanted(queries) -> np.ndarray:
    out = np.zeros(1 << 24, bool)
    out[[_code(t) for q in queries for t in trigrams(q)]] = True
    return out


def matches(rule: Rule, text: str, search=None) -> list[tuple[int, int]]:
    """Start and end of a rule's matches in a text."""
    search = search or compiled(rule)
    return [m.span() for m in search.finditer(text) if len(m[rule.group]) >= rule.least]


def compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.fold else 0))


def _text(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, candidates (rules whose query the text satisfies, of those that have one), kinds, starts and ends of all matches, by start, then in the rules' order."""
    queries = [trigram_query(r) for r in rules]

    def run(batches):
        marks, search = wanted(queries), [compiled(r) for r in rules]
        for batch in trimmed(batches):
            offsets, data = text_buffers(batch.column("text"))
            row = 0
            while row < batch.num_rows:
                to = min(row + SHARD_ROWS, max(row + 1, int(np.searchsorted(offsets, offsets[row] + SHARD_BYTES, side="right")) - 1), batch.num_rows)
                index = Postings(offsets[row : to + 1], data, marks)
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(to - row)]
                passed = np.zeros(to - row, np.int64)
                texts: dict[int, str] = {}
                for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                    rows = index.find(query)
                    if query is not True:
                        passed[rows] += 1
                    for i in rows.tolist():
                        if i not in texts:
                            texts[i] = bytes(data[offsets[row + i] : offsets[row + i + 1]]).decode("utf-8", "replace")
                        found[i] += [(a, k, b) for a, b in matches(rule, texts[i], search[k])]
                for spans in found:
                    spans.sort()
                parts = [pa.array([[s[j] if j != 1 else rules[s[1]].kind for s in spans] for spans in found], pa.list_(kind)) for j, kind in ((1, pa.string()), (0, pa.int64()), (2, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, to - row), pa.array(passed), *parts], ["doc_id", "candidates", "kinds", "starts", "ends"])
                row = to

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, candidates long, kinds array<string>, starts array<long>, ends array<long>")


def _is(kind: str):
    return lambda k: F.when(k == kind, 1)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.arrays_zip("kinds", "starts", "ends")

    def joined(some):
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])), ",")

    counts = [F.size(F.array_compact(F.transform("kinds", _is(r.kind)))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = F.filter(spans, lambda s: s["kinds"].isin([r.kind for r in BASE]))
    return scan(documents(spark, sf_dir)).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), "candidates")
