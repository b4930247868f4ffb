"""Text functions that Spark's built-ins lack, as Arrow-batched pandas UDFs over plain Python functions."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import unicodedata
import urllib.parse
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _each(kind, f):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else f(v)).astype(object)

    return run


def nfkc_key(text: str) -> str:
    """NFKC, case folded, white space collapsed."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def indel_ratio(a: str, b: str) -> float:
    """200 * longest common subsequence / (both lengths); 100 for two empty texts.  Bit-parallel."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _points(texts: list[str], width: int, fill: int) -> np.ndarray:
    """Code points of texts side by side, fill where a text has no more."""
    out = np.frombuffer("".join([t.ljust(width, "\0") for t in texts]).encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(texts), width)
    return np.where(np.arange(width) < np.array([len(t) for t in texts])[:, None], out, fill)


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """indel_ratio of many pairs: the bit rows of all pairs of about one length side by side; names of over 64 characters one by one."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    out = np.empty(len(sizes))
    swap = sizes[:, 0] > sizes[:, 1]  # the shorter one is the row of bits
    order = np.lexsort((sizes.max(1), sizes.min(1)))
    for at in range(0, len(order), 4096):
        some = order[at : at + 4096]
        wide, long = sizes[some].min(1), sizes[some].max(1)
        if wide.max() > 64:
            out[some] = [indel_ratio(a[i], b[i]) for i in some]
            continue
        # as many columns as whole bytes of bits; code points of a text that is too short match nothing
        x, y = (_points([s[i] if swap[i] == other else r[i] for i in some], width, fill) for r, s, other, width, fill in ((a, b, True, -(-wide.max() // 8) * 8, -1), (a, b, False, long.max(), -2)))
        full = np.where(wide < 64, (np.uint64(1) << np.minimum(wide, 63).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
        row, bits = full.copy(), np.zeros((len(some), 8), np.uint8)
        for j in range(y.shape[1]):
            bits[:, : x.shape[1] // 8] = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little")
            hit = row & bits.view("<u8")[:, 0]
            row = ((row + hit) | (row - hit)) & full
        total = wide + long
        out[some] = np.where(total > 0, 200.0 * (wide - np.bitwise_count(row)) / np.maximum(total, 1), 100.0)
    return out


def signatures(texts: list[str]) -> np.ndarray:
    """64 bits of how often characters occur: each digit up to 3 times, 17 classes of all others up to 2 times.

    Two texts' signatures differ in no more bits than characters must go and come to make one text the other.
    """
    out = np.zeros(len(texts), np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(sizes, kind="stable")
    for at in range(0, len(order), 4096):
        some = order[at : at + 4096]
        x = _points([texts[i] for i in some], int(sizes[some].max()), -1)
        digit = (x >= 48) & (x < 58)
        kind = np.where(digit, x - 48, np.where(x < 0, -1, x % 17 + 10))
        bit = 0
        for k in range(27):
            n = (kind == k).sum(1)
            for least in range(1, 4 if k < 10 else 3):
                out[some] |= (n >= least).astype(np.uint64) << np.uint64(bit)
                bit += 1
    return out


@F.pandas_udf(T.LongType())
def signature_udf(a: pd.Series) -> pd.Series:
    there = a.notna().to_numpy()
    out = np.zeros(len(a), np.int64)
    out[there] = signatures(a[there].tolist()).view(np.int64)
    return pd.Series(out).astype("Int64").where(there)


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    there = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[there] = indel_ratios(a[there].tolist(), b[there].tolist())
    return pd.Series(out).astype("Float64").where(there)


def similarity(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def edits_within(a: Column, b: Column, most: Column) -> Column:
    """An array of the number of edits, empty where it is above most; to be exploded, so that it is computed once.  Looked for in a band where most is small."""
    edits = F.when(most <= 2, F.levenshtein(a, b, 2)).when(most <= 4, F.levenshtein(a, b, 4)).otherwise(F.levenshtein(a, b))
    return F.filter(F.array(edits), lambda e: (e >= 0) & (e <= most))


def similarity_of_edits(a: Column, b: Column, edits: Column) -> Column:
    """similarity; where the number of edits says it, it is not computed in Python: no more than the lengths differ, or one between equal lengths."""
    m, n = F.length(a), F.length(b)
    common = F.when(edits == F.abs(m - n), F.least(m, n)).when((m == n) & (edits == 1), m - 1)
    known = F.when(common.isNotNull() & (m + n > 0), 200.0 * common / (m + n))
    asked = a.isNotNull() & b.isNotNull() & known.isNull()
    return F.coalesce(known, similarity(F.when(asked, a), F.when(asked, b)))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words whose 64 signs are summed at once.
_SUMMED = 1 << 16


def word_signs(words: list[str]) -> np.ndarray:
    """For each word 64 times 1 or -1, from bit 63 down, by the first 64 bits of its md5."""
    digests = b"".join([hashlib.md5(w.encode()).digest()[:8] for w in words])
    return np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64).astype(np.int8) * 2 - 1


def simhashes(texts: list[str | None]) -> np.ndarray:
    """64-bit similarity hashes: a bit is set if more of the words' hashes (repeats counted) have it set than not; 0 without words."""
    number: dict[str, int] = {}
    of = [np.array([number.setdefault(w, len(number)) for w in _WORD.findall(t or "")], np.int64) for t in texts]
    signs = word_signs(list(number))
    total = np.array([sum((signs[x[i : i + _SUMMED]].sum(0, dtype=np.int64) for i in range(0, len(x), _SUMMED)), np.zeros(64, np.int64)) for x in of]).reshape(-1, 64)
    return np.packbits(total > 0, axis=1).view(">i8").reshape(-1).astype(np.int64)


@F.pandas_udf(T.LongType())
def simhash_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64-bit similarity hash of a text's words (runs between white space, as they are written); null for null."""
    for s in texts:
        parts = [pd.Series(simhashes(s[i : i + 256].tolist()), dtype="Int64") for i in range(0, len(s), 256)]
        yield (pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype="Int64")).where(s.notna().reset_index(drop=True))


def canonical_json(value: object) -> str:
    """Sorted keys, ASCII, no spaces, no NaN."""
    return json.dumps(value, sort_keys=True, ensure_ascii=True, separators=(",", ":"), allow_nan=False)


def canonical_digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def locator(kind: str, *parts: object) -> str:
    return "/".join([kind, *(urllib.parse.quote(str(p), safe="") for p in parts)])


def flatten_confidence(payload: object, path: str = "", name: str = "confidence") -> dict[str, float]:
    """Dotted and indexed paths of every {value, confidence} in a nested payload."""
    out: dict[str, float] = {}
    if isinstance(payload, dict):
        if "value" in payload and name in payload:
            return {path: payload[name]} if payload[name] is not None else {}
        for key in sorted(payload):
            out |= flatten_confidence(payload[key], f"{path}.{key}" if path else key, name)
    elif isinstance(payload, list):
        for i, item in enumerate(payload):
            out |= flatten_confidence(item, f"{path}[{i}]", name)
    return out


# Issuer names, kinds and cues.
ISSUER_ALIASES = ((("東京電力", "tepco"), "東京電力", "electric"), (("東京ガス", "tokyo gas"), "東京ガス", "gas"))
ISSUER_KINDS = ((("電力", "electricity", "電気"), "electric"), (("ガス", "gas"), "gas"), (("水道", "water"), "water"), (("国民健康保険", "国保", "nhi"), "nhi"), (("税", "tax", "住民税", "固定資産"), "tax"))
UNITS = {"kwh": "kWh", "kw/h": "kWh", "m3": "m³", "m^3": "m³"}


def issuer(raw: str) -> tuple[str, str]:
    clean = " ".join(unicodedata.normalize("NFKC", raw).split())
    if not clean:
        raise ValueError("an issuer needs a name")
    low = clean.casefold()
    for cues, name, kind in ISSUER_ALIASES:
        if any(c in low for c in cues):
            return name, kind
    return clean, next((kind for cues, kind in ISSUER_KINDS if any(c in low for c in cues)), "other")


def period_or_date(raw: str | None, month_only: bool) -> dt.date | None:
    """ISO, Gregorian or Reiwa (year 2018 + n) labels; a month label gives its first day.  Raises ValueError for others."""
    text = unicodedata.normalize("NFKC", raw or "").strip()
    if not text:
        if month_only:
            raise ValueError("a billing period is needed")
        return None
    try:
        day = dt.date.fromisoformat(text)
        return day.replace(day=1) if month_only else day
    except ValueError:
        pass
    tail = r"(?:月)?(?:分)?$" if month_only else r"(?:月|\s*[-./])\s*(\d{1,2})(?:日)?$"
    found = re.match(r"^(?:(\d{4})|(?:令和|[Rr])\s*(\d{1,2}))\s*(?:年|[-./])\s*(\d{1,2})" + tail, text)
    if not found:
        raise ValueError(f"not a known date label: {raw!r}")
    year = int(found[1]) if found[1] else 2018 + int(found[2])
    if found[2] == "0":
        raise ValueError("there is no year 0")
    return dt.date(year, int(found[3]), 1 if month_only else int(found[4]))


def consumption(value: object, unit: str | None) -> tuple[Decimal | None, str | None]:
    if value is None:
        if unit not in (None, ""):
            raise ValueError("a unit needs a value")
        return None, None
    try:
        number = Decimal(str(value).replace(",", ""))
    except InvalidOperation:
        raise ValueError("consumption must be a number") from None
    if number <= 0 or not unit or not unit.strip():
        raise ValueError("consumption must be positive and have a unit")
    clean = unicodedata.normalize("NFKC", unit).strip()
    return number, UNITS.get(clean.casefold(), clean)


def tax_id(value: str | None) -> str | None:
    """T and 13 ASCII digits, or None."""
    text = re.sub(r"[ \-　\t\n]", "", unicodedata.normalize("NFKC", value or "").upper())
    text = text.removeprefix("T")
    return "T" + text if re.fullmatch(r"[0-9]{13}", text) else None


nfkc_udf = _each(T.StringType(), nfkc_key)
tax_id_udf = _each(T.StringType(), tax_id)
issuer_udf = _each(T.StringType(), lambda v: "|".join(issuer(v)))


def check_digit(base: Column) -> Column:
    """Check digit of 12 digits: 9 - (odd places from the right + 2 * even places) mod 9."""
    digit = [F.substring(base, 12 - i, 1).cast("int") for i in range(12)]
    total = sum(digit[2::2], digit[0]) + 2 * sum(digit[3::2], digit[1])
    return F.lit(9) - total % 9


def token_estimate(text: Column) -> Column:
    """CJK characters count one, words of letters, digits and _ a quarter of their length (rounded up), others one."""
    cjk = r"[぀-ヿ㐀-䶿一-鿿＀-￯]"
    words = F.aggregate(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+)"), F.lit(1)), F.lit(0), lambda s, w: s + F.ceil(F.length(w) / 4).cast("int"))
    other = F.regexp_count(text, F.lit(r"[^\sA-Za-z0-9_\u0085   -     　\x1c-\x1f぀-ヿ㐀-䶿一-鿿＀-￯]"))
    return F.coalesce(F.regexp_count(text, F.lit(cjk)) + words + other, F.lit(0))


def safe_cell(text: Column) -> Column:
    """White space collapsed; a cell that a spreadsheet would run gets a quote in front."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(clean.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), clean)).otherwise(clean)


def html_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def cosine(a: Column, b: Column) -> Column:
    """Cosine distance, not below 0; an error for unequal lengths or a zero norm."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(_squares(a)) * F.sqrt(_squares(b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different length"))).when(norm == 0, F.raise_error(F.lit("a vector without direction"))).otherwise(F.greatest(F.lit(0.0), 1.0 - dot / norm))


def _squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def normalised(a: Column) -> Column:
    """The vector over its length; an error for null or non-finite components or zero length."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(_squares(a))
    return F.when(bad | (norm == 0), F.raise_error(F.lit("not a vector that can be normalised"))).otherwise(F.transform(a, lambda x: x.cast("double") / norm))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded half away from zero that keeps its sign, also where it comes to zero (F.round gives 0.0 for small negative numbers, not -0.0)."""
    return F.round(F.abs(x) * 10.0**digits, 0) / 10.0**digits * F.signum(x)


def tagged(kind: str, text: Column) -> Column:
    """A value's text under the name of its type; null stays null."""
    return F.when(text.isNotNull(), F.struct(text.alias(kind)))


def tagged_bytes(raw: Column) -> Column:
    return F.when(raw.isNotNull(), F.struct(F.sha2(raw, 256).alias("bytes"), F.length(raw).alias("length")))


def stable_json(fields: dict[str, Column]) -> Column:
    """JSON of fields in the order of their names, nulls written."""
    return F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]), {"ignoreNullFields": "false"})


def candidate_key(*names: str) -> Column:
    """sha256 of the canonical JSON of columns, in the order of their names."""
    return F.sha2(stable_json({n: F.col(n) for n in names}), 256)
