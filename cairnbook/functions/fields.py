"""Fields of bills and payloads as columns: compared texts, issuers, periods, due dates, consumption, tax ids, locators, canonical JSON.

Everything is an expression of the plan but NFKC and canonical JSON, which Spark has no function for.  NFKC runs in Python on texts
with characters beyond ASCII only: others reach the worker as null.

A field that cannot be read makes no job fail: it is a struct with the reason in `error` and null elsewhere, so that a corpus
of bills gives a row for every bill.

Cases: null and empty texts are empty fields (an error where the field is needed: issuer, billing period; nothing at all for a due date or a
consumption without unit); texts of any length are read whole; digits are those of ASCII after NFKC; a Reiwa year 0, a month 13 or a 30th of
February is no date; ISO dates are YYYY-MM-DD or YYYYMMDD, week dates are not read.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.functions.text import ISSUER_ALIASES, ISSUER_KINDS, UNITS, check_digit

ASCII = r"\A[\x00-\x7F]*\z"
SPACES = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


@F.pandas_udf(T.StringType())
def _nfkc_folded(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC").str.casefold()


def _beyond_ascii(text: Column, udf, plain: Column) -> Column:
    simple = F.rlike(text, F.lit(ASCII))
    return F.when(simple, plain).otherwise(udf(F.when(~simple, text)))


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES + "+", " "))


def nfkc(text: Column) -> Column:
    return _beyond_ascii(text, _nfkc, text)


def text_key(text: Column) -> Column:
    """NFKC, case folded, white space collapsed: equal for texts that a reader takes for the same."""
    return squeezed(_beyond_ascii(text, _nfkc_folded, F.lower(text)))


def _failed(values: dict[str, Column], error: Column) -> Column:
    """A struct of values, all null where there is an error."""
    parts = [F.when(error.isNull(), v).alias(n) for n, v in values.items()]
    return F.struct(*parts, error.cast("string").alias("error"))


def issuer(text: Column) -> Column:
    """struct<name, kind, error>: the canonical name of a known issuer, or the text itself, and what it bills for."""
    clean = squeezed(nfkc(F.coalesce(text, F.lit(""))))
    low = F.lower(clean)

    def has(cues):
        found = F.contains(low, F.lit(cues[0]))
        for c in cues[1:]:
            found = found | F.contains(low, F.lit(c))
        return found

    name, kind = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for cues, known, of in ISSUER_ALIASES:
        name, kind = name.when(has(cues), known), kind.when(has(cues), of)
    for cues, of in ISSUER_KINDS:
        kind = kind.when(has(cues), of)
    return _failed({"name": name.otherwise(clean), "kind": kind.otherwise("other")}, F.when(clean == "", "an issuer needs a name"))


_YEAR = r"(?:(\d{4})|(?:令和|[Rr])\s*(\d{1,2}))\s*(?:年|[-./])\s*(\d{1,2})"
_MONTH_LABEL = "^" + _YEAR + r"(?:月)?(?:分)?$"
_DAY_LABEL = "^" + _YEAR + r"(?:月|\s*[-./])\s*(\d{1,2})(?:日)?$"
_ISO = r"^(\d{4})-?(\d{2})-?(\d{2})$"


def _label(text: Column, pattern: str, day: Column | None) -> Column:
    """The date of a label, or null: ISO first, then the pattern, whose Reiwa years begin in 2019."""

    def part(i, of=pattern):
        return F.nullif(F.regexp_extract(text, of, i), F.lit("")).cast("int")

    whole = F.when(F.rlike(text, F.lit(r"^(\d{4}-\d{2}-\d{2}|\d{8})$")), _date(part(1, _ISO), part(2, _ISO), part(3, _ISO)))
    year = F.coalesce(part(1), F.when(part(2) > 0, part(2) + 2018))
    return F.coalesce(whole, _date(year, part(3), part(4) if day is None else day))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(F.nullif(year, F.lit(0)).cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def billing_period(text: Column) -> Column:
    """struct<day, error>: the first day of the month that an ISO, Gregorian or Reiwa label names."""
    clean = squeezed(nfkc(F.coalesce(text, F.lit(""))))
    day = F.trunc(_label(clean, _MONTH_LABEL, F.lit(1)), "month")
    return _failed({"day": day}, F.when(clean == "", "a billing period is needed").when(day.isNull(), F.concat(F.lit("not a known month label: "), clean)))


def due_date(text: Column) -> Column:
    """struct<day, error>: the day that a label names; null without error for an empty one."""
    clean = squeezed(nfkc(F.coalesce(text, F.lit(""))))
    day = _label(clean, _DAY_LABEL, None)
    return _failed({"day": day}, F.when((clean != "") & day.isNull(), F.concat(F.lit("not a known date label: "), clean)))


def consumption(value: Column, unit: Column) -> Column:
    """struct<amount, unit, error>: a positive amount with its unit in one spelling; both or neither."""
    clean = squeezed(nfkc(F.coalesce(unit, F.lit(""))))
    number = F.replace(value, F.lit(","), F.lit("")).try_cast("decimal(18,4)")
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    error = (
        F.when(value.isNull(), F.when(F.coalesce(unit, F.lit("")) != "", "a unit needs a value")).when(number.isNull(), "consumption must be a number")
        .when((number <= 0) | (clean == ""), "consumption must be positive and have a unit")
    )
    return _failed({"amount": number, "unit": F.when(value.isNotNull(), F.coalesce(F.try_element_at(units, F.lower(clean)), clean))}, error)


def tax_id(text: Column) -> Column:
    """struct<tax_id, valid>: T and 13 digits, or null; valid if the first digit is the check digit of the others."""
    bare = F.regexp_replace(F.upper(nfkc(F.coalesce(text, F.lit("")))), r"[ \-\t\n]", "")
    digits = F.regexp_replace(bare, r"\AT", "")
    there = F.rlike(digits, F.lit(r"\A[0-9]{13}\z"))
    valid = F.coalesce(F.when(there, F.substring(digits, 1, 1).cast("int") == check_digit(F.substring(digits, 2, 12))), F.lit(False))
    return F.struct(F.when(there, F.concat(F.lit("T"), digits)).alias("tax_id"), valid.alias("valid"))


def locator(kind: str, *parts: Column) -> Column:
    """kind and percent-encoded parts by slashes; all but letters, digits and -._~ is encoded as UTF-8.  Null if a part is."""

    def encoded(c):
        form = F.url_encode(c.cast("string"))
        for raw, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            form = F.replace(form, F.lit(raw), F.lit(code))
        return form

    return F.concat(F.lit(kind), *[F.concat(F.lit("/"), encoded(p)) for p in parts])


@F.pandas_udf(T.StringType())
def _canonical(s: pd.Series) -> pd.Series:
    def refuse(name):
        raise ValueError(name)

    def one(text):
        try:
            return json.dumps(json.loads(text, parse_constant=refuse), sort_keys=True, ensure_ascii=True, separators=(",", ":"), allow_nan=False)
        except (ValueError, TypeError, RecursionError):
            return None

    return s.map(one, na_action="ignore").astype(object)


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys, ASCII only, without spaces; null for what is no JSON, or holds NaN or an infinity."""
    return _canonical(text)


_QUIET = r"(?is)<!--.*?-->|(<(script|style)\b[^>]*+>).*?</\2\s*+>"
_TAG = r"""(<[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>)"""


def html_counts(html: Column) -> Column:
    """struct<active, events, external>: elements that act, event attributes, and references to other hosts, in the tags of a page.

    Comments and what stands inside of scripts and styles are left out, as is what only looks like an attribute inside of a quoted value.
    """
    tags = F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), _QUIET, "$1"), F.lit(_TAG), F.lit(1))

    def number(pattern, of=lambda t: t):
        return F.aggregate(tags, F.lit(0), lambda n, t: n + F.regexp_count(of(t), F.lit(pattern)))

    bare = lambda t: F.regexp_replace(t, "\"[^\"]*+\"|'[^']*+'", "''")
    # quotes of values that are no references go, so that the pattern meets attributes only
    names = lambda t: F.regexp_replace(t, "(?i)(?<!\\b(?:src|href|action)\\s{0,9}=\\s{0,9})(?:\"[^\"]*+\"|'[^']*+')", "''")
    return F.struct(number(r"(?i)^<(?:script|iframe|object|embed)(?=[\s/>])").alias("active"), number(r"(?i)[\s'/]on[^\s=>/]*", bare).alias("events"), number(r"""(?i)[\s'"/](?:src|href|action)\s*=\s*["']?(?:https?:)?//""", names).alias("external"))
