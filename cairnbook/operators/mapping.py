"""Declarative mapping of staged rows: field rules compiled to columns, candidates and a ledger."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FIELDS, MAX_SOURCES = 64, 8
DATE_FORMATS = {"iso": (r"^(\d{4})-(\d{2})-(\d{2})$", "ymd"), "ymd": (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "ymd"), "dmy": (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "dmy"), "mdy": (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "mdy"), "japanese": (r"^(\d{4})年(\d{1,2})月(\d{1,2})日$", "ymd")}
DECIMAL_FORMATS = {"dot": (r"^[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?$", ",", "."), "comma": (r"^[+-]?(\d{1,3}(\.\d{3})+|\d+)(,\d+)?$", ".", ",")}


@dataclass(frozen=True)
class Rule:
    """How one target field is made: sources joined, trimmed, nulled, mapped, parsed."""

    target: str
    sources: tuple[str, ...] = ()
    literal: str | None = None
    joint: str = " "
    trim: bool = True
    nulls: tuple[str, ...] = ("",)
    value_map: dict[str, str] = field(default_factory=dict)
    kind: str = "text"  # text, date, decimal, currency
    style: str = ""
    sign: str = "preserve"  # preserve, negate, absolute
    required: bool = False

    def __post_init__(self):
        if bool(self.sources) == (self.literal is not None):
            raise ValueError(f"{self.target}: either sources or a literal")
        if len(self.sources) > MAX_SOURCES:
            raise ValueError(f"{self.target}: more than {MAX_SOURCES} sources")
        if self.kind == "date" and self.style not in DATE_FORMATS or self.kind == "decimal" and self.style not in DECIMAL_FORMATS:
            raise ValueError(f"{self.target}: unknown style {self.style!r}")


def parse_date(text: Column, style: str) -> Column:
    pattern, order = DATE_FORMATS[style]
    part = {c: F.regexp_extract(text, pattern, order.index(c) + 1) for c in "ymd"}
    made = F.concat_ws("-", part["y"], F.lpad(part["m"], 2, "0"), F.lpad(part["d"], 2, "0"))
    return F.when(text.rlike(pattern), F.try_to_date(made, "yyyy-MM-dd").cast("string"))


def parse_decimal(text: Column, style: str, sign: str = "preserve") -> Column:
    """Plain decimal text; the written scale stays."""
    pattern, group, point = DECIMAL_FORMATS[style]
    plain = F.translate(F.translate(text, group, ""), point, ".")
    plain = F.when(F.substring(plain, 1, 1) == "+", F.substring(plain, 2, 1 << 20)).otherwise(plain)
    minus, bare = F.substring(plain, 1, 1) == "-", F.regexp_replace(plain, "^-", "")
    zero = bare.rlike(r"^0+(\.0+)?$")
    if sign == "negate":
        plain = F.when(zero, bare).when(minus, bare).otherwise(F.concat(F.lit("-"), bare))
    elif sign == "absolute":
        plain = bare
    return F.when(text.rlike(pattern), plain)


def compile_rule(rule: Rule) -> tuple[Column, Column]:
    """(value, issue or null) of a rule over a column named values."""
    raw = F.lit(rule.literal) if rule.literal is not None else F.concat_ws(rule.joint, *[F.coalesce(F.element_at("values", F.lit(c)), F.lit("")) for c in rule.sources])
    raw = F.trim(raw) if rule.trim else raw
    raw = F.when(~raw.isin(list(rule.nulls)), raw) if rule.nulls else raw
    if rule.value_map:
        table = F.create_map(*[F.lit(x) for kv in rule.value_map.items() for x in kv])
        raw = F.coalesce(F.try_element_at(table, F.lower(raw) if rule.kind == "currency" else raw), raw)
    if rule.kind == "date":
        value = parse_date(raw, rule.style)
    elif rule.kind == "decimal":
        value = parse_decimal(raw, rule.style, rule.sign)
    elif rule.kind == "currency":
        value = F.when(F.upper(raw).rlike("^[A-Z]{3}$"), F.upper(raw))
    else:
        value = raw
    issue = F.when(raw.isNotNull() & value.isNull(), F.lit(f"{rule.target}:invalid_{rule.kind}"))
    if rule.required:
        issue = F.coalesce(issue, F.when(value.isNull(), F.lit(f"{rule.target}:required")))
    return value, issue


def validate(rules: Sequence[Rule], columns: Sequence[str]) -> None:
    """Fail before any job runs: too many fields, repeated targets, unknown columns."""
    targets = [r.target for r in rules]
    if len(rules) > MAX_FIELDS or len(set(targets)) < len(targets):
        raise ValueError("too many fields, or a target mapped twice")
    if unknown := {c for r in rules for c in r.sources} - set(columns):
        raise ValueError(f"unknown columns: {sorted(unknown)}")


def apply_rules(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rows with mapped (struct of targets) and issues (distinct, in rule order)."""
    made = [compile_rule(r) for r in rules]
    return rows.withColumn("mapped", F.struct(*[v.alias(r.target) for (v, _), r in zip(made, rules, strict=True)])).withColumn("issues", F.array_distinct(F.array_compact(F.array(*[i for _, i in made]))))


def candidates_and_ledger(staged: DataFrame, mappings: dict[str, Sequence[Rule] | None]) -> tuple[DataFrame, DataFrame]:
    """Candidates and a ledger with one disposition for every staged row; None ignores a table, tables without a mapping are residual.

    Candidates are numbered by document: rows of the mapped tables in the order of the mappings, then what is residual, one
    candidate a row with its cells as they stand.
    """
    columns = ["document_id", "source_location", "row_index", "payload", "issues", "place"]
    other = staged.where(~F.col("source_location").isin(list(mappings)) & ~F.col("blank"))
    candidates = other.select("document_id", "source_location", "row_index", F.to_json("values").alias("payload"), F.array().cast("array<string>").alias("issues"), F.lit(len(mappings)).alias("place"))
    for place, (location, rules) in enumerate(mappings.items()):
        if rules is not None:
            made = apply_rules(staged.where((F.col("source_location") == location) & ~F.col("blank")), rules)
            candidates = candidates.unionByName(made.select("document_id", "source_location", "row_index", F.to_json("mapped").alias("payload"), "issues", F.lit(place).alias("place")).select(columns))
    w = Window.partitionBy("document_id").orderBy("place", "source_location", "row_index")
    candidates = candidates.withColumn("ordinal", F.row_number().over(w)).drop("place")
    ignored = [k for k, v in mappings.items() if v is None]
    kind = F.when(F.col("source_location").isin(ignored), "ignored").when(~F.col("source_location").isin(list(mappings)), "residual").when(F.col("blank"), "blank").otherwise("mapped")
    return candidates, staged.select("document_id", "source_location", "row_index", "fingerprint", kind.alias("disposition"))


def ledger_violations(ledger: DataFrame) -> DataFrame:
    """Units that are in the ledger more than once; must be empty."""
    return ledger.groupBy("document_id", "source_location", "row_index").agg(F.count("*").alias("n")).where("n > 1")
