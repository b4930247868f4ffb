"""Mapping queries over events as staged rows: purchases and clicks are mapped, errors left out, the rest is residual."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cairnbook.functions.text import html_escape
from cairnbook.operators import mapping, staging
from cairnbook.plans.registry import query
from cairnbook.plans.scalars import CELL
from cairnbook.sources import fixtures as fx

NAMES = ("k", "value", "event", "day")
RULES = {
    "purchase": [
        mapping.Rule("transaction_date", ("day",), kind="date", style="iso", required=True), mapping.Rule("total_amount", ("value",), kind="decimal", style="dot", sign="negate", required=True),
        mapping.Rule("currency", ("event",), kind="currency", value_map={"purchase": "JPY"}), mapping.Rule("memo", ("event", "k"), joint=" <&> "),
    ],
    "click": [mapping.Rule("transaction_date", ("day",), kind="date", style="ymd"), mapping.Rule("total_amount", ("value",), kind="decimal", style="comma"), mapping.Rule("memo", literal="click", required=True)],
    "error": None,
}
#: Every fifth day cannot be read and every seventh row is blank.
ROWS = """s0 AS (SELECT user_id % 10 AS document_id, event_type AS source_location, event_id AS row_index, event_id % 7 = 0 AS blank, coalesce(json_extract_string(props, '$.k'), '') AS k0, coalesce(CAST(CAST(round(value, 2) AS DECIMAL(18,2)) AS VARCHAR), '') AS value0, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END AS day0 FROM events),
s AS (SELECT document_id, source_location, row_index, blank, CASE WHEN blank THEN '' ELSE k0 END AS k, CASE WHEN blank THEN '' ELSE value0 END AS value, CASE WHEN blank THEN '' ELSE source_location END AS event, CASE WHEN blank THEN '' ELSE day0 END AS day FROM s0),
purchases AS (SELECT *, CASE WHEN day <> 'n/a' THEN day END AS transaction_date, CASE WHEN CAST(value AS DOUBLE) = 0 THEN value ELSE '-' || value END AS total_amount, event || ' <&> ' || k AS memo, CASE WHEN day = 'n/a' THEN ['transaction_date:invalid_date'] ELSE [] END AS issues FROM s WHERE source_location = 'purchase' AND NOT blank),
clicks AS (SELECT *, list_concat(['transaction_date:invalid_date'], CASE WHEN regexp_full_match(value, '[0-9]+([.][0-9]{3})?') THEN [] ELSE ['total_amount:invalid_decimal'] END) AS issues FROM s WHERE source_location = 'click' AND NOT blank),
made AS (SELECT document_id, source_location, row_index, '{' || CASE WHEN transaction_date IS NOT NULL THEN '"transaction_date":"' || transaction_date || '",' ELSE '' END || '"total_amount":"' || total_amount || '","currency":"JPY","memo":"' || memo || '"}' AS payload, issues, 0 AS place FROM purchases
  UNION ALL SELECT document_id, source_location, row_index, '{"memo":"click"}', issues, 1 FROM clicks
  UNION ALL SELECT document_id, source_location, row_index, '{"k":"' || k || '","value":"' || value || '","event":"' || event || '","day":"' || day || '"}', CAST([] AS VARCHAR[]), 3 FROM s WHERE source_location NOT IN ('purchase', 'click', 'error') AND NOT blank),
ledger AS (SELECT document_id, source_location, row_index, sha256(source_location || '|' || row_index || '|' || k || '|' || value || '|' || event || '|' || day) AS fingerprint,
  CASE WHEN source_location = 'error' THEN 'ignored' WHEN source_location NOT IN ('purchase', 'click') THEN 'residual' WHEN blank THEN 'blank' ELSE 'mapped' END AS disposition FROM s)"""
R = f"WITH {ROWS} "


def rows(s, d):
    r = fx.staged_rows(s, d)
    blank = F.col("row_index") % 7 == 0
    cells = [F.when(blank, "").otherwise(F.when(F.col("row_index") % 5 == 0, "n/a").otherwise(F.col("values")[n]) if n == "day" else F.col("values")[n]) for n in NAMES]
    r = r.select("document_id", "source_location", "row_index", blank.alias("blank"), *[c.alias(n) for c, n in zip(cells, NAMES, strict=True)])
    values = F.create_map(*[x for n in NAMES for x in (F.lit(n), F.col(n))])
    return r.withColumn("values", values).withColumn("names", F.array(*map(F.lit, NAMES))).withColumn("kinds", F.array(*[staging.cell_kind(F.col(n)) for n in NAMES])).withColumn("fingerprint", F.sha2(F.concat_ws("|", "source_location", F.col("row_index").cast("string"), *NAMES), 256))


def mapped(s, d):
    for location, rules in RULES.items():
        if rules:
            mapping.validate(rules, NAMES)
    return mapping.candidates_and_ledger(rows(s, d), RULES)


@query("m1_structure_of_rows", R + f", c AS (SELECT document_id, source_location, unnest([0, 1, 2, 3]) AS pos, unnest(['k', 'value', 'event', 'day']) AS name, unnest([k, value, event, day]) AS x FROM s), t AS (SELECT *, {CELL} AS kind FROM c), g AS (SELECT document_id, source_location, pos, name, CASE count(DISTINCT kind) FILTER (kind <> 'blank') WHEN 0 THEN 'blank' WHEN 1 THEN max(kind) FILTER (kind <> 'blank') ELSE 'mixed' END AS kind FROM t GROUP BY ALL), o AS (SELECT document_id, source_location, '[' || string_agg('{{\"pos\":' || pos || ',\"name\":\"' || name || '\",\"kind\":\"' || kind || '\"}}', ',' ORDER BY pos) || ']' AS columns FROM g GROUP BY 1, 2) SELECT *, sha256(columns) AS schema_digest FROM o")
def m1(s, d):
    return staging.schema_fingerprint(rows(s, d)).select("document_id", "source_location", F.to_json("columns").alias("columns"), "schema_digest")


@query("m3_rules_over_rows", R + "SELECT row_index, transaction_date, total_amount, 'JPY' AS currency, memo, issues FROM purchases")
def m3(s, d):
    return mapping.apply_rules(rows(s, d).where("source_location = 'purchase' and not blank"), RULES["purchase"]).select("row_index", "mapped.*", "issues")


@query("m4_candidates_of_rows", R + "SELECT document_id, source_location, row_index, payload, issues, CAST(row_number() OVER (PARTITION BY document_id ORDER BY place, source_location, row_index) AS INTEGER) AS ordinal FROM made")
def m4(s, d):
    return mapped(s, d)[0]


@query("m4_ledger_of_rows", R + "SELECT * FROM ledger")
def m4b(s, d):
    return mapped(s, d)[1]


@query("m5_violations_of_rows", R + "SELECT document_id, source_location, row_index, CAST(2 AS BIGINT) AS n FROM ledger WHERE disposition = 'ignored'")
def m5(s, d):
    """A ledger into which every row that is left out was entered twice."""
    ledger = mapped(s, d)[1]
    return mapping.ledger_violations(ledger.unionByName(ledger.where("disposition = 'ignored'")))


@query("m6_preview_of_rows", R + "SELECT row_index, transaction_date, total_amount, 'JPY' AS currency, replace(replace(replace(memo, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS memo FROM purchases ORDER BY row_index LIMIT 50")
def m6(s, d):
    """The first fifty mapped rows as a review shows them, escaped."""
    made = mapping.apply_rules(rows(s, d).where("source_location = 'purchase' and not blank"), RULES["purchase"])
    return made.orderBy("row_index").limit(50).select("row_index", *[html_escape(F.col(f"mapped.{r.target}")).alias(r.target) for r in RULES["purchase"]])


@query("e13_dispositions_of_rows", R + "SELECT document_id, " + ", ".join(f"count(*) FILTER (disposition = '{k}') AS {k}" for k in ("mapped", "blank", "ignored", "residual", "error")) + " FROM ledger GROUP BY 1")
def e13(s, d):
    return mapped(s, d)[1].groupBy("document_id").agg(*[F.count_if(F.col("disposition") == k).alias(k) for k in ("mapped", "blank", "ignored", "residual", "error")])


@query("e14_counts_of_rows", R + "SELECT source_location, count(*) FILTER (len(issues) = 0) AS valid, count(*) FILTER (len(issues) > 0) AS errors FROM (SELECT source_location, issues FROM purchases UNION ALL SELECT source_location, issues FROM clicks) GROUP BY 1")
def e14(s, d):
    parts = [mapping.apply_rules(rows(s, d).where((F.col("source_location") == k) & ~F.col("blank")), r).select("source_location", "issues") for k, r in RULES.items() if r]
    made = reduce(lambda a, b: a.unionByName(b), parts)
    return made.groupBy("source_location").agg(F.count_if(F.size("issues") == 0).alias("valid"), F.count_if(F.size("issues") > 0).alias("errors"))
