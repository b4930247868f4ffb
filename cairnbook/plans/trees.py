"""Queries over JSON trees built from given tables, explored without a path."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnbook.operators import semistructured as tree
from cairnbook.plans.registry import query
from cairnbook.sources import fixtures as fx

TURNS = """t AS (SELECT conv_id, turn, role, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY i) - 1 AS j FROM t)"""


def trees(s, d):
    """A tree for each conversation: its turns two levels down (asking turns have another field than answering ones), and those of either role in a list of lists."""
    c = fx.table(s, d, "conversations").where("conv_id is not null")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    c = c.groupBy("conv_id").agg(turns.alias("turns"))

    def listed(f):
        return F.to_json(F.transform("turns", f))

    every = listed(lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(t["role"] == "user", F.length(t["text"])).alias("asked"), F.when(t["role"] != "user", F.length(t["text"])).alias("answered")))
    of = [F.to_json(F.transform(F.filter("turns", lambda t: t["role"] == "user"), lambda t: F.struct(t["turn"].alias("turn")))), F.to_json(F.transform(F.filter("turns", _other), lambda t: F.struct(t["turn"].alias("turn"), F.struct(F.length(t["text"]).alias("chars")).alias("size"))))]
    json = F.concat(F.lit('{"conversation":'), F.col("conv_id").cast("string"), F.lit(',"log":{"turns":'), every, F.lit(',"empty":[]},"roles":['), of[0], F.lit(","), of[1], F.lit(']}'))
    return c.select("conv_id", json.alias("json"))


def _other(t):
    return t["role"] != "user"


@query(
    "a9_discovered_tables",
    f"""WITH {TURNS}, first AS (SELECT conv_id, min(i) FILTER (role = 'user') AS a, min(i) FILTER (role <> 'user') AS b FROM t GROUP BY 1)
SELECT conv_id, 'root/log/turns' AS path, CASE WHEN b IS NULL THEN ['asked', 'role', 'turn'] WHEN a IS NULL THEN ['answered', 'role', 'turn'] WHEN a < b THEN ['asked', 'role', 'turn', 'answered'] ELSE ['answered', 'role', 'turn', 'asked'] END AS header, CAST(count(*) AS INTEGER) AS n_rows FROM t JOIN first USING (conv_id) GROUP BY ALL
UNION ALL SELECT conv_id, 'root/roles/1', ['turn'], CAST(count(*) AS INTEGER) FROM t WHERE role = 'user' GROUP BY 1
UNION ALL SELECT conv_id, 'root/roles/2', ['size', 'turn'], CAST(count(*) AS INTEGER) FROM t WHERE role <> 'user' GROUP BY 1""",
)
def a9(s, d):
    return tree.headers(tree.tables(trees(s, d), "conv_id"), "conv_id")


@query(
    "a8_discovered_cells",
    f"""WITH {TURNS}
SELECT conv_id, 'root/log/turns' AS path, CAST(i AS INTEGER) AS row_index, unnest(['turn', 'role', CASE WHEN role = 'user' THEN 'asked' ELSE 'answered' END]) AS "column", unnest([CAST(turn AS VARCHAR), role, CAST(chars AS VARCHAR)]) AS text FROM t
UNION ALL SELECT conv_id, 'root/roles/1', CAST(j AS INTEGER), 'turn', CAST(turn AS VARCHAR) FROM u WHERE role = 'user'
UNION ALL SELECT conv_id, 'root/roles/2', CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS INTEGER), unnest(['turn', 'size']), unnest([CAST(turn AS VARCHAR), '{{"chars":' || chars || '}}']) FROM t WHERE role <> 'user'""",
)
def a8(s, d):
    return tree.cells(tree.tables(trees(s, d), "conv_id"), "conv_id")


@query("e17_variant_schemas", """SELECT event_type, 'OBJECT<' || string_agg(key || ': BIGINT', ', ' ORDER BY key) || '>' AS schema FROM (SELECT DISTINCT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY 1""")
def e17(s, d):
    return tree.schemas(fx.table(s, d, "events"), "props", "event_type")


@query("e5_variant_numbers", "SELECT event_type, j.key AS \"column\", sum(CAST(j.value AS DOUBLE)) AS total, round(avg(CAST(j.value AS DOUBLE)), 6) AS average, count(*) AS n FROM events, json_each(props) j WHERE json_type(j.value) IN ('BIGINT', 'UBIGINT', 'DOUBLE') GROUP BY 1, 2")
def e5(s, d):
    return tree.numbers(fx.table(s, d, "events"), "props", "event_type")
