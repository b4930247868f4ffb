"""Queries of sections and blocks: documents written as marked-up texts, their lines headings, table rows, blanks and paragraphs in turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnbook.operators import outline
from cairnbook.plans.registry import query
from cairnbook.sources import fixtures as fx

END = outline.LINE_END
D = rf"""t AS (SELECT doc_id AS document_id, list_transform(string_split_regex(text, '{END}'), lambda x, i: CASE (i - 1) % 11 WHEN 1 THEN '# ' || x WHEN 3 THEN '### ' || x WHEN 5 THEN '| ' || x || ' |' WHEN 6 THEN '|' || x || '|' WHEN 7 THEN '## ' || x WHEN 9 THEN '' ELSE x END) AS x FROM documents WHERE text IS NOT NULL),
l0 AS (SELECT document_id, unnest(CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END) AS line, unnest(range(len(CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END))) AS pos FROM t),
l1 AS (SELECT *, len(regexp_extract(line, '{outline.HEADING}', 1)) AS level, regexp_extract(line, '{outline.HEADING}', 2) AS title, regexp_replace(line, '{outline.EDGES}', '', 'g') AS bare FROM l0),
l AS (SELECT *, CAST(sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY pos) AS BIGINT) AS section FROM l1)"""


def marked(s, d):
    text = F.split(F.col("text"), END)

    def line(x, i):
        n = i % 11
        return F.when(n == 1, F.concat(F.lit("# "), x)).when(n == 3, F.concat(F.lit("### "), x)).when(n == 5, F.concat(F.lit("| "), x, F.lit(" |"))).when(n == 6, F.concat(F.lit("|"), x, F.lit("|"))).when(n == 7, F.concat(F.lit("## "), x)).when(n == 9, "").otherwise(x)

    docs = fx.table(s, d, "documents").where("text is not null").select("doc_id", F.array_join(F.transform(text, line), "\n").alias("body"))
    return outline.lines(docs, "doc_id", "body")


@query(
    "v1_sections_of_documents",
    f"""WITH RECURSIVE {D}, p(document_id, section, path) AS (SELECT DISTINCT document_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM l UNION ALL
  SELECT l.document_id, l.section, list_concat(list_slice(p.path, 1, l.level - 1), [l.title]) FROM p JOIN l ON l.document_id = p.document_id AND l.section = p.section + 1 AND l.level > 0)
SELECT document_id, section, array_to_string(path, ' > ') AS heading_path, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM l JOIN p USING (document_id, section) WHERE level = 0 GROUP BY document_id, section, path HAVING bool_or(bare <> '')""",
)
def v1(s, d):
    return outline.sections(marked(s, d)).select("document_id", "section", "heading_path", "n_lines", F.md5("text").alias("digest"))


@query(
    "v2_blocks_of_documents",
    f"""WITH {D}, m AS (SELECT *, bare = '' AS blank, starts_with(bare, '|') AND len(bare) - len(replace(bare, '|', '')) > 1 AS is_table FROM l WHERE level = 0),
b AS (SELECT *, NOT blank AND (coalesce(lag(blank) OVER w, TRUE) OR lag(is_table) OVER w <> is_table) AS begins FROM m WINDOW w AS (PARTITION BY document_id, section ORDER BY pos)),
n AS (SELECT *, CAST(sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, section ORDER BY pos) AS BIGINT) AS block FROM b)
SELECT document_id, section, block, is_table, md5(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '{outline.EDGES}', '', 'g')) AS digest FROM n WHERE NOT blank GROUP BY document_id, section, block, is_table""",
)
def v2(s, d):
    return outline.blocks(marked(s, d)).select("document_id", "section", "block", "is_table", F.md5("text").alias("digest"))
