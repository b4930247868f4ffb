"""Sections and blocks as tables against the line-by-line reading of one text."""

import random

from cairnbook.operators import outline, search


def bodies():
    rng = random.Random(9)
    parts = ["# A", "## B", "### C", "###### D", "#no heading", "####### seven", "text", "  indented ", "", "   ", "| a | b |", "|x|", "| one bar", "# tail  "]
    out = ["", None, "plain", "\n\n", "### C\n### D\nx\n# E\n\n## F", "a\r\nb\rc\x0bd e", "# only"]
    return out + ["\n".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(80)]


def test_sections_and_blocks(spark):
    texts = bodies()
    rows = outline.lines(spark.createDataFrame(list(enumerate(texts)), "id int, body string"), "id", "body")
    want, pieces = [], []
    for i, t in enumerate(texts):
        for n, (path, own) in enumerate(search.sections(t or "")):
            want.append((i, n, path, len(own), "\n".join(own)))
            pieces += [(i, n, k, table, text) for k, (text, table) in enumerate(search.blocks(own))]
    got, number = [], {}
    for r in sorted(outline.sections(rows).collect(), key=lambda r: (r["document_id"], r["section"])):
        n = sum(x[0] == r["document_id"] for x in got)
        number[r["document_id"], r["section"]] = n
        got.append((r["document_id"], n, r["heading_path"], r["n_lines"], r["text"]))
    assert got == want
    found = sorted((r["document_id"], number[r["document_id"], r["section"]], r["block"] - 1, r["is_table"], r["text"]) for r in outline.blocks(rows).collect())
    assert found == sorted(pieces)
    assert outline.sections(rows.limit(0)).count() == 0
