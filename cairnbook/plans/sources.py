"""Queries of sources: small files made here, parsed on executors; pages and text from the tables."""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from cairnbook.plans.registry import query, rows_sql
from cairnbook.sources import fixtures as fx
from cairnbook.sources import files as fl
from cairnbook.sources import parse, policy

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def tarred(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in parts.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def png(width: int, height: int, frames: int = 1) -> bytes:
    def part(name, data):
        return struct.pack(">I", len(data)) + name + data + b"crc!"

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">II", width, height) + b"\x08\x02\0\0\0") + (part(b"acTL", struct.pack(">II", frames, 0)) if frames > 1 else b"") + part(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HH", 30, 20) + b"\x80\0\0" + b"\0" * 6 + (b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + b"\0" * 9 + b"\x02\x02\x4c\x01\0") * 2 + b";"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 48, 64) + b"\x03" + b"\0" * 9
DEEP = b"[" * 70 + b"]" * 70
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
O = "urn:oasis:names:tc:opendocument:xmlns"
SLIDE = f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><a:p><a:r><a:t>Quarter</a:t></a:r></a:p><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>k</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t>v</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:sld>'
ODS = f'<o:document xmlns:o="{O}:office:1.0" xmlns:text="{O}:text:1.0" xmlns:table="{O}:table:1.0"><text:h>Plan</text:h><text:p>one <text:span>two</text:span></text:p><table:table table:name="T"><table:table-row><table:table-cell table:number-columns-repeated="2"><text:p>x</text:p></table:table-cell><table:table-cell><text:p>y</text:p></table:table-cell><table:table-cell table:number-columns-repeated="900"/></table:table-row></table:table></o:document>'
CSV = b'name,name,note\nA,1,"line one\nline two"\nB,2,=SUM(A1:A2)\nC,3\n'
FILES = {
    "plain.csv": CSV, "japanese.tsv": "日付\t金額\n2026年7月1日\t1200\n".encode("cp932"), "wide.csv": "a;b;c\n1;2,5;3\n".encode("utf-16"),
    "tree.json": b'{"orders": [{"id": 1, "tags": ["x"]}, {"id": 2, "total": 3.5}], "meta": {"rows": [{"k": "v"}]}}', "lines.jsonl": b'{"a": 1}\n{"b": "two"}\n',
    "list.xml": b"<r><item><n>a</n><q>1</q></item><item><n>b</n></item><x/></r>", "note.md": "---\ntitle: Lease\n---\n# One\n\ntext\n\n## Two\n".encode(),
    "page.html": b"<html><body><p>Hi</p><script>x()</script><table><tr><th>a</th></tr><tr><td onclick='x'>1</td></tr></table><a href='https://example.com'>l</a></body></html>",
    "letter.docx": zipped({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'}),
    "book.xlsx": zipped({"xl/workbook.xml": f'<workbook xmlns="{S}"><sheets><sheet name="June"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}"><sheetData><row><c r="A1" t="inlineStr"><is><t>日付</t></is></c><c r="B1" t="inlineStr"><is><t>金額</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>2026-07-01</t></is></c><c r="B2"><v>5</v></c></row><row><c r="A4"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A4:B4"/></mergeCells></worksheet>'}),
    "bundle.zip": zipped({"a.txt": "x", "../evil.txt": "y", "in.tar": tarred({"deep.csv": b"a,b\n"})}), "one.gz": gzip.compress(b"hello", mtime=0),
    "mail.eml": b"From: a@example.com\nSubject: Invoice\nMIME-Version: 1.0\nContent-Type: text/plain\n\nTotal 1200\n", "old.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello \'e9\par World}", "shot.png": png(640, 480), "loop.gif": GIF, "photo.jpg": JPEG, "deck.pptx": zipped({"ppt/presentation.xml": "<x/>", "ppt/slides/slide2.xml": SLIDE.replace("Quarter", "Second"), "ppt/slides/slide1.xml": SLIDE}), "sheet.ods": zipped({"content.xml": ODS}),
    "bundle.tar": tarred({"a/b.csv": b"a,b\n", "/abs.txt": b"z"}), "bundle.tgz": gzip.compress(tarred({"only.txt": b"hello"}), mtime=0), "deep.json": DEEP, "wide.png": png(20_000, 10), "nul.bin": b"a\0b",
    "scan.pdf": b"%PDF-1.7\n", "server.log": b"started\nstopped\n", "flow.yaml": b"jobs:\n  - name: a\n  - name: b\n",
}


def files(s):
    return s.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "name string, content binary")


def parsed(s, names: list[str], f, schema: str):
    """Rows that f gives for the bytes of each file, made in Arrow batches on executors."""

    def run(batches):
        for pdf in batches:
            rows = [r for n, c in zip(pdf["name"], pdf["content"], strict=True) for r in f(n, bytes(c))]
            columns = [x.split()[0] for x in schema.replace("<string>", "").split(", ")]
            yield pd.DataFrame(rows, columns=columns)

    return files(s).where(F.col("name").isin(names)).mapInPandas(run, schema)


@query("a2_delimited_source", rows_sql("name, row_number, cells", ('plain.csv', 0, 'name|name|note'), ('plain.csv', 1, 'A|1|line one\nline two'), ('plain.csv', 2, 'B|2|=SUM(A1:A2)'), ('plain.csv', 3, 'C|3'), ('japanese.tsv', 0, '日付|金額'), ('japanese.tsv', 1, '2026年7月1日|1200'), ('wide.csv', 0, 'a|b|c'), ('wide.csv', 1, '1|2,5|3')))
def a2(s, d):
    return parsed(s, ["plain.csv", "japanese.tsv", "wide.csv"], lambda n, c: [(n, i, "|".join(r)) for i, r in enumerate([parse.delimited(c)[0], *parse.delimited(c)[1]])], "name string, row_number int, cells string")


@query("a3_charset", rows_sql("name, charset", ('plain.csv', 'utf-8'), ('japanese.tsv', 'cp932'), ('wide.csv', 'utf-16')))
def a3(s, d):
    return parsed(s, ["plain.csv", "japanese.tsv", "wide.csv"], lambda n, c: [(n, parse.decode(c)[1])], "name string, charset string")


@query("a4_delimiter", rows_sql("name, delimiter", ('plain.csv', ','), ('japanese.tsv', '\t'), ('wide.csv', ';')))
def a4(s, d):
    return parsed(s, ["plain.csv", "japanese.tsv", "wide.csv"], lambda n, c: [(n, parse.delimiter(parse.decode(c)[0]))], "name string, delimiter string")


@query("a5_strict_rows", rows_sql("name, n_rows, ragged", ('plain.csv', 3, 1)))
def a5(s, d):
    def count(n, c):
        head, rows = parse.delimited(c)
        return [(n, len(rows), sum(len(r) != len(head) for r in rows))]

    return parsed(s, ["plain.csv"], count, "name string, n_rows int, ragged int")


@query("a8_structured_source", rows_sql("name, path, header, n_rows", ('tree.json', '$.orders', 'id|tags|total', 2), ('tree.json', '$.meta.rows', 'k', 1), ('lines.jsonl', '$', 'a|b', 2)))
def a8(s, d):
    return parsed(s, ["tree.json", "lines.jsonl"], lambda n, c: [(n, p, "|".join(h), len(r)) for p, h, r in parse.structured(c, n.rsplit(".", 1)[1])], "name string, path string, header string, n_rows int")


@query("a9_json_tables", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def a9(s, d):
    return fx.table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("a10_xml_tables", rows_sql("path, header, rows", ('/r/item', 'n|q', 'a;1|b;')))
def a10(s, d):
    return parsed(s, ["list.xml"], lambda n, c: [(p, "|".join(h), "|".join(";".join(x) for x in r)) for p, h, r in parse.xml_tables(c)], "path string, header string, rows string")


@query("a11_html_source")
def a11(s, d):
    """Inert text and counters of every page."""

    def run(batches):
        for pdf in batches:
            got = [parse.inert_html(h or "") for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "n_chars": [len(t) for t, _, _ in got], "n_tables": [len(x) for _, x, _ in got], "active": [c["active"] for _, _, c in got], "events": [c["events"] for _, _, c in got], "external": [c["external"] for _, _, c in got]})

    return fx.table(s, d, "pages").select("page_id", "html").mapInPandas(run, "page_id long, n_chars long, n_tables long, active long, events long, external long")


@query("a11_inert_page", rows_sql("text, tables, active, events, external", ("Hi\nl", "a|1", 1, 1, 1)))
def a11b(s, d):
    """One page: text without its script, its table, and counts of what could act or load."""
    return parsed(s, ["page.html"], lambda n, c: [(text, ";".join("|".join(",".join(r) for r in t) for t in tables), counts["active"], counts["events"], counts["external"]) for text, tables, counts in [parse.inert_html(c.decode())]], "text string, tables string, active int, events int, external int")


KEYWORDS = frozenset(("日付", "金額", "合計", "取引先", "摘要", "備考", "科目", "date", "amount", "total", "vendor", "description"))


@query("a12_workbook", rows_sql("sheet, row_number, cells", ('June', 0, '日付|金額'), ('June', 1, '2026-07-01|5'), ('June', 2, '|'), ('June', 3, '1|1')))
def a12(s, d):
    return parsed(s, ["book.xlsx"], lambda n, c: [(sheet, i, "|".join(r)) for sheet, grid in parse.xlsx(c).items() for i, r in enumerate(grid)], "sheet string, row_number int, cells string")


@query("a13_header_row", rows_sql("sheet, header_row", ('June', 0)))
def a13(s, d):
    return parsed(s, ["book.xlsx"], lambda n, c: [(sheet, parse.header_score(grid, KEYWORDS)) for sheet, grid in parse.xlsx(c).items()], "sheet string, header_row int")


@query("a14_subtables", rows_sql("sheet, part, n_rows, n_columns", ('June', 0, 2, 2), ('June', 1, 1, 2)))
def a14(s, d):
    return parsed(s, ["book.xlsx"], lambda n, c: [(sheet, i, len(t), len(t[0])) for sheet, grid in parse.xlsx(c).items() for i, t in enumerate(parse.subtables(grid))], "sheet string, part int, n_rows int, n_columns int")


@query("a16_markdown_source", rows_sql("title, level, heading", ('Lease', 1, 'One'), ('Lease', 2, 'Two')))
def a16(s, d):
    return parsed(s, ["note.md"], lambda n, c: [(parse.front_matter(c.decode())[0].get("title"), level, title) for level, title in parse.outline(parse.front_matter(c.decode())[1])], "title string, level int, heading string")


@query("a17_text_source", "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\\x01-\\x08\\x0E-\\x1F]')) <= 0.05 * length(coalesce(text, '')) AS is_text FROM documents")
def a17(s, d):
    text = F.coalesce("text", F.lit(""))
    return fx.table(s, d, "documents").select("doc_id", (F.regexp_count(text, F.lit(r"[\x01-\x08\x0E-\x1F]")) <= 0.05 * F.length(text)).alias("is_text"))


@query("a18_docx", rows_sql("name, text, n_tables", ('letter.docx', '# Title\nBody', 1)))
def a18(s, d):
    return parsed(s, ["letter.docx"], lambda n, c: [(n, "\n".join(parse.docx(c)[0]), len(parse.docx(c)[1]))], "name string, text string, n_tables int")


@query("a19_rtf", rows_sql("name, text", ('old.rtf', 'Hello é\nWorld')))
def a19(s, d):
    return parsed(s, ["old.rtf"], lambda n, c: [(n, parse.rtf(c))], "name string, text string")


@query("a19_slides", rows_sql("name, slide, text, tables", ("deck.pptx", 1, "Quarter", "k,v"), ("deck.pptx", 2, "Second", "k,v")))
def a19b(s, d):
    return parsed(s, ["deck.pptx"], lambda n, c: [(n, i, text, ";".join(",".join(r) for t in tables for r in t)) for i, (text, tables) in enumerate(parse.pptx(c), 1)], "name string, slide int, text string, tables string")


@query("a19_open_document", rows_sql("name, text, table_name, cells", ("sheet.ods", "Plan\none two", "T", "x,x,y")))
def a19c(s, d):
    return parsed(s, ["sheet.ods"], lambda n, c: [(n, "\n".join(parse.odf(c)[0]), name, ";".join(",".join(r) for r in t)) for name, t in parse.odf(c)[1]], "name string, text string, table_name string, cells string")


@query("a20_mail", rows_sql("subject, sender, text, n_attachments", ('Invoice', 'a@example.com', 'Total 1200', 0)))
def a20(s, d):
    return parsed(s, ["mail.eml"], lambda n, c: [(m["subject"], m["sender"], m["text"], len(m["attachments"]))] if (m := parse.mail(c)) else [], "subject string, sender string, text string, n_attachments int")


@query("a21_archive_members", rows_sql("name, path, size, kind", ('bundle.zip', 'a.txt', 1, 'file'), ('bundle.zip', '../evil.txt', 1, 'unsafe'), ('bundle.zip', 'in.tar', 10240, 'file'), ('bundle.zip', 'in.tar!/deep.csv', 4, 'file'), ('one.gz', 'content', 5, 'file'), ('bundle.tar', 'a/b.csv', 4, 'file'), ('bundle.tar', '/abs.txt', 1, 'unsafe'), ('bundle.tgz', 'only.txt', 5, 'file')))
def a21(s, d):
    return parsed(s, ["bundle.zip", "one.gz", "bundle.tar", "bundle.tgz"], lambda n, c: [(n, *m) for m in parse.archive_members(c)], "name string, path string, size long, kind string")


PAGE = "coalesce(text, '')"


@query("a22_page_routing", f"SELECT doc_id, len(regexp_extract_all({PAGE}, '[\\p{{L}}\\p{{N}}]')) < 20 OR contains({PAGE}, '\ufffd') OR len(regexp_extract_all({PAGE}, '[ÃÂâ€™\ufffd]')) >= 0.1 * greatest(1, length({PAGE})) AS needs_ocr FROM documents")
def a22(s, d):
    """Whole texts: too few letters and digits, a replacement character, or too many characters that decoding errors leave."""
    text = F.coalesce("text", F.lit(""))
    few = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) < 20
    odd = F.regexp_count(text, F.lit("[ÃÂâ€™\ufffd]")) >= 0.1 * F.greatest(F.lit(1), F.length(text))
    return fx.table(s, d, "documents").select("doc_id", (few | F.contains(text, F.lit("\ufffd")) | odd).alias("needs_ocr"))


@query("a23_image_source", rows_sql("name, format, width, height, frames, error", ("shot.png", "png", 640, 480, 1, None), ("loop.gif", "gif", 30, 20, 2, None), ("photo.jpg", "jpeg", 64, 48, 1, None), ("wide.png", None, None, None, None, "width: 20000 is above 12000")))
def a23(s, d):
    def look(n, c):
        try:
            return [(n, *parse.image(c), None)]
        except ValueError as e:
            return [(n, None, None, None, None, str(e))]

    return parsed(s, ["shot.png", "loop.gif", "photo.jpg", "wide.png"], look, "name string, format string, width int, height int, frames int, error string")


FORMAT_ROWS = (('plain.csv', 'csv'), ('japanese.tsv', 'tsv'), ('wide.csv', 'csv'), ('tree.json', 'json'), ('lines.jsonl', 'jsonl'), ('list.xml', 'xml'), ('note.md', 'md'), ('page.html', 'html'), ('letter.docx', 'docx'), ('book.xlsx', 'xlsx'), ('bundle.zip', 'zip'), ('one.gz', 'gzip'), ('mail.eml', 'eml'), ('old.rtf', 'rtf'), ('shot.png', 'png'), ('loop.gif', 'gif'), ('photo.jpg', 'jpeg'), ('deck.pptx', 'pptx'), ('sheet.ods', 'odf'), ('bundle.tar', 'tar'), ('bundle.tgz', 'gzip'), ('deep.json', 'json'), ('wide.png', 'png'), ('nul.bin', 'unknown'), ('scan.pdf', 'pdf'), ('server.log', 'log'), ('flow.yaml', 'yaml'))


@query("a24_sniffing", rows_sql("name, format", *FORMAT_ROWS))
def a24(s, d):
    return parsed(s, list(FILES), lambda n, c: [(n, parse.sniff(c, n))], "name string, format string")


CASES = (
    ("image", "png", [], None, None, "process", "processing_queued"), ("image", "tiff", [], None, None, "store_unprocessed", "decoder_unavailable"), ("table", "csv", [], "generic_file", None, "process", "mapping_required"), ("table", "csv", [], "bill_scan", None, "reject", "intake_intent_mismatch"),
    ("document", "pdf", [], "bill_scan", None, "store_unprocessed", "adapter_unavailable"), ("document", "pdf", [], "generic_file", None, "store_unprocessed", "generic_candidate_deferred"), ("image", "png", [], "generic_file", None, "process", "processing_queued"),
    ("container", "zip", [], None, None, "process", "processing_queued"), ("container", "7z", [], None, None, "reject", "inspection_ambiguous"), ("opaque", "bin", [], None, None, "store_unprocessed", "opaque_safe_fallback"), ("empty", "csv", [], None, None, "reject", "empty_file"),
    ("executable", "elf", [], None, None, "reject", "prohibited_executable"), ("table", "csv", ["magic:text", "risk:active_content"], None, None, "reject", "active_content"), ("table", "csv", ["risk:unheard_of"], None, None, "process", "processing_queued"),
    ("table", "csv", [], None, "upload_too_large", "reject", "upload_too_large"), ("table", "csv", ["risk:active_content"], None, "upload_capacity_exceeded", "reject", "upload_capacity_exceeded"), ("spreadsheet", "ods", [], "generic_file", None, "process", "mapping_required"),
)


@query("a25_admission_policy", rows_sql("n, action, reason, retryable", *[(i, *c[5:], c[6] in policy.RETRYABLE) for i, c in enumerate(CASES)]))
def a25(s, d):
    """Seventeen files through the ordered table of decisions, with a registry of csv, png and zip."""
    rows = s.createDataFrame([(i, *c[:5]) for i, c in enumerate(CASES)], "n int, family string, format string, evidence array<string>, intent string, violation string")
    return policy.decide(rows, F.array(*[F.lit(f) for f in ("csv", "png", "zip")])).select("n", "action", "reason", "retryable")


FORMATS = dict(FORMAT_ROWS)


@query("a25_admitted_files", rows_sql("name, action, reason", *[(n, *(("process", "processing_queued") if f not in ("pdf", "unknown") else ("store_unprocessed", "opaque_safe_fallback" if f == "unknown" else "adapter_unavailable"))) for n, f in FORMATS.items()]))
def a25b(s, d):
    """All sample files with the registry that there is."""
    known = F.array(*[F.lit(n) for n in fl.default_registry().names()])
    rows = a24(s, d).select("name", "format", policy.family(F.col("format")).alias("family"), F.array().cast("array<string>").alias("evidence"), F.lit(None).cast("string").alias("intent"), F.lit(None).cast("string").alias("violation"))
    return policy.decide(rows, known).select("name", "action", "reason")


@query("a26_parse_budgets", "SELECT count(*) AS n, count(*) FILTER (length(text) > 20000) AS above FROM documents")
def a26(s, d):
    return fx.table(s, d, "documents").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 20000).alias("above"))


@query("a26_failed_closed", rows_sql("path, error", ("deep.json", "Budget: depth: 65 is above 64"), ("wide.png", "Budget: width: 20000 is above 12000"), ("nul.bin", "KeyError: 'nothing is registered for unknown'"), ("scan.pdf", "KeyError: 'nothing is registered for pdf'")))
def a26b(s, d):
    """Files above a limit or without a parser: one row with the error, nothing of their content."""
    return fl.parse_files(files(s).withColumnRenamed("name", "path")).where("error is not null").select("path", "error")


FOUND = {
    "plain.csv": (1, 0), "japanese.tsv": (1, 0), "wide.csv": (1, 0), "tree.json": (2, 0), "lines.jsonl": (1, 0), "list.xml": (1, 0), "note.md": (0, 1), "page.html": (1, 1), "letter.docx": (1, 1), "book.xlsx": (2, 0), "bundle.zip": (1, 0), "one.gz": (1, 0), "mail.eml": (1, 2), "old.rtf": (0, 1),
    "shot.png": (1, 0), "loop.gif": (1, 0), "photo.jpg": (1, 0), "deck.pptx": (2, 2), "sheet.ods": (1, 1), "bundle.tar": (1, 0), "bundle.tgz": (1, 0), "server.log": (0, 1), "flow.yaml": (1, 0),
}


@query("a27_adapter_dispatch", rows_sql("name, format, tables, texts", *[(n, FORMATS[n], *v) for n, v in FOUND.items()]))
def a27(s, d):
    """Each file through the parser that is registered for its sniffed format: number of tables and texts found."""
    units = fl.parse_files(files(s).withColumnRenamed("name", "path")).where("error is null")
    return units.groupBy(F.col("path").alias("name"), "format").agg(F.count_if(F.col("cells").isNotNull()).alias("tables"), F.count_if(F.col("cells").isNull()).alias("texts"))


@query("l5_handler_registry", rows_sql("step, outcome", ("register a", "done"), ("register a again", "a is registered already"), ("get a", "done"), ("get b", "nothing is registered for b")))
def l5(s, d):
    """A registry gives each name once: what happens to names that are taken or missing."""
    registry, out = fl.Registry(), []
    for step, act in (("register a", lambda: registry.register("a", len)), ("register a again", lambda: registry.register("a", len)), ("get a", lambda: registry.get("a")), ("get b", lambda: registry.get("b"))):
        try:
            act()
            out.append((step, "done"))
        except (ValueError, KeyError) as e:
            out.append((step, e.args[0]))
    return s.createDataFrame(out, "step string, outcome string")


@query("l6_adapter_formats", rows_sql("format", *[(f,) for f in ("bmp", "csv", "docx", "eml", "gif", "gzip", "html", "jpeg", "json", "jsonl", "log", "md", "odf", "png", "pptx", "rst", "rtf", "svg", "tar", "text", "tsv", "xlsx", "xml", "yaml", "zip")]))
def l6(s, d):
    """Formats that a plug-in is registered for; the same plug-ins serve spark.read.format("document_units")."""
    s.dataSource.register(fl.DocumentSource)
    return s.createDataFrame([(n,) for n in fl.default_registry().names()], "format string")


LEGACY = "SELECT p_partkey, p_name, printf('%.2f', p_retailprice) AS amount, sha256(p_partkey || ',' || p_name || ',' || printf('%.2f', p_retailprice)) AS digest FROM part"


@query("a28_legacy_import", f"SELECT digest, p_name AS counterparty, amount AS total_amount, 1.0 AS confidence FROM ({LEGACY}) WHERE p_partkey % 10 <> 0")
def a28(s, d):
    """Lines of an old export, read as CSV; those imported before (by the digest of their line) are left out, the rest become payloads of full confidence."""
    p = fx.table(s, d, "part").select("p_partkey", F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", F.format_string("%.2f", "p_retailprice")).alias("line"))
    known = p.where("p_partkey % 10 = 0").select(F.sha2("line", 256).alias("digest"))
    fields = F.from_csv("line", "id string, vendor string, amount string")
    new = p.select(F.sha2("line", 256).alias("digest"), fields.alias("r")).join(known, "digest", "left_anti")

    def wrapped(value):
        return F.struct(value.alias("value"), F.lit(1.0).alias("confidence"))

    payload = F.to_json(F.struct(wrapped(F.col("r.vendor")).alias("counterparty"), wrapped(F.col("r.amount")).alias("total_amount")))
    rows = new.select("digest", payload.alias("payload"))
    return rows.select("digest", F.get_json_object("payload", "$.counterparty.value").alias("counterparty"), F.get_json_object("payload", "$.total_amount.value").alias("total_amount"), F.get_json_object("payload", "$.total_amount.confidence").cast("double").alias("confidence"))
