"""Parsers of document formats: bytes in, plain Python values out; used inside Arrow-batched readers."""

from __future__ import annotations

import csv
import email
import email.policy
import gzip
import html.parser
import io
import json
import re
import struct
import tarfile
import xml.etree.ElementTree as ET
import zipfile

MAX_ROWS, MAX_CELLS, MAX_BYTES, MAX_NODES, MAX_DEPTH, MAX_MEMBERS = 100_000, 1_000_000, 50 << 20, 200_000, 64, 10_000
MAX_SIDE, MAX_PIXELS, MAX_FRAMES = 12_000, 40_000_000, 100


class Budget(ValueError):
    """An input is above a limit; nothing of it is kept."""


def need(name: str, value: int, most: int) -> None:
    if value > most:
        raise Budget(f"{name}: {value} is above {most}")


def decode(raw: bytes) -> tuple[str, str]:
    """(text, charset): by byte order mark, else UTF-8, else CP932; NUL bytes and other input are errors."""
    need("bytes", len(raw), MAX_BYTES)
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        return raw.decode("utf-16"), "utf-16"
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode(), "utf-8"
    if b"\0" in raw:
        raise ValueError("binary input")
    for name in ("utf-8", "cp932"):
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    raise ValueError("neither UTF-8, UTF-16 nor CP932")


def delimiter(text: str) -> str:
    """The most frequent of , ; tab | in the first 20 lines that are not blank; a tie goes to the comma."""
    lines = [x for x in text[: 64 << 10].splitlines() if x.strip()][:20]
    count = {c: sum(x.count(c) for x in lines) for c in ",;\t|"}
    most = max(count.values())
    if not most:
        raise ValueError("no delimiter found")
    return "," if count[","] == most else max((c for c in count if count[c] == most))


def delimited(raw: bytes) -> tuple[list[str], list[list[str]]]:
    """(first row, other rows), ragged rows kept, nothing interpreted."""
    text, _ = decode(raw)
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter(text), strict=True))
    need("rows", len(rows), MAX_ROWS)
    need("cells", sum(map(len, rows)), MAX_CELLS)
    return (rows[0], rows[1:]) if rows else ([], [])


def _plain(value) -> str:
    if isinstance(value, str):
        return value
    return "" if value is None else json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def tables_in_tree(value, path: str = "$") -> list[tuple[str, list[str], list[list[str]]]]:
    """(path, header, rows) of every non-empty array of objects; header: keys in the order first seen."""
    out = []
    stack = [(value, path, 0)]
    while stack:
        node, at, depth = stack.pop()
        need("depth", depth, MAX_DEPTH)
        if isinstance(node, list):
            if node and all(isinstance(x, dict) for x in node):
                header = list(dict.fromkeys(k for x in node for k in x))
                out.append((at, header, [[_plain(x.get(k)) for k in header] for x in node]))
            stack += [(x, f"{at}[{i}]", depth + 1) for i, x in reversed(list(enumerate(node)))]
        elif isinstance(node, dict):
            stack += [(x, f"{at}.{k}", depth + 1) for k, x in reversed(list(node.items()))]
    return out


def structured(raw: bytes, kind: str) -> list[tuple[str, list[str], list[list[str]]]]:
    """Tables of json, jsonl or yaml input."""
    text, _ = decode(raw)
    if kind == "jsonl":
        return tables_in_tree([json.loads(x) for x in text.splitlines() if x.strip()])
    if kind == "yaml":
        if re.search(r"(?m)(^|[\s\[,{:-])[&*!][A-Za-z0-9_!]", text):
            raise ValueError("anchors, aliases and tags are refused")
        import yaml

        return tables_in_tree(yaml.safe_load(text))
    return tables_in_tree(json.loads(text))


def xml_tables(raw: bytes) -> list[tuple[str, list[str], list[list[str]]]]:
    """Two or more siblings of one tag that all have children form a table."""
    text, _ = decode(raw)
    if re.search(r"<!(DOCTYPE|ENTITY)", text, re.I):
        raise ValueError("document types and entities are refused")
    root, out = ET.fromstring(text), []
    nodes = 0
    stack = [(root, "/" + root.tag)]
    while stack:
        node, at = stack.pop()
        nodes += 1
        need("nodes", nodes, MAX_NODES)
        groups: dict[str, list] = {}
        for kid in node:
            groups.setdefault(kid.tag, []).append(kid)
        for tag, kids in groups.items():
            if len(kids) > 1 and all(len(k) for k in kids):
                header = list(dict.fromkeys(c.tag for k in kids for c in k))
                out.append((f"{at}/{tag}", header, [["".join(found.itertext()).strip() if (found := k.find(h)) is not None else "" for h in header] for k in kids]))
            stack += [(k, f"{at}/{tag}") for k in reversed(kids)]
    return out


class _Inert(html.parser.HTMLParser):
    BLOCKS = ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "title")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.quiet, self.table, self.row, self.tables = [], 0, None, None, []
        self.counts = {"active": 0, "events": 0, "external": 0}

    def handle_starttag(self, tag, attrs):
        self.counts["events"] += sum(k.startswith("on") for k, _ in attrs)
        self.counts["external"] += sum(k in ("src", "href", "action") and bool(re.match(r"(?i)(https?:)?//", v or "")) for k, v in attrs)
        if tag in ("script", "style", "iframe", "object", "embed"):
            self.counts["active"] += tag != "style"
            self.quiet += tag in ("script", "style")
        elif tag == "table":
            if self.table is not None:
                raise ValueError("a table inside a table")
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.row = []
            self.table.append(self.row)
        elif tag in ("td", "th") and self.row is not None:
            self.row.append("")
        elif tag in self.BLOCKS:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.quiet:
            self.quiet -= 1
        elif tag == "table" and self.table is not None:
            self.tables.append(self.table)
            self.table = self.row = None
            self.text.append("\n")
        elif tag in self.BLOCKS:
            self.text.append("\n")

    def handle_data(self, data):
        if self.quiet:
            return
        if self.row:
            self.row[-1] += data
        else:
            self.text.append(data)


def inert_html(text: str) -> tuple[str, list[list[list[str]]], dict[str, int]]:
    """(text without script and style, tables, counts of active elements, event attributes and external references)."""
    p = _Inert()
    p.feed(text)
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.text).split("\n")]
    return "\n".join(x for x in lines if x), [[[" ".join(c.split()) for c in r] for r in t] for t in p.tables], p.counts


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """(key: value pairs between leading --- lines, rest)."""
    found = re.match(r"---\s*\n(.*?)\n---\s*(?:\n|$)", text, re.S)
    if not found:
        return {}, text
    pairs = re.findall(r"(?m)^([A-Za-z0-9_-]+):[ \t]*(.*?)\s*$", found[1])
    return {k: v.strip("\"'") for k, v in pairs}, text[found.end() :]


def outline(text: str) -> list[tuple[int, str]]:
    return [(len(a), b.strip()) for a, b in re.findall(r"(?m)^(#{1,6})\s+(.+?)\s*$", text)]


def archive_members(raw: bytes, at: str = "", depth: int = 0) -> list[tuple[str, int, str]]:
    """(path, size, kind) of members of ZIP, TAR, TGZ and GZ input, archives inside included; nothing is written anywhere."""
    need("depth", depth, 4)
    out: list[tuple[str, int, str]] = []

    def add(name: str, size: int, read):
        need("members", len(out), MAX_MEMBERS)
        unsafe = name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/")
        out.append((at + name, size, "unsafe" if unsafe else "file"))
        if not unsafe and size <= MAX_BYTES and re.search(r"(?i)\.(zip|tar|tgz|gz)$", name):
            out.extend(archive_members(read(), f"{at}{name}!/", depth + 1))

    if raw.startswith(b"PK"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    add(i.filename, i.file_size, lambda i=i: z.read(i))
    elif raw.startswith(b"\x1f\x8b") and not _is_tar(raw):
        add("content", len(gzip.decompress(raw)), lambda: gzip.decompress(raw))
    else:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for m in t:
                if m.isfile():
                    add(m.name, m.size, lambda m=m: t.extractfile(m).read())
    return out


def _is_tar(raw: bytes) -> bool:
    try:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            return t.next() is not None
    except tarfile.TarError:
        return False


def mail(raw: bytes) -> dict:
    """Headers, the preferred body (plain before HTML), attachments by name and size, messages inside counted."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body and body.get_content_type() == "text/html":
        text = inert_html(text)[0]
    attached = [(p.get_filename() or "", len(p.get_payload(decode=True) or b"")) for p in m.iter_attachments()]
    return {"subject": str(m["subject"] or ""), "sender": str(m["from"] or ""), "text": text.strip(), "attachments": attached}


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _part(z: zipfile.ZipFile, name: str):
    raw = z.read(name)
    if re.search(rb"<!(DOCTYPE|ENTITY)", raw, re.I):
        raise ValueError("document types and entities are refused")
    return ET.fromstring(raw)


def docx(raw: bytes) -> tuple[list[str], list[list[list[str]]]]:
    """(paragraphs with # for heading levels, tables)."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = _part(z, "word/document.xml").find(f"{_W}body")
    paragraphs, tables = [], []
    for node in body:
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = re.match(r"(?i)heading\s*(\d)", style.get(f"{_W}val", "")) if style is not None else None
            text = "".join(t.text or "" for t in node.iter(f"{_W}t"))
            if text.strip():
                paragraphs.append(("#" * int(level[1]) + " " if level else "") + text)
        elif node.tag == f"{_W}tbl":
            tables.append([["".join(t.text or "" for t in c.iter(f"{_W}t")) for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")])
    return paragraphs, tables


def xlsx(raw: bytes) -> dict[str, list[list[str]]]:
    """Grid of each sheet; merged ranges hold their first cell everywhere."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        strings = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in _part(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in _part(z, "xl/workbook.xml").iter(f"{_S}sheet")]
        out = {}
        for i, title in enumerate(titles, 1):
            root = _part(z, f"xl/worksheets/sheet{i}.xml")
            cells = {}
            for c in root.iter(f"{_S}c"):
                v, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
                text = "".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else (v.text or "" if v is not None else "")
                cells[_cell(c.get("r"))] = strings[int(text)] if c.get("t") == "s" else text
            for m in root.iter(f"{_S}mergeCell"):
                (r0, c0), (r1, c1) = (_cell(x) for x in m.get("ref").split(":"))
                cells |= {(r, c): cells.get((r0, c0), "") for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)}
            need("cells", len(cells), MAX_CELLS)
            rows, columns = (max((k[j] for k in cells), default=-1) + 1 for j in (0, 1))
            out[title] = [[cells.get((r, c), "") for c in range(columns)] for r in range(rows)]
    return out


def _cell(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def pptx(raw: bytes) -> list[tuple[str, list[list[list[str]]]]]:
    """(text, tables) of each slide, in order; cells are not part of the text."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for name in names:
            root = _part(z, name)
            tables, inside = [], set()
            for t in root.iter(f"{_A}tbl"):
                inside |= {id(x) for x in t.iter()}
                tables.append([["".join(x.text or "" for x in c.iter(f"{_A}t")) for c in r.iter(f"{_A}tc")] for r in t.iter(f"{_A}tr")])
            lines = ["".join(x.text or "" for x in p.iter(f"{_A}t")) for p in root.iter(f"{_A}p") if id(p) not in inside]
            out.append(("\n".join(x for x in lines if x.strip()), tables))
    return out


_TEXT, _TABLE = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}", "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"


def odf(raw: bytes) -> tuple[list[str], list[tuple[str, list[list[str]]]]]:
    """(paragraphs and headings outside tables, (name, rows) of each table) of an OpenDocument file; repeated cells are written out up to a limit."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = _part(z, "content.xml")
    tables, inside, cells = [], set(), 0
    for t in root.iter(f"{_TABLE}table"):
        inside |= {id(x) for x in t.iter()}
        rows = []
        for r in t.iter(f"{_TABLE}table-row"):
            row: list[str] = []
            for c in r:
                if c.tag.endswith(("}table-cell", "}covered-table-cell")):
                    times = int(c.get(f"{_TABLE}number-columns-repeated", "1"))
                    text = "\n".join("".join(p.itertext()) for p in c.iter(f"{_TEXT}p"))
                    cells += times if text else 1
                    need("cells", cells, MAX_CELLS)
                    row += [text] * (times if text else 1)
            while row and not row[-1]:
                row.pop()
            if row:
                rows.append(row)
        tables.append((t.get(f"{_TABLE}name", f"{len(tables) + 1}"), rows))
    return [x for n in root.iter() if n.tag in (f"{_TEXT}p", f"{_TEXT}h") and id(n) not in inside and (x := "".join(n.itertext()).strip())], tables


def image(raw: bytes) -> tuple[str, int, int, int]:
    """(format, width, height, frames) from the headers of PNG, GIF, JPEG and BMP input; nothing is decoded."""
    kind = next((k for m, k in MAGIC if raw.startswith(m)), "")
    if kind == "png" and raw[12:16] == b"IHDR":
        width, height = struct.unpack(">II", raw[16:24])
        at, frames = 8, 1
        while at + 12 <= len(raw):
            size, name = struct.unpack(">I4s", raw[at : at + 8])
            if name == b"acTL":
                frames = struct.unpack(">I", raw[at + 8 : at + 12])[0]
            at += size + 12
    elif kind == "gif":
        width, height = struct.unpack("<HH", raw[6:10])
        at, frames = 13 + (3 << (raw[10] & 7) + 1 if raw[10] & 128 else 0), 0
        while at < len(raw) and raw[at] != 0x3B:
            if raw[at] == 0x2C:
                frames += 1
                at += 11 + (3 << (raw[at + 9] & 7) + 1 if raw[at + 9] & 128 else 0)
            else:
                at += 2
            while at < len(raw) and raw[at]:
                at += raw[at] + 1
            at += 1
    elif kind == "jpeg":
        at, width, height, frames = 2, 0, 0, 1
        while at + 9 <= len(raw) and raw[at] == 0xFF:
            if raw[at + 1] in (0xC0, 0xC1, 0xC2, 0xC3):
                height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
                break
            at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    elif kind == "bmp":
        width, height = struct.unpack("<ii", raw[18:26])
        height, frames = abs(height), 1
    else:
        raise ValueError("not an image whose header is known")
    if not width or not height:
        raise ValueError("an image without dimensions")
    need("width", width, MAX_SIDE)
    need("height", height, MAX_SIDE)
    need("pixels", width * height * frames, MAX_PIXELS)
    need("frames", frames, MAX_FRAMES)
    return kind, width, height, frames


def rtf(raw: bytes) -> str:
    """Visible text: groups of destinations (fonttbl, \\*, ...) left out, escapes decoded."""
    text, out, skip, stack = raw.decode("latin-1"), [], False, []
    for word, number, hexa, char in re.findall(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\?([^a-z]|[a-z])", text, re.I):
        if char == "{":
            stack.append(skip)
        elif char == "}":
            skip = stack.pop() if stack else False
        elif word in ("fonttbl", "colortbl", "stylesheet", "info", "pict") or char == "*":
            skip = True
        elif skip:
            continue
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
        elif hexa:
            out.append(bytes.fromhex(hexa).decode("cp1252", "replace"))
        elif char and char not in "\r\n":
            out.append(char)
    return "".join(out).strip()


def header_score(rows: list[list[str]], keywords: frozenset[str]) -> int:
    """The row that looks most like a header: cells + 2 distinct + texts + 4 keywords + 2 if data follows, earlier rows first."""
    best, at = None, 0
    filled = [sum(bool(c.strip()) for c in r) for r in rows]
    for i, row in enumerate(rows):
        cells = [c.strip() for c in row if c.strip()]
        if not cells:
            continue
        texts = sum(not re.fullmatch(r"[+\-¥$€]?[\d.,/: \-]+%?", c) for c in cells)
        known = sum(c.casefold() in keywords for c in cells)
        follows = any(n >= min(2, len(cells)) for n in filled[i + 1 :])
        score = len(cells) + 2 * len({c.casefold() for c in cells}) + texts + 4 * known + 2 * follows - i / 1000
        if best is None or score > best:
            best, at = score, i
    return at


def subtables(rows: list[list[str]]) -> list[list[list[str]]]:
    """Parts of a grid between blank rows, then between blank columns."""
    width = max(map(len, rows), default=0)
    grid = [r + [""] * (width - len(r)) for r in rows]

    def runs(flags):
        start = None
        for i, flag in enumerate([*flags, False]):
            if flag and start is None:
                start = i
            elif not flag and start is not None:
                yield start, i
                start = None

    out = []
    for a, b in runs([any(c.strip() for c in r) for r in grid]):
        for c, e in runs([any(r[j].strip() for r in grid[a:b]) for j in range(width)]):
            out.append([r[c:e] for r in grid[a:b] if any(x.strip() for x in r[c:e])])
    return out


# Leading bytes of formats.
MAGIC = ((b"%PDF-", "pdf"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF8", "gif"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"), (b"PK\x03\x04", "zip"), (b"\x1f\x8b", "gzip"), (b"{\\rtf", "rtf"), (b"RIFF", "riff"), (b"BM", "bmp"))
ZIP_KINDS = (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"), ("content.xml", "odf"))


def sniff(raw: bytes, name: str = "") -> str:
    """Format by content; the name only refines plain text."""
    kind = next((k for m, k in MAGIC if raw.startswith(m)), None)
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            inside = set(z.namelist())
        return next((k for part, k in ZIP_KINDS if part in inside), "zip")
    if kind:
        return kind
    if len(raw) > 262 and raw[257:262] == b"ustar":
        return "tar"
    try:
        text, _ = decode(raw)
    except ValueError:
        return "unknown"
    head = text.lstrip()[:200].lower()
    if head.startswith(("<!doctype html", "<html")):
        return "html"
    if head.startswith(("<?xml", "<svg")):
        return "svg" if "<svg" in head else "xml"
    end = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return end if end in ("csv", "tsv", "md", "json", "jsonl", "yaml", "eml", "log", "rst") or end == "xml" and head.startswith("<") else "text"


def page_needs_ocr(text: str, least: int = 20, mojibake: float = 0.1) -> bool:
    """Too few letters and digits, a replacement character, or too many characters that decoding errors leave."""
    odd = sum(c in "ÃÂâ€™�" for c in text)
    return sum(c.isalnum() for c in text) < least or "�" in text or odd >= mojibake * max(1, len(text))
