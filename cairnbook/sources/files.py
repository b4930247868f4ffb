"""Files read by Spark and parsed in its tasks: sniffed by content, dispatched to the parser of their format.

read() takes any path that Spark reads.  A parser gives units of a file: texts and tables, with a locator each.  A
file that a parser refuses, or that is above a limit, gives one row with the error and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairnbook.sources import parse

Unit = tuple[str, str, list[list[str]] | None]  # locator, text, table
Adapter = Callable[[bytes], list[Unit]]
SCHEMA = "path string, format string, locator string, text string, cells array<array<string>>, error string"


def _table(locator: str, rows: list[list[str]]) -> Unit:
    return locator, "", rows


def _delimited(raw: bytes) -> list[Unit]:
    head, rows = parse.delimited(raw)
    return [_table("table/1", [head, *rows])]


def _trees(kind: str) -> Adapter:
    return lambda raw: [_table(at, [head, *rows]) for at, head, rows in parse.structured(raw, kind)]


def _plain(raw: bytes) -> list[Unit]:
    return [("text", parse.decode(raw)[0], None)]


def _html(raw: bytes) -> list[Unit]:
    text, tables, _ = parse.inert_html(parse.decode(raw)[0])
    return [("text", text, None), *[_table(f"table/{i + 1}", t) for i, t in enumerate(tables)]]


def _markdown(raw: bytes) -> list[Unit]:
    return [("text", parse.front_matter(parse.decode(raw)[0])[1], None)]


def _docx(raw: bytes) -> list[Unit]:
    paragraphs, tables = parse.docx(raw)
    return [("text", "\n".join(paragraphs), None), *[_table(f"table/{i + 1}", t) for i, t in enumerate(tables)]]


def _pptx(raw: bytes) -> list[Unit]:
    out: list[Unit] = []
    for i, (text, tables) in enumerate(parse.pptx(raw), 1):
        out += [(f"slide/{i}", text, None), *[_table(f"slide/{i}/table/{k + 1}", t) for k, t in enumerate(tables)]]
    return out


def _odf(raw: bytes) -> list[Unit]:
    paragraphs, tables = parse.odf(raw)
    return [("text", "\n".join(paragraphs), None), *[_table(f"table/{name}", t) for name, t in tables]]


def _xlsx(raw: bytes) -> list[Unit]:
    return [_table(f"sheet/{name}/{i + 1}", t) for name, grid in parse.xlsx(raw).items() for i, t in enumerate(parse.subtables(grid))]


def _mail(raw: bytes) -> list[Unit]:
    m = parse.mail(raw)
    return [("subject", m["subject"], None), ("text", m["text"], None), _table("attachments", [[n, str(s)] for n, s in m["attachments"]])]


def _archive(raw: bytes) -> list[Unit]:
    return [_table("members", [[p, str(n), k] for p, n, k in parse.archive_members(raw)])]


def _image(raw: bytes) -> list[Unit]:
    return [_table("image", [[str(x) for x in parse.image(raw)]])]


class Registry:
    """Adapters by format; a name is given once and never replaced."""

    def __init__(self):
        self._adapters: dict[str, Adapter] = {}

    def register(self, name: str, adapter: Adapter) -> None:
        if name in self._adapters:
            raise ValueError(f"{name} is registered already")
        self._adapters[name] = adapter

    def get(self, name: str) -> Adapter:
        if name not in self._adapters:
            raise KeyError(f"nothing is registered for {name}")
        return self._adapters[name]

    def names(self) -> list[str]:
        return sorted(self._adapters)


def default_registry() -> Registry:
    out = Registry()
    for names, adapter in (
        (("csv", "tsv"), _delimited), (("md",), _markdown), (("text", "log", "rst"), _plain), (("html",), _html), (("docx",), _docx), (("pptx",), _pptx), (("odf",), _odf), (("xlsx",), _xlsx), (("eml",), _mail),
        (("zip", "tar", "gzip"), _archive), (("png", "jpeg", "gif", "bmp"), _image),
    ):
        for name in names:
            out.register(name, adapter)
    for kind in ("json", "jsonl", "yaml"):
        out.register(kind, _trees(kind))
    for name in ("xml", "svg"):
        out.register(name, lambda raw: [_table(at, [head, *rows]) for at, head, rows in parse.xml_tables(raw)])
    out.register("rtf", lambda raw: [("text", parse.rtf(raw), None)])
    return out


def units(path: str, raw: bytes, registry: Registry) -> Iterator[tuple]:
    """Rows of SCHEMA of one file."""
    fmt = "unknown"
    try:
        fmt = parse.sniff(raw, path)
        for locator, text, cells in registry.get(fmt)(raw):
            yield path, fmt, locator, text, cells, None
    except Exception as e:  # noqa: BLE001  a file that cannot be read is a row, not a failed job
        yield path, fmt, None, None, None, f"{type(e).__name__}: {e}"[:500]


def parse_files(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Units (SCHEMA) of files (path, content); each task holds one file at a time.  All of a refused file's units are left out."""
    registry = registry or default_registry()
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string())), pa.string()]
    names = ["path", "format", "locator", "text", "cells", "error"]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = list(units(path, content.as_py() or b"", registry))
                rows = [r for r in rows if r[5]] or rows
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Units of all files under path."""
    return parse_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


class DocumentSource(DataSource):
    """spark.read.format("document_units").load(folder): units of the files in a folder that executors can open; one task for each file.

    For stores that only Spark opens, use read().
    """

    @classmethod
    def name(cls):
        return "document_units"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self):
        import os

        return [InputPartition(os.path.join(d, n)) for d, _, names in sorted(os.walk(self.path)) for n in sorted(names)]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            yield from units(partition.value, f.read(), default_registry())


def manifest(files: DataFrame) -> DataFrame:
    """path, format and sha256 of files (path, content), by content."""

    @F.pandas_udf("string")
    def kind(content, path):
        import pandas as pd

        return pd.Series([parse.sniff(bytes(c or b""), p or "") for c, p in zip(content, path, strict=True)])

    return files.select("path", kind("content", "path").alias("format"), F.sha2("content", 256).alias("sha256"), F.length("content").alias("n_bytes"))
