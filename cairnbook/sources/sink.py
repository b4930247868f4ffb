"""Ordered CSV files written by tasks: a Python data source with a two-phase commit.

``write_parts`` deals rows by ranges of an order, and each task writes its range as one part, in the order, under a name
of its attempt.  Nothing of that is part of the table.  When all tasks have ended, the commit on the driver gives the parts their
names in order, and at last writes _parts.json, which lists rows, bytes, digest and the offset that each part has in the file that all make
together; a reader that looks there finds all of a write or none.  If a task fails, or a character has no code in the charset, the
attempts are deleted and the folder is as it was.

Lines end with CRLF, cells are quoted where they must be, null is an empty cell; a header is in the first part only.  Paths are
those of pyarrow's file systems (local, hdfs, s3, gs) and must be the same for all executors.

Cases: no rows give one part with the header alone, or an empty one; rows alike in the order are in any order among them;
an existing table is replaced by the commit, not before.
"""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

PARTS = "_parts.json"


@dataclass
class Part(WriterCommitMessage):
    number: int
    file: str
    rows: int
    bytes: int
    sha256: str


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str], header: bool, charset: str):
        self.path, self.columns, self.header, self.charset = path.rstrip("/"), columns, header, charset
        self.attempts = f"{self.path}/_attempt-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        number, rows, size, digest = task.partitionId(), 0, 0, hashlib.sha256()
        fs, folder = _at(self.attempts)
        fs.create_dir(folder)
        file = f"{number:05d}-{task.taskAttemptId()}"

        def encoded(lines) -> bytes:
            text = io.StringIO(newline="")
            csv.writer(text, lineterminator="\r\n").writerows(lines)
            return text.getvalue().encode(self.charset)

        with fs.open_output_stream(f"{folder}/{file}") as out:

            def put(data: bytes) -> int:
                out.write(data)
                digest.update(data)
                return len(data)

            if self.header and number == 0:
                size += put(encoded([self.columns]))
            for batch in iterator:
                size += put(encoded(zip(*[c.to_pylist() for c in batch.columns], strict=True)))
                rows += batch.num_rows
        return Part(number, file, rows, size, digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        fs, folder = _at(self.path)
        attempts = _at(self.attempts)[1]
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.type == pafs.FileType.File]
        for path in sorted(old, key=lambda p: not p.endswith(PARTS)):  # the list first: without it there is no table
            fs.delete_file(path)
        listed, offset = [], 0
        for part in sorted((m for m in messages if m), key=lambda m: m.number):
            name = f"part-{part.number:05d}.csv"
            fs.move(f"{attempts}/{part.file}", f"{folder}/{name}")
            listed.append({"name": name, "rows": part.rows, "bytes": part.bytes, "offset": offset, "sha256": part.sha256})
            offset += part.bytes
        fs.delete_dir(attempts)
        with fs.open_output_stream(f"{folder}/{PARTS}") as out:
            out.write(json.dumps({"charset": self.charset, "header": self.columns if self.header else None, "bytes": offset, "parts": listed}, ensure_ascii=False).encode())

    def abort(self, messages: list[Part | None]) -> None:
        fs, folder = _at(self.attempts)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


@dataclass
class Listed(InputPartition):
    path: str
    skip: int


class PartsReader(DataSourceReader):
    """One task for each part of a committed write; a part is read as a stream."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path.rstrip("/"), columns
        self.about = listed(self.path)

    def partitions(self) -> list[Listed]:
        return [Listed(f"{self.path}/{p['name']}", int(i == 0 and bool(self.about["header"]))) for i, p in enumerate(self.about["parts"])]

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        fs, file = _at(partition.path)
        with fs.open_input_stream(file) as raw:
            lines = csv.reader(io.TextIOWrapper(raw, encoding=self.about["charset"], newline=""))
            for _ in range(partition.skip):
                next(lines)
            while some := list(itertools.islice(lines, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], self.columns)


class PartsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_csv"

    def writer(self, schema: T.StructType, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options["path"], schema.names, self.options.get("header", "false") == "true", self.options.get("charset", "utf-8"))

    def reader(self, schema: T.StructType) -> PartsReader:
        return PartsReader(self.options["path"], schema.names)


def write_parts(df: DataFrame, path: str, order: list[Column | str], header: bool = True, charset: str = "utf-8", drop: tuple[str, ...] = ()) -> None:
    """df's columns (but for drop, which only order) as text, in the order, under path."""
    spark = df.sparkSession
    spark.dataSource.register(PartsSource)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if c not in drop])
    rows.write.format("ordered_csv").mode("overwrite").option("path", path).option("header", str(header).lower()).option("charset", charset).save()


def listed(path: str) -> dict:
    """The list of a committed write; FileNotFoundError where there is none."""
    fs, folder = _at(path.rstrip("/"))
    with fs.open_input_stream(f"{folder}/{PARTS}") as f:
        return json.loads(f.read())


def read_parts(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The rows of a committed write under the given names; all cells are texts."""
    spark.dataSource.register(PartsSource)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.format("ordered_csv").schema(schema).option("path", path).load()
