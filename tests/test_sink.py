"""Ordered parts: bytes, order, offsets, and what a failed write leaves."""

import csv
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from cairnbook.sources import sink

ROWS = [(i, f"取引 {i}" if i % 3 else None, 'a "quoted", cell' if i % 5 == 0 else f"v{i}") for i in range(500)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id long, name string, note string").repartition(7)


def whole(path):
    about = sink.listed(path)
    data = b"".join(open(f"{path}/{p['name']}", "rb").read() for p in about["parts"])
    for p in about["parts"]:
        part = data[p["offset"] : p["offset"] + p["bytes"]]
        assert hashlib.sha256(part).hexdigest() == p["sha256"] and part == open(f"{path}/{p['name']}", "rb").read()
    assert len(data) == about["bytes"]
    return data


def rendered(rows, header, charset):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\r\n").writerows([*([header] if header else []), *rows])
    return out.getvalue().encode(charset)


@pytest.mark.parametrize(("header", "charset"), [(True, "utf-8"), (False, "shift_jis")])
def test_parts_make_one_file(spark, tmp_path, header, charset):
    path = f"{tmp_path}/out"
    sink.write_parts(frame(spark), path, ["id"], header, charset)
    names = ["id", "name", "note"]
    assert whole(path) == rendered(ROWS, names if header else None, charset)
    assert len(sink.listed(path)["parts"]) > 1 and sum(p["rows"] for p in sink.listed(path)["parts"]) == len(ROWS)
    got = sorted((int(r["id"]), r["name"], r["note"]) for r in sink.read_parts(spark, path, names).collect())
    assert got == [(i, n or "", v) for i, n, v in ROWS]
    sink.write_parts(frame(spark, ROWS[:9]), path, [F.desc("id")], header, charset)  # replaces
    assert whole(path) == rendered(ROWS[8::-1], names if header else None, charset)


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = f"{tmp_path}/out"
    sink.write_parts(frame(spark), path, ["id"])
    before, files = whole(path), sorted(os.listdir(path))
    bad = frame(spark, [*ROWS, (900, "no code for this: \U0001f600", "x")])
    with pytest.raises(Exception, match="(?i)encode|shift_jis|UnicodeEncodeError"):
        sink.write_parts(bad, path, ["id"], charset="shift_jis")
    assert whole(path) == before and sorted(os.listdir(path)) == files
    with pytest.raises(Exception, match="(?i)encode|shift_jis|UnicodeEncodeError"):
        sink.write_parts(bad, f"{tmp_path}/new", ["id"], charset="shift_jis")
    with pytest.raises(FileNotFoundError):
        sink.listed(f"{tmp_path}/new")


def test_no_rows(spark, tmp_path):
    sink.write_parts(frame(spark, ROWS[:0] or []), f"{tmp_path}/a", ["id"])
    assert whole(f"{tmp_path}/a") == b"id,name,note\r\n"
    assert sink.read_parts(spark, f"{tmp_path}/a", ["id", "name", "note"]).count() == 0
