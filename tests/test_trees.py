"""Tables in JSON trees against a walk in plain Python."""

import json
import random

import pytest

from cairnbook.operators import semistructured as tree

TREES = [
    '{"a": [{"x": 1, "y": "t"}, {"z": null, "x": 2.5}], "b": {"c": [[{"q": true}], [1, 2], []]}}', '[{"k": {"n": [1, {"m": 2}]}}, {}]', "[1, {\"a\": 1}]", "17", "null", '"text"', "not json", None, "{}", "[]", "[{}]",
    '{"deep": {"er": [{"in": [{"side": 1}]}]}}', '[[[{"日本": "é", "n": -7}]]]', '{"big": [{"n": 12345678901234567890}, {"n": 1e30}]}',
]


def walk(value, path=("root",)):
    if isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
        yield "/".join(path), value
        return
    for key, item in value.items() if isinstance(value, dict) else ((str(i), x) for i, x in enumerate(value, 1)) if isinstance(value, list) else ():
        yield from walk(item, (*path, key))


def loads(text):
    try:
        return json.loads(text or "")
    except ValueError:
        return None


def header(rows):
    return list(dict.fromkeys(k for row in rows for k in sorted(row)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.2:
            return rng.choice([1, 2.5, "t", None, True])
        if kind < 0.5:
            return {rng.choice("abcd"): made(depth - 1) for _ in range(rng.randint(0, 3))}
        return [made(depth - 1) for _ in range(rng.randint(0, 3))]

    return TREES + [json.dumps(made(5)) for _ in range(150)]


def test_tables_headers_and_cells(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, json string")
    want = {(i, path): rows for i, t in enumerate(texts) for path, rows in walk(loads(t))}
    found = tree.tables(df, "id")
    got = {(r["id"], r["path"]): (r["header"], r["n_rows"]) for r in tree.headers(found, "id").collect()}
    assert got == {k: (header(rows), len(rows)) for k, rows in want.items()}
    cells = {(r["id"], r["path"], r["row_index"], r["column"]): r["text"] for r in tree.cells(found, "id").collect() if r["column"] is not None}
    assert set(cells) == {(*k, i, c) for k, rows in want.items() for i, row in enumerate(rows) for c in row}
    for k, rows in want.items():
        for i, row in enumerate(rows):
            for c, v in row.items():
                text = cells[*k, i, c]
                if v is None:
                    assert text == ""
                elif isinstance(v, dict | list | bool):
                    assert json.loads(text) == v
                else:
                    assert text == v if isinstance(v, str) else float(text) == float(v)


def test_what_cannot_be_read(spark):
    df = spark.createDataFrame([(1, "{"), (2, None), (3, "[1]"), (4, "null")], "id int, json string")
    assert {r["id"]: r["readable"] for r in tree.readable(df).collect()} == {1: False, 2: False, 3: True, 4: True}
    assert tree.tables(df, "id").count() == 0 and tree.tables(df.limit(0), "id").count() == 0


def test_depth_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(tree, "DEPTH", 3)
    with pytest.raises(ValueError, match="deeper"):
        tree.tables(spark.createDataFrame([(1, "[[[[1]]]]")], "id int, json string"), "id")


def test_numbers_and_schemas(spark):
    df = spark.createDataFrame([("a", '{"x": 1, "y": "2"}'), ("a", '{"x": 2.5, "z": true}'), ("b", '{"x": null}'), ("b", "[1]"), ("b", None)], "g string, json string")
    assert [tuple(r) for r in tree.numbers(df, "json", "g").collect()] == [("a", "x", 3.5, 1.75, 2)]
    got = {r["g"]: r["schema"] for r in tree.schemas(df.where("json like '{%'"), "json", "g").collect()}
    assert got == {"a": "OBJECT<x: DECIMAL(21,1), y: STRING, z: BOOLEAN>", "b": "OBJECT<x: VOID>"}
