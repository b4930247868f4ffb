"""Files on disk through Spark's reader and through the data source."""

from pyspark.sql import functions as F

from cairnbook.plans.sources import DEEP, FILES
from cairnbook.sources import files as fl


def test_folder_of_files(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    rows = fl.read(spark, f"file://{tmp_path}").withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["name"], []).append(r)
    assert set(by) == set(FILES)
    assert by["plain.csv"][0]["cells"] == [["name", "name", "note"], ["A", "1", "line one\nline two"], ["B", "2", "=SUM(A1:A2)"], ["C", "3"]]
    assert [r["locator"] for r in by["deck.pptx"]] == ["slide/1", "slide/1/table/1", "slide/2", "slide/2/table/1"]
    assert by["deep.json"][0]["error"].startswith("Budget") and len(by["deep.json"]) == 1 and by["deep.json"][0]["cells"] is None
    assert by["scan.pdf"][0]["error"] and not any(r["error"] for r in by["letter.docx"])
    spark.dataSource.register(fl.DocumentSource)
    again = spark.read.format("document_units").load(f"file://{tmp_path}")
    assert again.count() == len(rows) and again.where("error is not null").count() == sum(r["error"] is not None for r in rows)
    assert fl.read(spark, f"file://{tmp_path}", "*.csv").select("path").distinct().count() == 2
    kinds = {r["path"].rsplit("/", 1)[-1]: r["format"] for r in fl.manifest(spark.read.format("binaryFile").load(f"file://{tmp_path}")).collect()}
    assert kinds["book.xlsx"] == "xlsx" and kinds["nul.bin"] == "unknown"


def test_empty_and_refused(spark):
    df = spark.createDataFrame([("a.csv", bytearray(b"")), ("b.json", bytearray(DEEP)), ("c.txt", None), ("d.csv", bytearray(b"a,b\n1,2\n"))], "path string, content binary")
    got = {r["path"]: r for r in fl.parse_files(df).collect()}
    assert got["a.csv"]["error"] and got["b.json"]["error"] and got["c.txt"]["text"] == "" and got["d.csv"]["cells"] == [["a", "b"], ["1", "2"]]
    assert fl.parse_files(df.limit(0)).count() == 0
