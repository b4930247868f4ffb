"""A corpus pipeline: language, toxicity, near duplicates, source weights, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; docs has the columns of the documents table.
All but the last stage return the same columns.

- language: documents whose language cannot be told (no letters, "und", or an unsure posterior) go.
- toxicity: documents that the network scores 0.5 or more go.
- near_duplicates: of each group of rows linked by a Jaccard similarity of 0.8 or more on five-word shingles (equal
  texts included) the row of the smallest id stays; of rows of one id that of the smallest text hash, and a row without
  id only where no row of its group has one.  Texts without words link with nothing and stay.
- mixture: documents are repeated or left out so that sources come near their target weights.
- packing: token sequences of at most 4,096 ids; one row per piece.

Cases, for every stage: an empty table gives an empty table; a null text is empty; null ids, sources and languages are values of
their own; texts of any length are read whole; repeated rows are rows each until near_duplicates; columns besides those of documents,
whatever their names, pass through.  The first stage needs lang, source and text, toxicity and later ones doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.llm import jaccard, langid, mixing, packing, toxicity
from cairnbook.llm.shared import documents, stored

SENT = 500_000


def _row(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    return langid.identify_documents(docs, model).where("accepted").select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(_row(docs)), net, "row.text").where("score < 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = stored(jaccard.duplicates(docs, n=5, num=80, den=100), "pipeline-duplicates")
    found = found.select(F.col("doc_id").isNull().alias("a_"), F.coalesce("doc_id", F.lit(0)).alias("b_"), F.col("tie").alias("c_"), (F.col("keep") & (F.col("rows") == 1)).alias("stays_"), (F.col("keep") & (F.col("rows") > 1)).alias("once_"))
    own = F.col("doc_id").cast("long")
    rows = docs.select(_row(docs), own.isNull().alias("a_"), F.coalesce(own, F.lit(0)).alias("b_"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("c_"))
    keys = ["a_", "b_", "c_"]
    # up to SENT keys (some 64 bytes each) go to all tasks and no text is shuffled; beyond that the texts are, once
    gone, once = (found.where(c).select(keys) for c in ("not stays_", "once_"))
    kept = rows.join(_sent(gone), keys, "left_anti").select("row.*")
    if not once.limit(1).count():
        return kept
    # rows equal in id and text, of which one stays, are few: only they are gathered by key
    again = rows.join(_sent(once), keys, "left_semi").groupBy(keys).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.unionByName(again.select("row.*"))


def _sent(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(SENT + 1).count() <= SENT else keys


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.remix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", pack)]

#: SQL expresses neither language, toxicity nor packing; tests compare near_duplicates and packing with brute force, and the mixture with its SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
