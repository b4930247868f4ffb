"""Queries of chunking and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.operators import neighbors, search
from cairnbook.plans.registry import query, rows_sql
from cairnbook.sources import fixtures as fx

MARKDOWN = "# Expenses\n\nlead text\n\n## June\n\n| a | b |\n| 1 | 2 |\n\n### Notes\n\n領収書 paid in cash. Another sentence! And more?"
RAW = "greatest(0.0::DOUBLE, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)))"
DIST = f"round({RAW}, 6)"


def with_query(s, d):
    # the query vector is one row
    q = fx.table(s, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    return fx.table(s, d, "embeddings").join(F.broadcast(q), F.lit(True))


def nearest(rows, k):
    return search.nearest(rows, F.col("q"), k, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query("v8_filtered_knn", f"SELECT vec_id, {DIST} AS distance FROM embeddings WHERE label IN (1, 3, 5) ORDER BY {RAW}, vec_id LIMIT 8")
def v8(s, d):
    return nearest(with_query(s, d).where(F.col("label").isin(1, 3, 5)), search.TOP_K)


PAIR_DIST = "round(greatest(0.0::DOUBLE, 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 9)"


@query(
    "v8_filtered_knn_of_many",
    f"SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM "
    f"(SELECT q.vec_id AS query_id, e.vec_id, {PAIR_DIST} AS distance FROM embeddings q JOIN embeddings e ON q.vec_id % 10 = 0 AND (q.vec_id % 100 = 0 OR e.label IN (q.label, (q.label + 3) % 10, (q.label + 6) % 10)))) WHERE rank <= 8",
)
def v8_of_many(s, d):
    """Every tenth vector as a query that admits three labels, every hundredth one that admits all; the vectors of all lists within reach."""
    rows = fx.table(s, d, "embeddings")
    label = F.col("label")
    admits = F.when(F.col("vec_id") % 100 != 0, F.array(label, (label + 3) % 10, (label + 6) % 10))
    asked = rows.where("vec_id % 10 = 0").withColumn("admits", admits)
    found = neighbors.nearest_of_many(asked, "vec_id", "embedding", neighbors.build(rows, "vec_id", "embedding", "label"), search.TOP_K, "admits")
    return found.withColumnRenamed("id", "vec_id")


@query("g4_vector_topk", f"SELECT vec_id, {DIST} AS distance FROM embeddings ORDER BY {RAW}, vec_id LIMIT 10")
def g4(s, d):
    return nearest(with_query(s, d), 10)


@query("v7_domain_filter", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en') OR NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id)")
def v7(s, d):
    visible = fx.table(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("a")).distinct().withColumn("financial", F.lit(True))
    marked = fx.table(s, d, "labels").select(F.col("doc_id").alias("b")).distinct().withColumn("marked", F.lit(True))
    rows = fx.table(s, d, "embeddings").select("vec_id").join(visible, F.col("vec_id") == F.col("a"), "left").join(marked, F.col("vec_id") == F.col("b"), "left")
    return rows.where(F.col("financial").isNotNull() | F.col("marked").isNull()).select("vec_id")


@query("d34_l2_normalise", "SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / n, 6)) AS unit FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)")
def d34(s, d):
    return fx.table(s, d, "embeddings").select("vec_id", F.transform(tx.normalised(F.col("embedding")), lambda x: tx.rounded(x, 6)).alias("unit"))


@query("d35_cosine_distance", f"SELECT vec_id, {DIST} AS distance FROM embeddings")
def d35(s, d):
    return with_query(s, d).select("vec_id", F.round(tx.cosine(F.col("embedding"), F.col("q")), 6).alias("distance"))


@query("d36_prompt_prefix", "SELECT item_id, CASE WHEN starts_with(text, 'query: ') THEN text ELSE 'query: ' || text END AS prompt FROM benchmark")
def d36(s, d):
    return fx.table(s, d, "benchmark").select("item_id", F.when(F.col("text").startswith("query: "), F.col("text")).otherwise(F.concat(F.lit("query: "), F.col("text"))).alias("prompt"))


@query("v1_sections", rows_sql("heading_path, n_lines", ("Expenses", 3), ("Expenses > June", 4), ("Expenses > June > Notes", 2)))
def v1(s, d):
    return s.createDataFrame([(p, len(lines)) for p, lines in search.sections(MARKDOWN)], "heading_path string, n_lines int")


@query("v2_blocks", rows_sql("text, is_table", ("# Expenses", False), ("lead text", False), ("## June", False), ("| a | b |\n| 1 | 2 |", True), ("### Notes", False), ("領収書 paid in cash. Another sentence! And more?", False)))
def v2(s, d):
    return s.createDataFrame(search.blocks(MARKDOWN.splitlines()), "text string, is_table boolean")


@query("v3_greedy_chunks")
def v3(s, d):
    return search.chunks(fx.table(s, d, "documents"), "doc_id", "text").select("document_id", "seq", "heading_path", "tokens", F.md5("text").alias("digest"))


@query("v4_hard_split", rows_sql("seq, text, tokens", *[(i, "領収書" * 4, 12) for i in range(7)], (7, "領収書領収書 abcdefgh abcdefgh abcdefgh", 12), (8, " ".join(["abcdefgh"] * 6), 12), (9, " ".join(["abcdefgh"] * 6), 12), (10, " ".join(["abcdefgh"] * 5), 10)))
def v4(s, d):
    rows = [(i, t, search.tokens(t)) for i, t in enumerate(search.hard_split("領収書" * 30 + " abcdefgh" * 20, 12))]
    return s.createDataFrame(rows, "seq int, text string, tokens int")


@query("w8_chunk_seq", f"SELECT doc_id AS document_id, CAST(unnest(range(1 + doc_id % 5)) AS INTEGER) AS seq, 'xxxxxxxxxxxx' || doc_id || 'p' || unnest(range(1 + doc_id % 5)) AS text FROM documents")
def w8(s, d):
    """Numbers of chunks in their documents: texts of one to five paragraphs, each as large as a chunk may be."""
    paragraphs = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 5).cast("int")), lambda i: F.concat(F.lit("x" * 12), F.col("doc_id").cast("string"), F.lit("p"), i.cast("string")))
    docs = fx.table(s, d, "documents").select("doc_id", F.array_join(paragraphs, "\n\n").alias("text"))
    return search.chunks(docs, "doc_id", "text", 7).select("document_id", "seq", "text")


@query("v5_discovery_chunks", rows_sql("document_id, seq, heading_path, text", (1, 0, "Expenses", "lead text"), (1, 1, "Expenses > June", "| a | b |\n| 1 | 2 |"), (1, 2, "Expenses > June > Notes", "領収書 paid in cash. Another sentence! And more?"), (2, 0, "", "plain")))
def v5(s, d):
    docs = s.createDataFrame([(1, MARKDOWN), (2, "plain")], "id long, text string")
    return search.chunks(docs, "id", "text", 60).select("document_id", "seq", "heading_path", "text")


@query("v6_batched_embedding", "SELECT item_id, [CAST(length(text) AS DOUBLE), CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE)] AS embedding FROM benchmark")
def v6(s, d):
    rows = fx.table(s, d, "benchmark").select("item_id", "text")
    return search.embed(rows, lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]).select("item_id", "embedding")


@query("i17_replace_chunks")
def i17(s, d):
    from cairnbook.sources.tables import replace_partitions

    made = search.chunks(fx.table(s, d, "documents"), "doc_id", "text").where("error is null").drop("error").withColumn("chunk_id", F.sha2(F.concat_ws("/", F.col("document_id").cast("string"), F.col("seq").cast("string"), "text"), 256)).withColumn("part", F.col("document_id") % 4)
    return replace_partitions(made, "chunks", "part").groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"))


@query("l3_semantic_answer", f"WITH h AS (SELECT vec_id FROM embeddings ORDER BY {RAW}, vec_id LIMIT 3), p AS (SELECT d.text || ' [source ' || vec_id || ':0]' AS passage FROM h JOIN documents d ON d.doc_id = vec_id) SELECT 'what does the warranty say' AS question, FALSE AS refused, passage FROM p UNION ALL SELECT 'total of June', TRUE, '{search.REFUSAL}' UNION ALL SELECT 'which receipt did I spend most on', FALSE, passage FROM p")
def l3(s, d):
    """A question answered from passages, one about amounts that is refused, and one that goes with a verified total."""
    texts = fx.table(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("seq"), "text")
    hits = search.nearest(with_query(s, d), F.col("q"), 3, "vec_id").select(F.col("vec_id").alias("document_id")).join(texts, "document_id")
    parts = [search.answer(*x) for x in (("what does the warranty say", hits), ("total of June", hits), ("which receipt did I spend most on", hits, True))]
    return parts[0].union(parts[1]).union(parts[2])
