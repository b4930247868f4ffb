"""Queries of duplicate detection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.operators import dedupe, review
from cairnbook.operators import names as nm
from cairnbook.plans.registry import query
from cairnbook.sources import fixtures as fx
from cairnbook.sources.fixtures import SQL_EXTRACTED, SQL_VERIFIED


def files(s, d):
    return fx.table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("sha256"))


@query("j14_checksum_join", "SELECT doc_id AS document_id, first AS other_id, CAST(1.0 AS DOUBLE) AS score, 'exact_sha256' AS reason FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents WHERE text IS NOT NULL) WHERE doc_id <> first")
def j14(s, d):
    return dedupe.exact_matches(files(s, d))


@query("j14_duplicate_classes", "SELECT doc_id AS document_id, min(doc_id) OVER (PARTITION BY text) AS class_id, CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS copies FROM documents WHERE text IS NOT NULL")
def j14b(s, d):
    return dedupe.duplicate_classes(files(s, d))


TEXT_HASH = r"""w AS (SELECT doc_id, CAST('0x' || substr(md5(unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))), 1, 16) AS UBIGINT) AS v FROM documents WHERE text IS NOT NULL),
bits AS (SELECT doc_id, i, sum(CASE WHEN (v >> i) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS one FROM w, range(64) r(i) GROUP BY doc_id, i),
h0 AS (SELECT d.doc_id AS document_id, CAST(coalesce(sum(CASE WHEN i = 63 THEN -CAST(9223372036854775808 AS HUGEINT) ELSE CAST(1 AS HUGEINT) << CAST(i AS INTEGER) END) FILTER (one), 0) AS BIGINT) AS phash
  FROM documents d LEFT JOIN bits b ON b.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id),
h AS (SELECT phash, min(document_id) AS document_id FROM h0 GROUP BY 1)"""


def text_hashes(s, d):
    """The similarity hash of each document's words."""
    return fx.table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("document_id"), tx.simhash_udf("text").alias("phash"))


@query("j15_text_hashes", f"WITH {TEXT_HASH} SELECT least(a.document_id, b.document_id) AS document_id, greatest(a.document_id, b.document_id) AS other_id, CAST(bit_count(xor(a.phash, b.phash)) AS INTEGER) AS distance, greatest(0.0::DOUBLE, 1 - bit_count(xor(a.phash, b.phash)) / 64.0::DOUBLE) AS score FROM h a JOIN h b ON a.document_id < b.document_id WHERE bit_count(xor(a.phash, b.phash)) <= 8")
def j15c(s, d):
    return dedupe.near_hashes(text_hashes(s, d)).select("document_id", "other_id", F.col("distance").cast("int").alias("distance"), "score")


@query("j15_text_hash_classes", f"WITH {TEXT_HASH} SELECT h0.document_id, h.document_id AS class_id, CAST(count(*) OVER (PARTITION BY h0.phash) AS BIGINT) AS copies FROM h0 JOIN h USING (phash)")
def j15d(s, d):
    return dedupe.duplicate_classes(text_hashes(s, d), "phash")


HASH = "h0 AS (SELECT p_partkey AS document_id, (p_partkey * 2654435761) % 4294967296 * 3 AS phash FROM part UNION ALL SELECT p_partkey + 1000000, xor((p_partkey * 2654435761) % 4294967296 * 3, CAST(1 << CAST(p_partkey % 20 AS INTEGER) AS BIGINT)) FROM part), h AS (SELECT phash, min(document_id) AS document_id FROM h0 GROUP BY 1)"


def hashes(s, d):
    """A hash of 34 bits for each part, and the same with one bit flipped."""
    base = fx.table(s, d, "part").select(F.col("p_partkey").alias("document_id"), ((F.col("p_partkey") * 2654435761) % 4294967296 * 3).alias("phash"), (F.col("p_partkey") % 20).cast("int").alias("bit"))
    flip = F.col("phash").bitwiseXOR(F.expr("shiftleft(1L, bit)"))
    return base.select("document_id", "phash").unionByName(base.select((F.col("document_id") + 1000000).alias("document_id"), flip.alias("phash")))


@query("j15_hamming_join", f"WITH {HASH} SELECT least(a.document_id, b.document_id) AS document_id, greatest(a.document_id, b.document_id) AS other_id, CAST(bit_count(xor(a.phash, b.phash)) AS INTEGER) AS distance, greatest(0.0::DOUBLE, 1 - bit_count(xor(a.phash, b.phash)) / 64.0::DOUBLE) AS score FROM h a JOIN h b ON a.document_id < b.document_id WHERE bit_count(xor(a.phash, b.phash)) <= 8")
def j15(s, d):
    return dedupe.near_hashes(hashes(s, d)).select("document_id", "other_id", F.col("distance").cast("int").alias("distance"), "score")


@query("j15_hash_classes", f"WITH {HASH} SELECT h0.document_id, h.document_id AS class_id, CAST(count(*) OVER (PARTITION BY h0.phash) AS BIGINT) AS copies FROM h0 JOIN h USING (phash)")
def j15b(s, d):
    return dedupe.duplicate_classes(hashes(s, d), "phash")


FACTS = f"WITH {SQL_VERIFIED}, facts AS (SELECT id AS document_id, transaction_date, CAST(CAST(total_amount / 1000 AS BIGINT) AS DECIMAL(18,2)) AS total_amount, counterparty FROM fx_verified)"


@query("j16_business_join", FACTS + ", c AS (SELECT transaction_date, total_amount, counterparty, min(document_id) AS id FROM facts GROUP BY 1, 2, 3) SELECT least(a.id, b.id) AS document_id, greatest(a.id, b.id) AS other_id FROM c a JOIN c b ON a.total_amount = b.total_amount AND a.id < b.id AND abs(date_diff('day', a.transaction_date, b.transaction_date)) <= 1 AND a.counterparty = b.counterparty")
def j16(s, d):
    return dedupe.business_matches(facts(s, d), least=100.0).select("document_id", "other_id")


@query("j16_business_classes", FACTS + " SELECT document_id, min(document_id) OVER (PARTITION BY transaction_date, total_amount, counterparty) AS class_id, CAST(count(*) OVER (PARTITION BY transaction_date, total_amount, counterparty) AS BIGINT) AS copies FROM facts")
def j16b(s, d):
    return dedupe.business_classes(facts(s, d)).select("document_id", "class_id", "copies")


@query("j16_fuzzy_names")
def j16c(s, d):
    """Names at least 90 alike (customers' names differ in their digits)."""
    return dedupe.business_matches(facts(s, d)).select("document_id", "other_id", "similarity")


def facts(s, d):
    return fx.verified(s, d).select(F.col("id").alias("document_id"), "transaction_date", F.round(F.col("total_amount") / 1000, 0).cast("decimal(18,2)").alias("total_amount"), "counterparty")


def ratio_sql(a: str, b: str) -> str:
    """The similarity of two names of at most 60 characters: the bits of a row go through one character of b after the other."""
    masks = f"list_transform(string_split({b}, ''), lambda c: CAST(list_sum(list_transform(range(1, len({a}) + 1), lambda i: CASE WHEN {a}[i] = c THEN CAST(1 AS BIGINT) << CAST(i - 1 AS INTEGER) ELSE 0 END)) AS BIGINT))"
    full = f"((CAST(1 AS BIGINT) << CAST(len({a}) AS INTEGER)) - 1)"
    return f"200.0::DOUBLE * (len({a}) - bit_count(list_reduce({masks}, lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full}, {full}))) / (len({a}) + len({b}))"


@query("d16_similarity_ratio", f"WITH n AS (SELECT c_custkey, c_name, lead(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS other FROM customer) SELECT c_custkey, CASE WHEN other IS NOT NULL THEN round({ratio_sql('c_name', 'other')}, 6) END AS ratio FROM n")
def d16(s, d):
    c = fx.table(s, d, "customer").select("c_custkey", "c_name", F.lead("c_name").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("other"))
    return c.select("c_custkey", F.round(tx.similarity(F.col("c_name"), F.col("other")), 6).alias("ratio"))


NAMES = """names AS (SELECT c_custkey AS id, lower(c_name) AS name FROM customer UNION ALL SELECT 1000000000 + s_suppkey, lower(s_name) FROM supplier
  UNION ALL SELECT 2000000000 + c_custkey, substr(lower(c_name), 1, CAST(c_custkey % 18 AS INTEGER)) || 'x' || substr(lower(c_name), CAST(c_custkey % 18 AS INTEGER) + 2) FROM customer
  UNION ALL SELECT 3000000000 + s_suppkey, substr(lower(s_name), 1, CAST(s_suppkey % 18 AS INTEGER)) || substr(lower(s_name), CAST(s_suppkey % 18 AS INTEGER) + 2) FROM supplier)"""


def names(s, d):
    """Names of customers and suppliers, those of customers with one character changed, those of suppliers with one left out."""
    c, u = (fx.table(s, d, t).select(F.col(k).alias("key"), F.lower(n).alias("name")) for t, k, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name")))
    place = (F.col("key") % 18).cast("int")

    def edited(rows, between):
        return rows.withColumn("name", F.concat(F.substring("name", F.lit(1), place), F.lit(between), F.substring("name", place + 2, F.length("name"))))

    parts = [x.select((F.col("key") + i * 1_000_000_000).alias("id"), "name") for i, x in enumerate((c, u, edited(c, "x"), edited(u, "")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("j16_near_names", f"WITH {NAMES}, own AS (SELECT name, min(id) AS id FROM names GROUP BY name), p AS (SELECT a.id, b.id AS other_id, a.name AS x, b.name AS y FROM own a JOIN own b ON a.id < b.id WHERE levenshtein(a.name, b.name) <= len(a.name) + len(b.name) - 2 * ceil(0.45 * (len(a.name) + len(b.name)) - 1e-9)), s AS (SELECT id, other_id, {ratio_sql('x', 'y')} AS similarity FROM p) SELECT id, other_id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 90")
def j16d(s, d):
    return nm.near_names(names(s, d), 90.0).withColumn("similarity", F.round("similarity", 6))


@query("g6_dedupe_ranking", "WITH t AS (SELECT doc_id, text FROM documents WHERE doc_id = 0) SELECT d.doc_id AS document_id, CAST(1.0 AS DOUBLE) AS score, 'exact_sha256' AS reason FROM documents d JOIN t ON d.text = t.text AND d.doc_id <> t.doc_id ORDER BY 1")
def g6(s, d):
    """What a review shows of one document's duplicates."""
    return dedupe.candidates_of(files(s, d), 0)


PAYLOADS = f"WITH {SQL_VERIFIED}, {SQL_EXTRACTED}, v AS (SELECT * FROM fx_verified WHERE currency IS NOT NULL), x AS (SELECT extraction_document_id AS document_id, extraction_id, version AS created, CASE version WHEN 6 THEN NULL WHEN 5 THEN DATE '2024-02-29' ELSE DATE '2024-03-01' END AS d, CASE WHEN version = 4 THEN NULL ELSE 1200.50 + version END AS a, CASE WHEN version = 3 THEN NULL ELSE 'Shop ' || version END AS c FROM fx_extracted)"


@query("w11_precedence_fallback", PAYLOADS + ", y AS (SELECT document_id, extraction_id, created + 10 AS created, d, a, c FROM x WHERE d IS NOT NULL AND a IS NOT NULL AND c IS NOT NULL UNION ALL SELECT document_id, extraction_id, 0, DATE '2020-01-02', 7.00, 'Old' FROM x WHERE document_id % 2 = 0), e AS (SELECT document_id, arg_max(d, created) AS d, arg_max(a, created) AS a, arg_max(c, created) AS c FROM y GROUP BY 1) SELECT coalesce(v.document_id, e.document_id) AS document_id, CASE WHEN v.document_id IS NOT NULL THEN 'verified' ELSE 'extraction' END AS origin, CASE WHEN v.document_id IS NOT NULL THEN transaction_date ELSE e.d END AS transaction_date, CAST(CASE WHEN v.document_id IS NOT NULL THEN total_amount ELSE e.a END AS DOUBLE) AS total_amount, CASE WHEN v.document_id IS NOT NULL THEN counterparty ELSE e.c END AS counterparty FROM v FULL JOIN e ON v.document_id = e.document_id")
def w11(s, d):
    """Facts of each document: verified ones, else of the newest extraction that can be read; some payloads lack what is needed or write it loosely."""
    e = fx.extracted(s, d)
    n = F.col("version")
    day = F.when(n == 6, "30 February").when(n == 5, "2024-2-29").otherwise(" 2024-03-01 ")
    amount = F.when(n == 4, "n/a").otherwise(F.concat(F.lit("¥1,20"), n.cast("string"), F.lit(".50円")))
    name = F.when(n == 3, "  ").otherwise(F.concat(F.lit(" Shop "), n.cast("string")))
    new = F.to_json(F.struct(F.struct(day.alias("value")).alias("issue_date"), amount.alias("total_amount"), F.struct(name.alias("value"), F.lit(0.5).alias("confidence")).alias("counterparty")))
    rows = e.select(F.col("extraction_document_id").alias("document_id"), "extraction_id", (n + 10).alias("created"), new.alias("payload"))
    old = e.where("extraction_document_id % 2 = 0").select(F.col("extraction_document_id").alias("document_id"), "extraction_id", F.lit(0).alias("created"), F.lit('{"transaction_date": "2020-01-02", "amount": {"value": 7}, "issuer": "Old"}').alias("payload"))
    v = fx.verified(s, d).where("currency is not null")
    return dedupe.fingerprints(v, rows.unionByName(old)).withColumn("total_amount", F.col("total_amount").cast("double"))


@query("i16_flag_upsert", "WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id AS document_id, first AS other_id FROM c WHERE doc_id <> first) SELECT document_id, other_id, CASE WHEN document_id % 3 = 0 THEN 'fuzzy' ELSE 'exact_sha256' END AS reason, CASE WHEN document_id % 3 = 0 THEN 0.93::DOUBLE ELSE 1.0::DOUBLE END AS score, CASE WHEN document_id % 2 = 0 THEN 'update' ELSE 'insert' END AS action, CASE WHEN document_id % 3 = 0 THEN 2 ELSE 1 END AS writes FROM p UNION ALL SELECT -1, -2, 'old', 0.5, 'keep', 0")
def i16(s, d):
    """Pairs flagged before (even ids, and one that is not found again), a run over all copies, and a later run over a third of them."""
    pairs = dedupe.exact_matches(files(s, d))
    old = s.createDataFrame([(-1, -2, "old", 0.5)], "document_id long, other_id long, reason string, score double")
    flags = pairs.where("document_id % 2 = 0").select("document_id", "other_id", F.lit("old").alias("reason"), F.lit(0.5).alias("score")).unionByName(old)
    later = pairs.where("document_id % 3 = 0").select("document_id", "other_id", F.lit(0.93).alias("score"), F.lit("fuzzy").alias("reason"), F.lit(2).alias("run"))
    return dedupe.upsert_flags(flags, pairs.withColumn("run", F.lit(1)).unionByName(later))


@query("j20_uniqueness_conflicts", "WITH m AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS member_id, l_orderkey % 1000 AS cohort_id, l_orderkey % 7 AS document_id, l_orderkey % 25 AS issuer_id, CAST(date_trunc('month', min(l_shipdate) OVER (PARTITION BY l_orderkey, l_linenumber)) AS DATE) AS billing_period FROM lineitem), b AS (SELECT DISTINCT l_suppkey % 25 AS issuer_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS billing_period FROM lineitem WHERE l_suppkey % 2 = 0), t AS (SELECT *, count(*) OVER (PARTITION BY cohort_id, issuer_id, billing_period) > 1 AS twice FROM m) SELECT member_id, issuer_id, billing_period, CASE WHEN twice THEN 'duplicate_in_cohort' ELSE 'owned_elsewhere' END AS reason FROM t LEFT JOIN b USING (issuer_id, billing_period) WHERE twice OR b.issuer_id IS NOT NULL AND document_id <> 3")
def j20(s, d):
    """Members of cohorts whose issuer and month occur twice, or belong to a bill of another document (bills here are of document 3)."""
    lines = fx.table(s, d, "lineitem")
    month = F.to_date(F.trunc("l_shipdate", "month"))
    members = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(month).alias("billing_period")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("member_id"), (F.col("l_orderkey") % 1000).alias("cohort_id"), (F.col("l_orderkey") % 7).alias("document_id"), (F.col("l_orderkey") % 25).alias("issuer_id"), "billing_period")
    bills = lines.where("l_suppkey % 2 = 0").select((F.col("l_suppkey") % 25).alias("issuer_id"), month.alias("billing_period"), F.lit(3).cast("long").alias("document_id")).distinct()
    return review.period_conflicts(members, bills)
