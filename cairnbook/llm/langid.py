"""Language identification by Bayesian evidence fusion (operator 9).

The posterior of a language is proportional to

    prior(language | host) * P(text | language) * P(declared language | language) * P(address suffix | language)

- text: naive Bayes over letter trigrams of UTF-8 bytes (A-Z lowered, other ASCII read as space), hashed to
  BUCKETS, counted over all labelled texts; the mean log likelihood counts as STRENGTH trigrams at most.  A
  further class, "und", has the same probability for every bucket.
- declared language (the markup's lang attribute) and address suffix (top-level domain and a two-letter first
  path segment): how often each value goes with each language, taken from the table itself.
- host: prior smoothed from host to its domain to all pages, taken from the table itself.

"How often" uses each page's best language by text; a page's own vote is taken out of what it is judged by.
Counts per value are aggregated before they are joined back, one row per value, so that a host with
a third of all pages is neither gathered nor cross joined.

Page texts are the whole page without tags, comments, scripts and styles; character references stand for their
characters.

Cases: a null or empty text, or one without letters, has no text evidence; a null declared language, address
or host gives no evidence of its kind; without any labelled text every page is "und".  A row is accepted if its
best language is not "und", its posterior reaches LEAST and it has text evidence.
"""

from __future__ import annotations

from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.llm import words
from cairnbook.llm.shared import documents, stored, trimmed

BUCKETS, STRENGTH, SMOOTH, LEAST, HELD = 1 << 15, 40, 20.0, 0.6, 64
UNKNOWN = "und"

_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
PIECE = 1 << 19


def _trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte but the last two, and whether it counts (its middle is a letter)."""
    c = _CLASS[data]
    a, b, d = c[:-2], c[1:-1], c[2:]
    bucket = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + d * np.uint32(0xC2B2AE3D)) >> np.uint32(17)
    return bucket, b != 32


def _pieces(column):
    """(first row, last row + 1, offsets, bytes) of runs of rows of about PIECE bytes."""
    offs, raw = words.text_buffers(column)
    row, n = 0, len(offs) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + PIECE, side="right")) - 1)
        yield row, to, offs[row : to + 1] - offs[row], raw[offs[row] : offs[to]]
        row = to


def _sums(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the summed table columns over its trigrams, (rows, classes), and their number."""
    n, classes = len(offs) - 1, table.shape[1]
    out, count = np.zeros((n, classes)), np.zeros(n)
    if len(data) < 3:
        return out, count
    bucket, good = _trigrams(data)
    edge = offs[1:-1]
    for back in (1, 2):
        at = edge - back
        good[at[(at >= 0) & (at < len(good))]] = False
    where = np.flatnonzero(good)
    to = np.searchsorted(where, offs)
    some = np.flatnonzero(np.diff(to))
    if len(some):
        out[some] = np.add.reduceat(table[bucket[where]], to[some], axis=0)
        count[some] = np.diff(to)[some]
    return out, count


class TextModel:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: (languages, BUCKETS)."""
        self.languages = [*languages, UNKNOWN]
        self.table = np.full((BUCKETS, len(languages) + 1), np.log(1 / BUCKETS), np.float32)
        for i in range(len(languages)):
            self.table[:, i] = np.log((counts[i] + 0.5) / (counts[i].sum() + 0.5 * BUCKETS))


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> TextModel:
    """Trigram counts of all texts by language; at most BUCKETS numbers of each language reach the driver.

    A task holds the counts of HELD languages and of those of one piece at a time.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.col(lang_col) != UNKNOWN)).select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())

    def run(batches):
        number = {lang: i for i, lang in enumerate(languages)}
        total = {}

        def flush():
            for i, of in total.items():
                some = np.flatnonzero(of)
                yield pa.RecordBatch.from_arrays([pa.array(some + i * BUCKETS), pa.array(of[some])], ["cell", "n"])
            total.clear()

        for batch in trimmed(batches):
            own = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, to, offs, data in _pieces(batch.column("text")):
                if len(data) < 3:
                    continue
                bucket, good = _trigrams(data)
                there, which = np.unique(own[first:to], return_inverse=True)
                which = np.repeat(which, np.diff(offs))[1:-1]
                bucket, which = bucket[good], which[good]
                for at in range(0, len(there), HELD):
                    some = there[at : at + HELD]
                    mine = (which >= at) & (which < at + HELD)
                    got = np.bincount((which[mine] - at) * BUCKETS + bucket[mine], minlength=len(some) * BUCKETS).reshape(len(some), BUCKETS)
                    for i, of in zip(some.tolist(), got, strict=True):
                        if i in total:
                            total[i] += of
                        else:
                            total[i] = of.copy()
                    if len(total) > HELD:
                        yield from flush()
        yield from flush()

    got = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow() if languages else None
    counts = np.zeros(len(languages) * BUCKETS, np.int64)
    if got is not None:
        counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    return TextModel(languages, counts.reshape(len(languages), BUCKETS))


def text_evidence(df: DataFrame, model: TextModel, text_col: str = "text", keep_text: bool = False, entities: bool = False) -> DataFrame:
    """df's other columns with text_n (trigrams) and text_logs (log likelihood of each language; zeros without text).

    text_col may name a field of a struct column, which then stays.  entities: character references stand for their characters.
    """
    shared = df.sparkSession.sparkContext.broadcast(model.table)
    outer, _, field = text_col.partition(".")
    kept = [c for c in df.columns if field or keep_text or c != outer]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema.add("text_n", T.LongType()).add("text_logs", T.ArrayType(T.DoubleType()))

    def run(batches):
        table = shared.value
        for batch in trimmed(batches):
            logs, number = [], []
            text = batch.column(outer).field(field) if field else batch.column(outer)
            if entities:
                text = pa.array([unescape(t) if t and "&" in t else t for t in text.to_pylist()], pa.large_string())
            for _, _, offs, data in _pieces(text):
                sums, count = _sums(data, offs, table)
                logs.append(sums / np.maximum(count, 1)[:, None] * np.minimum(count, STRENGTH)[:, None])
                number.append(count)
            flat = np.concatenate(logs) if logs else np.zeros((0, table.shape[1]))
            offsets = pa.array(np.arange(len(flat) + 1) * table.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(np.concatenate(number).astype(np.int64) if number else [], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat.reshape(-1)))], [*kept, "text_n", "text_logs"])

    return df.mapInArrow(run, schema)


def _best(logs: Column) -> Column:
    """Place of the largest number, the first of equals."""
    return F.array_position(logs, F.array_max(logs)).cast("int") - 1


def _counted(df: DataFrame, key: str, classes: int, name: str) -> DataFrame:
    """Votes of each value of key by language; votes of rows without text evidence do not count."""
    votes = F.array(*[F.count_if((F.col("vote") == i) & (F.col("text_n") > 0)).cast("double") for i in range(classes)])
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{name}_key")).agg(votes.alias(name))


def _less_own(counts: Column, classes: int) -> Column:
    """Counts without the row's own vote."""
    own = F.when(F.col("text_n") > 0, F.col("vote")).otherwise(-1)
    return F.transform(counts, lambda x, i: F.greatest(F.lit(0.0), x - F.when(i == own, 1.0).otherwise(0.0)))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def fuse(rows: DataFrame, languages: list[str], keys: dict[str, str | None], voters: DataFrame | None = None) -> DataFrame:
    """rows (with text_n, text_logs) plus lang, posterior and accepted.

    voters: the same rows without what is not needed to count them (default: rows).

    keys: names of the columns with the declared language, suffix, host and domain (None: no such evidence).
    """
    classes = len(languages)
    rows, voters = (x.withColumn("vote", _best(F.col("text_logs"))) for x in (rows, rows if voters is None else voters))
    every = voters.where("text_n > 0").groupBy().agg(F.array(*[F.count_if(F.col("vote") == i).cast("double") for i in range(classes)]).alias("all_")).first()[0]
    base = (np.array(every) + 1) / (sum(every) + classes)
    logs = F.col("text_logs")
    for name in ("declared", "suffix"):
        if key := keys.get(name):
            counts = stored(_counted(voters, key, classes, name), "lang-counts")
            rows = rows.join(counts, rows[key] == F.col(f"{name}_key"), "left")
            value = _less_own(F.col(name), classes)
            # P(value | language), smoothed to the value's share over all languages
            share = (_total(value) + 1.0) / (float(sum(every)) + 2.0)
            sizes = F.array(*[F.lit(float(x)) for x in every])
            chance = F.zip_with(value, sizes, lambda x, n: F.log((x + SMOOTH * share) / (n + SMOOTH)))
            rows = rows.withColumn(f"{name}_logs", F.when(F.col(name).isNotNull(), chance).otherwise(F.array(*[F.lit(0.0)] * classes)))
            logs = F.zip_with(logs, F.col(f"{name}_logs"), lambda a, b: a + b)
    prior = F.array(*[F.lit(float(x)) for x in base])
    for name in ("domain", "host"):
        if key := keys.get(name):
            counts = stored(_counted(voters, key, classes, name), "lang-counts")
            rows = rows.join(counts, rows[key] == F.col(f"{name}_key"), "left")
            value = _less_own(F.col(name), classes)
            n = _total(value)
            smoothed = F.zip_with(value, prior, lambda x, p: (x + SMOOTH * p) / (n + SMOOTH))
            rows = rows.withColumn(f"{name}_prior", F.when(F.col(name).isNotNull(), smoothed).otherwise(prior))
            prior = F.col(f"{name}_prior")
    rows = rows.withColumn("logs", F.zip_with(logs, prior, lambda a, p: a + F.log(p)))
    top = F.array_max("logs")
    names = F.array(*[F.lit(x) for x in languages])
    return (
        rows.withColumn("posterior", F.lit(1.0) / _total(F.transform("logs", lambda x: F.exp(x - top))))
        .withColumn("lang", F.element_at(names, _best(F.col("logs")) + 1))
        .withColumn("accepted", (F.col("text_n") > 0) & (F.col("lang") != UNKNOWN) & (F.col("posterior") >= LEAST))
    )


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, text without markup, and the declared language, suffix, host and domain."""
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.lower(F.col(url_col))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.nullif(F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://([^/?#:@]+)", 1), F.lit(""))
    segment = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/]+/([a-z]{2})(?:[/?#]|$)", 1)
    declared = F.lower(F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,8})", 1), F.lit("")))
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), bare.alias("text"), declared.alias("declared_lang"), F.when(host.isNotNull(), F.concat_ws("/", F.substring_index(host, ".", -1), segment)).alias("address"), host.alias("host_name"), F.substring_index(host, ".", -2).alias("domain_name"),
    )


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    rows = stored(text_evidence(page_evidence(pages), model, entities=True), "lang-pages")
    return fuse(rows, model.languages, {"declared": "declared_lang", "suffix": "address", "host": "host_name", "domain": "domain_name"})


def identify_documents(docs: DataFrame, model: TextModel) -> DataFrame:
    """row (all columns of docs), lang_found, posterior and accepted; the source stands for the host, the given language for the declared one.

    The texts are read twice: once to count by language and source, once to judge; they are not shuffled
    unless the counts are too many to be sent to all tasks.
    """
    declared, source = F.col("lang").cast("string").alias("declared_lang"), F.col("source").cast("string").alias("host_name")
    voters = stored(text_evidence(docs.select(declared, source, "text"), model), "lang-votes")
    rows = text_evidence(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), declared, source), model, "row.text")
    return fuse(rows, model.languages, {"declared": "declared_lang", "host": "host_name"}, voters).select("row", F.col("lang").alias("lang_found"), "posterior", "accepted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(documents(spark, sf_dir))
    found = identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)
    names = F.array(*[F.lit(x) for x in model.languages])
    return found.select("page_id", "lang", F.round("posterior", 6).alias("posterior"), F.element_at(names, F.col("vote") + 1).alias("text_lang"), F.col("declared_lang"), F.col("address"), "host_name", F.col("text_n").alias("n_trigrams"), "accepted")
