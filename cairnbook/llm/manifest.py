"""Merkle dataset manifest by superblock reduction (operator 11).

Every row is a leaf: H, the lowercase hex sha256, of its columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and
its value.  The leaves of one source ascend by id; while several nodes remain, every FAN consecutive ones become the H of
their hex digests (the last run may hold fewer, even one).  What remains is the source's subroot; the subroots, ordered by
source (null first, then bytewise), are reduced alike to the root.

Rows are numbered inside their source by ranges of (source, id) and the sizes of the ranges before.  A superblock is
index div FAN**LEVELS: one group of at most FAN**LEVELS nodes whatever the source holds, so that a hot source is many groups.
``applyInPandas`` collapses LEVELS levels of a superblock to one node; the superblocks' nodes are the leaves of the next
round, until each source has one.  Going down again, a node's proof is that inside its superblock followed by that of
its superblock, which a cogroup brings once for each superblock, not for each row.

Cases: null columns are ``-``; a null id comes first in its source and is never tampered with; rows of one id are ordered by leaf,
and rows alike in all columns are leaves each, in any order; an empty text has byte count 0; a source of one row has its leaf as
subroot; one source alone has its subroot as root; an empty table gives no rows; columns besides those named take no part.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnbook.llm.shared import documents, id_remainder, shuffle_partitions, stored

FAN, LEVELS, EVERY = 16, 3, 5
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALL = "="


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(col: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(df: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", every: int = EVERY) -> DataFrame:
    """(key, id, leaf, tampered): tampered is the leaf with the text's A-Z lowered, for ids whose crc32 is divisible by every, else null.

    key orders as the group does and is never null.
    """

    def digest(change):
        return F.sha2(F.concat(*[encoded(change(F.col(f"`{c}`")) if c == text_col else F.col(f"`{c}`")) for c in columns]), 256)

    changed = F.when(id_remainder(F.col(f"`{id_col}`").cast("long"), every) == 0, digest(lambda c: F.translate(c, UPPER, LOWER)))
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("-"))
    return df.select(key.alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"), digest(lambda c: c).alias("leaf"), changed.alias("tampered"))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their index i inside their key, in the given order, and the key's size."""
    by = [F.col("key"), *order, F.rand(11)]  # the last one deals rows alike in all columns over tasks
    placed = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by[:-1]).withColumn("at", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("task", F.shiftright("at", 33)), "manifest-rows")
    runs = placed.groupBy("task", "key").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("key")
    before = F.coalesce(F.sum("n").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("task", "key", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    return placed.join(runs, ["task", "key"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "shift", "task")


def collapse(nodes: list[str], size: int, fan: int, levels: int) -> list[list[str]]:
    """Levels of one superblock from its nodes up: so many as it has, or fewer where its source, of size nodes, has no more."""
    out = [nodes]
    while len(out) <= levels and size > 1:
        out.append([H("".join(out[-1][a : a + fan])) for a in range(0, len(out[-1]), fan)])
        size = -(-size // fan)
    return out


def beside(level: list[str], fan: int) -> list[tuple[str, str]]:
    """What stands before and after each node in its run."""
    out = []
    for a in range(0, len(level), fan):
        run = level[a : a + fan]
        out += [("".join(run[:j]), "".join(run[j + 1 :])) for j in range(len(run))]
    return out


def lower_proofs(levels: list[list[str]], fan: int) -> list[tuple[list[str], list[str]]]:
    """Of each node of a superblock the texts before and after its path, level by level, below the superblock's node."""
    proofs: list[tuple[list[str], list[str]]] = [([], [])] * len(levels[-1])
    for level in reversed(levels[:-1]):
        proofs = [([b, *proofs[j // fan][0]], [a, *proofs[j // fan][1]]) for j, (b, a) in enumerate(beside(level, fan))]
    return proofs


def rise(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """Rounds of superblock reduction of (key, i, size, hash), the nodes first; in the last one each key has one node."""
    wide, rounds = fan**levels, [nodes]

    def roots(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        size = int(pdf["size"].iloc[0])
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "i": pdf["i"].iloc[:1] // wide, "size": -(-size // wide), "hash": [collapse(pdf["hash"].tolist(), size, fan, levels)[-1][0]]})

    while rounds[-1].where("size > 1").limit(1).count():
        below = rounds[-1].select("key", "i", "size", "hash", F.floor(F.col("i") / wide).alias("block"))
        rounds.append(stored(below.groupBy("key", "block").applyInPandas(roots, "key string, i long, size long, hash string"), "manifest-blocks"))
    return rounds


def descend(rounds: list[DataFrame], proofs: DataFrame, fan: int, levels: int) -> DataFrame:
    """(key, i, before, after) of the nodes of the first round; proofs: those of the last one."""
    wide = fan**levels

    def prove(below: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        below = below.sort_values("i")
        own = lower_proofs(collapse(below["hash"].tolist(), int(below["size"].iloc[0]), fan, levels), fan)
        up = [list(above[c].iloc[0]) for c in ("before", "after")]
        return pd.DataFrame({"key": below["key"], "i": below["i"], "before": [b + up[0] for b, _ in own], "after": [a + up[1] for _, a in own]})

    for nodes in reversed(rounds[:-1]):
        below = nodes.select("key", "i", "size", "hash", F.floor(F.col("i") / wide).alias("block")).groupBy("key", "block")
        found = below.cogroup(proofs.withColumnRenamed("i", "block").groupBy("key", "block")).applyInPandas(prove, "key string, i long, before array<string>, after array<string>")
        proofs = stored(found, "manifest-proofs")
    return proofs


def manifest(leaf: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """One row per leaf (key, id, leaf, tampered): id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    wide = fan**levels
    base = stored(numbered(leaf, F.col("id").asc_nulls_first(), F.col("leaf")).withColumnRenamed("leaf", "hash"), "manifest-leaves")
    rounds = rise(base, fan, levels)
    subroots = rounds[-1].select("key", F.col("hash").alias("subroot"))
    # the subroots are the leaves of one more tree, whose only key is _ALL
    top = stored(numbered(subroots.select(F.lit(_ALL).alias("key"), F.col("key").alias("of"), F.col("subroot").alias("hash")), F.col("of")), "manifest-subroots")
    over = rise(top, fan, levels)
    root = over[-1].select("i", F.col("hash").alias("root"))
    none = F.array().cast("array<string>")
    upper = descend(over, over[-1].select("key", "i", none.alias("before"), none.alias("after")), fan, levels)
    of = top.select("i", F.col("of").alias("key"), F.col("hash").alias("subroot"))
    ends = upper.drop("key").join(of, "i").select("key", F.lit(0).cast("long").alias("i"), "before", "after")
    if len(rounds) > 1:
        ends = descend(rounds[1:], ends, fan, levels)
    roots = of.withColumn("zero", F.lit(0).cast("long")).join(root.withColumnRenamed("i", "zero"), "zero").select("key", "subroot", "root")
    ends = ends.join(roots, "key").withColumnRenamed("i", "block")

    def result(below: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        below = below.sort_values("i")
        nodes, one = below["hash"].tolist(), above.iloc[0]
        up_before, up_after = list(one["before"]), list(one["after"])
        up_text = "".join(b + a for b, a in zip(up_before, up_after, strict=True))
        proof, folded = [], []
        own = lower_proofs(collapse(nodes, int(below["size"].iloc[0]), fan, levels), fan)
        for node, changed, (before, after) in zip(nodes, below["tampered"], own, strict=True):
            proof.append(H("".join(b + a for b, a in zip(before, after, strict=True)) + up_text))
            at = changed if isinstance(changed, str) else node
            for b, a in zip(before + up_before, after + up_after, strict=True):
                at = H(b + at + a)
            folded.append(at)
        out = pd.DataFrame({"id": below["id"], "leaf": nodes, "subroot": one["subroot"], "root": one["root"], "proof_sha256": proof, "folded_root": folded})
        return out.assign(verified=out["folded_root"] == one["root"])

    # ids pass as text, as pandas would turn a group with a null into floats
    below = base.select("key", F.col("id").cast("string").alias("id"), "hash", "tampered", "size", "i", F.floor(F.col("i") / wide).alias("block")).groupBy("key", "block")
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return below.cogroup(ends.groupBy("key", "block")).applyInPandas(result, schema).withColumn("id", F.col("id").cast("long"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(leaves(documents(spark, sf_dir))).withColumnRenamed("id", "doc_id")


_ENCODED = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in COLUMNS)
_TAMPERED = _ENCODED.replace("CAST(text AS VARCHAR)", f"translate(text, '{UPPER}', '{LOWER}')")
_CRC32 = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
  lambda crc, c: list_reduce(list_value(0, 1, 2, 3, 4, 5, 6, 7), lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, c)), 4294967295), 4294967295)"""


def _tree(name: str, of: str) -> str:
    """Recursive CTE of a tree over of(g, i, n, h): level, group, index, nodes of the level, hash."""
    return f"""{name}(lv, g, i, n, h) AS (SELECT 0, g, i, n, h FROM {of} UNION ALL
  SELECT lv + 1, g, i // {FAN}, max((n + {FAN - 1}) // {FAN}), sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY lv, g, i // {FAN})"""


#: Level by level over all nodes, without superblocks.
OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '-') AS g, sha256({_ENCODED}) AS leaf, CASE WHEN {_CRC32} % {EVERY} = 0 THEN sha256({_TAMPERED}) END AS changed FROM documents),
e AS (SELECT *, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS k, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
leaves AS (SELECT g, i, n, leaf AS h FROM e), {_tree("low", "leaves")},
tops AS (SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h, g AS source FROM low WHERE n = 1), {_tree("high", "tops")},
place AS (SELECT e.*, t.i AS ti, t.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root FROM e JOIN tops t ON t.source = e.g),
sides AS (
  SELECT k, lv AS s, string_agg(h, '' ORDER BY x) FILTER (x < own) AS before, string_agg(h, '' ORDER BY x) FILTER (x > own) AS after
  FROM (SELECT p.k, t.lv, t.h, t.i AS x, p.i // CAST(pow({FAN}, t.lv) AS BIGINT) AS own FROM place p JOIN low t ON t.g = p.g AND t.n > 1 AND t.i // {FAN} = p.i // CAST(pow({FAN}, t.lv + 1) AS BIGINT)) GROUP BY k, lv
  UNION ALL
  SELECT k, 100 + lv, string_agg(h, '' ORDER BY x) FILTER (x < own), string_agg(h, '' ORDER BY x) FILTER (x > own)
  FROM (SELECT p.k, t.lv, t.h, t.i AS x, p.ti // CAST(pow({FAN}, t.lv) AS BIGINT) AS own FROM place p JOIN high t ON t.n > 1 AND t.i // {FAN} = p.ti // CAST(pow({FAN}, t.lv + 1) AS BIGINT)) GROUP BY k, lv),
steps AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY s) AS s, coalesce(before, '') AS before, coalesce(after, '') AS after FROM sides),
proofs AS (SELECT k, sha256(string_agg(before || after, '' ORDER BY s)) AS proof, max(s) AS last FROM steps GROUP BY k),
fold(k, s, h) AS (SELECT k, CAST(0 AS BIGINT), coalesce(changed, leaf) FROM e UNION ALL SELECT f.k, t.s, sha256(t.before || f.h || t.after) FROM fold f JOIN steps t ON t.k = f.k AND t.s = f.s + 1)
SELECT p.doc_id, p.leaf, p.subroot, p.root, coalesce(q.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = p.root AS verified
FROM place p LEFT JOIN proofs q ON q.k = p.k JOIN fold f ON f.k = p.k AND f.s = coalesce(q.last, 0)
"""
