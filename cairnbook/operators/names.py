"""Names alike: all pairs of a similarity of at least a bound, by an index instead of all comparisons.

The similarity of names of m and n characters is 200 * L / (m + n), L their longest common subsequence, so that a bound
asks for an L of at least least * (m + n) / 200.  Two ways find the candidates, each for the pairs of lengths where it is cheaper:

- few deletions: a name without any m - L of its characters.  Names with such a subsequence in common have one of these texts in
  common; used where a name has at most VARIANTS of them.  What meets this way is a result already.
- 2-grams: m - L characters that go and n - L that come leave at least 3L - m - n - 1 of the 2-grams (numbered where they repeat)
  in both names.  So of the first of them in any order that is the same for all, as many as may be lost and one more, one is common.
  The order has the most frequent ones last.

Pairs of lengths for which neither says anything (3L < m + n + 2, which for bounds above 67 are very short names) meet by lengths alone.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.functions.text import edits_within, similarity_of_edits
from cairnbook.sources.tables import stored

VARIANTS = 256
#: 2-grams whose frequency is known to the tasks; they come last, the most frequent at the end.
FREQUENT = 4096
#: The map of the shorter names' tokens; names of a task that writes tokens, and such tasks at most.
MAP_BITS, TASK, MOST_TASKS = 1 << 25, 4096, 2000


def needed(m: int, n: int, least: float) -> int:
    """The common subsequence that names of these lengths need."""
    return max(0, math.ceil(least * (m + n) / 200 - 1e-9))


def by_deletion(m: int, n: int, common: int) -> bool:
    return max(math.comb(m, m - common), math.comb(n, n - common)) <= VARIANTS


def partners(m: int, lengths: list[int], least: float) -> list[tuple[int, int]]:
    """Lengths that a name of m characters can be alike to, and the common subsequence needed."""
    return [(n, k) for n in lengths if (k := needed(m, n, least)) <= min(m, n)]


def grams(name: str) -> list[tuple[str, int]]:
    """2-grams, each with how often it came before."""
    seen: Counter = Counter()
    out = []
    for a, b in itertools.pairwise(name):
        out.append((a + b, seen[a + b]))
        seen[a + b] += 1
    return out


def tokens(name: str, lengths: list[int], least: float, frequent: dict[str, int], longer: bool) -> set[str]:
    """What a name is found by: two names alike have one of these in common, one as the shorter, one as the longer of the two.

    Those of names of one length, and the 2-grams, are the same on both sides and begin with =.
    """
    m, out, prefix = len(name), set(), 0
    for n, common in partners(m, lengths, least):
        low, high = sorted((m, n))
        deletion = by_deletion(m, n, common)
        if not deletion and 3 * common >= m + n + 2:
            prefix = max(prefix, 2 * (m - common) + (n - common) + 1)
        elif m == (high if longer else low):
            way = f"{'=' if m == n else ''}{'d' if deletion else 'l'}{low},{high}"
            out |= {f"{way}:{''.join(x)}" for x in itertools.combinations(name, common)} if deletion else {way}
    if prefix:
        order = sorted(grams(name), key=lambda g: (frequent.get(g[0], 0), g))
        out |= {f"=g{k}:{g}" for g, k in order[:prefix]}
    return out


def place(token: str) -> int:
    """The bit of a token in the map of the shorter names' tokens."""
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % MAP_BITS


def near_names(names: DataFrame, least: float, seen: Observation | None = None) -> DataFrame:
    """id, other_id, similarity (0 to 100): pairs of different names at least so much alike, each name under its smallest id.

    names: id long, name string (compared as it is; normalise it before).  Null names take no part; equal names are one (a class, not
    pairs); empty names are alike to none.  seen: gets names and scored (pairs whose similarity was computed).  Distinct lengths of
    names, FREQUENT 2-grams and a map of MAP_BITS bits reach the driver: a longer name is found only by texts that some shorter one has.
    A pair that meets several times is scored each time, and only its ids and similarity are shuffled again.
    """
    own = stored(names.where("name is not null").groupBy("name").agg(F.min("id").alias("id")), "names").withColumn("size", F.length("name"))
    lengths = sorted(r["size"] for r in own.select("size").distinct().collect())
    pairs_of = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.col("size") - 1, F.lit(1))), lambda i: F.substring("name", i, F.lit(2)))).alias("gram"))
    frequent = {r["gram"]: r["n"] for r in pairs_of.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(FREQUENT).collect()}
    own = own.repartition(max(1, min(MOST_TASKS, -(-own.count() // TASK))))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def as_shorter(some: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in some:
            yield s.map(lambda v: sorted(tokens(v, lengths, least, frequent, False)))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def places(some: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in some:
            yield s.map(lambda v: [place(x) for x in tokens(v, lengths, least, frequent, False) if x[0] != "="])

    # a word of 32 bits a row
    words = own.select(F.explode(places("name")).alias("p")).groupBy(F.shiftright("p", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 31))")).alias("bits"))
    words = words.toArrow()
    known = np.zeros(MAP_BITS // 32, np.uint32)
    known[words["word"].to_numpy()] = words["bits"].to_numpy()

    def held(token: str) -> bool:
        at = place(token)
        return bool(known[at >> 5] >> (at & 31) & 1)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def as_longer(some: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in some:
            yield s.map(lambda v: sorted(x for x in tokens(v, lengths, least, frequent, True) if x[0] == "=" or held(x)))

    # the last bit says that both names stand on both sides
    key = F.xxhash64("token").bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(F.startswith("token", F.lit("=")).cast("long"))
    found, other = (own.select("id", "name", F.explode(f("name")).alias("token")).withColumn("token", key) for f in (as_shorter, as_longer))
    met = found.join(other.select(F.col("id").alias("other_id"), F.col("name").alias("other"), "token"), "token").where("(token & 1) = 0 or id < other_id")
    m, n = F.length("name"), F.length("other")
    fits = 200.0 * F.least(m, n) >= least * (m + n)
    # changes of single characters are no more than insertions and deletions: a bounded look in the JVM leaves few to score
    changes = m + n - 2 * F.ceil(least * (m + n) / 200 - 1e-9)
    met = met.where(fits).select("id", "other_id", "name", "other", F.explode(edits_within(F.col("name"), F.col("other"), changes)).alias("edits"))
    if seen is not None:
        met = met.observe(seen, F.count("*").alias("scored"))
    alike = met.withColumn("similarity", similarity_of_edits(F.col("name"), F.col("other"), F.col("edits"))).where(F.col("similarity") >= least)
    return alike.select(F.least("id", "other_id").alias("id"), F.greatest("id", "other_id").alias("other_id"), "similarity").distinct()
