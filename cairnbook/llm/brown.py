"""Brown class-based bigram language model (operator 10).

The classes begin with exchange clustering (at most SWEEPS sweeps) over the bigram counts, of all training
texts, of the TOP most frequent words and of the other words' endings, dealt to ENDINGS groups.  Then every
other word seen SEEN times or more is inserted into the class that its own neighbours' classes make most likely:
their number grows with the corpus.  Words seen less often, and unseen ones, have the class of their ending.
The text's probability is the product over tokens of

    LAMBDA * P(class | class before) * (c + 1) / D(class)  +  (1 - LAMBDA) * (c + 1) / (N + V + 1)

with c the token's training count, D(class) = tokens + types (+ 1 for unseen words) of the class,
N training tokens and V their types.  As c + 1 is a factor of both terms, only sum(log10(c + 1)) of
a document needs the words' counts; the rest needs classes.  Counts and classes of frequent words (at most
FREQUENT) are sent to all tasks; those of all other words are joined by the word's 64-bit hash.

Cases: a null text is empty and has the end token alone; a null id is a training row; without
training rows every count is 0.  Repeated rows are scored each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.llm import words
from cairnbook.llm.shared import documents, id_remainder, stored, trimmed

TOP, ENDINGS, CLASSES, FREQUENT = 512, 256, 64, 1 << 18
LAMBDA, SWEEPS, SEEN = 0.95, 4, 2
HOLD_MOD, HOLD = 7, 2


def _endings(chunk: words.Words) -> np.ndarray:
    """Group of each word by its last two bytes, 0 .. ENDINGS - 1."""
    last = chunk.data[chunk.ends - 1].astype(np.uint64)
    before = chunk.data[np.maximum(chunk.ends - 2, chunk.starts)].astype(np.uint64)
    low = np.where((last >= 65) & (last <= 90), last + np.uint64(32), last)
    lower = np.where((before >= 65) & (before <= 90), before + np.uint64(32), before)
    return (words.mix(low * np.uint64(257) + lower) % np.uint64(ENDINGS)).astype(np.int64)


def word_counts(train: DataFrame) -> DataFrame:
    """(h, ending, c) of all words of a text column: counted per some MB of text, then summed by key."""

    def run(batches):
        hashes, endings, held = [], [], 0

        def flush():
            h, first, c = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
            e = np.concatenate(endings)[first]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(e.astype(np.int16)), pa.array(c.astype(np.int64))], ["h", "ending", "c"])

        for batch in trimmed(batches):
            for chunk in words.chunks(batch.column(0)):
                hashes.append(chunk.hashes)
                endings.append(_endings(chunk).astype(np.int16))
                held += len(chunk.hashes)
                if held > 3_000_000:
                    yield flush()
                    hashes, endings, held = [], [], 0
        if held:
            yield flush()

    return train.mapInArrow(run, "h long, ending short, c long").groupBy("h", "ending").agg(F.sum("c").alias("c"))


class Lexicon:
    """Frequent words: sorted hashes, counts, the item of each (-1: by its ending), and its class once known (-1: by its item)."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.items = np.full(len(hashes), -1, np.int64)
        best = np.lexsort((self.hashes, -self.counts))[:TOP]
        self.items[best] = np.arange(1, len(best) + 1)
        self.classes = np.full(len(hashes), -1, np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def item(self, hashes: np.ndarray, endings: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        own = self.items[at] if len(self.items) else np.full(len(hashes), -1)
        return np.where(there & (own >= 0), own, 1 + TOP + endings)

    def class_(self, at: np.ndarray, there: np.ndarray, of_item: np.ndarray) -> np.ndarray:
        own = self.classes[at] if len(self.classes) else np.full(len(at), -1)
        return np.where(there & (own >= 0), own, of_item)


N_ITEMS = 1 + TOP + ENDINGS  # item 0 is the end of a text


def _distinct(chunk: words.Words, lexicon: Lexicon):
    """Distinct hashes of a chunk, each word's index into them, and of each: place in the lexicon, whether there, item."""
    distinct, first, index = np.unique(chunk.hashes, return_index=True, return_inverse=True)
    at, there = lexicon.find(distinct)
    some = words.Words(0, chunk.counts, distinct, chunk.starts[first], chunk.ends[first], chunk.data)
    return distinct, index, at, there, lexicon.item(distinct, _endings(some), at, there)


def _before_after(items: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of consecutive texts with an end (item 0) after each: before, token, and first token of each text."""
    sizes = counts + 1
    begins = np.cumsum(sizes) - sizes
    tokens = np.zeros(int(sizes.sum()), np.int64)
    tokens[np.arange(len(items)) + np.repeat(np.arange(len(counts)), counts)] = items
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    if len(begins):
        before[begins] = 0
    return before, tokens, begins


def bigram_counts(train: DataFrame, lexicon) -> np.ndarray:
    """Item bigrams of all training texts; at most N_ITEMS squared numbers reach the driver."""

    def run(batches):
        total = np.zeros(N_ITEMS * N_ITEMS, np.int64)
        for batch in trimmed(batches):
            for chunk in words.chunks(batch.column(0)):
                _, index, _, _, item = _distinct(chunk, lexicon.value)
                before, tokens, _ = _before_after(item[index], chunk.counts)
                total += np.bincount(before * N_ITEMS + tokens, minlength=len(total))
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["cell", "n"])

    got = train.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(N_ITEMS * N_ITEMS)
    matrix[got["cell"].to_numpy()] = got["n"].to_numpy()
    return matrix.reshape(N_ITEMS, N_ITEMS)


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(matrix: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Exchange clustering: move each item to the class that raises the bigram likelihood most, until nothing moves or for so many sweeps.

    Item 0 keeps class 0 alone.  Items never seen get the last class.
    """
    n = len(matrix)
    weight = matrix.sum(0)
    order = np.argsort(-weight[1:], kind="stable") + 1
    label = np.zeros(n, np.int64)
    label[order] = 1 + np.arange(n - 1) % (classes - 1)
    label[1:][weight[1:] == 0] = classes - 1
    one = np.zeros((n, classes))
    one[np.arange(n), label] = 1
    cells = one.T @ matrix @ one
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if weight[w] == 0:
                break
            out, into, self_ = matrix[w] @ one, matrix[:, w] @ one, matrix[w, w]
            old = label[w]
            out[old] -= self_
            into[old] -= self_
            cells[old] -= out
            cells[:, old] -= into
            cells[old, old] -= self_
            # likelihood change of putting w into each class g: cells (g, j) gain out_j, (j, g) gain into_j, (g, g) both and w-w
            flat = _entropy(cells)
            gain = (_entropy(cells + out) - flat).sum(1) + (_entropy(cells.T + into) - flat.T).sum(1)
            diagonal = np.diagonal(cells)
            gain += _entropy(diagonal + out + into + self_) - _entropy(diagonal + out) - _entropy(diagonal + into) + _entropy(diagonal)
            left, right = cells.sum(1), cells.sum(0)
            gain -= _entropy(left + out.sum() + self_) - _entropy(left) + _entropy(right + into.sum() + self_) - _entropy(right)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            cells[new] += out
            cells[:, new] += into
            cells[new, new] += self_
            if new != old:
                moved += 1
                one[w, old], one[w, new], label[w] = 0, 1, new
        if not moved:
            break
    return label


def contexts(train: DataFrame, lexicon, label: np.ndarray, whole: bool) -> DataFrame:
    """(h, code, n) of all words but the TOP: code is the class before, or CLASSES + the class after, plus 2 * CLASSES * the ending's class.

    whole: the lexicon has all words that will be placed, so others are left out at once.
    """

    def run(batches):
        held, size = [], 0

        def flush():
            h, code, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((code, h))
            h, code, n = h[order], code[order], n[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (code[1:] != code[:-1])])
            return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(code[first].astype(np.int16)), pa.array(np.add.reduceat(n, first))], ["h", "code", "n"])

        for batch in trimmed(batches):
            for chunk in words.chunks(batch.column(0)):
                if not len(chunk.hashes):
                    continue
                distinct, index, _, there, item = _distinct(chunk, lexicon.value)
                before, tokens, _ = _before_after(label[item][index], chunk.counts)
                at = np.arange(len(index)) + np.repeat(np.arange(len(chunk.counts)), chunk.counts)
                some = np.flatnonzero(((item > TOP) & (there | (not whole)))[index])
                if not len(some):
                    continue
                key = index[some] * (2 * CLASSES)
                key, n = np.unique(np.concatenate((key + before[at[some]], key + CLASSES + tokens[at[some] + 1])), return_counts=True)
                which, code = np.divmod(key, 2 * CLASSES)
                held.append((distinct[which], code + 2 * CLASSES * label[item[which]], n.astype(np.int64)))
                size += len(n)
                if size > 3_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return train.mapInArrow(run, "h long, code short, n long").groupBy("h", "code").agg(F.sum("n").alias("n"))


def insert(cells: np.ndarray, sizes: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Class of each word that raises the bigram likelihood most, when it is taken out of its ending's class; sizes: its entries of (code, n)."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    side, old = code % (2 * CLASSES), code // (2 * CLASSES)
    row = np.concatenate((cells, cells.T))  # class i before: cells (i, g); class j after: cells (g, j)
    without = row[side]
    place = np.arange(len(code))
    without[place, old] = np.maximum(without[place, old] - n, 0)
    gain = np.add.reduceat(_entropy(without + n[:, None]) - _entropy(without), first, axis=0)
    count = np.add.reduceat(np.where(side < CLASSES, n, 0), first).astype(float)
    mine, each = old[first], np.arange(len(sizes))
    for total in (cells.sum(1), cells.sum(0)):
        rest = np.tile(total, (len(sizes), 1))
        rest[each, mine] = np.maximum(rest[each, mine] - count, 0)
        gain -= _entropy(rest + count[:, None]) - _entropy(rest)
    gain[:, 0] = -np.inf
    return np.argmax(gain, 1)


def placed(found: DataFrame, cells: np.ndarray) -> DataFrame:
    """(h, cls) of all words of contexts() seen SEEN times or more; a word has at most 2 * CLASSES entries."""

    def run(batches):
        for batch in trimmed(batches):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                entries = part.column("x").flatten()
                sizes = part.column("x").value_lengths().to_numpy().astype(np.int64)
                cls = insert(cells, sizes, entries.field(0).to_numpy().astype(np.int64), entries.field(1).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("h"), pa.array(cls.astype(np.int16))], ["h", "cls"])

    before = F.when(F.col("code") % (2 * CLASSES) < CLASSES, F.col("n")).otherwise(0)
    by_word = found.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("x"), F.sum(before).alias("c")).where(F.col("c") >= SEEN)
    return by_word.select("h", "x").mapInArrow(run, "h long, cls short")


def class_bigrams(sequences: DataFrame) -> np.ndarray:
    """Class bigrams of a column of class sequences (a byte a token, without ends)."""

    def run(batches):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in trimmed(batches):
            for before, tokens, _ in _sequences(batch.column(0)):
                total += np.bincount(before * CLASSES + tokens, minlength=len(total))
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["cell", "n"])

    got = sequences.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(CLASSES * CLASSES)
    cells[got["cell"].to_numpy()] = got["n"].to_numpy()
    return cells.reshape(CLASSES, CLASSES)


def _sequences(column):
    """_before_after of some rows at a time."""
    for at in range(0, len(column), 256):
        some = column.slice(at, 256).to_pylist()
        yield _before_after(np.frombuffer(b"".join(some), np.uint8).astype(np.int64), np.array([len(x) for x in some], np.int64))


class Model:
    """log10 of the class part of a token's probability, for each class before and class."""

    def __init__(self, matrix: np.ndarray, label: np.ndarray, types: np.ndarray, n_tokens: int, n_types: int, classes: int = CLASSES, unseen: np.ndarray | None = None):
        """unseen: classes that unseen words can have (default: those of the endings' items)."""
        one = np.zeros((len(label), classes))
        one[np.arange(len(label)), label] = 1
        cells = one.T @ matrix @ one
        size = cells.sum(0)
        open_ = np.zeros(classes)
        open_[label[1 + TOP :] if unseen is None else unseen] = 1
        emission = size + one.T @ types + open_
        prior = (size + 1) / (size.sum() + classes)
        step = (cells + classes * prior) / (cells.sum(1, keepdims=True) + classes)
        self.base = math.log10(n_tokens + n_types + 1)
        self.label = label
        self.table = np.log10(LAMBDA * step / np.maximum(emission, 1) + (1 - LAMBDA) / (n_tokens + n_types + 1))


def fit(train: DataFrame, counts: DataFrame):
    """Lexicon with classes (broadcast), labels of the items, (h, c, cls) of all words (cls null: by ending), types by class, N and V, training texts.

    To the driver: a histogram of counts, FREQUENT words, N_ITEMS squared bigrams, type counts by class.
    """
    spark = train.sparkSession
    n_texts = train.count()
    steps = counts.groupBy(F.least("c", F.lit(1_000_000)).alias("c")).agg(F.count("*").alias("n"), F.sum("c").alias("s")).orderBy(F.desc("c")).collect()
    least, room = 2, FREQUENT
    for row in steps:
        if (room := room - row["n"]) < 0:
            break
        least = row["c"]
    if steps and room < 0 and steps[0]["n"] > FREQUENT:
        least = 1_000_001
    frequent = F.col("c") >= max(2, least)
    top = counts.where(frequent).select("h", "c").toArrow()
    lexicon = Lexicon(top["h"].to_numpy().view(np.uint64), top["c"].to_numpy())
    n_types = sum(r["n"] for r in steps) + (n_texts > 0)
    n_tokens = sum(r["s"] for r in steps) + n_texts
    lex = spark.sparkContext.broadcast(lexicon)
    matrix = bigram_counts(train, lex)
    label = exchange(matrix)
    one = np.zeros((N_ITEMS, CLASSES))
    one[np.arange(N_ITEMS), label] = 1
    own = lexicon.items > 0
    seeds = spark.createDataFrame([(int(h), int(c)) for h, c in zip(lexicon.hashes[own].view(np.int64), label[lexicon.items[own]], strict=True)], "h long, cls short")
    whole = max(2, least) <= SEEN
    classes = placed(contexts(train, lex, label, whole), one.T @ matrix @ one).unionByName(seeds)
    known = stored(counts.join(classes, "h", "left"), "lm-words")
    by_ending = F.element_at(F.array(*[F.lit(int(x)) for x in label[1 + TOP :]]), F.col("ending") + 1)
    types = np.zeros(CLASSES)
    for r in known.groupBy(F.coalesce(F.col("cls").cast("int"), by_ending).alias("g")).agg(F.count("*").alias("n")).collect():
        types[r["g"]] += r["n"]
    types[0] += 1 if n_texts else 0
    mine = known.where(frequent & F.col("cls").isNotNull()).select("h", "cls").toArrow()
    lexicon.classes[lexicon.find(mine["h"].to_numpy().view(np.uint64))[0]] = mine["cls"].to_numpy()
    return spark.sparkContext.broadcast(lexicon), label, known, types, n_tokens, n_types, n_texts


def _scan(rows: DataFrame, lex, label: np.ndarray) -> DataFrame:
    """For each row: what needs no join (rare = false), and its words outside the lexicon with number and places (rare = true).

    classes has a byte a word; places (int32 each) are where the joined class of a rare word goes.
    """
    names = ["rid", "rare", "doc_id", "held_out", "n_tokens", "n_known", "sum_known", "classes", "h", "tf", "places"]

    def run(batches):
        lexicon = lex.value
        log_count = np.log10(lexicon.counts + 1.0) if len(lexicon.counts) else np.zeros(1)
        for batch in trimmed(batches):
            rid, doc, held = (batch.column(x).to_numpy(zero_copy_only=False) if x != "doc_id" else batch.column(x) for x in ("rid", "doc_id", "held_out"))
            for chunk in words.chunks(batch.column("text")):
                n = len(chunk.counts)
                distinct, index, at, there, item = _distinct(chunk, lexicon)
                row = np.repeat(np.arange(n), chunk.counts)
                cls = lexicon.class_(at, there, label[item])[index].astype(np.uint8) if len(index) else np.zeros(0, np.uint8)
                begins = np.cumsum(chunk.counts) - chunk.counts
                offsets = pa.array(np.r_[begins, len(index)].astype(np.int32))
                classes = pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(cls.tobytes())])
                logs = np.where(there, log_count[at], 0.0) if len(distinct) else np.zeros(0)
                known = there[index] if len(index) else np.zeros(0, bool)
                sum_known = np.bincount(row, logs[index] if len(index) else None, minlength=n)
                some = slice(chunk.first, chunk.first + n)
                empty = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(np.zeros(n, bool)), doc.slice(chunk.first, n), pa.array(held[some]), pa.array(chunk.counts + 1), pa.array(np.bincount(row[known], minlength=n)), pa.array(sum_known.astype(float)), classes, empty, empty, pa.nulls(n, pa.binary())], names)
                rare = np.flatnonzero(~known)
                pairs = row[rare] * (len(distinct) + 1) + index[rare]
                order = np.argsort(pairs, kind="stable")
                pair, first, tf = np.unique(pairs[order], return_index=True, return_counts=True)
                if k := len(pair):
                    to, which = np.divmod(pair, len(distinct) + 1)
                    none = [pa.nulls(k, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary())]
                    where = (rare - begins[row[rare]])[order].astype(np.int32)
                    edges = pa.array((np.r_[first, len(where)] * 4).astype(np.int32))
                    places = pa.Array.from_buffers(pa.binary(), k, [None, edges.buffers()[1], pa.py_buffer(where.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(rid[chunk.first + to]), pa.array(np.ones(k, bool)), *none, pa.array(distinct[which].view(np.int64)), pa.array(tf.astype(np.int64)), places], names)

    return rows.mapInArrow(run, "rid long, rare boolean, doc_id long, held_out boolean, n_tokens long, n_known long, sum_known double, classes binary, h long, tf long, places binary")


def _patched(rows: DataFrame) -> DataFrame:
    """rows with the classes of moved (cls, places) put into classes."""
    kept = [c for c in rows.columns if c not in ("classes", "moved")]

    def run(batches):
        for batch in trimmed(batches):
            out = []
            for classes, moved in zip(batch.column("classes").to_pylist(), batch.column("moved").to_pylist(), strict=True):
                if moved:
                    new = np.frombuffer(classes, np.uint8).copy()
                    for x in moved:
                        new[np.frombuffer(x["places"], np.int32)] = x["cls"]
                    classes = new.tobytes()
                out.append(classes)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.binary())], [*kept, "classes"])

    return rows.mapInArrow(run, rows.select(*kept, "classes").schema)


def _class_sums(rows: DataFrame, model) -> DataFrame:
    """rows with sum_class in place of classes."""
    kept = [c for c in rows.columns if c != "classes"]

    def run(batches):
        for batch in trimmed(batches):
            sums = [np.add.reduceat(model.value.table[before, tokens], begins) for before, tokens, begins in _sequences(batch.column("classes"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(np.concatenate(sums) if sums else [], pa.float64())], [*kept, "sum_class"])

    return rows.mapInArrow(run, rows.select(*kept, F.lit(0.0).alias("sum_class")).schema)


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the rows whose crc32(id) mod 7 is not 2 and score all rows; four scans of the texts, two of their classes."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (id_remainder(F.col(id_col), HOLD_MOD) == HOLD).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = rows.where("not held_out").select("text")
    counts = stored(word_counts(train), "lm-counts")
    lex, label, known, types, n_tokens, n_types, n_texts = fit(train, counts)
    scanned = stored(_scan(rows.withColumn("rid", F.monotonically_increasing_id()), lex, label), "lm-scan", "rare")
    rare = (
        scanned.where("rare").select("rid", "h", "tf", "places").join(known.select("h", "c", "cls"), "h", "left")
        .groupBy("rid").agg(
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0) * F.col("tf")).alias("s"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k"),
            F.collect_list(F.when(F.col("cls").isNotNull(), F.struct("cls", "places"))).alias("moved"),
        )
    )
    joined = scanned.where("not rare").join(rare, "rid", "left").select("doc_id", "held_out", "n_tokens", "n_known", "sum_known", "s", "k", "classes", "moved")
    ready = stored(_patched(joined), "lm-classes")
    cells = class_bigrams(ready.where("not held_out").select("classes"))
    model = df.sparkSession.sparkContext.broadcast(Model(cells, np.arange(CLASSES), types, n_tokens, n_types, unseen=label[1 + TOP :]))
    out = _class_sums(ready, model)
    counted = F.col("sum_known") + F.coalesce("s", F.lit(0.0)) + F.lit(math.log10(n_texts + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0)) + F.lit(int(n_types > 0))).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        (counted - F.col("n_tokens") * F.lit(math.log10(n_tokens + n_types + 1))).alias("base_score"), (counted + F.col("sum_class")).alias("score"),
        F.pow(F.lit(10.0), -(counted + F.col("sum_class")) / F.col("n_tokens")).alias("perplexity"),
    )


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
