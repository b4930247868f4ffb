"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 1).

A word enters as the sum of a trained vector of its hash bucket (word input) and the summed trained vectors of the
buckets of its character n-grams (character input), next to three fixed inputs: the log odds of the word, and the
largest and mean log odds of its character n-grams, counted over the training texts.  Two gated recurrent units read
a window of WINDOW words in both directions; attention weights pool their states; a logistic unit gives the
window's log odds.  Windows start every STRIDE words, the last one ends with the text; a text scores as its
strongest window, so that no part of it is left out, less what the strongest of so many clean windows is expected to
have (a line over the logarithm of their number, fitted on the clean training texts).  Training (numpy, in one task over the bounded sample) is multiple-instance: a
text's label is learnt on the window that scores highest at the time.

Training rows: labelled texts of the training fold, the first of each label by hash of the id, until there are
SAMPLE of them or they hold SAMPLE_CHARS characters (parameters of fit; one text of each label in any case).  Texts
of every length are drawn alike and learnt whole; everything else covers whole texts and all rows.

Cases: a null or empty text, or one without words, scores like an empty window; a null id is never used for
training; labels that are null or not 0 or 1 are not used; without training rows of both labels every text scores 0.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.llm import words
from cairnbook.llm.shared import documents, id_remainder, returned, stored, trimmed

HELD_MOD = 5
SAMPLE, SAMPLE_CHARS = 1500, 8_000_000
WINDOW, STRIDE = 32, 16
BUCKETS = 1 << 16
VECTOR, HIDDEN, ATTENTION, FIXED = 6, 8, 6, 3
EPOCHS, STEPS, RATE, BATCH, GRAMS = 5, 100, 0.01, 256, (4, 5)
SLICE = 1 << 14
F32 = np.float32


def _grams(chunk: words.Words, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of words (letters lowered, with a mark before the word), and each word's number of them."""
    data = chunk.data
    size = ends - starts
    offs = np.concatenate(([0], np.cumsum(size + 1)))
    flat = np.full(int(offs[-1]), 1, np.uint64)
    inner = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)) + 1, size)
    byte = data[np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))] if len(size) else data[:0]
    flat[inner] = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    keys, owner = [], []
    which = np.repeat(np.arange(len(size)), size + 1)
    for n in GRAMS:
        if len(flat) < n:
            continue
        key = np.zeros(len(flat) - n + 1, np.uint64)
        for i in range(n):
            key = key * np.uint64(0x100000001B3) + flat[i : len(flat) - n + 1 + i]
        good = which[: len(key)] == which[n - 1 :]
        keys.append(words.mix(key[good] + np.uint64(n)) % np.uint64(BUCKETS))
        owner.append(which[: len(key)][good])
    if not keys:
        return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
    key, own = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return key[order].astype(np.int32), np.bincount(own, minlength=len(size))


def _reduce(op, values: np.ndarray, counts: np.ndarray, empty=0.0) -> np.ndarray:
    """op.reduceat over runs of counts rows; empty runs give empty."""
    out = np.full((len(counts), *values.shape[1:]), empty, values.dtype)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = op.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out


class Distinct:
    """The distinct words of a chunk: word buckets, n-gram buckets, and each word's place among them."""

    def __init__(self, chunk: words.Words):
        self.hashes, first, self.index = np.unique(chunk.hashes, return_index=True, return_inverse=True)
        self.word = (self.hashes % np.uint64(BUCKETS)).astype(np.int64)
        starts, ends = chunk.starts[first], chunk.ends[first]
        parts = [_grams(chunk, starts[i : i + SLICE], ends[i : i + SLICE]) for i in range(0, max(1, len(first)), SLICE)]
        self.grams, self.counts = (np.concatenate(x) for x in zip(*parts, strict=True))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and row of each window of rows of counts words; a row without words has one empty window."""
    n = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(counts)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    begin = np.minimum(k * STRIDE, np.maximum(0, counts[row] - WINDOW))
    return (np.cumsum(counts) - counts)[row] + begin, np.minimum(counts[row], WINDOW), row


def _sigmoid(x):
    return F32(1) / (F32(1) + np.exp(-x))


class Network:
    """The trained network; all arrays float32."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        d, h = VECTOR + FIXED, HIDDEN
        self.p = {
            "word": r.normal(0, 0.05, (BUCKETS, VECTOR)), "char": r.normal(0, 0.02, (BUCKETS, VECTOR)),
            **{f"{k}{s}": v for s in "fb" for k, v in (("W", r.normal(0, 0.4, (d, 3 * h))), ("U", r.normal(0, 0.3, (h, 3 * h))), ("b", np.zeros(3 * h)))},
            "A": r.normal(0, 0.4, (2 * h, ATTENTION)), "a": np.zeros(ATTENTION), "v": r.normal(0, 0.5, ATTENTION), "o": r.normal(0, 0.4, 2 * h), "c": np.full(1, -1.0),
        }
        self.p = {k: v.astype(F32) for k, v in self.p.items()}
        self.word_odds, self.gram_odds = np.zeros(BUCKETS, F32), np.zeros(BUCKETS, F32)
        self.shift, self.slope = F32(0), F32(0)
        self.trained = False

    def inputs(self, some: Distinct) -> np.ndarray:
        """(distinct words + 1, inputs); the last row stands for no word."""
        x = np.zeros((len(some.hashes) + 1, VECTOR + FIXED), F32)
        ends = np.cumsum(some.counts)
        for i in range(0, len(some.hashes), SLICE):
            part = slice(i, min(i + SLICE, len(some.hashes)))
            counts = some.counts[part]
            grams = some.grams[ends[part.start] - counts[0] : ends[part.stop - 1]]
            x[part, :VECTOR] = self.p["word"][some.word[part]] + _reduce(np.add, self.p["char"][grams], counts)
            x[part, VECTOR] = self.word_odds[some.word[part]]
            odds = self.gram_odds[grams]
            x[part, VECTOR + 1] = _reduce(np.maximum, odds, counts)
            x[part, VECTOR + 2] = _reduce(np.add, odds, counts) / np.maximum(1, counts)
        return x

    def _run(self, projected: np.ndarray, index: np.ndarray, mask: np.ndarray | None, s: str, keep: bool):
        """States (steps, windows, HIDDEN) of one direction; index: (windows, steps) rows of projected."""
        h, n, steps = HIDDEN, *index.shape
        state, out, kept = np.zeros((n, h), F32), np.zeros((steps, n, h), F32), [None] * steps
        U = self.p[f"U{s}"]
        for t in range(steps) if s == "f" else range(steps - 1, -1, -1):
            x, u = projected[index[:, t]], state @ U
            gates = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
            if mask is not None:
                z = z * mask[:, t, None] + (1 - mask[:, t, None])
            if keep:
                kept[t] = (state, u, z, r, new)
            state = (1 - z) * new + z * state
            out[t] = state
        return out, kept

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray | None = None, keep: bool = False):
        """Log odds of windows; index: (windows, steps) rows of the inputs x, mask: 1 where there is a word."""
        p = self.p
        runs = {s: self._run(x @ p[f"W{s}"] + p[f"b{s}"], index, mask, s, keep) for s in "fb"}
        states = np.concatenate((runs["f"][0], runs["b"][0]), axis=2)
        e = np.tanh(states @ p["A"] + p["a"])
        raw = e @ p["v"]
        if mask is not None:
            raw = np.where(mask.T > 0, raw, F32(-30))
        weight = np.exp(raw - raw.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ p["o"] + p["c"][0]
        return logit, (runs, states, e, weight, pooled) if keep else None

    def backward(self, x, index, mask, kept, grad):
        """Gradients of all weights but the input vectors, and of x; grad: of each window's log odds."""
        p, h = self.p, HIDDEN
        runs, states, e, weight, pooled = kept
        g = {"o": pooled.T @ grad, "c": grad.sum(keepdims=True)}
        d_pooled = grad[:, None] * p["o"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_states = weight[:, :, None] * d_pooled
        d_raw = weight * (d_weight - (weight * d_weight).sum(0))
        if mask is not None:
            d_raw = d_raw * (mask.T > 0)
        g["v"] = np.einsum("tn,tna->a", d_raw, e)
        d_e = d_raw[:, :, None] * p["v"] * (1 - e * e)
        g["a"], g["A"] = d_e.sum((0, 1)), np.einsum("tnh,tna->ha", states, d_e)
        d_states = d_states + d_e @ p["A"].T
        d_x = np.zeros_like(x)
        steps = index.shape[1]
        for s, part in (("f", d_states[:, :, :h]), ("b", d_states[:, :, h:])):
            U = p[f"U{s}"]
            d_u, d_state = np.zeros_like(U), np.zeros((len(index), h), F32)
            d_p = np.zeros((len(x), 3 * h), F32)
            for t in range(steps - 1, -1, -1) if s == "f" else range(steps):
                before, u, z, r, new = runs[s][1][t]
                d = part[t] + d_state
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (before - new)
                if mask is not None:
                    d_z = d_z * mask[:, t, None]
                d_z = d_z * z * (1 - z)
                d_r = d_new * u[:, 2 * h :] * r * (1 - r)
                to_u = np.concatenate((d_z, d_r, d_new * r), axis=1)
                to_x = np.concatenate((d_z, d_r, d_new), axis=1)
                d_u += before.T @ to_u
                d_state = d * z + to_u @ U.T
                np.add.at(d_p, index[:, t], to_x)
            g[f"U{s}"], g[f"W{s}"], g[f"b{s}"] = d_u, x.T @ d_p, d_p.sum(0)
            d_x += d_p @ p[f"W{s}"].T
        return g, d_x


def _tally(label: np.ndarray, half: np.ndarray, some: Distinct, doc: np.ndarray, word: np.ndarray, step: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Texts of each half and label in which a bucket occurs, (4, BUCKETS), of words and of character n-grams.

    doc, word: distinct pairs, ascending by doc; step texts at a time, as the n-grams of all texts are many.
    """
    out = np.zeros((2, 4, BUCKETS), np.int64)
    begin = np.cumsum(some.counts) - some.counts
    for low in range(0, len(label), step):
        part = slice(*np.searchsorted(doc, (low, low + step)))
        d, w = doc[part], word[part]
        reps = some.counts[w]
        flat = np.repeat(begin[w] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
        for i, (bucket, owner) in enumerate(((some.word[w], d), (some.grams[flat], np.repeat(d, reps)))):
            pair = np.unique((owner - low) * BUCKETS + bucket)
            at = low + pair // BUCKETS
            out[i] += np.bincount((half[at] * 2 + label[at]) * BUCKETS + pair % BUCKETS, minlength=4 * BUCKETS).reshape(4, BUCKETS)
    return out[0], out[1]


def _odds(tally: np.ndarray, texts: np.ndarray, halves: list[int]) -> np.ndarray:
    """Smoothed log odds of a bucket's occurring in a text of label 1; texts: number of texts of each half and label."""
    one, zero = (sum(tally[2 * h + v] for h in halves) for v in (1, 0))
    n1, n0 = (sum(texts[2 * h + v] for h in halves) for v in (1, 0))
    ratio = np.log((one + 0.5) / (n1 + 1)) - np.log((zero + 0.5) / (n0 + 1))
    trust = (one + zero) / (one + zero + 4.0)
    return np.clip(ratio * trust / 2, -1.0, 3.0).astype(F32)


def train(texts: list[str], label: np.ndarray, seed: int = 5, epochs: int | None = None) -> Network:
    """Fit on whole texts with labels 0 and 1."""
    net = Network()
    if not len(label) or label.min() == label.max():
        return net
    net.trained = True
    epochs = epochs or min(60, max(EPOCHS, -(-STEPS * BATCH // (2 * len(texts)))))
    chunk = words.joined(list(words.chunks(pa.array(texts, pa.large_string()))))
    some = Distinct(chunk)
    doc = np.repeat(np.arange(len(texts)), chunk.counts)
    pair = np.unique(doc * np.int64(len(some.hashes)) + some.index)
    d, w = pair // len(some.hashes), pair % len(some.hashes)
    begin = np.cumsum(some.counts) - some.counts
    # a text is learnt with odds counted on the other half of the texts, and scored later with those of all
    half = np.arange(len(texts)) % 2
    tallies = _tally(label, half, some, d, w)
    numbers = np.bincount(half * 2 + label, minlength=4)
    odds = [tuple(_odds(t, numbers, halves) for t in tallies) for halves in ([1], [0], [0, 1])]
    first, length, row = windows(chunk.counts)
    none = len(some.hashes)
    mask, index = np.zeros((len(row), WINDOW), F32), np.full((len(row), WINDOW), none, np.int32)
    for i in range(0, len(row), 4096):
        part = slice(i, i + 4096)
        mask[part] = np.arange(WINDOW) < length[part, None]
        if len(some.index):
            place = np.minimum(first[part, None] + np.arange(WINDOW), len(some.index) - 1)
            index[part] = np.where(mask[part] > 0, some.index[place], none)
    r = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        logit = np.zeros(len(row), F32)
        for side in (0, 1):
            net.word_odds, net.gram_odds = odds[side]
            at = np.flatnonzero(half[row] == side)
            logit[at] = _logits(net, net.inputs(some), index[at], mask[at])
        # the strongest window of each text, and as many others of texts of label 0
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, row, logit)
        chosen = np.flatnonzero(logit >= best[row])
        others = np.flatnonzero((label[row] == 0) & (logit < best[row]))
        extra = r.choice(others, min(len(others), len(texts)), replace=False) if len(others) else others
        order = r.permutation(np.concatenate((chosen, extra)))
        batches = [(side, p_[i : i + BATCH]) for side in (0, 1) for p_ in [order[half[row[order]] == side]] for i in range(0, len(p_), BATCH)]
        for k in r.permutation(len(batches)):
            side, part = batches[k]
            net.word_odds, net.gram_odds = odds[side]
            used, local = np.unique(index[part], return_inverse=True)
            local = local.reshape(len(part), WINDOW)
            x = _some_inputs(net, some, used, none)
            if r.random() < 0.5:  # half of the time without the trained vectors, so that rare words are not learnt by heart
                x[:, :VECTOR] = 0
            got, kept = net.forward(x, local, mask[part], keep=True)
            y = label[row[part]].astype(F32)
            grad = ((_sigmoid(got) - y) / len(part)).astype(F32)
            g, d_x = net.backward(x, local, mask[part], kept, grad)
            words_ = used[used < none]
            d_in = d_x[: len(words_), :VECTOR] * F32(x[:, :VECTOR].any())
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], some.word[words_], d_in)
            n = some.counts[words_]
            grams = some.grams[np.repeat(begin[words_] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            np.add.at(g["char"], grams, np.repeat(d_in, n, axis=0))
            step += 1
            rate = RATE * (1 - 0.7 * epoch / epochs)
            for name, v in net.p.items():
                m, s = moments[name]
                if name in ("word", "char"):
                    at_ = np.unique(some.word[words_] if name == "word" else grams)
                    m[at_] = 0.9 * m[at_] + 0.1 * g[name][at_]
                    s[at_] = 0.99 * s[at_] + 0.01 * g[name][at_] ** 2
                    v[at_] -= 0.3 * rate * (m[at_] / (np.sqrt(s[at_]) + 1e-4) + 1e-3 * v[at_])
                else:
                    m += 0.1 * (g[name] - m)
                    s += 0.01 * (g[name] ** 2 - s)
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    best = np.full(len(texts), -np.inf)
    for side in (0, 1):
        net.word_odds, net.gram_odds = odds[side]
        at = np.flatnonzero(half[row] == side)
        np.maximum.at(best, row[at], _logits(net, net.inputs(some), index[at], mask[at]))
    net.word_odds, net.gram_odds = odds[2]
    many = np.log(np.bincount(row, minlength=len(texts)))
    net.slope = F32(_slope(many[label == 0], best[label == 0]))
    net.shift = F32(_threshold(best - net.slope * many, label))
    return net


def _slope(x: np.ndarray, y: np.ndarray) -> float:
    """Slope of the line of least squares, at least 0."""
    spread = ((x - x.mean()) ** 2).sum()
    return max(0.0, float(((x - x.mean()) * (y - y.mean())).sum() / spread)) if spread > 0 else 0.0


def _some_inputs(net: Network, some: Distinct, used: np.ndarray, none: int) -> np.ndarray:
    own = used[used < none]
    part = Distinct.__new__(Distinct)
    part.hashes, part.word, part.counts = some.hashes[own], some.word[own], some.counts[own]
    begin = (np.cumsum(some.counts) - some.counts)[own]
    n = part.counts
    part.grams = some.grams[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    x = net.inputs(part)
    return x if len(own) < len(used) else x[:-1]


def _logits(net: Network, x: np.ndarray, index: np.ndarray, mask: np.ndarray, size: int = 4096) -> np.ndarray:
    return np.concatenate([net.forward(x, index[i : i + size], mask[i : i + size])[0] for i in range(0, len(index), size)])


def _threshold(best: np.ndarray, label: np.ndarray) -> float:
    """Midway between the neighbouring text scores that part labels with the best F1."""
    order = np.argsort(-best, kind="stable")
    s, y = best[order], label[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    at = int(np.argmax(f1))
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at]) - 1.0


def score_chunk(net: Network, chunk: words.Words) -> np.ndarray:
    """Score of each row of a chunk, 0 to 1."""
    if not net.trained:
        return np.zeros(len(chunk.counts))
    some = Distinct(chunk)
    x = net.inputs(some)
    none = len(some.hashes)
    first, length, row = windows(chunk.counts)
    best = np.full(len(chunk.counts), -np.inf)
    full = length == WINDOW
    spread = np.arange(WINDOW)
    size = 4096
    at = np.flatnonzero(full)
    for i in range(0, len(at), size):
        part = at[i : i + size]
        got, _ = net.forward(x, some.index[first[part][:, None] + spread])
        np.maximum.at(best, row[part], got)
    at = np.flatnonzero(~full)
    for i in range(0, len(at), size):
        part = at[i : i + size]
        mask = spread < length[part][:, None]
        index = np.where(mask, some.index[np.minimum(first[part][:, None] + spread, max(0, len(some.index) - 1))], none) if len(some.index) else np.full(mask.shape, none)
        got, _ = net.forward(x, index, mask.astype(F32))
        np.maximum.at(best, row[part], got)
    many = np.log(np.bincount(row, minlength=len(best)))
    return 1 / (1 + np.exp(-np.clip(best - net.slope * many - net.shift, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Network:
    """Train on at most sample labelled texts of each label and chars characters of them, of the training fold."""
    fold = id_remainder(F.col("doc_id"), HELD_MOD)
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold > 0))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    by_hash = F.xxhash64("doc_id", F.lit(3))
    # labels meet ids first, so that what is drawn has texts; then only the texts of at most 2 * sample ids are joined
    there = texts.select("doc_id").join(marked, "doc_id").distinct()
    drawn = [there.where(F.col("label") == v).orderBy(by_hash, "doc_id").limit(sample) for v in (0, 1)]
    joined = stored(texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").withColumn("tie", F.xxhash64("text")), "toxicity-drawn")
    w = Window.partitionBy("label").orderBy(by_hash, "doc_id", "tie")
    ranked = joined.select("doc_id", "label", "tie", F.length("text").cast("long").alias("chars")).withColumn("place", F.row_number().over(w)).withColumn("upto", F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ranked.where((F.col("place") <= sample) & ((F.col("upto") <= chars // 2) | (F.col("place") == 1))).select("doc_id", "label", "tie").distinct()
    picked = joined.join(F.broadcast(kept), ["doc_id", "label", "tie"], "left_semi").select("doc_id", "text", F.col("label").cast("long").alias("label")).coalesce(1)

    def run(batches):
        got = sorted((r for batch in trimmed(batches) for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text")), strict=True)))
        net = train([r[2] for r in got], np.array([r[1] for r in got], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])
        del got, net
        returned()

    rows = picked.mapInArrow(run, "net binary").collect()
    return pickle.loads(rows[0]["net"]) if rows else Network()


def score(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs' other columns and score (in place of one of that name); text_col may name a field of a struct column, which then stays."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    outer, _, field = text_col.partition(".")
    kept = [c for c in docs.columns if (field or c != outer) and c != "score"]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("score", T.DoubleType())

    def run(batches):
        for batch in trimmed(batches):
            text = batch.column(outer).field(field) if field else batch.column(outer)
            got = [score_chunk(shared.value, c) for c in words.chunks(text, size=1 << 19)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], [*kept, "score"])

    return docs.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder(F.col("doc_id"), HELD_MOD) == 0).alias("held_out"), "text")
    return score(rows, net).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
