"""Parts of the operators that need no session."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cairnbook.llm import ans, brown, components, fingerprints, kdtree, packing, rtree, shared, tokens, toxicity, words

TEXTS = ["", None, " \t\n", "A b\x0bC", "x y z", "é " * 3000, "one two three four five six", "a" * 50]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("size", [1, 64, 1 << 20])
def test_words_are_the_pattern(size):
    seen = {}
    rows = []
    for chunk in words.chunks(pa.array(TEXTS), size):
        at = 0
        for n in chunk.counts:
            rows.append(chunk.hashes[at : at + n].tolist())
            at += n
    for text, hashes in zip(TEXTS, rows, strict=True):
        found = WORD.findall(fold(text))
        assert len(found) == len(hashes)
        for w, h in zip(found, hashes, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_text_in_pieces(monkeypatch):
    text = "abc def  ghi " * 200
    whole = next(iter(words.chunks(pa.array([text]))))
    monkeypatch.setattr(words, "PIECE", 100)
    parts = next(iter(words.chunks(pa.array([text]))))
    assert (whole.hashes == parts.hashes).all() and (whole.starts == parts.starts).all()


def test_sliced_column():
    column = pa.array(["a b", "c", "d e f"])[1:]
    assert [c.counts.tolist() for c in words.chunks(column)] == [[1, 3]]


def test_sketches_estimate_and_merge():
    r = np.random.default_rng(1)
    a, b = ("w%d w%d w%d" % tuple(r.integers(0, 9, 3)) for _ in range(2))
    base = [f"w{i}" for i in r.integers(0, 50_000, 4000)]
    left, right = " ".join(base[:3000]), " ".join(base[1000:])
    x, y, z, w = fingerprints.sketches(pa.array([left, right, "", a + " " + b]))
    assert (fingerprints.decode(fingerprints.encode(x)) == x).all()
    assert abs(fingerprints.resemblance(x, y) - 0.5) < 0.15
    assert abs(fingerprints.containment(x, y) - 2 / 3) < 0.2
    assert abs(fingerprints.distinct_count(x) / 2996 - 1) < 0.3
    assert fingerprints.resemblance(z, z) == 1 and fingerprints.resemblance(z, x) == 0
    both = next(iter(fingerprints.sketches(pa.array([left + " " + " ".join(base[1000:])]))))
    assert len(np.setdiff1d(fingerprints.merge(x, y), both)) <= 4  # shingles over the seam
    assert fingerprints.distinct_count(w) < fingerprints.K


def test_tree_search_is_exact():
    r = np.random.default_rng(2)
    vectors = r.integers(-300, 300, (700, 12))
    vectors[:200] = vectors[0]  # a third alike
    ids, uids = r.permutation(700), np.arange(700)
    tree = kdtree.Tree.from_bytes(kdtree.Tree.build(ids, uids, vectors).to_bytes())
    for low in (-(1 << 63), None):
        best = [[] for _ in range(40)]
        scores = vectors[:40] @ vectors.T
        floor = np.array([low if low is not None else np.sort(np.delete(scores[i], i))[-10] for i in range(40)], object)
        tree.search(vectors[:40], uids[:40], best, floor, 10)
        for i in range(40):
            want = sorted(((-int(scores[i, j]), int(ids[j])) for j in range(700) if j != i))[:10]
            assert sorted((-s, -v) for s, v, _ in best[i]) == want


def test_tree_small_and_empty():
    for n in (0, 1, 3):
        tree = kdtree.Tree.from_bytes(kdtree.Tree.build(np.arange(n), np.arange(n), np.zeros((n, 2), np.int64)).to_bytes())
        best = [[]]
        tree.search(np.ones((1, 2), np.int64), np.array([99]), best, np.array([-(1 << 63)], object), 10)
        assert len(best[0]) == n


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_rtree_links_all_components():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = r.integers(0, 1 << 63, 120, dtype=np.uint64)
        for _ in range(r.integers(1, 9)):
            keep = base[r.random(120) > r.choice([0.0, 0.02, 0.05, 0.1])]
            sets.append(np.unique(np.append(keep, r.integers(0, 1 << 63, r.integers(1, 9), dtype=np.uint64))))
    got = rtree.link(sets, np.arange(len(sets)), 85, 100)
    py = [set(s.tolist()) for s in sets]
    assert all(jaccard(py[a], py[b]) >= 0.85 for a, b in got)
    links = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(py[i], py[j]) >= 0.85]
    want = components.contract(*np.array(links).T)
    have = components.contract(*np.array(got).T)
    assert dict(zip(*want, strict=True)) == dict(zip(*have, strict=True))


def test_coder_round_trip():
    r = np.random.default_rng(4)
    for n in (0, 1, 63, 64, ans.BLOCK, ans.BLOCK + 1, 3 * ans.BLOCK - 5):
        ids = np.minimum(r.zipf(1.3, n), 49_407).astype(np.uint16)
        docs = [ids[: n // 3], ids[n // 3 : n // 2], ids[n // 2 :]]
        data = ans.encode_file([5, None, 7], docs)
        names, sizes, out = ans.decode_file(data)
        assert names == [5, None, 7] and sizes.tolist() == [len(d) for d in docs] and (out == ids).all()
    assert (ans.decode_file(data, only=1)[2] == ids[ans.BLOCK : 2 * ans.BLOCK]).all()
    assert len(data) < 2 * n  # shorter than 16 bits an id
    broken = bytearray(data)
    broken[-9] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        ans.decode_file(bytes(broken))


def test_shares_of_a_wide_table():
    share = ans.table(np.arange(49_408, dtype=np.uint16))
    assert share.sum() == 1 << 16 and share.min() >= 1


def test_plans_cover_the_histogram():
    r = np.random.default_rng(5)
    for n in (0, 1, 40, 20_000):
        h = np.bincount(r.lognormal(6, 1.3, n).astype(int) % 4096, minlength=4096)
        patterns, cut = packing.plan(h)
        used = cut.copy()
        for p, times in patterns:
            assert sum(p) <= 4096
            for x in p:
                used[x] += times
        used[0] = h[0]
        assert (used == h).all()
        tokens_ = sum(sum(p) * m for p, m in patterns)
        waste = sum((4096 - sum(p)) * m for p, m in patterns if sum(p) & (sum(p) - 1))
        assert waste <= 0.01 * max(1, tokens_)


def test_ids_by_words_are_ids_of_the_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    texts = [*TEXTS, "It's A <|endoftext|>x <|ENDOFTEXT|> ΑΣ ΟΔΟΣ. é ́a 'Sſ İstanbul 12,5 中文 \U0001f600!?"]
    for text, ids in zip(texts, tokens.documents_ids(pa.array(texts), 1), strict=True):
        assert ids.tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_clustering_raises_the_likelihood():
    r = np.random.default_rng(6)
    half = (brown.N_ITEMS - 1) // 2
    m = np.zeros((brown.N_ITEMS, brown.N_ITEMS))
    m[1 : half + 1, half + 1 :] = r.poisson(3, (half, brown.N_ITEMS - 1 - half))
    m[half + 1 :, 1 : half + 1] = r.poisson(3, (brown.N_ITEMS - 1 - half, half))
    label = brown.exchange(m, classes=5)
    assert label[0] == 0 and set(label[1 : half + 1].tolist()).isdisjoint(label[half + 1 :].tolist())


def test_model_sums_to_one():
    n, k = brown.N_ITEMS, brown.CLASSES
    r = np.random.default_rng(7)
    m = r.poisson(0.2, (n, n)).astype(float)
    label = brown.exchange(m, sweeps=1)
    types = r.integers(1, 4, n).astype(float)
    types[0] = 1
    counts = m.sum(0)
    n_tokens, n_types = int(counts.sum()), int(types.sum())
    model = brown.Model(m, label, types, n_tokens, n_types)
    one = np.zeros((n, k))
    one[np.arange(n), label] = 1
    open_ = np.zeros(k)
    open_[label[1 + brown.TOP :]] = 1
    mass = one.T @ (counts + types) + open_  # sum over the words of a class of count + 1, with one unseen word where there can be one
    total = (10.0 ** model.table) @ mass
    assert np.allclose(total, total[0]) and abs(total[0] - 1) < 0.1


def test_gradients():
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(8)
    x = r.normal(0, 1, (7, toxicity.VECTOR + toxicity.FIXED))
    index, mask = r.integers(0, 7, (3, 5)), np.ones((3, 5))
    mask[1, 3:] = 0
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.forward(x, index, mask)[0]
        return float(np.sum(np.logaddexp(0, z) - y * z))

    z, kept = net.forward(x, index, mask, keep=True)
    g, d_x = net.backward(x, index, mask, kept, 1 / (1 + np.exp(-z)) - y)
    for name in ("Wf", "Ub", "bf", "A", "a", "v", "o", "c"):
        at = tuple(r.integers(0, s) for s in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-2 * max(0.05, abs(g[name][at]))
    x[2, 1] += 1e-3
    up = loss()
    x[2, 1] -= 2e-3
    assert abs((up - loss()) / 2e-3 - d_x[2, 1]) < 2e-2


def test_windows_cover_every_word():
    counts = np.array([0, 1, 31, 32, 33, 48, 100])
    first, length, row = toxicity.windows(counts)
    begin = np.cumsum(counts) - counts
    for i, n in enumerate(counts):
        seen = {w for f, k, r in zip(first, length, row, strict=True) if r == i for w in range(f - begin[i], f - begin[i] + k)}
        assert seen == set(range(n))


def test_network_learns_planted_words():
    r = np.random.default_rng(9)
    neutral = [f"w{i}" for i in range(300)]
    texts, label = [], []
    for i in range(240):
        w = list(r.choice(neutral, 80))
        if i % 3 == 0:
            for at in r.integers(0, 80, 3):
                w[at] = r.choice(["vileword", "vilething", "grubby"]) + r.choice(["", "s", "ly"])
        texts.append(" ".join(w))
        label.append(int(i % 3 == 0))
    label = np.array(label)
    net = toxicity.train(texts[:180], label[:180])
    got = np.concatenate([toxicity.score_chunk(net, c) for c in words.chunks(pa.array(texts[180:]))])
    assert ((got >= 0.5) == label[180:]).mean() > 0.9
    assert zlib.crc32(b"1") % 5 >= 0
    some = [*texts[180:186], "", " \t ", "grubby", " ".join(neutral[:31]), " ".join([*neutral, *neutral][:33]), "Vileword " * 47]
    for text, score in zip(some, np.concatenate([toxicity.score_chunk(net, c) for c in words.chunks(pa.array(some))]), strict=True):
        assert abs(score - plain_score(net, text)) < 1e-4, text


def plain_score(net, text):
    """A text's score by loops over numbers: every window, both directions, attention, the allowance for many windows."""
    h, p = toxicity.HIDDEN, {k: v.astype(float).tolist() for k, v in net.p.items() if k not in ("word", "char")}
    found = text.split()
    x = [net.inputs(toxicity.Distinct(next(iter(words.chunks(pa.array([w]))))))[0].astype(float).tolist() for w in found]

    def times(vector, matrix, j):
        return sum(a * row[j] for a, row in zip(vector, matrix, strict=True))

    def states(window, s):
        state, out = [0.0] * h, []
        for v in window if s == "f" else window[::-1]:
            into = [times(v, p["W" + s], j) + p["b" + s][j] for j in range(3 * h)]
            back = [times(state, p["U" + s], j) for j in range(3 * h)]
            z, r = ([1 / (1 + math.exp(-into[j] - back[j])) for j in range(at, at + h)] for at in (0, h))
            new = [math.tanh(into[2 * h + j] + r[j] * back[2 * h + j]) for j in range(h)]
            state = [(1 - z[j]) * new[j] + z[j] * state[j] for j in range(h)]
            out.append(state)
        return out if s == "f" else out[::-1]

    def logit(window):
        both = [a + b for a, b in zip(states(window, "f"), states(window, "b"), strict=True)]
        raw = [sum(p["v"][j] * math.tanh(times(st, p["A"], j) + p["a"][j]) for j in range(toxicity.ATTENTION)) for st in both]
        weight = [math.exp(v) for v in raw]
        pooled = [sum(w * st[j] for w, st in zip(weight, both, strict=True)) / sum(weight) for j in range(2 * h)] if both else [0.0] * (2 * h)
        return sum(a * b for a, b in zip(pooled, p["o"], strict=True)) + p["c"][0]

    wide, step = toxicity.WINDOW, toxicity.STRIDE
    begins = [*range(0, max(0, len(x) - wide), step), max(0, len(x) - wide)]
    best = max(logit(x[b : b + wide]) for b in begins)
    return 1 / (1 + math.exp(-(best - float(net.slope) * math.log(len(begins)) - float(net.shift))))


def thue_morse(n):
    """Two words of n letters that meet under every hash that is linear modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return tuple("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))


@pytest.mark.parametrize("n", [8, 9, 64, 1024, 2048, 4096])
def test_structured_words_stay_apart(n):
    a, b = thue_morse(n)
    (chunk,) = words.chunks(pa.array([f"{a} {b} {a}", a[:-1], a[1:], a + "\0"]))
    h = chunk.hashes
    assert h[0] == h[2] and len(set(h.tolist())) == 5
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    for text, ids in zip([a, b], tokens.documents_ids(pa.array([a, b]), 1), strict=True):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_ids_when_all_words_share_hashes(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(words, "mix", lambda x: x & np.uint64(3))
    path = public_tokenizers.path(tokens.TOKENIZER)
    t, own = Tokenizer.from_file(path), tokens.WordTokenizer(path)
    texts = ["one two three four five six seven", "eight one nine " + "long" * 9, "x" * 30 + " " + "x" * 31 + " one two ten", " ".join(f"w{i}" for i in range(500))]
    for _ in range(2):
        for text in texts:
            (chunk,) = words.chunks(pa.array([text]), fold=False)
            ids, counts = own.encode(chunk)
            assert ids.tolist() == t.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]


def test_known_words_go_when_a_task_needs_none():
    texts = pa.array([" ".join(f"held{i}" for i in range(3000))])
    (ids,) = tokens.documents_ids(texts, 1)
    own = tokens.tokenizer()
    assert own.known >= 3000
    assert list(shared.trimmed([1, 2], tokens.HELD)) == [1, 2] and own.known >= 3000
    assert list(shared.trimmed([1, 2])) == [1, 2] and own.known == 0 and not len(own.keys)
    (again,) = tokens.documents_ids(texts, 1)
    assert again.tolist() == ids.tolist()


def test_new_words_are_encoded_a_few_at_a_time():
    import public_tokenizers

    own, sizes = tokens.WordTokenizer(public_tokenizers.path(tokens.TOKENIZER)), []
    whole = own.tokenizer

    class Counted:
        def encode_batch_fast(self, some, **kw):
            sizes.append(len(some))
            return whole.encode_batch_fast(some, **kw)

    own.tokenizer = Counted()
    text = " ".join(f"w{i}" for i in range(20_000))
    (chunk,) = words.chunks(pa.array([text]), fold=False)
    ids, _ = own.encode(chunk)
    assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
    assert sum(sizes) == 20_000 and max(sizes) <= 1 << 13
