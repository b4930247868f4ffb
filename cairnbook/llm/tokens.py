"""Token ids of whole texts, one tokenizer call per distinct word.

For tokenizers that drop white space and never join characters across ASCII white space, the ids
of a text are those of its words in order.  Each worker keeps the ids of words it has met until it has a task that needs none.

Words are looked up by their hashes, and their bytes compared with those of the word found; a word that
shares its hash with another is kept by its bytes.

Cases: a null or empty text, or one of white space, has no ids but the end id; a word of any length is one word;
ids of one text follow from the text alone, whatever was met before.
"""

from __future__ import annotations

import os

import numpy as np

from cairnbook.llm import shared, words

TOKENIZER = "word_bpe_49k.json"
HELD = "words' ids"
KEPT, KEPT_BYTES = 1_500_000, 1 << 26
AT_ONCE = 1 << 13


def _doubled(x: np.ndarray) -> np.ndarray:
    """x and as many zeros, whose memory is not touched yet."""
    out = np.zeros(2 * len(x), x.dtype)
    out[: len(x)] = x
    return out


class WordTokenizer:
    """Ids of the words of Words chunks; ids must be below 65,536."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self):
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # ascending hashes of known words, and the slot of each
        self.others: dict[bytes, int] = {}
        self.starts, self.text_starts = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.sizes, self.text_sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.uint16), 0
        self.text, self.text_used, self.known = np.zeros(1 << 20, np.uint8), 0, 0

    def _learn(self, words_: list[bytes]) -> np.ndarray:
        """Slots of new words, encoded AT_ONCE at a time, as an encoding is many times its word."""
        first = self.known
        for at in range(0, len(words_), AT_ONCE):
            self._add(words_[at : at + AT_ONCE])
        return np.arange(first, self.known)

    def _add(self, words_: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words_], add_special_tokens=False)
        for word, encoding in zip(words_, found, strict=True):
            ids, slot = encoding.ids, self.known
            if slot == len(self.starts):
                self.starts, self.sizes, self.text_starts, self.text_sizes = (_doubled(x) for x in (self.starts, self.sizes, self.text_starts, self.text_sizes))
            while self.used + len(ids) > len(self.flat):
                self.flat = _doubled(self.flat)
            while self.text_used + len(word) + 8 > len(self.text):
                self.text = _doubled(self.text)
            self.flat[self.used : self.used + len(ids)] = ids
            self.text[self.text_used : self.text_used + len(word)] = np.frombuffer(word, np.uint8)
            self.starts[slot], self.sizes[slot], self.text_starts[slot], self.text_sizes[slot] = self.used, len(ids), self.text_used, len(word)
            self.used += len(ids)
            self.text_used += len(word)
            self.known += 1

    def encode(self, chunk: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of the chunk one after the other, and their number in each row."""
        keys, first, index = np.unique(chunk.hashes, return_index=True, return_inverse=True)
        size = chunk.ends - chunk.starts

        def word(at: int) -> bytes:
            return chunk.data[chunk.starts[at] : chunk.ends[at]].tobytes()

        named_ = len(keys)
        other = first[index]
        wide = words.eights(chunk.data)
        odd = np.flatnonzero(~words.equal(wide, chunk.starts, size, wide, chunk.starts[other], size[other]))
        if len(odd):  # words of one hash that differ
            apart: dict[bytes, int] = {}
            more = []
            for at in odd.tolist():
                if (w := word(at)) not in apart:
                    apart[w] = len(first) + len(more)
                    more.append(at)
                index[at] = apart[w]
            keys, first = np.concatenate((keys, chunk.hashes[more])), np.concatenate((first, more))
        if self.known > KEPT or self.text_used > KEPT_BYTES:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(0, len(self.keys) - 1))
        hit = self.keys[near] == keys if len(self.keys) else np.zeros(len(keys), bool)
        slot = np.where(hit, self.slots[near], -1).astype(np.int64) if len(self.keys) else np.full(len(keys), -1)
        there = np.flatnonzero(hit)
        same = words.equal(wide, chunk.starts[first[there]], size[first[there]], words.eights(self.text, padded=True), self.text_starts[slot[there]], self.text_sizes[slot[there]].astype(np.int64))
        new = np.flatnonzero(~hit)
        named = new[new < named_]  # of words that share a hash in this chunk the first is found by it, all others by their bytes
        apart_ = np.concatenate((there[~same], new[new >= named_]))
        if len(named):
            slot[named] = self._learn([word(i) for i in first[named].tolist()])
            self.keys, self.slots = np.insert(self.keys, at[named], keys[named]), np.insert(self.slots, at[named], slot[named].astype(np.int32))
        for i in apart_.tolist():
            if (w := word(first[i])) not in self.others:
                self.others[w] = int(self._learn([w])[0])
            slot[i] = self.others[w]
        sizes = self.sizes[slot][index].astype(np.int64) if len(index) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        begins = self.starts[slot][index] - (ends - sizes) if len(index) else sizes
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(begins, sizes) + np.arange(total)]
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(chunk.counts)))]
        return ids, np.diff(upto)


_loaded: dict[str, WordTokenizer] = {}


def _forget() -> None:
    for of in _loaded.values():
        of._clear()


def tokenizer(path: str | None = None) -> WordTokenizer:
    """The worker's tokenizer, loaded once."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def documents_ids(column, end: int, path: str | None = None):
    """For each text of an Arrow column its ids and the end id, as unsigned 16-bit integers."""
    encoder = tokenizer(path)
    shared.held[HELD] = _forget
    for chunk in words.chunks(column, fold=False):
        ids, counts = encoder.encode(chunk)
        at = 0
        for count in counts.tolist():
            out = np.empty(count + 1, np.uint16)
            out[:count] = ids[at : at + count]
            out[count] = end
            at += count
            yield out
