"""Words and byte n-grams of whole texts, hashed in numpy; a bounded memo of per-word numbers for linear models."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

#: Letters A-Z become lower case and ASCII punctuation becomes a space before a text is split into words.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else (32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b) for b in range(256)
)
MEMO_WORDS = 250_000
_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def fold_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M
    return h ^ (h >> np.uint64(29))


def gram_buckets(words: list[bytes], orders: tuple[int, ...], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order n: (index of the word, bucket) of each n-gram of <word>; last, each word's own bucket."""
    buf = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = ends[word] - np.arange(len(buf))  # bytes to the end of the word, this one included
    out, h, last = [], np.zeros(len(buf), np.uint64), max(orders, default=0)
    with np.errstate(over="ignore"):
        for n in range(1, last + 1):
            h = h * _P
            m = max(0, len(buf) - n + 1)  # a few letters in all may be fewer than n
            h[:m] += buf[len(buf) - m :]
            if n in orders:
                at = np.flatnonzero(left >= n)
                out.append((word[at], (_mix(h[at] + np.uint64(n)) % np.uint64(buckets)).astype(np.int64)))
        inner = np.arange(len(buf), dtype=np.uint64) - (ends - sizes).astype(np.uint64)[word]
        whole = np.add.reduceat(_mix(buf + inner * _P), ends - sizes)
        out.append((np.arange(len(words)), (_mix(whole) % np.uint64(buckets)).astype(np.int64)))
    return out


class WordScores:
    """word -> (sum of the weights of its n-grams and itself, how many they are), for the words seen lately."""

    def __init__(self, weights: np.ndarray, orders: tuple[int, ...]):
        self.weights, self.orders = weights, orders
        self.index: dict[bytes, int] = {}
        self.sums, self.counts = np.zeros(0), np.zeros(0, np.int64)

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of all words of the texts, one after another."""
        if len(self.index) > MEMO_WORDS:
            self.index, self.sums, self.counts = {}, np.zeros(0), np.zeros(0, np.int64)
        flat = [w for t in texts for w in t]
        new = list(set(flat).difference(self.index))
        if new:
            s, c = np.zeros(len(new)), np.zeros(len(new), np.int64)
            for word, bucket in gram_buckets(new, self.orders, len(self.weights)):
                s += np.bincount(word, self.weights[bucket], len(new))
                c += np.bincount(word, minlength=len(new))
            self.index.update(zip(new, range(len(self.sums), len(self.sums) + len(new)), strict=True))
            self.sums, self.counts = np.concatenate([self.sums, s]), np.concatenate([self.counts, c])
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        return self.sums[at], self.counts[at]


def word_table(texts: Iterable[str], words_of: Callable, orders: tuple[int, ...], buckets: int, step: int = 20_000) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Training texts as arrays of word numbers; buckets of all words, one word after another; how many each word has.

    Built text by text and in steps of the vocabulary, as the driver that trains has little memory.
    """
    vocab: dict[bytes, int] = {}
    docs = []
    for t in texts:
        words = words_of(t)
        docs.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32, len(words)))
    flat, sizes = [], []
    every = list(vocab)
    for a in range(0, len(every), step):
        part = every[a : a + step]
        grams = gram_buckets(part, orders, buckets)
        word = np.concatenate([g[0] for g in grams]).astype(np.int32)
        bucket = np.concatenate([g[1] for g in grams]).astype(np.int32)
        flat.append(bucket[np.argsort(word, kind="stable")])
        sizes.append(np.bincount(word, minlength=len(part)))
    none = np.zeros(0, np.int32)
    return docs, np.concatenate([none, *flat]), np.concatenate([np.zeros(0, np.int64), *sizes])
