"""A bounded memo of word -> token ids held in flat arrays, so that whole texts are encoded by table lookup."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

MEMO_WORDS = 400_000


class _Index(dict):
    """word -> its number; a word that is asked for first gets the next number and is noted in `new`."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, word) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def flatten(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one list after another, and the lists' sizes."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of flat of these begins and sizes, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordIds:
    """encode(words) -> (all ids, ids of each word); it is called only for words that are not remembered.

    A full memo starts anew with the words that were asked for at least twice since it last did; most words occur once.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], known: dict | None = None, dtype=np.uint16):
        self.encode, self.known, self.dtype = encode, known or {}, dtype
        self._start()

    def _start(self) -> None:
        self.index = _Index()
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.begin, self.size, self.asked = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for word in self.known:
            self.index[word]
        self._add(lambda words: flatten([self.known[w] for w in words]))

    def _renew(self) -> None:
        at = np.flatnonzero(self.asked >= 2)
        at = at[at >= len(self.known)]
        if len(at) > MEMO_WORDS // 2:
            at = np.sort(at[np.argsort(-self.asked[at], kind="stable")[: MEMO_WORDS // 2]])
        words = list(self.index)
        kept, ids, sizes = [words[i] for i in at], gather(self.flat, self.begin[at], self.size[at]), self.size[at]
        self._start()
        for word in kept:
            self.index[word]
        self._add(lambda _: (ids, sizes))

    def _add(self, encode: Callable) -> None:
        """Encodes the words that the index has noted."""
        if not self.index.new:
            return
        ids, sizes = encode(self.index.new)
        self.index.new = []
        total = len(ids)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * (self.used + total), self.dtype)])
        self.flat[self.used : self.used + total] = ids
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.asked = np.concatenate([self.asked, np.zeros(len(sizes), np.int64)])
        self.used += total

    def of(self, texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts' words, one text after another, and how many each text has."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        number: dict = {}
        index = np.fromiter(
            (number.setdefault(w, len(number)) for w in chain.from_iterable(texts)), np.int64, int(n.sum())
        )
        return self.of_distinct(list(number), index, n)

    def of_distinct(self, words: list, index: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts whose words are words[index], per_text of them in each text."""
        if len(self.index) > MEMO_WORDS + len(self.known):
            self._renew()
        own = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        self._add(self.encode)
        self.asked[own] += np.bincount(index, minlength=len(words))
        at = own[index]
        size = self.size[at]
        reach = np.concatenate([[0], np.cumsum(size)])[np.cumsum(per_text)]
        return gather(self.flat, self.begin[at], size), np.diff(np.concatenate([[0], reach]))
