"""Minimal acyclic automata over sorted words, with a perfect hash: every word's number is its place in the sorted order.

Transitions lie in two flat arrays sorted by (state, letter), so a whole block of words walks at once by binary search.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

LETTERS = 256


class Automaton:
    """Built from sorted different words over single bytes; a state that is no longer on the last word's path is merged
    with an equal one when the next word leaves it, so the memory is that of the minimal automaton and one path."""

    def __init__(self, words: Iterable[bytes]):
        self._known: dict[tuple, int] = {}
        self._size: list[int] = []  # words that a state accepts
        keys: list[int] = []
        to: list[int] = []
        skip: list[int] = []
        final: list[bool] = []
        path: list[list] = [[False, [], []]]  # of the last word: is it a word's end, letters, states behind them
        last = b""

        def close(node: list) -> int:
            name = (node[0], bytes(node[1]), tuple(node[2]))
            state = self._known.get(name)
            if state is None:
                state = self._known[name] = len(final)
                before = int(node[0])
                for c, t in zip(node[1], node[2], strict=True):
                    keys.append(state * LETTERS + c)
                    to.append(t)
                    skip.append(before)
                    before += self._size[t]
                final.append(node[0])
                self._size.append(before)
            return state

        for word in words:
            same = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                same += 1
            while len(path) > same + 1:
                done = close(path.pop())
                path[-1][2].append(done)
            for c in word[same:]:
                path[-1][1].append(c)
                path.append([False, [], []])
            path[-1][0] = True
            last = word
        while len(path) > 1:
            done = close(path.pop())
            path[-1][2].append(done)
        self.root = close(path[0])
        self.keys, self.to, self.skip = np.array(keys, np.int64), np.array(to, np.int64), np.array(skip, np.int64)
        self.final = np.array(final, bool)
        self.first = np.searchsorted(self.keys, np.arange(len(final) + 1) * LETTERS)  # a state's transitions
        del self._known, self._size

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Numbers of the transitions, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(state), -1)
        key = state * LETTERS + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def branches(self, state: np.ndarray, but: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, transition) of all transitions of these states, without those by the letter `but`."""
        n = self.first[state + 1] - self.first[state]
        row = np.repeat(np.arange(len(state)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.first[state][row]
        if but is not None:
            keep = self.keys[at] % LETTERS != but[row]
            row, at = row[keep], at[keep]
        return row, at


def one_error(a: Automaton, words: np.ndarray, exact: int, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, word number) of the automaton's words that have the first `exact` letters of a row of `words` and differ in
    exactly one: replaced or, with `longer`, inserted letters, else one deleted letter.

    words: letters of words of one length, a row each. Every (row, word) comes once: a deleted letter is the last of a
    run of equal ones, and an inserted letter stands after the letters equal to it.
    """
    rows, length = words.shape
    state, number, alive = np.full(rows, a.root), np.zeros(rows, np.int64), np.ones(rows, bool)
    row, at, sum_ = (np.zeros(0, np.int64) for _ in range(3))  # with the error behind them: row, state, number so far

    def walk(row: np.ndarray, state: np.ndarray, number: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, ...]:
        t = a.step(state, letter)
        ok = t >= 0
        return row[ok], a.to[t[ok]], number[ok] + a.skip[t[ok]]

    for i in range(length):
        letter = words[:, i].astype(np.int64)
        row, at, sum_ = walk(row, at, sum_, letter[row])
        if i >= exact:
            live = np.flatnonzero(alive)
            if longer:
                of, t = a.branches(state[live], letter[live])
                of = live[of]
                to, n = a.to[t], number[of] + a.skip[t]
                more = [(of, to, n), walk(of, to, n, letter[of])]  # replaced, or inserted before this letter
            else:
                if i + 1 < length:
                    live = live[words[live, i] != words[live, i + 1]]
                more = [(live, state[live], number[live])]
            row, at, sum_ = (np.concatenate([x, *(m[k] for m in more)]) for k, x in enumerate((row, at, sum_)))
        t = a.step(state, letter)
        alive &= t >= 0
        t = np.where(alive, t, 0)
        if len(a.keys):
            number, state = number + a.skip[t], np.where(alive, a.to[t], state)
    if longer:
        live = np.flatnonzero(alive)
        of, t = a.branches(state[live], None)
        of = live[of]
        row, at, sum_ = (np.concatenate(x) for x in ((row, of), (at, a.to[t]), (sum_, number[of] + a.skip[t])))
    ok = a.final[at] if len(at) else np.zeros(0, bool)
    return row[ok], sum_[ok]
