"""Benchmark decontamination: an FM-index per training shard, searched backwards for every benchmark window.

A task cuts its texts into shards of a few million characters. Words are numbered by the benchmark's vocabulary;
any other word is a separator, and a stretch between separators that is shorter than the shortest window is left out,
as no window can lie in it (no match is lost: windows hold vocabulary words only). Over the rest the shard's suffix
array, its Burrows-Wheeler transform in a wavelet matrix, and every SAMPLE-th suffix position make the FM-index. All
windows are searched at once, last word first, each step two rank queries; occurrences are located by walking back to
a sampled position; their words are marked and joined into removal spans. Nothing is shuffled, and what a task holds
depends on the shard and on the benchmark block, not on the input.

Benchmarks are a query set: they are read in blocks of at most BLOCK_WORDS words and each block is broadcast. When
there are more than MAX_BLOCKS blocks, the texts are read once for each group of blocks, whose hits are written and whose
blocks are freed before the next group is shipped; the hits are merged by row.

Edge cases: null, empty or wordless texts have no words and no hits; items without words match nothing; an item of
fewer than `size` words is one window, one of more than BLOCK_WORDS goes in parts; repeated items with one id count once, items with a null id mark words but
are not listed; repeated documents and very long ones are returned whole; extra columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain, islice, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packreview.llm.common import map_rows, materialise, table
from packreview.llm.textbag import fold_words

WINDOW, SAMPLE, BLOCK_WORDS, MAX_BLOCKS = 10, 8, 200_000, 10
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass
class Windows:
    """Distinct windows of a block of benchmark items, over the block's vocabulary numbered from 1."""

    vocab: dict[bytes, int]
    words: np.ndarray  # int32[windows, size], 0 after the end of a short one
    sizes: np.ndarray
    items: list[list[str]]  # ids of the items that hold each window


def windows_of(rows: list[tuple[object, list[bytes]]], size: int = WINDOW) -> Windows:
    vocab: dict[bytes, int] = {}
    found: dict[tuple, dict[str, None]] = {}
    for item, words in rows:
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in words]
        for i in range(max(1, len(ids) - size + 1) if ids else 0):
            names = found.setdefault(tuple(ids[i : i + size]), {})
            if item is not None:
                names[str(item)] = None
    table_ = np.zeros((len(found), size), np.int32)
    for i, w in enumerate(found):
        table_[i, : len(w)] = w
    return Windows(vocab, table_, np.fromiter(map(len, found), np.int64, len(found)), list(map(list, found.values())))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s in order, by doubling the length they are ranked by."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(new)
        if n == 0 or rank[order[-1]] == n:
            return order
        k *= 2


@dataclass
class FMIndex:
    """Backward search and locating over a sequence of small integers; 0 is never searched for."""

    text: np.ndarray
    sample: int = SAMPLE
    levels: list[tuple[int, np.ndarray, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        s = np.concatenate([self.text.astype(np.int64), [-1]]) + 1  # a smallest last symbol of its own
        sa = suffix_array(s)
        self.n = len(s)
        self.bwt = s[sa - 1]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(s))])
        at = self.bwt
        for bit in reversed(range(max(1, int(s.max()).bit_length()))):
            ones = (at >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]), int(self.n - ones.sum())))
            at = np.concatenate([at[ones == 0], at[ones == 1]])
        self.sampled = sa % self.sample == 0
        self.marks = np.cumsum(self.sampled) - 1
        self.positions = sa[self.sampled]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs in the first i symbols of the transform."""
        lo = np.zeros_like(i)
        for bit, ones, zeros in self.levels:
            up = (c >> bit) & 1 == 1
            i, lo = np.where(up, zeros + ones[i], i - ones[i]), np.where(up, zeros + ones[lo], lo - ones[lo])
        return i - lo

    def search(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each row of words; empty where first == end."""
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        for j in reversed(range(words.shape[1])):
            on = np.flatnonzero((sizes > j) & (hi > lo))
            c = words[on, j].astype(np.int64) + 1
            known = c < len(self.start) - 1
            hi[on[~known]] = lo[on[~known]]
            on, c = on[known], c[known]
            lo[on], hi[on] = self.start[c] + self.rank(c, lo[on]), self.start[c] + self.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[rows[left]]
            out[left[done]] = self.positions[self.marks[rows[left[done]]]] + steps
            left = left[~done]
            c = self.bwt[rows[left]]
            rows[left] = self.start[c] + self.rank(c, rows[left])
            steps += 1
        return out


def find(lists: list[list[bytes]], win: Windows) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Over the words of the texts, one after another: which are hit; (text, window) of all occurrences."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    hit = np.zeros(int(n.sum()) + 1, np.int64)
    if not len(win.sizes) or not n.sum():
        return hit[:-1] > 0, []
    ids = np.fromiter((x for ws in lists for x in map(win.vocab.get, ws, repeat(0))), np.int32, int(n.sum()))
    doc = np.repeat(np.arange(len(lists)), n)
    cut = np.flatnonzero((ids[1:] == 0) != (ids[:-1] == 0)) + 1
    cut = np.unique(np.concatenate([[0], cut, np.cumsum(n)[:-1], [len(ids)]]))
    cut = cut[cut <= len(ids)]
    a, b = cut[:-1], cut[1:]
    use = (b - a >= win.sizes.min()) & (ids[np.minimum(a, len(ids) - 1)] > 0)
    a, b = a[use], b[use]
    if not len(a):
        return hit[:-1] > 0, []
    size = b - a + 1  # each stretch is followed by a separator
    where = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
    seq = ids[np.minimum(where, len(ids) - 1)]
    seq[np.cumsum(size) - 1] = 0
    fm = FMIndex(seq)
    lo, hi = fm.search(win.words, win.sizes)
    count = np.maximum(0, hi - lo)
    w = np.repeat(np.arange(len(count)), count)
    at = where[fm.locate(np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum()))]
    np.add.at(hit, at, 1)
    np.add.at(hit, at + win.sizes[w], -1)
    pairs = np.unique(doc[at] * len(count) + w) if len(at) else np.zeros(0, np.int64)
    return np.cumsum(hit[:-1]) > 0, [(int(p // len(count)), int(p % len(count))) for p in pairs]


def char_spans(text: str, hit: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(begin, end, first, last) of each stretch of hit words: code points, end exclusive, and words, last inclusive."""
    out: list[tuple[int, int, int, int]] = []
    for i, m in enumerate(_WORD.finditer(text.translate(_LOWER))):
        if hit[i]:
            if out and out[-1][3] == i - 1:
                out[-1] = (out[-1][0], m.end(), out[-1][2], i)
            else:
                out.append((*m.span(), i, i))
    return out


def merged_spans(spans: list[dict]) -> list[dict]:
    """Stretches found with different blocks, as one search for all of them would give them: those that share or adjoin words are one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["last"] + 1:
            if s["last"] > out[-1]["last"]:
                out[-1] |= {"end": s["end"], "last": s["last"]}
        else:
            out.append(dict(s))
    return out


def search_texts(texts: list[str | None], blocks: list[Windows]) -> dict[str, list]:
    lists = [fold_words(t) for t in texts]
    n = [len(x) for x in lists]
    hit, items = np.zeros(sum(n), bool), [set() for _ in lists]
    for win in blocks:
        h, pairs = find(lists, win)
        hit |= h
        for text, w in pairs:
            items[text].update(win.items[w])
    ends = np.cumsum(n)
    each = [hit[e - k : e] for e, k in zip(ends, n, strict=True)]
    return {
        "n_words": n,
        "hit_words": [np.flatnonzero(h) for h in each],
        "items": [sorted(x) for x in items],
        "spans": [[dict(zip(("begin", "end", "first", "last"), x, strict=True)) for x in char_spans(t, h)] if h.any() else [] for t, h in zip(texts, each, strict=True)],
    }


def benchmark_blocks(bench: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS):
    """Windows of the benchmark, block by block in the order of item ids; one block is on the driver at a time.

    An item beyond block_words is cut into parts of that many windows, which go into blocks of their own.
    """
    rows, held = [], 0
    for r in bench.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        words = fold_words(r.text)
        for a in range(0, max(1, len(words) - size + 1), block_words):
            part = words[a : a + block_words + size - 1]
            rows.append((r.item_id, part))
            held += len(part)
            if held >= block_words:
                yield windows_of(rows, size)
                rows, held = [], 0
    if rows:
        yield windows_of(rows, size)


def decontaminate(docs: DataFrame, bench: DataFrame, size: int = WINDOW) -> DataFrame:
    """Adds n_words, n_hit, items (sorted item ids) and spans (code points to remove) to docs(text, ...)."""
    made = "n_words int, hit_words array<int>, items array<string>, spans array<struct<begin:int,end:int,first:int,last:int>>"
    sc = docs.sparkSession.sparkContext
    keep = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans", "hit_words")]

    def scan(df: DataFrame, part: list, columns: list[str]) -> DataFrame:
        return map_rows(df, lambda texts: search_texts(texts, [b.value for b in part]), made, columns)

    span = lambda c: F.transform(c, lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end")))
    blocks = benchmark_blocks(bench, size)
    group = [sc.broadcast(win) for win in islice(blocks, MAX_BLOCKS)]  # at most BLOCK_WORDS words each
    more = next(blocks, None)
    if more is None:
        out = scan(docs, group, keep)
        return out.select(*keep, "n_words", F.size("hit_words").alias("n_hit"), "items", span("spans").alias("spans"))
    rows = materialise(docs.select(*keep, F.monotonically_increasing_id().alias("__row")), "rows")
    hits = None
    while group:  # a group's hits are written before the next group is read, so one group is shipped at a time
        part = materialise(scan(rows, group, ["__row"]), "hits")
        hits = part if hits is None else hits.unionByName(part)
        for b in group:
            b.destroy()
        follow = islice(blocks, MAX_BLOCKS) if more is None else chain([more], islice(blocks, MAX_BLOCKS - 1))
        group, more = [sc.broadcast(win) for win in follow], None
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  at most a text's own words
    hits = hits.groupBy("__row").agg(
        F.max("n_words").alias("n_words"), F.size(flat("hit_words")).alias("n_hit"), flat("items").alias("items"), F.flatten(F.collect_list("spans")).alias("__spans"),
    )

    def merge(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("begin", "end", "first", "last")]))
        for b in batches:
            at = b.schema.get_field_index("__spans")
            yield b.set_column(at, "__spans", pa.array([merged_spans(x) for x in b.column(at).to_pylist()], kind))

    hits = hits.mapInArrow(merge, hits.schema)
    return rows.join(hits, "__row").select(*keep, "n_words", "n_hit", "items", span("__spans").alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("long"), F.col("n_hit").cast("long"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
