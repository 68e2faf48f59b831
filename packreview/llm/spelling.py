"""Spelling variants: each frequent word with its near words, the more frequent form it varies, and that form's root.

A word is a maximal run of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z made lower case; a run whose hash with the
document's id divides by DROP loses a letter (a slip that is planted so that there is something to find). Words of at
least LEAST_LETTERS letters and LEAST_N occurrences are compared: near words differ by one inserted, deleted or
replaced letter.

Of a pair whose shorter word has m letters either the first m // 2 are equal or the last m - m // 2. So each word is
dealt out by its halves, with m as its own length and as one less, and words of an equal half meet in a task. There a
minimal acyclic automaton of all words at hand (of the words turned round, for second halves) is walked by each word's half
exactly and on from there with one error; the automaton's perfect hash gives the number of the word that is reached.
A pair with both halves in common would be found in both directions and counts in the first. Only one row for each word
and half leaves a task, never pairs.

A half that more than GROUP words share is cut into blocks, and its blocks meet in pairs, so no task holds more than
two blocks of it whatever the vocabulary.

Edge cases: null text has no words and a null id counts as ''; repeated rows count as the rows they are; ties between forms
go to the word that is smallest in code-point order; words of any length are words (a walk is one pass over the letters,
one automaton holds BATCH letters or one word); chains of forms end, as counts grow fivefold at each step; an empty table
gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packreview.llm.automaton import Automaton, one_error
from packreview.llm.common import materialise, reach_workers, table
from packreview.llm.termcounts import HELD_BYTES, HELD_TERMS, counted

LEAST_LETTERS, LEAST_N, TIMES, DROP = 6, 5, 5, 199
#: Words that share a half and meet in one automaton; more are cut into blocks. Words and letters of an automaton.
GROUP, BATCH_WORDS, BATCH = 50_000, 20_000, 400_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else (b if b >= 0xC0 or 97 <= b <= 122 else 32) for b in range(256))


def runs_of(text: str) -> list[bytes]:
    """The runs in Latin-1, a byte for each letter; every other character parts them."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


class Slips:
    """(word, n) of the rows added, with the planted slips."""

    def __init__(self):
        self._start()

    def _start(self) -> None:
        self.words: dict[bytes, int] = {}
        self.bytes = 0

    def add(self, columns: list[list], texts: list[bytes]) -> None:
        words = self.words
        for key, text in zip(columns[0], texts, strict=True):
            begin = zlib.crc32(f"{'' if key is None else key}:".encode())
            for run, n in Counter(r for r in runs_of(text.decode("utf-8", "replace")) if len(r) >= LEAST_LETTERS).items():
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begin)
                if h % DROP == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST_LETTERS:
                        continue
                if run in words:
                    words[run] += n
                else:
                    words[run] = n
                    self.bytes += len(run)

    def full(self) -> bool:
        return len(self.words) > HELD_TERMS or self.bytes > HELD_BYTES

    def take(self) -> list[list]:
        out = [[w.decode("latin-1") for w in self.words], list(self.words.values())]
        self._start()
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that are compared, over docs(doc_id, text)."""
    parts = counted(docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")), Slips, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


def dealt(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(back, m, half, i, j, word, n): rows with an equal (back, m, half, i, j) meet; block i asks and block j answers."""
    lengths = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    rows = words.select("word", "n", lengths).select("word", "n", "m", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    h = F.floor(F.col("m") / 2).cast("int")
    half = F.when(F.col("back"), F.substring(F.reverse("word"), F.lit(1), F.col("m") - h)).otherwise(F.substring("word", F.lit(1), h))
    rows = rows.withColumn("half", half)
    keys = ["back", "m", "half"]
    blocks = F.ceil(F.count("*") / group).cast("int").alias("blocks")
    hot = materialise(rows.groupBy(*keys).agg(blocks).where("blocks > 1"), "hot-halves")
    whole = lambda df: df.select(*keys, F.lit(0).alias("i"), F.lit(0).alias("j"), "word", "n", F.lit(True).alias("asks"), F.lit(True).alias("answers"))
    if hot.isEmpty():
        return whole(rows)
    own = (F.pmod(F.xxhash64("word"), F.col("blocks")) + 1).cast("int")  # 0 is for halves that are not cut
    cut = rows.join(hot, keys).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(1), F.col("blocks"))))
    asks = cut.select(*keys, F.col("own").alias("i"), F.col("other").alias("j"), "word", "n", F.lit(True).alias("asks"), (F.col("own") == F.col("other")).alias("answers"))
    answers = cut.where("own <> other").select(*keys, F.col("other").alias("i"), F.col("own").alias("j"), "word", "n", F.lit(False).alias("asks"), F.lit(True).alias("answers"))
    return whole(rows.join(hot, keys, "left_anti")).unionByName(asks).unionByName(answers)


def _search(back: bool, asks: list[tuple[int, bytes]], answers: dict[bytes, int]) -> Iterator[tuple[bytes, int, int, bytes]]:
    """(word, near words, n of the best, the best) of asks (m, word), which meet the words of answers (word -> n)."""
    turn = (lambda w: w[::-1]) if back else (lambda w: w)
    known = sorted(map(turn, answers))
    if not known or not asks:
        return
    a = Automaton(known)
    plain = [turn(w) for w in known]
    n = np.array([answers[w] for w in plain], np.int64)
    order = np.empty(len(plain), np.int64)
    order[np.array(sorted(range(len(plain)), key=plain.__getitem__), np.int64)] = np.arange(len(plain))
    classes: dict[tuple[int, int], list[bytes]] = {}
    for m, word in asks:
        classes.setdefault((m, len(word)), []).append(word)
    for (m, length), words in classes.items():
        letters = np.frombuffer(b"".join(map(turn, words)), np.uint8).reshape(len(words), length)
        row, number = one_error(a, letters, m - m // 2 if back else m // 2, length == m)
        if back:  # those with the first half in common are found forwards
            h = m // 2
            fresh = np.fromiter((words[r][:h] != plain[k][:h] for r, k in zip(row.tolist(), number.tolist(), strict=True)), bool, len(row))
            row, number = row[fresh], number[fresh]
        best = np.lexsort((order[number], -n[number], row))
        row, number = row[best], number[best]
        first, many = np.unique(row, return_index=True, return_counts=True)[1:]
        for k, c in zip(first.tolist(), many.tolist(), strict=True):
            yield words[row[k]], c, int(n[number[k]]), plain[number[k]]


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n, n_near, best_n, best): the number of near words of each of words(word, n), and the most frequent of them."""
    reach_workers(words.sparkSession)
    keys = ["back", "m", "half", "i", "j"]
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks: list[tuple[int, bytes]] = []
        answers: dict[bytes, int] = {}
        before, letters = None, 0

        def out() -> Iterator[pa.RecordBatch]:
            got = list(_search(before[0], asks, answers))
            if got:
                text = lambda k: pa.array([g[k].decode("latin-1") for g in got], pa.string())
                yield pa.RecordBatch.from_arrays([text(0), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), text(3)], schema=schema)

        for batch in batches:
            for *key, word, n, is_asking, answering in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # halves that follow one another share an automaton, blocks of a hot half have their own
                if before is not None and key != before and (key[0] != before[0] or key[3:] != [0, 0] or before[3:] != [0, 0] or len(answers) > BATCH_WORDS or letters > BATCH):
                    yield from out()
                    asks, answers, letters = [], {}, 0
                before, own = key, word.encode("latin-1")
                if is_asking:
                    asks.append((key[1], own))
                if answering and own not in answers:
                    answers[own] = n
                    letters += len(own)
        if before is not None:
            yield from out()

    rows = dealt(words, group).select(*keys, "word", "n", "asks", "answers")
    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "word string, near long, best_n long, best string")
    none = lambda kind: F.lit(None).cast(kind)
    every = found.withColumn("n", none("long")).unionByName(
        words.select("word", "n", F.lit(0).cast("long").alias("near"), none("long").alias("best_n"), none("string").alias("best"))
    )
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    out = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("b"))
    return out.select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): the last word on each chain. The way that is known doubles with each round, and
    no chain has over 26 words, as each form occurs five times as often as the one before."""
    known = forms.select("word", F.col("form").alias("root"))
    for _ in range(5):
        known = materialise(known, "roots")
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = materialise(further, "roots")
        if further.where("moved").isEmpty():
            return known
        known = further.drop("moved")
    return known


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) over docs(doc_id, text)."""
    words = materialise(word_counts(docs), "words")
    near = materialise(near_words(words), "near")
    is_form = F.col("best_n") >= TIMES * F.col("n")
    near = near.select("word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    last = roots(near.where("form is not null"))
    out = near.join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
