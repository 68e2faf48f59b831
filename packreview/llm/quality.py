"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(f - threshold_k) with one score f for all grades: the mean of hashed weights over a text's words
and byte trigrams, shared by all thresholds, which are kept in order by learning their (positive) gaps. The expected
grade is the sum of the tail probabilities; P(grade >= keep_grade) selects texts.

Edge cases: null, empty or blank texts have f = 0 and so the thresholds' base rates; grades may be fractions,
and more than toxicity.MAX_CLASSES of them are binned into so many; one grade only, or no labels, gives
every text that grade (0 if none); ties and repeated rows are scored alike; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packreview.llm.common import fitted, is_held_out, map_rows, table
from packreview.llm.textbag import WordScores, word_table
from packreview.llm.toxicity import rated, training_sample

PER_GRADE = 1200  # the documented bound of the training sample, for each grade
BUCKETS, ORDERS, SELECT = 1 << 17, (3,), 0.5


@dataclass
class OrdinalModel:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words with their punctuation, which tells junk from prose."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[str], ratings: list[float], priors: dict[float, float] | None = None, epochs: int = 12, seed: int = 3) -> OrdinalModel:
    """AdaGrad on the negative log likelihood of the ratings, each grade weighted to its share `priors`."""
    grades = sorted(set(ratings))
    if len(grades) < 2:
        return OrdinalModel(grades or [0], np.zeros(BUCKETS, np.float32), np.zeros(0))
    y = np.searchsorted(grades, ratings)
    numbers, flat, sizes = word_table(texts, plain_words, ORDERS, BUCKETS)
    ends = np.cumsum(sizes)
    docs = []
    for w in numbers:  # a text as (bucket, how many of its features)
        n = sizes[w]
        f = flat[np.repeat(ends[w] - np.cumsum(n), n) + np.arange(n.sum())] if len(w) else flat[:0]
        idx, c = np.unique(f, return_counts=True)
        docs.append((idx, c.astype(np.int32)))
    share = np.bincount(y, minlength=len(grades)) / len(y)
    want = np.array([(priors or {}).get(g, s) for g, s in zip(grades, share, strict=True)])
    weight = want / share
    rng, k = np.random.default_rng(seed), len(grades) - 1
    w, gw = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    cum = np.clip(1 - np.cumsum(want / want.sum())[:-1], 0.01, 0.99)
    theta = -np.log(cum / (1 - cum))
    base, gaps = theta[0], np.log(np.maximum(np.diff(theta), 1e-2))
    gt = np.full(k, 1e-4)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            idx, c = docs[i]
            if not len(idx):
                continue
            x = c / c.sum()
            theta = base + np.concatenate([[0], np.cumsum(np.exp(gaps))])
            f = float(w[idx] @ x)
            tail = np.concatenate([[1.0], _sigmoid(f - theta), [0.0]])  # P(grade >= j)
            p = max(tail[y[i]] - tail[y[i] + 1], 1e-9)
            slope = tail * (1 - tail)
            df = weight[y[i]] * -(slope[y[i]] - slope[y[i] + 1]) / p
            g = df * x
            gw[idx] += g * g
            w[idx] -= 0.5 * g / np.sqrt(gw[idx])
            dt = np.zeros(k)
            if y[i] > 0:
                dt[y[i] - 1] += slope[y[i]] / p
            if y[i] < k:
                dt[y[i]] -= slope[y[i] + 1] / p
            dt *= weight[y[i]]
            dg = np.concatenate([[dt.sum()], [np.exp(gaps[j]) * dt[j + 1 :].sum() for j in range(k - 1)]])
            gt += dg * dg
            move = 0.05 * dg / np.sqrt(gt)
            base, gaps = base - move[0], gaps - move[1:]
    return OrdinalModel(grades, w.astype(np.float32), base + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def grade_shares(labels: DataFrame, rating: str) -> dict[float, float]:
    """The share of each grade over all rated rows outside the held-out quarter."""
    rows = rated(labels, rating).groupBy("y").agg(F.count("*").alias("n")).collect()  # MAX_CLASSES rows at most
    return {r.y: r.n / sum(r.n for r in rows) for r in rows}


def train(docs: DataFrame, labels: DataFrame, rating: str = "quality", per_grade: int = PER_GRADE) -> OrdinalModel:
    """Fits on a bounded sample of the ratings in one task, with the grades' shares over all rated rows."""
    sample = training_sample(docs, labels, rating, per_grade)
    shares = grade_shares(labels, rating)
    return fitted(sample, lambda rows: fit([t for _, t, _ in sorted(rows)], [y for *_, y in sorted(rows)], shares))


def grade(docs: DataFrame, model: OrdinalModel, keep_grade: float | None = None) -> DataFrame:
    """Adds expected_grade, tail (array: P(grade > each lower grade)), p_keep and keep to docs(text, ...). No shuffle."""
    keep_grade = model.grades[-1] if keep_grade is None else keep_grade
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    seen: dict[str, WordScores] = {}

    def run(texts: list[str | None]) -> dict[str, list]:
        m = shipped.value
        if not seen:
            seen["words"] = WordScores(m.weights, ORDERS)
        lists = [plain_words(t) for t in texts]
        sums, counts = seen["words"].of(lists)
        text = np.repeat(np.arange(len(lists)), list(map(len, lists)))
        f = np.bincount(text, sums, len(lists)) / np.maximum(1, np.bincount(text, counts, len(lists)))
        tail = _sigmoid(f[:, None] - m.thresholds[None, :])
        steps = np.diff(m.grades)
        at = int(np.searchsorted(m.grades, keep_grade))
        p = np.ones(len(lists)) if at == 0 else (tail[:, at - 1] if at <= tail.shape[1] else np.zeros(len(lists)))
        return {"expected_grade": m.grades[0] + tail @ steps if len(steps) else np.full(len(lists), float(m.grades[0])), "tail": list(tail), "p_keep": p, "keep": p >= SELECT}

    made = ("expected_grade", "tail", "p_keep", "keep")
    return map_rows(docs, run, "expected_grade double, tail array<double>, p_keep double, keep boolean", [c for c in docs.columns if c not in made])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, expected_grade, p_keep (P(quality >= 1)), keep. More than two grades need no change."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = grade(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "p_keep", "keep")
