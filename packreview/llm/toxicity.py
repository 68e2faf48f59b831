"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams (word ends marked) and itself, so an unseen misspelling shares
most of its vectors with the word it came from. A window of `window` words is the mean of its subword vectors under
a two-class linear softmax; a text's score is that of its most toxic window, so one insult in a long text is not
averaged away. Training picks that window anew in each epoch from the label of the whole text.

As the mean and the softmax's logits are linear, a word's part of a window's logit is one number: scoring keeps a
bounded memo of word -> (sum of subword scores, number of subwords) and never touches the vectors.

Edge cases: null, empty or blank texts have the score of the bias alone, or of zero vectors under a bias of -1.5 where
that is lower, so they are below the threshold; of several texts of one labelled id the least is learned from; repeated rows are
scored alike; a table without labels of both classes gives every text the training share of toxic labels (0 if none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packreview.llm.common import fitted, is_held_out, map_rows, materialise, table
from packreview.llm.textbag import WordScores, fold_words, word_table

#: Training rows of each class at most: the documented bound of the sample that the classifier is fitted on.
PER_CLASS = 1500
#: Classes or grades at most; more are binned. Characters of a text that is learned from.
MAX_CLASSES, SAMPLE_CHARS = 128, 200_000
BUCKETS, DIM, WINDOW, STRIDE = 1 << 17, 8, 12, 6
ORDERS = (3, 4, 5)
THRESHOLD = 0.3


@dataclass
class ToxicModel:
    subword: np.ndarray  # float32[BUCKETS], logit difference of each subword
    bias: float


def window_bounds(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts of these word counts, laid one after another: (text, first word, end). A text without words has none."""
    n = np.where(sizes > 0, np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    base = (np.cumsum(sizes) - sizes)[text]
    lo = k * STRIDE
    return text, base + lo, base + np.minimum(lo + WINDOW, sizes[text])


def window_logits(sums: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    text, lo, hi = window_bounds(sizes)
    s, c = np.concatenate([[0.0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(counts)])
    return text, lo, hi, (s[hi] - s[lo]) / np.maximum(1, c[hi] - c[lo])


def fit(texts: list[str], labels: list[int], share: float, seed: int = 7) -> ToxicModel:
    """Joint training of vectors and softmax by AdaGrad; `share` is the share of toxic labels to correct the bias for."""
    y = np.asarray(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
        return ToxicModel(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    docs, flat, sizes = word_table(texts, fold_words, ORDERS, BUCKETS)
    if not len(sizes):
        return fit(texts, [0] * len(texts), share)
    ends = np.cumsum(sizes)
    E = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    W = rng.normal(0, 0.4, DIM).astype(np.float32)
    b, gE, gW, gb = 0.0, np.full(BUCKETS, 1e-4, np.float32), np.full(DIM, 1e-4, np.float32), 1e-4
    weight = np.where(y > 0, 0.5 * len(y) / y.sum(), 0.5 * len(y) / (len(y) - y.sum()))
    lengths = np.array([len(d) for d in docs])
    joined = np.concatenate(docs)
    steps = -(-len(docs) // 32)
    for epoch in range(max(6, min(60, 1100 // steps))):
        if epoch == 0:  # no window is known to be the toxic one yet: words of the whole text, drawn anew
            picks = [d if len(d) <= 100 else d[rng.integers(0, len(d), 100)] for d in docs]
        else:
            per_word = np.add.reduceat((E @ W)[flat], ends - sizes)
            text, lo, hi, z = window_logits(per_word[joined], sizes[joined], lengths)
            best = np.lexsort((-z, text))
            first = best[np.unique(text, return_index=True)[1]]
            picks = [np.zeros(0, np.int64)] * len(docs)
            for i in first:
                picks[text[i]] = joined[lo[i] : hi[i]]
        shuffled = rng.permutation(len(docs))
        rate = 0.5 if epoch else 1.0
        for a in range(0, len(shuffled), 32):
            rows = np.array([i for i in shuffled[a : a + 32] if len(picks[i])])
            if not len(rows):
                continue
            w = np.concatenate([picks[i] for i in rows])
            n = sizes[w]
            cat = flat[np.repeat(ends[w] - np.cumsum(n), n) + np.arange(n.sum())]
            per_doc = np.add.reduceat(n, np.cumsum([0] + [len(picks[i]) for i in rows[:-1]]))
            mean = np.add.reduceat(E[cat], np.cumsum(per_doc) - per_doc) / per_doc[:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ W + b, -30, 30)))
            g = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            dW, db = mean.T @ g, float(g.sum())
            step = np.bincount(cat, np.repeat(8 * g / per_doc, per_doc), BUCKETS).astype(np.float32)
            hit = np.flatnonzero(step)
            gE[hit] += step[hit] ** 2
            E[hit] -= rate * (step[hit] / np.sqrt(gE[hit]))[:, None] * W[None, :]
            gW += dW**2
            gb += db**2
            W -= 0.1 * dW / np.sqrt(gW)
            b -= 0.1 * db / np.sqrt(gb)
    share = min(max(share, 1e-3), 1 - 1e-3)
    return ToxicModel((E @ W).astype(np.float32), float(b + np.log(share / (1 - share))))


def score_texts(texts: list[str | None], words: WordScores, bias: float) -> np.ndarray:
    """Score of each whole text: the softmax of its most toxic window."""
    lists = [fold_words(t) for t in texts]
    sums, counts = words.of(lists)
    text, _, _, z = window_logits(sums, counts, np.fromiter(map(len, lists), np.int64, len(lists)))
    top = np.full(len(lists), -np.inf)
    np.maximum.at(top, text, z)
    # without words: the softmax of the bias alone, or of zero vectors, whichever is less toxic
    top = np.where(np.isfinite(top), top + bias, min(bias, -1.5))
    return 1 / (1 + np.exp(-np.clip(top, -60, 60)))


def rated(labels: DataFrame, label: str, most: int = MAX_CLASSES) -> DataFrame:
    """Rows outside the held-out quarter with their label as y: whole numbers as long, others as double; null and NaN are no
    label. More than `most` different grades are binned: y is the lower end of one of `most` equal stretches."""
    whole = labels.schema[label].dataType.typeName() in ("boolean", "byte", "short", "integer", "long")
    rows = labels.where(~is_held_out(F.col("doc_id"))).withColumn("y", F.col(label).cast("long" if whole else "double"))
    rows = rows.where(F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double")))
    if rows.select("y").distinct().limit(most + 1).count() <= most:
        return rows
    y = F.col("y").cast("double")
    low, high = rows.where(F.abs(y) < float("inf")).agg(F.min(y), F.max(y)).first()
    step = (high - low) / most or 1.0
    bin_ = F.least(F.greatest(F.floor((y - low) / step), F.lit(0)), F.lit(most - 1))
    return rows.withColumn("y", low + bin_ * step)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> DataFrame:
    """(key, text, y): at most per_class labelled rows of each class, chosen by a hash of the id, never of the held-out
    quarter. Of several texts of one id the least is taken, and of several labels the greatest; texts of more than
    SAMPLE_CHARS are not learned from, so the sample is bounded in bytes too."""
    lab = rated(labels, label).groupBy("doc_id").agg(F.max("y").alias("y"))
    lab = lab.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)))
    # of a large class only so many of the least hashes as hold twice the sample are put in order
    share = 2.0 * per_class / F.count("*")
    bound = F.when(share < 0.9, (-(2.0**63) + share * 2.0**64).cast("long")).otherwise(F.lit(2**63 - 1))
    lab = lab.join(lab.groupBy("y").agg(bound.alias("bound")), "y").where(F.col("h") <= F.col("bound"))
    place = F.row_number().over(Window.partitionBy("y").orderBy("h", "doc_id"))
    # written, so that Spark knows how small it is: per_class rows for each class
    some = materialise(lab.withColumn("place", place).where(F.col("place") <= per_class).select("doc_id", "y"), "sample")
    rows = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).join(some, "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return rows.select(F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text"), "y")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicModel:
    """Fits on a bounded sample in one task; the share of toxic labels is counted over all labelled rows outside the
    held-out quarter."""
    sample = training_sample(docs, labels, "toxic", per_class)
    seen = labels.where(F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
    share = seen.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    learn = lambda rows: fit([t for _, t, _ in sorted(rows)], [int(y == 1) for *_, y in sorted(rows)], share)
    return fitted(sample, learn)


def score(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """Adds toxic_score and toxic_predicted to docs(text, ...); its other columns pass through. No shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.subword, model.bias))  # 0.5 MB whatever the input
    seen: dict[str, WordScores] = {}

    def run(texts: list[str | None]) -> dict[str, list]:
        subword, bias = shipped.value
        if not seen:
            seen["words"] = WordScores(subword, ORDERS)
        s = score_texts(texts, seen["words"], bias)
        return {"toxic_score": s, "toxic_predicted": (s >= threshold).astype(np.int32)}

    return map_rows(docs, run, "toxic_score double, toxic_predicted int", [c for c in docs.columns if c not in ("toxic_score", "toxic_predicted")])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted")
    )
