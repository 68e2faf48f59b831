"""Language identification by compression: the language whose dictionary compresses a text best.

Each language's dictionary is raw content for zstandard: an even share of each sample text of that language, DICT_BYTES in
all or as many as there are. A sample shorter than the longest is repeated to its length, which adds nothing to find but
lets zstandard treat all dictionaries alike; a rare language so leaves the dictionaries of the others whole. Many
languages share ALL_BYTES, so that a dirty column costs time for each of its values but neither memory nor the job.
A text is cut into blocks of BLOCK characters, every block is compressed once with every dictionary, and the sizes
are added up, so the end of a long text counts like its start. The smallest sum wins. The score is the softmax of the
saved bytes a block; where the margin to the runner-up is under MARGIN of the smallest sum the prediction is `rejected`
(the best guess still stands in lang_pred).

Edge cases: null text or text without letters is `und` with score 0; ties take the language first in order; repeated
rows are predicted alike; without any labelled text everything is `und`; a language of a few bytes has a dictionary of
them, one whose texts are all empty has none; of many copies of a text one is learned from; an empty table gives an empty result; lang, source and ids never reach a prediction; columns
called lang_pred, score or rejected are replaced.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packreview.llm.common import is_held_out, map_rows, materialise, table

#: The documented bound of the training sample: texts of each language, and bytes of each dictionary.
DOCS_PER_LANG, DICT_BYTES = 120, 96 << 10
#: Bytes of all dictionaries together.
ALL_BYTES = 64 << 20
BLOCK, LEVEL, MARGIN = 3000, 3, 0.01


def training_texts(docs: DataFrame, per_lang: int = DOCS_PER_LANG, size: int = DICT_BYTES) -> dict[str, list[str]]:
    """Parts of at most per_lang different texts of each language, chosen by a hash of the text; held-out rows are left out.

    Copies count once: a threshold for the hash is set from the number of different texts, and no sort brings the rows
    of a language together. Each text gives an even share of `size` and what a whole small language lacks besides, from
    its beginning on; the shares are cut in the executors, so about twice `size` for each language comes back.
    """
    seen = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    seen = seen.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text", F.lit(3)).alias("h"))
    counts = seen.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    # twice the share that is wanted, and at least the whole of a small language: the count is an estimate
    bound = (F.least(F.lit(1.0), 2.0 * per_lang / F.greatest("n", F.lit(1))) * (1 << 30)).cast("long")
    bounds = materialise(counts.select("lang", bound.alias("bound"), F.ceil(size / F.least("n", F.lit(per_lang)) * 1.25).cast("int").alias("share")), "languages")
    drawn = seen.join(bounds, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("bound"))
    rows = drawn.groupBy("lang", "h").agg(F.min(F.substring("text", F.lit(1), F.col("share"))).alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h % (1 << 30), r.text)):
        if len(out.setdefault(r.lang, [])) < per_lang:
            out[r.lang].append(r.text)
    return out


def dictionaries(texts: dict[str, list[str]], size: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw dictionaries of at most `size` bytes from each language's own sample, short ones repeated to the longest."""
    size = max(1 << 10, min(size, ALL_BYTES // max(1, len(texts))))
    joined = {lang: "\n".join(ts).encode("utf-8", "surrogatepass") for lang, ts in texts.items()}
    kept = {lang: joined[lang][:size] + b"\n" for lang in sorted(joined) if joined[lang].strip()}
    most = max(map(len, kept.values()), default=1) - 1
    return {lang: (b * -(-most // len(b)))[:most].ljust(8, b"\n") for lang, b in kept.items()}


class Compressors:
    def __init__(self, dicts: dict[str, bytes]):
        self.langs = list(dicts)
        self.each = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))

    def sizes(self, text: str) -> tuple[np.ndarray, int]:
        blocks = [text[i : i + BLOCK].encode("utf-8", "surrogatepass") for i in range(0, len(text), BLOCK)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.each], float), len(blocks)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        s, blocks = self.sizes(text)
        best = int(np.argmin(s))
        p = np.exp(-np.clip((s - s[best]) / (4 * blocks), 0, 50))
        rest = np.partition(s, 1)[1] if len(s) > 1 else s[best] * 2
        return self.langs[best], float(1 / p.sum()), bool(rest - s[best] < MARGIN * s[best])


def identify(docs: DataFrame, dicts: dict[str, bytes]) -> DataFrame:
    """Adds lang_pred, score and rejected to docs(text, ...); other columns pass through. No shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(dicts)  # DICT_BYTES for each language
    state: list[Compressors] = []

    def run(texts: list[str | None]) -> dict[str, list]:
        if not state:
            state.append(Compressors(shipped.value))
        got = [state[0].predict(t) for t in texts]
        return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]}

    return map_rows(docs, run, "lang_pred string, score double, rejected boolean", [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")])


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dicts = dictionaries(training_texts(docs.select("doc_id", "text", "lang")))
    found = identify(docs.select("doc_id", "text"), dicts)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
