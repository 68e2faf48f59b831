"""How the sources of a language differ in their use of words, by integer-dictionary encoding.

Terms are maximal runs of letters of A-Z and a-z and of all characters beyond ASCII; A-Z alone become lower case. Counts
of (lang, source, term) are gathered in the tasks, added up by key, and dealt by ranges of (lang, term), so that each
task holds a stretch of the language's dictionary in UTF-8 order. There the kept terms are a sorted array; searchsorted
gives each row its id and bincount each source its vector. Ids keep the order of the terms, so ties need no strings.

A chunk is a stretch of CHUNK kept terms, named by its first one. Its sources' vectors are made dense a slice at a time
and compared in blocks of BLOCK sources; a pair of sources of which neither has a term in the chunk costs nothing
there, as the value that both would have in every term is added once at the end.

All arithmetic is on whole numbers: probabilities are parts in 10**9, worked out by long division, so counts up to
9 * 10**15 are exact.

Edge cases: null text, lang and source are read as ''; a group without terms, or a language without kept terms, still
gets its pairs (value 0 where no term is kept); a language with one source has no pairs; repeated rows count as the rows
they are; ties go by UTF-8 order; a term of any length is a term; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packreview.llm.common import materialise, reach_workers, table
from packreview.llm.termcounts import HELD_BYTES, HELD_TERMS, counted

#: Documents of a language that a kept term stands in, and ranks of a group's terms that are reported.
LEAST_DOCS, TOP_TERMS = 3, 200
#: Kept terms of a chunk, (term, source) counts of a chunk, terms made dense at a time, and sources of a block.
CHUNK, CELLS, SLICE, BLOCK = 1 << 15, 500_000, 1 << 11, 256
SCALE = 1_000_000_000
#: Binary digits of a value, from none to 63.
DIGITS = 64
_FOLD = bytes(b + 32 if 65 <= b <= 90 else (b if b >= 128 or 97 <= b <= 122 else 32) for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class GroupTerms:
    """(lang, source, term, n, docs) of the rows added; a group's row with the term '' says that it occurs."""

    def __init__(self):
        self._start()

    def _start(self) -> None:
        self.groups: dict[tuple, dict] = {}
        self.rows = self.bytes = 0

    def add(self, columns: list[list], texts: list[bytes]) -> None:
        for lang, source, text in zip(*columns, texts, strict=True):
            if (lang, source) not in self.groups:
                self.rows += 1
            seen = self.groups.setdefault((lang, source), {})
            for term, n in Counter(terms_of(text)).items():
                if cell := seen.get(term):
                    cell[0] += n
                    cell[1] += 1
                else:
                    seen[term] = [n, 1]
                    self.rows += 1
                    self.bytes += len(term)

    def full(self) -> bool:
        return self.rows > HELD_TERMS or self.bytes > HELD_BYTES

    def take(self) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        for (lang, source), seen in self.groups.items():
            cells = [[0, 0], *seen.values()]
            for column, more in zip(out, ([lang] * len(cells), [source] * len(cells), [b"", *seen], [c[0] for c in cells], [c[1] for c in cells]), strict=True):
                column.extend(more)
        out[2] = [t.decode() for t in out[2]]
        self._start()
        return out


def group_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) over all docs(text, lang, source), and a row with the term '' for each group."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = counted(rows, GroupTerms, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


CODED = "lang string, chunk string, source string, ids binary, counts binary, shared binary, terms array<string>, size long, total long"


def _coded(lang: str, terms: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[dict]:
    """A chunk's rows: its sorted kept terms (source null), and each source's ids, counts, and counts of the whole language."""
    source, term, n = rows
    ids = np.searchsorted(terms, term)
    names, of = np.unique(source, return_inverse=True)
    every = np.zeros(len(terms), np.int64)
    np.add.at(every, ids, n)
    yield {"lang": lang, "chunk": terms[0], "terms": terms.tolist(), "size": len(terms), "total": int(n.sum())}
    order = np.argsort(of, kind="stable")
    for k, part in enumerate(np.split(order, np.cumsum(np.bincount(of, minlength=len(names)))[:-1])):
        at = ids[part]
        vector = np.bincount(at, minlength=len(terms)) > 0  # ids of this source, in order
        counts = np.zeros(len(terms), np.int64)
        np.add.at(counts, at, n[part])
        own = np.flatnonzero(vector)
        yield {
            "lang": lang, "chunk": terms[0], "source": str(names[k]), "ids": own.astype("<i4").tobytes(), "counts": counts[own].astype("<i8").tobytes(),
            "shared": every[own].astype("<i8").tobytes(), "total": int(n[part].sum()),
        }


def encoded(counts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunks of the kept terms of each language with the vectors of its sources (CODED). Rows of an equal (lang, term) are
    at most as many as sources; they stand together as the table is dealt by ranges."""
    from pyspark.sql.types import StructType

    reach_workers(counts.sparkSession)
    fields = StructType.fromDDL(CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(fields)
        lang, kept, rows, term, cells, docs = None, [], [[], [], []], None, [], 0

        def close_term() -> None:
            if docs >= LEAST_DOCS:
                kept.append(term)
                for source, n in cells:
                    for column, x in zip(rows, (source, term, n), strict=True):
                        column.append(x)

        def close_chunk() -> Iterator[pa.RecordBatch]:
            if kept:
                made = list(_coded(lang, np.array(kept, object), (np.array(rows[0], object), np.array(rows[1], object), np.array(rows[2], np.int64))))
                for a in range(0, len(made), 64):
                    yield pa.RecordBatch.from_pylist(made[a : a + 64], schema=schema)
            kept.clear()
            for column in rows:
                column.clear()

        for batch in batches:
            for own_lang, source, own_term, n, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own_term != term or own_lang != lang:
                    close_term()
                    if own_lang != lang or len(kept) >= chunk or len(rows[0]) >= CELLS:
                        yield from close_chunk()
                    lang, term, cells, docs = own_lang, own_term, [], 0
                cells.append((source, n))
                docs += d
        close_term()
        yield from close_chunk()

    rows = counts.where("term <> ''").select("lang", "source", "term", "n", "docs")
    return rows.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, fields)


def parts_of(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total) in 64 bits, three decimal digits at a time; count + 1 <= total."""
    rest, out = count + 1, np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64)
    whole, rest = np.divmod(rest, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return 1 + whole * SCALE + out


def spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _dense(vectors: list[tuple[int, np.ndarray, np.ndarray]], rows: int, lo: int, hi: int) -> np.ndarray:
    out = np.zeros((rows, hi - lo), np.int64)
    for at, ids, counts in vectors:
        a, b = np.searchsorted(ids, (lo, hi))
        out[at, ids[a:b] - lo] = counts[a:b]
    return out


def pair_sums(vectors: DataFrame, blocks: DataFrame) -> DataFrame:
    """(lang, a, b, more): for each ordered pair of sources numbered a and b, what its value has beyond that of terms which neither has.

    vectors(lang, chunk, no, ids, counts); blocks(lang, block, blocks, totals, size): the totals n + v of each source of a block.
    """
    reach_workers(vectors.sparkSession)
    rows = vectors.withColumn("own", (F.col("no") / BLOCK).cast("int")).join(blocks.select("lang", F.col("block").alias("own"), "blocks"), ["lang", "own"])
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # a vector meets every block: as the left side of a pair of blocks and as the right one, or once as both within its own
    rows = rows.select("lang", "chunk", "no", "ids", "counts", "own", others.alias("other"))
    pair = rows.select("lang", "chunk", "no", "ids", "counts", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    totals = lambda side: blocks.select("lang", F.col("block").alias(side), F.col("totals").alias(f"{side}_totals"))
    pair = pair.join(totals("lo"), ["lang", "lo"]).join(totals("hi"), ["lang", "hi"])

    def run(key: tuple, tab: pa.Table) -> pa.Table:
        lang, _, lo, hi = (k.as_py() for k in key)
        left, right = (np.array(tab.column(f"{s}_totals")[0].as_py(), np.int64) for s in ("lo", "hi"))
        total = left if lo == hi else np.concatenate([left, right])
        cols = [tab.column(c).to_pylist() for c in ("no", "ids", "counts")]
        base = [lo * BLOCK, hi * BLOCK]
        place = lambda no: no - base[0] if no // BLOCK == lo else len(left) + no - base[1]
        vs = [(place(no), np.frombuffer(i, "<i4"), np.frombuffer(c, "<i8")) for no, i, c in zip(*cols, strict=True)]
        here = np.zeros(len(total), bool)
        here[[v[0] for v in vs]] = True
        zero = parts_of(np.zeros(len(total), np.int64), total)
        plain = spread(zero[:, None], zero[None, :])
        out, last = np.zeros(plain.shape, np.int64), max(int(v[1][-1]) for v in vs) + 1
        for at in range(0, last, SLICE):
            dense = _dense(vs, len(total), at, min(last, at + SLICE))
            used = dense.any(axis=0)
            dense = dense[:, used]
            p = parts_of(dense, total[:, None])
            for a in range(len(total)):
                either = (dense[a] > 0) | (dense > 0)
                out[a] += np.where(either, spread(p[a], p) - plain[a][:, None], 0).sum(axis=1)
        number = np.concatenate([base[0] + np.arange(len(left)), base[1] + np.arange(len(right))])[: len(total)]
        a, b = np.nonzero(here[:, None] | here[None, :])
        keep = (a != b) & ((lo == hi) | ((a < len(left)) != (b < len(left))))
        a, b = a[keep], b[keep]
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(number[a], pa.int64()), "b": pa.array(number[b], pa.int64()), "more": pa.array(out[a, b], pa.int64())})

    made = pair.groupBy("lang", "chunk", "lo", "hi").applyInArrow(run, "lang string, a long, b long, more long")
    return made.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))


def best_of_chunks(vectors: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, chunk, source, best, sizes): the `top` best terms of each source's vector in a chunk as array<struct<id,value>>,
    and how many of their values have 0, 1, ... 63 binary digits."""
    reach_workers(vectors.sparkSession)
    item = pa.struct([("id", pa.int32()), ("value", pa.int64())])
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("source", pa.string()), ("best", pa.list_(item)), ("sizes", pa.list_(pa.int64()))])
    powers = 1 << np.arange(63, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, counts, shared = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["shared"], "<i8")
                p, q = parts_of(counts, np.array(r["n"] + r["v"])), parts_of(shared, np.array(r["lang_n"] + r["v"]))
                up = np.flatnonzero(p > q)
                value = spread(p[up], q[up])
                order = np.lexsort((ids[up], -value))[:top]
                found = pa.StructArray.from_arrays([pa.array(ids[up][order], pa.int32()), pa.array(value[order], pa.int64())], fields=list(item))
                best = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), found)
                sizes = pa.array([np.bincount(np.searchsorted(powers, value[order], "right"), minlength=DIGITS)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c]], pa.string()) for c in ("lang", "chunk", "source")] + [best, sizes], schema=schema)

    return vectors.select("lang", "chunk", "source", "ids", "counts", "shared", "n", "v", "lang_n").mapInArrow(
        run, "lang string, chunk string, source string, best array<struct<id:int,value:long>>, sizes array<long>"
    )


def top_terms(vectors: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, chunk, source, id, value, rank) of the `top` best terms of each source.

    The values' numbers of binary digits, added up over the chunks, show a power of two that at least `top` values of the
    source reach; terms under it never leave their chunks.
    """
    best = materialise(best_of_chunks(vectors, top), "best-of-chunks")
    sizes = F.array(*[F.sum(F.get("sizes", F.lit(i))) for i in range(DIGITS)])
    sizes = best.groupBy("lang", "source").agg(sizes.alias("sizes"))
    reached = lambda b: F.aggregate(F.slice("sizes", b + 1, DIGITS), F.lit(0).cast("long"), lambda x, y: x + y) >= top
    digits = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.lit(DIGITS - 1)), reached)), F.lit(0))
    bound = sizes.withColumn("digits", digits).select("lang", "source", F.expr("if(digits > 0, shiftleft(1L, digits - 1), 0L)").alias("bound"))
    fit = F.filter("best", lambda x: x["value"] >= F.col("bound"))
    rows = best.join(bound, ["lang", "source"]).select("lang", "source", "chunk", F.explode(fit).alias("x")).select("lang", "source", "chunk", "x.*")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "chunk", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def divergence(docs: DataFrame, top: int = TOP_TERMS, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank) over docs(text, lang, source)."""
    counts = materialise(group_counts(docs), "group-terms")
    coded = materialise(encoded(counts, chunk), "coded")
    of_lang = coded.where("source is null").groupBy("lang").agg(F.sum("size").alias("v"), F.sum("total").alias("lang_n"))
    of_group = coded.where("source is not null").groupBy("lang", "source").agg(F.sum("total").alias("n"))
    groups = counts.where("term = ''").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = groups.select("lang", "source", (F.row_number().over(by_name) - 1).cast("long").alias("no"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "v", "lang_n")])
    groups = materialise(groups, "groups")
    vectors = coded.where("source is not null").join(groups, ["lang", "source"])

    block = (F.col("no") / BLOCK).cast("int")
    blocks = groups.groupBy("lang", block.alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("no", (F.col("n") + F.col("v")).alias("t")))), lambda x: x["t"]).alias("totals"))
    blocks = blocks.join(groups.groupBy("lang").agg((F.max(block) + 1).alias("blocks")), "lang")
    sums = pair_sums(vectors.select("lang", "chunk", "no", "ids", "counts"), blocks)
    left = groups.select("lang", F.col("source"), F.col("no").alias("a"), "v", (F.col("n") + F.col("v")).alias("ta"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("b"), (F.col("n") + F.col("v")).alias("tb"))
    # every ordered pair of a language's sources is a row of the result; a total over 0 stands for a language without kept terms
    zero = lambda t: (1 + F.expr(f"{SCALE} div greatest({t}, 1)"))
    pairs = left.join(right, "lang").where("a <> b").withColumn("p", zero("ta")).withColumn("q", zero("tb"))
    plain = F.expr("v * (((p - q) * (p - q)) div q)")
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", (plain + F.coalesce("more", F.lit(0).cast("long"))).alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    pairs = ranked.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    names = coded.where("source is null").select("lang", "chunk", F.posexplode("terms").alias("id", "item"))
    terms = top_terms(vectors, top).join(names, ["lang", "chunk", "id"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))
