"""Byte-level BPE: higher-order functions fold ranked merges over the byte arrays of distinct words.

A word (a match of the pre-token pattern) is the array of its bytes. The fold makes size - 1 steps; a step looks up the
rank of each adjacent pair in a literal rank map and joins the first pair of the lowest rank, until no pair has a rank.
The literal is the vocabulary cut into buckets by crc32 of the piece, as a lookup in one map literal walks all of it.

Every distinct word of all documents is folded so, once. Joining each place of each word by a shuffle would move the corpus
twice and more, so places are joined by blocks: a task cuts its texts into words, numbers the distinct words of BLOCK_BYTES
of text, and writes the texts as such numbers. A block's words go to the fold by a hash of the word, their ids come back to
the block, and there each text looks up its numbers. Words beyond LONG_WORD bytes, whose fold takes steps that grow with the
square, are folded by a heap, by the same merges.

Decoding looks up each id's piece and concatenates the bytes.

Edge cases: null and empty texts have no ids and decode to no bytes; any bytes can be encoded as every single byte has
a rank; repeated rows are encoded alike; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import sys
import zlib
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from packreview.llm.common import fresh_path, give_back, materialise, reach_workers, slices, table
from packreview.llm.wordids import flatten, gather
from packreview.sources.scratch import bucketed, short_plans, spread

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text whose distinct words are numbered together, and parts of a block's words by a hash.
BLOCK_BYTES, PARTS = 32 << 20, 1024
#: Bytes of text that are cut into words at a time, and bytes of packed numbers that are looked up at a time. A Python
#: worker takes some fifty times as much for either, and each core has two of them here.
CUT_BYTES, LOOKUP_BYTES = 512 << 10, 128 << 10
#: Bytes of a word beyond which it is folded by a heap, and never by higher-order functions.
LONG_WORD = 200
_BUCKETS = 32_768
#: Patterns by the greatest character of the texts that they are for: the fewer ranges a class has, the faster it is.
LEVELS = (0xFF, 0xFFFF, sys.maxunicode)


@lru_cache(3)
def library_ranges(pattern: str) -> list[tuple[int, int]]:
    """Ranges of the characters of a class such as \\p{L}, as the library that the ids must equal tells them: it is given a
    text of all characters and the class as its pattern, and returns those that match."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    codes = np.fromiter(map(ord, probe.decode(probe.encode_ordinary(every))), np.int64)
    cut = np.flatnonzero(np.diff(codes) > 1)
    return list(zip(codes[np.concatenate([[0], cut + 1])].tolist(), codes[np.concatenate([cut, [len(codes) - 1]])].tolist(), strict=True))


@lru_cache(1)
def pretoken_patterns() -> tuple[str, ...]:
    r"""The public pattern 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+ in the syntax of re, for each
    of LEVELS. Words come first, as no other alternative begins like one. Worked out on the driver and shipped, so that
    the workers' Python version does not matter."""
    out = []
    for last in LEVELS:
        letters, numbers, space = ("".join(f"\\U{a:08x}-\\U{min(b, last):08x}" for a, b in library_ranges(c) if a <= last) for c in (r"\p{L}", r"\p{N}", r"\s"))
        out.append(f" ?[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")
    return tuple(out)


_BEYOND_BMP = re.compile("[\U00010000-\U0010ffff]")
_compiled = lru_cache(8)(re.compile)


def pretokens(text: str | None, patterns: tuple[str, ...] | None = None) -> list[str]:
    if not text:
        return []
    try:
        text.encode("latin-1")
        level = 0
    except UnicodeEncodeError:
        level = 2 if _BEYOND_BMP.search(text) else 1
    return _compiled((patterns or pretoken_patterns())[level]).findall(text)


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_literal(ranks: dict[bytes, int], buckets: int = _BUCKETS) -> Column:
    """The ranks as one literal: array<map<hex piece, rank>>, a piece's bucket by crc32 of its hex."""
    cells: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, rank in ranks.items():
        h = piece.hex().upper()
        cells[zlib.crc32(h.encode()) % buckets][h] = rank
    return F.from_json(F.lit(json.dumps(cells)), "array<map<string,int>>")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def fold_merges(word: Column, ranks: Column, buckets: int = _BUCKETS) -> Column:
    """array<int>: the ids of the byte array of `word` (binary), by ranked merges in higher-order functions.

    The state holds the pieces and the rank of each with its right neighbour, so that a step looks up two pairs.
    """
    n, whole = F.octet_length(word), F.hex(word)
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(whole, (2 * i - 1).cast("int"), F.lit(2)))).otherwise(F.array().cast("array<string>"))

    def fold(table: Column) -> Column:
        rank = lambda h: F.try_element_at(F.element_at(table, (F.crc32(h) % buckets + 1).cast("int")), h)
        pair = lambda p, i: rank(F.concat(F.get(p, i), F.get(p, i + 1)))

        def join(acc: Column, k: Column) -> Column:
            p = F.transform(F.filter(acc["p"], lambda _, i: i != k + 1), lambda x, i: F.when(i == k, F.concat(x, F.get(acc["p"], i + 1))).otherwise(x))
            old = F.filter(acc["r"], lambda _, i: i != k)
            return _let(p, lambda q: F.struct(q.alias("p"), F.transform(old, lambda x, i: F.when((i == k) | (i == k - 1), pair(q, i)).otherwise(x)).alias("r")))

        def step(acc: Column, _: Column) -> Column:
            # the first pair of the lowest rank is joined
            return _let(F.array_min(acc["r"]), lambda low: F.when(low.isNull(), acc).otherwise(_let((F.array_position(acc["r"], low) - 1).cast("int"), lambda k: join(acc, k))))

        start = _let(parts, lambda p: F.struct(p.alias("p"), F.transform(p, lambda _, i: pair(p, i)).alias("r")))
        steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.aggregate(steps, start, step, lambda acc: acc["p"]), rank)

    return _let(ranks, fold)


def fold_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold over one word's bytes."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    scores = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        best, at = None, -1
        for i, r in enumerate(scores):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del scores[at]
        if at < len(scores):
            scores[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            scores[at - 1] = ranks.get(parts[at - 1] + parts[at])


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a long word, in a number of steps that grows with n log n: a heap of the pairs by rank and place.

    end[i] is where the piece that begins at byte i ends, 0 if none begins there; begun[e] is where the piece that ends
    at e begins. A pair in the heap counts only while both its pieces stand as they did.
    """
    n = len(word)
    end, begun = [*range(1, n + 1)], [*range(-1, n)]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, c = heapq.heappop(heap)
        b = end[a]
        if not b or b >= n or end[b] != c:
            continue
        end[a], end[b], begun[c] = c, 0, a
        if a and (r := ranks.get(word[begun[a] : c])) is not None:
            heapq.heappush(heap, (r, begun[a], c))
        if c < n and (r := ranks.get(word[a : end[c]])) is not None:
            heapq.heappush(heap, (r, a, end[c]))
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


@lru_cache(1)
def java_pattern() -> str:
    """The pre-token pattern in Java's syntax, with the same classes."""
    letters, numbers, space = ("".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in library_ranges(c)) for c in (r"\p{L}", r"\p{N}", r"\s"))
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"


def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, the end of each number): seven bits a byte, low ones first; all but a number's last byte have the eighth bit."""
    size = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in (1, 2, 3, 4))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        on = size > k
        out[(ends - size)[on] + k] = (numbers[on] >> 7 * k & 127) | ((size[on] > k + 1) << 7)
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128) + 1
    begin = np.concatenate([[0], ends[:-1]])[: len(ends)]
    out = data[begin].astype(np.int64) & 127
    for k in range(1, int((ends - begin).max(initial=0))):
        on = ends - begin > k
        out[on] |= (data[begin[on] + k].astype(np.int64) & 127) << 7 * k
    return out


class _Numbers(dict):
    """word -> its number, the next one where it is new."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def binaries(data: np.ndarray, cut: np.ndarray):
    """Arrow's array of the stretches of data between the places in cut, which begins with 0; it holds data itself, no copy."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


#: What numbered() adds: rows of docs have __words, rows of a block's words the other three columns.
_NUMBERED = "__block long, __words binary, __part int, __list array<string>, __numbers array<int>"


def numbered(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with the text as packed numbers of words within a block, and each block's words in PARTS
    rows by their hash (those beyond LONG_WORD bytes in part -1). It is written, bucketed by block."""
    reach_workers(docs.sparkSession)
    patterns = pretoken_patterns()
    made = StructType.fromDDL(_NUMBERED)
    full = StructType([StructField(f.name, f.dataType) for k in keep for f in docs.select(k).schema.fields] + made.fields)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(full)
        block, held, index = TaskContext.get().partitionId() << 24, 0, _Numbers()
        row = lambda n, cols: pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

        def words_of_block():
            parts: dict[int, tuple[list, list]] = {}
            for word, n in index.items():
                raw = word.encode()
                words, numbers = parts.setdefault(zlib.crc32(raw) % PARTS if len(raw) <= LONG_WORD else -1, ([], []))
                words.append(word)
                numbers.append(n)
            if parts:
                lists = {"__list": [x for x, _ in parts.values()], "__numbers": [x for _, x in parts.values()], "__part": list(parts), "__block": [block] * len(parts)}
                yield row(len(parts), {k: pa.array(v, schema.field(k).type) for k, v in lists.items()})

        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.string())
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            for a, b in slices(sizes, CUT_BYTES):
                if held and held + int(sizes[a:b].sum()) > BLOCK_BYTES:
                    yield from words_of_block()
                    block, held, index = block + 1, 0, _Numbers()
                held += int(sizes[a:b].sum())
                tokens = [pretokens(t, patterns) for t in texts.slice(a, b - a).to_pylist()]
                n = np.fromiter(map(len, tokens), np.int64, b - a)
                data, ends = pack(np.fromiter(map(index.__getitem__, chain.from_iterable(tokens)), np.int64, int(n.sum())))
                at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
                cols = {k: batch.column(i).slice(a, b - a).cast(schema.field(i).type) for i, k in enumerate(keep)}
                yield row(b - a, cols | {"__block": pa.array([block] * (b - a), pa.int64()), "__words": binaries(data, at)})
        yield from words_of_block()
        index = None
        give_back()

    return bucketed(docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, full), "numbered", "__block")


def fold_all(parts: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(__block, __part, __ids) of parts(__block, __part, __list): each distinct word is folded once by higher-order functions,
    and its ids go to every part of a block that has it, packed behind the sizes, in the order of its list. It is written."""
    shipped = parts.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary
    own = spread(parts.where("__part >= 0"), "__part")
    each = own.select("__part", "__block", F.posexplode("__list").alias("n", "__word"))
    words = each.groupBy("__part", "__word").agg(F.collect_list(F.struct("__block", "n")).alias("__at"))
    folded = words.select("__part", "__at", fold_merges(F.encode("__word", "UTF-8"), rank_literal(ranks)).alias("ids"))
    placed = folded.select("__part", F.explode("__at").alias("a"), "ids").groupBy("__part", F.col("a.__block").alias("__block"))
    placed = placed.agg(F.collect_list(F.struct("a.n", "ids")).alias("x"))
    short = placed.select("__block", "__part", F.col("x.n").alias("n"), F.transform("x", lambda w: F.size(w["ids"])).alias("sizes"), F.flatten("x.ids").alias("ids"))
    made = "__block long, __part int, __ids binary"

    def packed(block: int, part: int, sizes: np.ndarray, ids: np.ndarray):
        import pyarrow as pa

        data = zlib.compress(pack(sizes)[0].tobytes() + pack(ids)[0].tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["__block", "__part", "__ids"])

    def in_order(batches):
        for b in batches:
            for i in range(b.num_rows):
                block, part, n, sizes, ids = (c[i] for c in b.columns)
                n, sizes, ids = (np.asarray(c.values, np.int64) for c in (n, sizes, ids))
                order, begin = np.argsort(n), np.cumsum(sizes) - sizes
                yield packed(block.as_py(), part.as_py(), sizes[order], gather(ids, begin[order], sizes[order]))

    def by_heap(batches):
        for b in batches:
            for block, part, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, sizes = flatten([fold_word(w.encode(), shipped.value) for w in words])
                yield packed(block, part, sizes, ids)

    long = parts.where("__part < 0").select("__block", "__part", "__list")
    return materialise(short.mapInArrow(in_order, made).unionByName(long.mapInArrow(by_heap, made)), "folded")


def encode(docs: DataFrame, vocabulary: str, keep: list[str] | None = None) -> DataFrame:
    """Adds ids (binary: little-endian unsigned 32-bit) and n_tokens to the columns `keep` of docs(text, ...), all by default."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "n_tokens")]
    table = numbered(docs, keep)
    folded = fold_all(table.where("__part is not null").select("__block", "__part", "__list"), read_ranks(vocabulary))
    texts = table.select("__block", "__words", "__part", "__numbers", *keep)
    full = StructType([*texts.select(*keep).schema.fields, StructField("ids", BinaryType()), StructField("n_tokens", LongType())])

    def run(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        give_back()  # of the block before
        schema = to_arrow_schema(full)
        ids_of = dict(zip(right.column("__part").to_pylist(), right.column("__ids").to_pylist(), strict=True))
        numbers, rows = {}, []
        for batch in left.to_batches():
            is_part = pc.is_valid(batch.column("__part"))
            own = batch.filter(is_part)
            numbers |= {p: np.asarray(n.values) for p, n in zip(own.column("__part").to_pylist(), own.column("__numbers"), strict=True)}
            rows.append((batch, pc.invert(is_part)))
        total = sum(map(len, numbers.values()))
        sizes, begins, flat, used = np.zeros(total, np.int64), np.zeros(total, np.int64), [np.zeros(0, "<u4")], 0
        for part, n in numbers.items():
            got = unpack(np.frombuffer(zlib.decompress(ids_of[part]), np.uint8))
            sizes[n], begins[n] = got[: len(n)], used + np.cumsum(got[: len(n)]) - got[: len(n)]
            flat.append(got[len(n) :].astype("<u4"))
            used += len(flat[-1])
        flat = np.concatenate(flat)
        out = []
        for batch, is_text in rows:
            batch = batch.filter(is_text)
            words = batch.column(1)
            for a, b in slices(np.asarray(pc.binary_length(words)), LOOKUP_BYTES):
                raw = words.slice(a, b - a).to_pylist()
                data = np.frombuffer(b"".join(raw), np.uint8)
                last = np.concatenate([[0], np.cumsum(data < 128)])[np.concatenate([[0], np.cumsum(list(map(len, raw)))]).astype(np.int64)]
                at = unpack(data)
                ids = gather(flat, begins[at], sizes[at])
                cut = np.concatenate([[0], np.cumsum(sizes[at])])[last]
                kept = [batch.column(i).slice(a, b - a).cast(schema.field(i - 4).type) for i in range(4, len(keep) + 4)]
                made = [binaries(ids, cut), pa.array(np.diff(cut), pa.int64())]
                out.append(pa.RecordBatch.from_arrays(kept + made, schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return texts.groupBy("__block").cogroup(folded.groupBy("__block")).applyInArrow(run, full)


def encode_by_join(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The same as encode(), whole by the named method: all distinct words of all documents are folded by higher-order
    functions and joined back to every place they stand at.

    It moves every word of the corpus twice; encode() is the main path for that, with the same fold. Words beyond LONG_WORD
    bytes are folded by the heap.
    """
    ranks = read_ranks(vocabulary)
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary
    keep = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    found = F.posexplode_outer(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(java_pattern()), F.lit(0)))
    rest = [c for c in keep if c != "text"]
    places = docs.withColumn("__row", F.monotonically_increasing_id()).select(*rest, "__row", found.alias("__at", "__word"))
    words = materialise(places.where("__word is not null").groupBy("__word").agg(F.count("*").alias("n")), "words")
    short = F.octet_length("__word") <= LONG_WORD
    with_ids = words.where(short).select("__word", fold_merges(F.encode("__word", "UTF-8"), rank_literal(ranks)).alias("__ids"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids = [fold_word(w.as_py().encode(), shipped.value) for w in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["__word", "__ids"])

    long = words.where(~short).select("__word").mapInArrow(run, "__word string, __ids array<int>")
    folded = with_ids.unionByName(long)
    with short_plans(docs.sparkSession):
        path = fresh_path(docs.sparkSession, "folded")
        folded.write.parquet(path)
    folded = docs.sparkSession.read.parquet(path)
    part = F.when(F.col("__at").isNotNull(), F.struct("__at", "__ids"))
    placed = places.join(folded, "__word", "left").groupBy("__row").agg(
        *[F.first(c).alias(c) for c in rest], F.array_sort(F.collect_list(part)).alias("__parts")
    )
    ids = F.flatten(F.transform("__parts", lambda x: x["__ids"]))
    byte = lambda i, k: F.lpad(F.hex(F.shiftright(i, 8 * k).bitwiseAND(255).cast("long")), 2, "0")
    little = F.transform(ids, lambda i: F.concat(*[byte(i, k) for k in range(4)]))
    return placed.select(*rest, F.unhex(F.array_join(little, "")).alias("ids"), F.size(ids).cast("long").alias("n_tokens"))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds decoded (binary) to encoded(ids, ...): the pieces of the ids, concatenated. A column of that name is replaced."""
    encoded = encoded.drop("decoded")
    ranks = read_ranks(vocabulary)
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    shipped = encoded.sparkSession.sparkContext.broadcast((sizes, np.frombuffer(b"".join(pieces), np.uint8)))
    state: dict[str, np.ndarray] = {}

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        if not state:
            state["size"], state["bytes"] = shipped.value
            state["begin"] = np.cumsum(state["size"]) - state["size"]
        for batch in batches:
            coded = pc.fill_null(batch.column(batch.schema.get_field_index("ids")), b"")
            n = np.asarray(pc.binary_length(coded), np.int64)
            for a, b in slices(n, LOOKUP_BYTES):
                ids = np.frombuffer(b"".join(coded.slice(a, b - a).to_pylist()), "<u4")
                size = state["size"][ids]
                cut = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n[a:b])]) // 4]
                made = binaries(gather(state["bytes"], state["begin"][ids], size), cut)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, made], names=[*batch.schema.names, "decoded"])
        give_back()

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decode(encode(docs, path, ["doc_id"]), path)
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
