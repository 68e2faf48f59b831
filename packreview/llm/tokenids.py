"""Token ids in files: ids ranked by frequency, in byte-aligned variable-length coding with separate control bytes.

Texts are encoded by the tokenizers library; the counts of all ids over all texts rank them, so the most frequent ids
get the smallest ranks and one byte each. A block holds consecutive documents in ascending id order: control bytes (two
bits a value: its bytes less one, four values a control byte) and then the data bytes, low byte first. Decoding looks up
each control byte's lengths in a table and gathers the bytes in numpy. The files are Parquet tables of blocks, so they
can be written to and read from any store that Spark reaches: blocks(part, block, doc_ids, sizes, control, data) and the
rank table (rank, id).

The passes: encode and write ids, count them, deal documents to range parts of the id and write blocks; then read the
blocks back. A block's place comes from running sums over one row a block and one row a part, joined to the blocks.

Encoding remembers words: the pre-tokens of this vocabulary never span white space, so each distinct word is encoded
by the library once for a while, and a text's ids are gathered from that memo. Texts are cut into words in Arrow.

Special tokens written in a text get their own ids, as the library does by default; `special_as_text` takes their
letters as any other text instead. Ids are kept in 16 bits where the vocabulary fits them, else in 32.

Edge cases: null and empty texts have the end id alone; documents with one id are ordered by a hash of their ids, equal
ones in any order, so that one id may span several parts; null ids come first; a text longer than a block is a block of
its own; an empty table writes an empty file; other columns are not looked at.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from packreview.llm.common import discard, fresh_path, map_rows, materialise, reach_workers, table
from packreview.llm.wordids import WordIds, flatten

VOCABULARY, END = "word_bpe_49k.json", 2
#: Ids in a block, and ids in a range part beyond which there are more parts than the session's shuffle partitions.
BLOCK_IDS, PART_IDS = 1 << 20, 32 << 20
SLICE = 4 << 20
#: Letters that the vocabulary's normaliser and splitter leave alone, and marks that follow them as a piece of their own.
_PLAIN, _MARKS = re.compile("[a-zß-öø-ÿ]+"), b".,;:!?*$%&#@"


def vbyte_encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    v = values.astype("<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    pad = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    pad[: len(v)] = extra
    control = pad[0::4] | pad[1::4] << 2 | pad[2::4] << 4 | pad[3::4] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] <= extra[:, None]]
    return control.tobytes(), data.tobytes()


#: For each control byte, the lengths of its four values.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])[None, :] & 3).astype(np.int64) + 1


def vbyte_decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(size) - size
    out = raw[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class LibraryEncoder:
    """The tokenizers library over many words at once.

    Words of lower-case Latin letters alone skip its normaliser and splitter, which leave them whole: they are joined by
    spaces, and a word's ids end with the only id whose piece ends a word.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.full.encode_special_tokens = special_as_text
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = _byte_letters() | {0x20: " "}
        vocab = self.full.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flatten([e.ids for e in self.full.encode_batch_fast(words, add_special_tokens=False)])

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = [" ".join(words[i : i + 4096]).encode().decode("latin-1") for i in range(0, len(words), 4096)]
        lines = [x.translate(self.letters) for x in lines]
        ids, _ = flatten([e.ids for e in self.plain.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
            return self._one_by_one(words)  # a vocabulary that lacks some letter at a word's end
        return ids, np.diff(ends, prepend=0)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the ids of each word."""
        plain = np.fromiter(map(bool, map(_PLAIN.fullmatch, words)), bool, len(words))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        parts = [self._joined(list(compress(words, plain))), self._one_by_one(list(compress(words, ~plain)))]
        flat, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[order], size[order] = np.cumsum(n) - n, n
        ends = np.cumsum(size)
        return flat[np.repeat(begin - (ends - size), size) + np.arange(len(flat))], size


@lru_cache(1)
def id_type(vocabulary: str) -> str:
    """The numpy type that the vocabulary's ids fit."""
    import json

    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    most = max([*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])], default=0)
    return "<u2" if most < 1 << 16 else "<u4"


@lru_cache(2)
def remembered(vocabulary: str, dtype: str, special_as_text: bool = False) -> WordIds:
    """The memo of a Python worker, which later tasks find filled."""
    return WordIds(LibraryEncoder(vocabulary, special_as_text), dtype=np.dtype(dtype))


#: A-Z to lower case; and classes of bytes: 1 a letter, 2 a mark, 0 anything else.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_CLASS = bytes(1 if 0x61 <= b <= 0x7A else 2 * (b in _MARKS) for b in range(256))


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, the number of each word of all texts, words in each text): pieces between white space.

    Where no combining sign can follow a letter and no special token is written, A-Z become lower case and a mark is cut
    from the letter before it, which leaves fewer words to encode and changes no id.
    """
    texts = pa.concat_arrays([pc.fill_null(texts, "")])
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0] if len(ends) else np.zeros(1, np.int32)
    if len(data):
        low = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
        kind = np.frombuffer(low.tobytes().translate(_CLASS), np.uint8)
        letter, mark = kind == 1, kind == 2
        wide = np.flatnonzero(data >= 0x80)
        if len(wide):  # the second bytes of the letters from U+00C0 to U+00FF; two of these are signs
            second = wide[data[wide - 1] == 0xC3]
            letter[second] = (data[second] != 0x97) & (data[second] != 0xB7)
        odd = [wide[data[wide] >= 0xC4], np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))]
        odd = np.concatenate(odd)  # letters beyond U+00FF, and the opening of a special token
        if len(odd):
            simple = np.ones(len(texts), bool)
            simple[np.searchsorted(ends, odd, "right") - 1] = False
            here = np.repeat(simple, np.diff(ends))
            low, mark = np.where(here, low, data), mark & here
        cut = np.flatnonzero(letter[:-1] & mark[1:]) + 1
        data, ends = np.insert(low, cut, 0x20), ends + np.searchsorted(cut, ends, "left")
    arr = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(arr)  # control characters 1C to 1F are no white space here, nor in the library
    coded = lists.flatten().dictionary_encode()
    every = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
    words = pc.binary_join(every, "\n")[0].as_py().split("\n") if len(coded.dictionary) else []  # faster than one by one
    return words, np.asarray(coded.indices), np.diff(np.asarray(lists.offsets))


def encode_ids(docs: DataFrame, vocabulary: str, end: int = END, special_as_text: bool = False) -> DataFrame:
    """Adds ids (binary, little-endian, of id_type(vocabulary), `end` last) and n_tokens to docs(text, ...)."""
    dtype = id_type(vocabulary)

    def run(texts: pa.Array) -> dict[str, list]:
        ids, n = remembered(vocabulary, dtype, special_as_text).of_distinct(*words_of(texts))
        ends = np.cumsum(n)
        last = np.array([end], dtype).tobytes()
        each = [ids[e - k : e].astype(dtype).tobytes() + last for e, k in zip(ends, n, strict=True)]
        return {"ids": each, "n_tokens": n + 1}

    keep = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    return map_rows(docs, run, "ids binary, n_tokens long", keep, arrow=True, limit=SLICE)


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // max(1, n)}")


def id_counts(encoded: DataFrame) -> list[tuple[int, int]]:
    """(id, count) over all documents, the most frequent first; as many rows as the vocabulary has at most."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for x, n in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                more = np.bincount(_ids(x.as_py(), n), minlength=len(total))
                more[: len(total)] += total
                total = more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    counted = encoded.select("ids", "n_tokens").mapInArrow(run, "id long, n long")
    rows = counted.groupBy("id").agg(F.sum("n").alias("n")).collect()
    return sorted(((r.id, r.n) for r in rows), key=lambda r: (-r[1], r[0]))


def write_blocks(encoded: DataFrame, ranked: list[tuple[int, int]], path: str, parts: int) -> None:
    """Writes encoded(doc_id, ids, n_tokens) as blocks in ascending doc_id order under path/blocks, ranks under path/ranks."""
    spark = encoded.sparkSession
    rank_rows = [(r, i) for r, (i, _) in enumerate(ranked)]
    spark.createDataFrame(rank_rows, "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    to_rank = np.zeros(max((i for i, _ in ranked), default=0) + 1, np.uint32)
    to_rank[[i for i, _ in ranked]] = np.arange(len(ranked))
    shipped = spark.sparkContext.broadcast(to_rank)  # at most the vocabulary
    long, whole = LongType(), IntegerType()
    made = StructType([
        StructField("part", whole), StructField("block", whole),
        StructField("doc_ids", ArrayType(encoded.schema["doc_id"].dataType)), StructField("sizes", ArrayType(long)),
        StructField("control", BinaryType()), StructField("data", BinaryType()), StructField("n", long),
    ])

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, part = to_arrow_schema(made), TaskContext.get().partitionId()
        held, state = [], {"block": 0, "size": 0}

        def flush():
            ids = np.concatenate([_ids(x, n) for _, x, n in held])
            control, data = vbyte_encode(shipped.value[ids])
            row = [part, state["block"], [d for d, _, _ in held], [n for _, _, n in held], control, data, len(ids)]
            state.update(block=state["block"] + 1, size=0)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            ids, sizes = batch.column(1), batch.column(2).to_pylist()
            for d, x, n in zip(batch.column(0).to_pylist(), ids, sizes, strict=True):
                if held and state["size"] + n > BLOCK_IDS:
                    yield flush()
                held.append((d, x.as_py(), n))
                state["size"] += n
        if held:
            yield flush()

    rows = encoded.select("doc_id", "ids", "n_tokens", F.xxhash64("ids").alias("h")).withColumn("at", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, "doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at")
    blocks = rows.select("doc_id", "ids", "n_tokens").mapInArrow(run, made)
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")


def block_starts(blocks: DataFrame) -> DataFrame:
    """(part, block, start): ids before each block, from running sums over one row a part and one row a block."""
    sizes = blocks.select("part", "block", "n")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("base"))  # one row for each task that wrote
    within = sizes.select("part", "block", before(Window.partitionBy("part").orderBy("block")).alias("within"))
    return within.join(parts, "part").select("part", "block", (F.col("base") + F.col("within")).alias("start"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids binary of little-endian unsigned 32-bit) of every document in the files."""
    reach_workers(spark)
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()  # at most the vocabulary
    shipped = spark.sparkContext.broadcast(np.array([r.id for r in ranks], "<u4"))
    blocks = spark.read.parquet(f"{path}/blocks")
    starts = materialise(block_starts(blocks), "block_starts")  # as a table, so that Spark knows whether it may be broadcast
    made = StructType([StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType), StructField("start", LongType()), StructField("ids", BinaryType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(made)
        for batch in batches:
            for row in batch.to_pylist():
                to_id, sizes = shipped.value, np.array(row["sizes"], np.int64)
                ids = to_id[vbyte_decode(row["control"], row["data"], int(sizes.sum()))]
                ends = np.cumsum(sizes)
                each = [ids[e - k : e].tobytes() for e, k in zip(ends, sizes, strict=True)]
                cols = [row["doc_ids"], row["start"] + ends - sizes, each]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    placed = blocks.join(starts, ["part", "block"]).select("doc_ids", "sizes", "control", "data", "start")
    return placed.mapInArrow(run, made)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = materialise(encode_ids(docs, public_tokenizers.path(VOCABULARY)).drop("text"), "ids")
    ranked = id_counts(encoded)
    path = fresh_path(spark, "token_ids")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(n for _, n in ranked) // PART_IDS))
    write_blocks(encoded, ranked, path, parts)
    discard(spark, encoded)
    return read_blocks(spark, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
