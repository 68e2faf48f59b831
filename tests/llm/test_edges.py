"""Edge cases that the docstrings define: nulls, repeated ids and rows, long texts, empty tables, clashing columns, bounds."""

import json
import random
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_copies_do_not_fill_the_language_sample(spark):
    from packreview.llm import langid as L

    copies = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("the same text of that language").alias("text"), F.lit("aa").alias("lang"))
    others = spark.range(20_000, 20_400).select(F.col("id").alias("doc_id"), F.concat(F.lit("another text "), "id").alias("text"), F.lit("aa").alias("lang"))
    got = L.training_texts(copies.unionByName(others), per_lang=120)["aa"]
    assert len(got) == len(set(got)) == 120
    assert L.training_texts(copies.where("false")) == {} and L.dictionaries({}) == {}
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.col("id").cast("string").alias("lang"))
    assert L.training_texts(many) == {str(i): ["t"] for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2}
    docs = frame(spark, [(1, "x" * 500_000), (2, "x"), (2, "x")]).withColumn("score", F.lit("own"))
    out = L.identify(docs, {"aa": b"x" * 200, "bb": b"x" * 200}).collect()
    assert len(out) == 3 and {r.lang_pred for r in out} == {"aa"} and all(0 <= r.score <= 1 for r in out)  # a tie takes the first


def test_token_files_of_wide_ids_and_any_key(spark, tmp_path):
    from packreview.llm import tokenids as K
    from packreview.llm.common import fresh_path

    vocabulary = tmp_path / "v.json"
    vocabulary.write_text(json.dumps({"model": {"vocab": {str(i): i for i in range(70_000)}}, "added_tokens": []}))
    assert K.id_type(str(vocabulary)) == "<u4"
    rng = np.random.default_rng(3)
    rows = [(k, rng.integers(0, 200_000, n, dtype=np.uint32)) for k, n in [("b", 5), ("a", 3), ("b", 1), (None, 2), ("b", 5), ("c", 40), ("a", 3)]]
    rows[4] = ("b", rows[0][1])
    df = spark.createDataFrame([(k, x.tobytes(), len(x)) for k, x in rows], "doc_id string, ids binary, n_tokens long")
    path = fresh_path(spark, "wide")
    K.write_blocks(df, K.id_counts(df), path, parts=3)
    got = sorted(K.read_blocks(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, "a", "a", "b", "b", "b", "c"]
    assert sorted(bytes(r.ids) for r in got) == sorted(x.tobytes() for _, x in rows)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([len(r.ids) // 4 for r in got])[:-1]]).tolist()
    path = fresh_path(spark, "none")
    K.write_blocks(df.where("false"), [], path, parts=2)
    assert K.read_blocks(spark, path).count() == 0


def test_text_longer_than_a_block(spark, monkeypatch):
    import public_tokenizers as P

    from packreview.llm import tokenids as K
    from packreview.llm.common import fresh_path

    docs = frame(spark, [(2, "hello world " * 400), (1, "one"), (3, "three")]).withColumn("ids", F.lit(1))
    encoded = K.encode_ids(docs, P.path(K.VOCABULARY)).select("doc_id", "ids", "n_tokens")
    monkeypatch.setattr(K, "BLOCK_IDS", 100)
    path = fresh_path(spark, "long")
    K.write_blocks(encoded, K.id_counts(encoded), path, parts=1)
    assert [(r.doc_id, r.start) for r in K.read_blocks(spark, path).orderBy("start").collect()] == [(1, 0), (2, 2), (3, 803)]


def test_long_words_of_bpe(spark):
    import public_tokenizers as P
    import tiktoken

    from packreview.llm import bpe as B

    path = P.path(B.VOCABULARY)
    ranks = B.read_ranks(path)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    word = "".join(rng.choice("abcdefghé") for _ in range(12_000))
    docs = frame(spark, [(1, word), (1, word), (2, "short")]).withColumn("decoded", F.lit("own"))
    got = B.decode(B.encode(docs, path), path).collect()
    assert [np.frombuffer(bytes(r.ids), "<u4").tolist() for r in sorted(got, key=lambda r: r.doc_id)] == [lib.encode_ordinary(t) for t in (word, word, "short")]
    assert bytes(got[0].decoded).decode() in (word, "short")
    million = "".join(rng.choice("theingato") for _ in range(1_000_000)).encode()
    assert B.fold_long(million[:5000], ranks) == lib.encode_ordinary(million[:5000].decode()) and len(B.fold_word(million, ranks)) > 1000
    for n in (1, 2, 30, 199, 200, 201):
        w = million[:n]
        assert B.fold_word(w, ranks) == ([ranks[w]] if w in ranks else B.fold_long(w, ranks))


def test_bpe_whole_by_the_named_method(spark):
    import public_tokenizers as P

    from packreview.llm import bpe as B

    path = P.path(B.VOCABULARY)
    docs = frame(spark, [(1, None), (2, ""), (3, "hello world's  \n\n x  "), (4, "½² ١٢ don't zz 日本語 🎉 é"), (4, "b" * 700 + " tail"), (4, "hello"), (None, "hello hello")])
    key = lambda df: sorted(((r.doc_id or 0, r.n_tokens, bytes(r.ids)) for r in df.collect()))
    assert key(B.encode_by_join(docs, path)) == key(B.encode(docs, path))


def test_every_distinct_word_of_bpe_is_folded_by_spark_once(spark, monkeypatch):
    import public_tokenizers as P

    from packreview.llm import bpe as B

    path, folded = P.path(B.VOCABULARY), []
    words = [f"w{i * 7919}q" for i in range(3000)]
    docs = frame(spark, [(i, " ".join([w, words[-1 - i], "b" * 300 * (i < 2)])) for i, w in enumerate(words)])
    monkeypatch.setattr(B, "BLOCK_BYTES", 1 << 12)  # many blocks
    monkeypatch.setattr(B, "fold_merges", lambda w, *a, own=B.fold_merges: (folded.append(w), own(w, *a))[1])
    monkeypatch.setattr(B, "fold_word", lambda w, ranks, own=B.fold_word: own(w, ranks) if len(w) > B.LONG_WORD else 1 / 0)
    got = {r.doc_id: r for r in B.encode(docs, path).collect()}
    monkeypatch.undo()
    ranks = B.read_ranks(path)
    assert len(folded) == 1 and len(got) == 3000
    for r in docs.collect():
        assert list(np.frombuffer(bytes(got[r.doc_id].ids), "<u4")) == [x for w in B.pretokens(r.text) for x in B.fold_word(w.encode(), ranks)]
    for v in ([], [0, 127, 128, 16383, 16384, 1 << 21, (1 << 31) - 1, 5]):
        assert B.unpack(B.pack(np.array(v, np.int64))[0]).tolist() == v


def brute_vectors(rows):
    """(n_links, component) of each row by all pairs; rows are (id, unit vector)."""
    m = np.array([v for _, v in rows])
    link = m @ m.T >= 0.95
    np.fill_diagonal(link, False)
    comp = np.arange(len(rows))
    while True:
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(rows))])
        if (new == comp).all():
            break
        comp = new
    low = {c: min((i for (i, _), k in zip(rows, comp, strict=True) if k == c and i is not None), default=None) for c in set(comp)}
    return [(i, int(link[k].sum()), None if i is None else low[comp[k]]) for k, (i, _) in enumerate(rows)]


def test_repeated_and_null_vector_ids(spark):
    from packreview.llm import vectors as V

    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x)
    a, b, c = (unit(rng.normal(size=64)) for _ in range(3))
    near = lambda x: unit(x + rng.normal(size=64) * 0.01)
    rows = [(1, a), (1, b), (2, near(a)), (3, near(a)), (4, near(b)), (None, c), (5, near(c)), (6, near(c)), (7, a), (7, a), (None, b), (8, unit(rng.normal(size=64)))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").withColumn("rep", F.lit("own"))
    got = V.near_vectors(df).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute_vectors(rows), key=key)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert V.near_vectors(df.where("false")).count() == 0
    mixed = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.01]), (4, [5.0])]
    out = {r.vec_id: r.n_links for r in V.near_vectors(spark.createDataFrame(mixed, "vec_id long, embedding array<double>")).collect()}
    assert out == {1: 1, 2: 0, 3: 1, 4: 0}


@pytest.mark.parametrize("dims", [64, 384])
def test_recall_just_above_the_threshold(spark, dims):
    from packreview.llm import vectors as V

    rng = np.random.default_rng(dims)
    rows = []
    for i in range(300):  # pairs at a cosine of 0.951 to 0.96
        a = rng.normal(size=dims)
        a /= np.linalg.norm(a)
        o = rng.normal(size=dims)
        o -= (o @ a) * a
        o /= np.linalg.norm(o)
        c = rng.uniform(0.951, 0.96)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * o).tolist())]
    got = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) >= 0.97 * 600 and max(r.n_links for r in got) == 1


def test_stored_ledger_scans_each_blob_once(spark):
    from packreview.llm import secrets as S
    from packreview.llm.common import fresh_path

    ledger = S.Ledger(spark, fresh_path(spark, "ledger"))
    assert ledger.rows() is None
    first = frame(spark, [(1, "token=abcdef1"), (2, "clean"), (3, "clean"), (None, None)])
    assert ledger.scan(first).count() == 3 and ledger.scan(first).count() == 3
    second = first.unionByName(frame(spark, [(1, "token=abcdef2"), (4, "clean")]))  # a later version of one path
    assert ledger.scan(second).count() == 4
    raised = tuple(replace(r, version=2) if r.name == "hex" else r for r in S.RULES)
    rows = ledger.scan(second, raised)
    assert rows.count() == 8 and rows.where("size(findings) = 1").count() == 4
    found = S.findings_by_path(second, rows, ["doc_id", "text"], raised).collect()
    assert sorted((r.doc_id or 0, len(r.findings)) for r in found) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 0), (4, 0)]
    assert S.scan_unseen(first.where("false")).count() == 0


def test_very_many_findings(spark):
    from packreview.llm import secrets as S

    text = "é" + "".join(f" token=abcdef{i:04}" for i in range(3000)) + " end"
    docs = frame(spark, [(1, text)])
    row = S.findings_by_path(docs, S.scan_unseen(docs), ["doc_id", "text"]).withColumn("m", S.masked(F.col("text"), F.col("findings"))).first()
    assert [(f.start, f.end) for f in row.findings] == [(2 + 17 * i, 18 + 17 * i) for i in range(3000)]
    assert row.m == "é" + " [SECRET]" * 3000 + " end"


def test_near_duplicates_of_null_and_repeated_ids(spark):
    from packreview.llm.minhash import NearDup, near_duplicates

    rng = random.Random(6)
    a, b, long = prose(rng, 200), prose(rng, 150), prose(rng, 40_000, 5000)
    rows = [(None, a), (7, a + " tail"), (7, b), (8, b + " end"), (9, b), (9, b), (None, "alone words here"), (3, long), (4, long + " more"), (5, None)]
    got = sorted(((r.id or 0, r.n_shingles, r.component, r.first) for r in near_duplicates(frame(spark, rows), NearDup()).collect()), key=str)
    by = {}
    for i, n, c, first in got:
        by.setdefault((i, c), []).append(first)
    assert set(by) == {(0, 7), (7, 7), (8, 7), (9, 7), (0, None), (3, 3), (4, 3), (5, 5)} and by[3, 3] == [True] and by[4, 3] == [False]
    assert sum(by[7, 7]) == 2  # two texts of one id, each the first of its own component
    assert near_duplicates(frame(spark, rows).where("false"), NearDup()).count() == 0


def test_learning_without_labels_or_from_two_texts(spark):
    from packreview.llm import quality as Q
    from packreview.llm import toxicity as X

    docs = frame(spark, [(1, "b text"), (1, "a text"), (2, None), (3, "x " * 50_000)])
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    assert [(r.text, r.y) for r in X.training_sample(docs, labels, "toxic").collect()] == [("a text", 1)]
    none = labels.where("false")
    clean = X.score(docs, X.train(docs, none)).collect()
    assert len(clean) == 4 and all(r.toxic_predicted == 0 for r in clean)
    graded = Q.grade(docs.withColumn("keep", F.lit("own")), Q.train(docs, none)).collect()
    assert len(graded) == 4 and {r.expected_grade for r in graded} == {0.0}
    assert X.score(docs.where("false"), X.train(docs, labels)).count() == Q.grade(docs.where("false"), Q.train(docs, labels)).count() == 0


def test_shards_of_an_empty_table(spark):
    from packreview.llm import shards as H
    from packreview.llm.common import fresh_path

    written = H.shuffle_to_shards(frame(spark, []).select("doc_id", "text"), fresh_path(spark, "none"))
    assert H.with_slots(written, written).count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    item = prose(rng, 12, 9999)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = prose(rng, 30_000, 3000)
    rows = [(1, long), (2, long), (2, long), (3, "token=abcdef99"), (4, None), (5, ""), (None, long), (6, item)]
    names = ["toxic_score", "toxic_predicted", "text_hash", "n_words", "n_hit", "items", "spans", "hit_words", "findings", "rep"]
    docs = frame(spark, rows)
    wide = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []
        wide = stage(spark, wide, str(tmp_path))
        assert wide.columns == [*docs.columns, *names], name
    got = {r.doc_id: r for r in wide.collect()}
    assert set(got) == {1, 3, 4, 5, None} and got[3].text == "[SECRET]" and got[3].n_chars == 8
    assert all(got[i][n] == f"{n}{i}" for i in (1, 3, 4, 5) for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), str(tmp_path)).count() == 0


def test_python_workers_of_bpe_stay_small(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa
    import public_tokenizers as P
    from pyspark import TaskContext
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    from packreview.llm import bpe as B

    path, words = P.path(B.VOCABULARY), [f"w{i}" for i in range(20_000)]
    rng = random.Random(4)
    texts = [" ".join(rng.choices(words, k=2000)) for _ in range(400)]
    docs = frame(spark, list(enumerate(texts))).select("doc_id", "text").coalesce(1)
    taken: dict = {}

    def note(kind, own):
        return lambda self, run, schema: (taken.setdefault(kind, []).append((self, run)), own(self, run, schema))[1]

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", note("groups", PandasCogroupedOps.applyInArrow))
    monkeypatch.setattr(type(docs), "mapInArrow", note("rows", type(docs).mapInArrow))
    coded = B.encode(docs, path, ["doc_id"])
    B.decode(coded, path)
    monkeypatch.undo()
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))

    def most(run, *args) -> float:
        """MB that Python and numpy held at once."""
        tracemalloc.start()
        for _ in run(*args) if len(args) == 1 else [run(*args)]:
            pass
        top = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return top

    table = coded.select("doc_id", "ids").toArrow()
    cut, back = taken["rows"][0][1], taken["rows"][-1][1]
    text = pa.record_batch({"doc_id": list(range(400)), "__text": texts})
    grouped, run = taken["groups"][0]
    left, right = grouped._gd1._df.toArrow(), grouped._gd2._df.toArrow()
    ids = sum(len(x.as_py()) for x in table.column("ids")) / 1e6
    held = most(cut, [text]), most(run, left, right) - ids, most(back, table.combine_chunks().to_batches())
    assert held[0] < 40 and held[1] < 15 and held[2] < 5  # 77, 37 and 7 where slices were of 2 MB


def test_near_duplicates_hold_no_words_and_no_key_on_the_heap(spark):
    import tracemalloc

    from packreview.llm import minhash

    texts = [[" ".join(f"w{i}x{j}" for j in range(500)) for i in range(at, at + 20)] for at in range(0, 400, 20)]
    minhash.shingle_sets(["a b c d"], 3)
    tracemalloc.start()
    for some in texts:
        minhash.shingle_sets(some, 3)
    held = tracemalloc.get_traced_memory()[0] / 1e6
    tracemalloc.stop()
    assert held < 3  # 200,000 words were kept, more than 20 MB
    name = "spark.sql.sortMergeJoinExec.buffer.in.memory.threshold"
    spark.conf.unset(name)
    minhash.near_duplicates(frame(spark, [(1, "a b c d"), (2, "a b c d")]), minhash.NearDup()).collect()
    assert spark.conf.get(name) == "4096"
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8388608b"
