"""Work that must not grow with the pairs of two tables."""

import pyarrow as pa

from packreview.operators import retrieval


def shuffled_rows(spark) -> int:
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_searches_do_not_make_a_row_for_each_pair(spark):
    chunks = spark.range(2000).selectExpr("'x' as corpus", "cast(id as string) as chunk_id", "id as pos", "concat('the firm has a valid certificate of class ', id % 50) as text")
    queries = spark.range(400).selectExpr("'x' as corpus", "id as query_id", "concat('a certificate of class ', id % 40, ' for lot ', 5000 + id) as text")
    for top in (retrieval.bm25_top, retrieval.hash_vector_top):
        before = shuffled_rows(spark)
        got = top(queries, chunks, 5, True).where("query_id = 7").orderBy("rank").collect()
        assert shuffled_rows(spark) - before < 100_000  # 800,000 pairs
        assert len(got) == 5
        if top is retrieval.bm25_top:
            assert [r.chunk_id for r in got] == ["7", "57", "107", "157", "207"]


def test_scores_too_large_for_one_whole_number_and_unshared_pairs():
    import numpy as np

    scores = np.array([[1.0, 3.0, 3.0, 2.0], [0.0, -1.0, 5.0, 5.0]])
    for by in (1.0, 1e10):
        row, col = retrieval._best(scores * by, None, 2)
        assert {(int(r), int(c)) for r, c in zip(row, col)} == {(0, 1), (0, 2), (1, 2), (1, 3)}
        row, col = retrieval._best(scores * by, scores != 3.0, 3)
        assert {(int(r), int(c)) for r, c in zip(row, col)} == {(0, 0), (0, 3), (1, 0), (1, 2), (1, 3)}


def test_a_plain_table_is_as_large_as_its_rows(spark):
    from packreview.sources.scratch import materialise

    rows = spark.range(200_000).selectExpr("id % 3 as k", "'the bidder must hold a valid licence' as text")
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size(materialise(rows, "rows")) < 1_000_000 < 8_000_000 < size(materialise(rows, "rows", plain=True))


def test_turns_of_many_that_want_the_same(spark):
    from packreview.operators import evaluate

    texts = spark.range(300).selectExpr("1 as case_id", "id as ord", "concat('a turnover of lot ', id) as text", "'' as quote")
    gold = spark.range(250).selectExpr("1 as case_id", "id as gold_ord", "array(if(id % 2 = 0, 'Turnover', 'lot 29')) as phrases")
    before = shuffled_rows(spark)
    assert [tuple(r) for r in evaluate.match_gold(texts, gold).collect()] == [(1, 250, 300, 125 + 11)]  # 29 and 290 to 299
    assert shuffled_rows(spark) - before < 40_000  # each turn was a round of joins over all pairs


def test_dense_search_takes_many_queries_in_slices(spark, monkeypatch):
    import numpy as np

    sizes, best = [], retrieval._best
    vectors = [(i, np.random.default_rng(i % 90).normal(size=4).tolist()) for i in range(600)]
    v = spark.createDataFrame(vectors, "id long, vector array<double>")
    got = retrieval.dense_top(v.withColumnRenamed("id", "query_id"), v, 3).where("query_id in (5, 500)").orderBy("query_id", "rank").collect()
    assert [r.id for r in got] == [5, 95, 185, 50, 140, 230]
    monkeypatch.setattr(retrieval, "_best", lambda s, shares, k: (sizes.append(s.shape[0]), best(s, shares, k))[1])
    monkeypatch.setattr(type(v), "mapInPandas", lambda df, run, schema: (list(run(iter([df.toPandas()]))), df.selectExpr("id as query_id", "id", "0d as score"))[1])
    retrieval.dense_top(v.withColumnRenamed("id", "query_id"), v, 3)
    assert sum(sizes) == 600 and max(sizes) <= retrieval.SLICE


def test_equal_quotes_and_texts_meet_once(spark):
    from packreview.operators import extract

    text = "the bidder shall not have been blacklisted by any department"
    chunks = spark.range(600).selectExpr("1 as case_id", "concat('c', id) as chunk_id", "id + 5 as pos", f"if(id % 2 = 0, '{text}', concat('{text} of lot ', id % 4)) as text")
    claims = spark.range(500).selectExpr("1 as case_id", "id as claim_id", f"if(id % 2 = 0, '{text}', 'not have been blacklisted by any department of lot 3') as quote", "'none' as chunk_id")
    before = shuffled_rows(spark)
    got = {(r.claim_id % 2, r.found_chunk) for r in extract.chunk_of_quote(claims, chunks).collect()}
    assert got == {(0, "c0"), (1, "c3")}
    assert shuffled_rows(spark) - before < 30_000  # 300,000 pairs


def test_reranking_compares_pairs_by_matrices_and_broadcasts_no_texts(spark):
    from pyspark.sql import functions as F

    from packreview.functions import text as T

    texts = ["a valid licence of class 7", "A  valid\tLICENCE", "", "ab", "\U0001f600\U0001f600\U0001f601 ok ok ok", "x" * 1999 + "yz valid licence", None, "valid licence of the firm"]
    chunks = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "corpus string, chunk_id int, text string")
    queries = chunks.select("corpus", F.col("chunk_id").alias("query_id"), "text")
    pool = queries.crossJoin(chunks.select("chunk_id")).withColumn("rank", F.col("chunk_id") + 1)
    score = lambda q, t: F.round(T.trigram_jaccard(q, t), 12)
    got = retrieval.rerank(pool, queries, chunks, 5)
    rows = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 12)) for r in df.collect())
    assert rows(got) == rows(retrieval.rerank(pool, queries, chunks, 5, scorer=score)) and len(rows(got)) == 40
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_reranking_reads_whole_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from packreview.functions import text as T

    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    query, texts = "valid licence \U0001f600\U0001f601 ok", ["x" * 2500 + " no", "x" * 2500 + " valid licence \U0001f600\U0001f601 ok", "é" * 90_000 + " licence", "", None]
    want = [len(grams(query) & grams(t or "")) / len(grams(query) | grams(t or "")) for t in texts]
    chunks = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "corpus string, chunk_id int, text string").coalesce(1)
    queries = spark.createDataFrame([("x", 1, query)], "corpus string, query_id int, text string")
    pool = chunks.select("corpus", F.lit(1).alias("query_id"), "chunk_id", (F.col("chunk_id") + 1).alias("rank"))
    for scorer in (None, T.trigram_jaccard):
        got = {r.chunk_id: r.score for r in retrieval.rerank(pool, queries, chunks, 9, scorer=scorer).collect()}
        assert all(abs(got[i] - x) < 1e-12 for i, x in enumerate(want)) and want[1] > want[0] == 0
    sizes, jaccards = [], retrieval._jaccards
    monkeypatch.setattr(retrieval, "_jaccards", lambda a, b: (sizes.append(sum(map(len, set(b.to_pylist())))), jaccards(a, b))[1])
    monkeypatch.setattr(retrieval, "CHARACTERS", 3000)
    long = pa.array([f"{i}{'y' * 1000}" for i in range(40)] + ["z" * 5000])
    list(retrieval._pair_scores([pa.record_batch({"__q": pa.array(["a licence"] * 41), "__t": long})]))
    assert sum(sizes) == sum(map(len, long.to_pylist())) and sorted(sizes)[-2] <= 3000 and max(sizes) == 5000


def test_evidence_is_cited_without_a_broadcast_of_the_texts(spark):
    import re

    from packreview.jobs import review

    company = spark.range(40).selectExpr("1 as case_id", "concat('c', id) as chunk_id", "id as pos", "concat('a solvency certificate of class ', id) as text")
    req = spark.range(3).selectExpr("1 as case_id", "id as req_id", "concat('a certificate of class ', id) as text")
    hits = review.evidence_hits(req, company, 2, "bm25")
    assert re.search(r"SortMergeJoin \[.*?chunk_id#\d+\]", hits._jdf.queryExecution().executedPlan().toString())
    assert {(r.req_id, r.chunk_id) for r in hits.where("rank = 1").collect()} == {(0, "c0"), (1, "c1"), (2, "c2")}


def test_a_review_reads_risks_and_deadlines_from_the_text_once(spark):
    from packreview.jobs import review

    text = "concat('Liquidated damages of class ', id, ' shall be levied. The pre-bid meeting of lot ', id, ' is held on 12-Oct-2026.') as text"
    tender = spark.range(6).selectExpr("1 as case_id", "concat('t', id) as chunk_id", "id as pos", "1 as page", text)
    company = spark.range(4).selectExpr("1 as case_id", "concat('c', id) as chunk_id", "id as pos", "'the firm pays' as text")
    out = review.review(spark.sql("select 1 as case_id, 'x' as title"), tender, company)
    assert (out["risks"].count(), out["deadlines"].count(), out["failures"].count()) == (6, 6, 0)
    for name in ("risks", "deadlines", "failures"):
        assert "Generate" not in out[name]._jdf.queryExecution().executedPlan().toString()


def test_chunking_takes_small_batches_and_folds_as_before(spark):
    from pyspark.sql import functions as F

    from packreview.functions import text as T
    from packreview.operators import chunking

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10000")
    docs = spark.sql("select '1' as document_id, 0 as ordinal, 0 as case_id, 'tender' as role, 'x' as filename")
    docs = docs.withColumn("text", F.lit("PART  ONE  TWO\n　the text  "))
    assert [(r.section, r.text) for r in chunking.chunk_texts(docs).collect()] == [("PART ONE TWO", "the text")]
    assert spark.conf.get(name) == "512"
    odd = spark.range(0x3100).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    x = F.concat("c", F.lit("a b"), "c", F.lit("c"), "c")
    assert odd.where(T.strip(x) != F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).count() == 0


def test_runs_of_lines_are_measured_once(spark):
    from packreview.functions import text as T
    from packreview.operators import chunking

    docs = spark.sql("select id as document_id, id as ordinal, 0 as case_id, 'tender' as role, 'x' as filename, 'PART ONE' as text from range(3)")
    plan = chunking.chunk_texts(docs)._jdf.queryExecution().optimizedPlan().toString()
    fold = plan[plan.index("ArrowEvalPython [_ranges") : plan.index("ArrowEvalPython [_runs")]
    assert fold.count(T.PART_WORD) == 1  # once for each argument before


def test_packs_are_files_of_one_folder(spark, tmp_path):
    from pyspark.sql import functions as F

    from packreview.jobs import flow_queries

    rows = spark.range(60).selectExpr("id % 5 as case_id", "id as part", "concat('pack ', id) as body")
    flow_queries._written(rows, F.col("body"), f"{tmp_path}/in")
    read = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(f"{tmp_path}/in")
    assert {r.value for r in read.collect()} == {f"pack {i}\n" for i in range(60)}
    assert len({f.rsplit("/", 1)[0] for f in read.inputFiles()}) == 1  # a folder for each pack is a listing task for each
