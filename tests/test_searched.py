"""Decisions on searched evidence, against brute force over every company chunk of the case."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from packreview.jobs import queries as Q


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two nations: one with six suppliers (24 chunks), one with two; a third with a tender and no supplier."""
    d = str(tmp_path_factory.mktemp("tables"))
    customers = [(i, (0, 0, 1, 2)[i // 8 % 4], 900.0 + 350 * i) for i in range(1, 33)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{d}/customer.parquet")
    suppliers = [(i, 0 if i <= 6 else 1, 1500.0 * i) for i in range(1, 9)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(0, "A"), (1, "B"), (2, "C"), (3, "D")], "n_nationkey int, n_name string").write.parquet(f"{d}/nation.parquet")
    return d


def tokens(text):
    return re.findall("[a-z0-9]+", text.lower())


def embed(text):
    v = defaultdict(float)
    for t in tokens(text):
        c = zlib.crc32(t.encode())
        v[c % 384] += 1 if c & 0x100 else -1
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items() if x}


def trigrams(text):
    t = " ".join(text.lower().split())
    return {t[i : i + 3] for i in range(len(t) - 2)}


def brute(query, chunks, k=8, pool=30):
    """Chunk ids for a query; chunks: (chunk_id, pos, text) of one case."""
    chunks = sorted(chunks, key=lambda c: c[1])
    docs = [tokens(c[2]) or ["empty"] for c in chunks]
    df = Counter(t for d in docs for t in set(d))
    raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: low if x < 0 else x for t, x in raw.items()}
    mean = sum(map(len, docs)) / len(docs)
    q, qv = tokens(query), embed(query)

    def bm25(d):
        tf = Counter(d)
        return sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in q if t in tf)

    def ranks(scores):
        order = sorted(range(len(chunks)), key=lambda i: (-round(scores[i], 9), i))[:pool]
        return {i: r + 1 for r, i in enumerate(order)}

    vectors = [embed(c[2]) for c in chunks]
    rv = ranks([sum(w * qv.get(dim, 0.0) for dim, w in v.items()) for v in vectors])
    rb = ranks([bm25(d) for d in docs])
    fused = {i: sum(1 / (60 + r[i]) for r in (rv, rb) if i in r) for i in rv.keys() | rb.keys()}
    order = sorted(fused, key=lambda i: (-round(fused[i], 9), rv.get(i, 10**9), rb.get(i, 10**9)))[:pool]
    a = trigrams(query)
    near = {i: len(a & (b := trigrams(chunks[i][2]))) / len(a | b) for i in order}
    best = sorted(range(len(order)), key=lambda n: (-round(near[order[n]], 9), n))[:k]
    return [chunks[order[n]] for n in best]


def decide(need, hits):
    """The rules of the derived lines, over ranked hits."""
    low = need.lower()
    first = lambda *marks: next((h[2] for h in hits if any(m in h[2].lower() for m in marks)), None)
    money = lambda text: int(re.search(r"Rs\. (\d+)", text)[1])
    for word in ("turnover", "solvency"):
        if word in low:
            want = int(re.search(r"(\d+) lakh", low)[1]) * 100000 if "lakh" in low else money(need)
            found = first(word)
            return "missing" if found is None else "met" if money(found) >= want else "not_met"
    if "similar" in low:
        works = [money(h[2]) for h in hits if "civil work" in h[2]]
        count = int(re.search(r"completed (\d)", low)[1])
        return "missing" if not works else "met" if sum(w >= money(need) for w in works) >= count else "not_met"
    if "gst" in low:
        return "met" if first("goods and services tax") else "missing"
    if "blacklist" in low:
        found = first("blacklisted")
        return "missing" if found is None else "met" if "never been" in found else "not_met"
    return "met" if first("demand draft", "earnest money deposit") else "missing"


def test_searched_decisions_against_brute_force(spark, folder):
    chunks = defaultdict(list)
    for r in Q.company(spark, folder).collect():
        chunks[r.case_id].append((r.chunk_id, r.pos, r.text))
    assert len(chunks[0]) == 24 and 2 not in chunks
    got = Q.dec9_matrix_searched(spark, folder).collect()
    want = {(r.case_id, r.req_id): decide(r.text, brute(r.text, chunks[r.case_id]) if chunks.get(r.case_id) else []) for r in got}
    assert len(got) == len(want) > 20 and {(r.case_id, r.req_id): r.decision for r in got} == want
    # evidence from beyond the case's first eight chunks is seen, and decisions turn on it
    first = {c[0] for c in sorted(chunks[0], key=lambda c: c[1])[:8]}
    assert any(r.case_id == 0 and r.evidence_chunk_id and r.evidence_chunk_id not in first for r in got)

    verdict = {}
    for case in range(4):
        rows = [(r, want[r.case_id, r.req_id]) for r in got if r.case_id == case]
        stop = any(x == "not_met" or (x == "missing" and r.obligation == "qualification") for r, x in rows)
        verdict[case] = "NO-GO" if stop else "GO" if rows and all(x == "met" for _, x in rows) else "CONDITIONAL"
    assert {r.case_id: r.go_no_go for r in Q.dec10_go_no_go_searched(spark, folder).collect()} == verdict
    counts = {r.case_id: (r.n, r.met, r.not_met, r.missing, r.unclear) for r in Q.dec11_counts_searched(spark, folder).collect()}
    by_case = defaultdict(Counter)
    for (case, _), x in want.items():
        by_case[case][x] += 1
    assert counts == {c: (n.total(), n["met"], n["not_met"], n["missing"], n["unclear"]) for c, n in by_case.items()}


def test_hits_against_brute_force(spark, folder):
    from packreview.jobs import review as R
    from packreview.operators import extract

    req = extract.requirements(Q.tender(spark, folder)).withColumn("req_id", Q.F.col("ord"))
    chunks = defaultdict(list)
    for r in Q.company(spark, folder).collect():
        chunks[r.case_id].append((r.chunk_id, r.pos, r.text))
    hits = defaultdict(list)
    for r in R.evidence_hits(req, Q.company(spark, folder)).orderBy("rank").collect():
        hits[r.case_id, r.req_id].append(r.chunk_id)
    rows = [r for r in req.collect() if r.case_id in chunks]
    assert {k: len(v) for k, v in hits.items()} == {(r.case_id, r.req_id): 8 for r in rows}
    for r in rows:
        assert hits[r.case_id, r.req_id] == [c[0] for c in brute(r.text, chunks[r.case_id])], r.text


def test_claims_count_the_dates_that_the_letter_asks_about(spark, folder):
    from packreview.jobs import more_queries as M

    open_rows = Counter(r.case_id for r in M._rule_matrix(spark, folder)[1].where("decision <> 'met'").collect())
    got = {r.case_id: r.n for r in M.ver1_claims(spark, folder).where("stage = 'drafter'").collect()}
    dates = {0: 2, 1: 1, 2: 1}  # customers 5 and 13, 21, 29
    assert got == {case: min(6, open_rows[case]) + n for case, n in dates.items()}


def test_all_modes_are_scored_from_two_searches_and_no_pairs(spark, folder, monkeypatch):
    from packreview.jobs import flow_queries as W
    from packreview.operators import evaluate, retrieval

    made, in_blocks, scores = [], retrieval._in_blocks, evaluate.scores_of_hits
    monkeypatch.setattr(retrieval, "_in_blocks", lambda *a: (made.append("search"), in_blocks(*a))[1])
    monkeypatch.setattr(evaluate, "scores_of_hits", lambda hits, n: (made.append(n.count()), scores(hits, n))[1])
    got = {r["mode"]: r for r in W.evl2_all_modes(spark, folder).collect()}
    assert made[:2] == ["search"] * 2 and len(made) == 3  # each mode searched anew, and each pair of a fact was a row
    assert set(got) == {"vector", "bm25", "hybrid", "hybrid_rerank"} and all(0 < r.queries <= made[2] and r.recall5 <= r.recall10 for r in got.values())
