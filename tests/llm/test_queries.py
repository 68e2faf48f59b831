"""The registered queries themselves, over a small copy of the tables with awkward rows, against brute force."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

LOWER = {c: c + 32 for c in range(65, 91)}
SOURCE = "/root/testdata/sf0.001"
KEY = "AKIA" + "Q" * 16


def crc(text):
    return zlib.crc32(text) & 0xFFFFFFFF


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """documents of SOURCE, and nulls, empties, repeated and long rows under ids from 10,000 on."""
    base = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SOURCE}/documents.parquet")
    rng = random.Random(1)
    words = [f"w{i}" for i in range(900)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    near = long.split()
    near[77] = "changed"
    item = spark.read.parquet(f"{SOURCE}/benchmark.parquet").first().text
    more = [
        (10_000, None, "en"), (10_001, "", "en"), (10_002, " \n ", None), (10_003, long, "en"), (10_004, long, "en"), (10_005, " ".join(near), "en"),
        (10_006, f"token = 'abcdef99' {KEY} é {'0a' * 14} password: x", "de"), (10_007, "a" * 5000, None), (10_008, f"Vor. {item.upper()} nach!", "de"),
        (10_009, "one two", None), (10_010, "One TWO", None), (10_011, "日本語 🎉 don't <|endoftext|> a.b, C", None), (10_011, "another text of that id", None),
    ]
    rows = [(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in more]
    every = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    every.repartition(5).write.parquet(f"{base}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SOURCE}/{name}.parquet").write.parquet(f"{base}/{name}.parquet")
    return base


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def run(name, spark, sf):
    from packreview.llm.queries import QUERIES

    return QUERIES[name](spark, sf)


def by_row(rows, texts):
    """Rows of ids that stand once."""
    once = {i for i, _ in texts if sum(j == i for j, _ in texts) == 1}
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in texts)
    return {r.doc_id: r for r in rows if r.doc_id in once}, once


def test_language_query(spark, sf, texts):
    out = run("op1_language", spark, sf)
    assert [f"{n} {t}" for n, t in out.dtypes][:4] == ["doc_id bigint", "held_out boolean", "lang_pred string", "score double"]
    got, once = by_row(out.collect(), texts)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [i for i in once if got[i].held_out]
    assert held == [i for i in once if crc(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == lang[i] for i in held if lang[i] and i < 10_000]) > 0.85
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (10_000, 10_001, 10_002))
    assert all(0 <= r.score <= 1 and (r.lang_pred == "und" or r.lang_pred in set(lang.values())) for r in got.values())


def test_quality_and_toxicity_queries(spark, sf, texts):
    first = {(r.doc_id, round(r.score, 9), r.predicted, r.held_out) for r in run("op8_toxicity", spark, sf).collect()}
    assert first == {(r.doc_id, round(r.score, 9), r.predicted, r.held_out) for r in run("op8_toxicity", spark, sf).collect()}
    assert all(0 <= s <= 1 and p == (s >= 0.3) and h == (crc(str(i).encode()) % 4 == 2) for i, s, p, h in first)
    grades = run("op2_quality", spark, sf).collect()
    assert len(grades) == len(texts) and all(0 <= r.p_keep <= 1 and r.keep == (r.p_keep >= 0.5) for r in grades)


def test_language_query_against_compression(spark, sf, texts):
    """Every text's blocks are compressed here with each dictionary, and the smallest sum is taken."""
    import zstandard

    from packreview.llm import langid as L

    dicts = L.dictionaries(L.training_texts(spark.read.parquet(f"{sf}/documents.parquet")))
    assert list(dicts) == sorted(dicts) and len({len(b) for b in dicts.values()}) == 1
    each = {k: zstandard.ZstdCompressor(L.LEVEL, dict_data=zstandard.ZstdCompressionDict(b, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False, write_checksum=False) for k, b in dicts.items()}
    got, once = by_row(run("op1_language", spark, sf).collect(), texts)
    for i, t in texts:
        if i in once and t and re.search(r"[^\W\d_]", t):
            blocks = [t[a : a + 3000].encode() for a in range(0, len(t), 3000)]
            sums = {k: sum(len(c.compress(b)) for b in blocks) for k, c in each.items()}
            assert got[i].lang_pred == min(sums, key=lambda k: (sums[k], k))
            low, next_ = sorted(sums.values())[:2]
            assert got[i].rejected == (next_ - low < 0.01 * low)
            assert got[i].score == pytest.approx(1 / sum(np.exp(-min(50, (s - low) / (4 * len(blocks)))) for s in sums.values()))


M64 = (1 << 64) - 1


def mixed(h):
    h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & M64
    return h ^ (h >> 29)


def features(word, orders, buckets=1 << 17):
    """Buckets of <word>'s n-grams and of itself, by whole numbers of Python."""
    b = b"<" + word + b">"
    out = []
    for n in orders:
        for a in range(len(b) - n + 1):
            h = 0
            for x in b[a : a + n]:
                h = (h * 0x9E3779B97F4A7C15 + x + 1) & M64
            out.append(mixed((h + n) & M64) % buckets)
    return [*out, mixed_sum(b) % buckets]


def mixed_sum(b):
    return mixed(sum(mixed((x + 1 + i * 0x9E3779B97F4A7C15) & M64) for i, x in enumerate(b)) & M64)


def test_quality_query_against_summed_weights(spark, sf, texts):
    from packreview.llm import quality as Q

    model = Q.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    got, once = by_row(run("op2_quality", spark, sf).collect(), texts)
    for i, t in texts:
        if i in once and len(t or "") < 3000:
            at = [x for w in (t or "").encode().lower().split() for x in features(w, (3,))]
            f = sum(float(model.weights[x]) for x in at) / max(1, len(at))
            tail = [1 / (1 + np.exp(-(f - c))) for c in model.thresholds]
            assert got[i].expected_grade == pytest.approx(model.grades[0] + sum(p * s for p, s in zip(tail, np.diff(model.grades), strict=True)), abs=1e-6)
            assert got[i].p_keep == pytest.approx(tail[-1], abs=1e-6) and got[i].keep == (got[i].p_keep >= 0.5)


def test_toxicity_query_against_averaged_windows(spark, sf, texts):
    from packreview.llm import toxicity as X

    model = X.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    got, once = by_row(run("op8_toxicity", spark, sf).collect(), texts)
    for i, t in texts:
        if i in once and len(t or "") < 3000:
            words = [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))]
            bags = [[float(model.subword[x]) for x in features(w, (3, 4, 5))] for w in words]
            starts = range(0, max(1, len(words) - 12 + 6), 6) if words else ()
            means = [sum(map(sum, bags[a : a + 12])) / sum(map(len, bags[a : a + 12])) for a in starts if bags[a : a + 12]]
            z = max(means) + model.bias if means else min(model.bias, -1.5)
            assert got[i].score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_secrets_query(spark, sf, texts):
    rules = [
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24),
    ]
    got, once = by_row(run("op3_secrets", spark, sf).collect(), texts)
    assert got[10_006].n_assign == got[10_006].n_access == got[10_006].n_hex == 1
    for i, t in texts:
        if i in once:
            want = [(m.start(), o, f"{k}:{m.start()}:{m.end()}") for o, (k, p, g, least) in enumerate(rules) for m in p.finditer(t or "") if len(m.group(g)) >= least]
            line = ",".join(x for _, _, x in sorted(want))
            assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
            assert [got[i][f"n_{k}"] for k, *_ in rules] == [sum(o == j for _, o, _ in want) for j in range(3)]
            assert set(line.split(",")) - {""} <= set(got[i].spans.split(","))


def test_token_id_query(spark, sf, texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = run("op5_token_ids", spark, sf)
    assert [t for _, t in out.dtypes] == ["bigint"] * 4
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(i for i, _ in texts)
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    want = sorted((i, crc(struct.pack(f"<{len(x) + 1}I", *x, 2)), len(x) + 1) for i, t in texts for x in [lib.encode(t or "", add_special_tokens=False).ids])
    assert sorted((r.doc_id, r.ids_crc32, r.n_tokens) for r in rows) == want


def test_byte_bpe_query(spark, sf, texts):
    import public_tokenizers as P
    import tiktoken

    from packreview.llm import bpe as B

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(P.path(B.VOCABULARY)), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i, len(x), sha(struct.pack(f"<{len(x)}I", *x)), sha((t or "").encode())) for i, t in texts for x in [lib.encode_ordinary(t or "")])
    assert sorted(map(tuple, run("op6_byte_bpe", spark, sf).collect())) == want


def test_sharding_query(spark, sf, texts):
    rows = run("op7_sharding", spark, sf).collect()
    want = sorted((i, len((t or "").encode()) + 1, crc((t or "").encode())) for i, t in texts)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} == {"key"} and all(r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8 for r in rows)
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert all(len({r.shard for r in rows if r.doc_id == i}) == 1 for i, _ in texts)


def test_sharding_query_against_its_hashes(spark, sf, texts, tmp_path):
    """Shards from the ids' hashes, and each bucket's order from the seeded permutation of its sorted rows."""
    import xxhash

    from packreview.llm import shards as H

    def drawn(i, k):  # Spark's xxhash64 of several columns takes each result as the next one's seed
        seed = xxhash.xxh64_intdigest(str(i).encode(), 42)
        for n in (H.SEED, k):
            seed = xxhash.xxh64_intdigest(struct.pack("<i", n), seed)
        return seed - (1 << 64) * (seed >> 63)

    rows = run("op7_sharding", spark, sf).collect()
    for r in rows:
        for shard, n in ((r.shard, 8), (r.grown_shard, 9)):
            assert shard == max(range(n), key=lambda k: (drawn(r.doc_id, k), -k))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    written = H.shuffle_to_shards(docs, str(tmp_path / "shards"), bucket_bytes=60_000)
    slots = {}
    cells = {}
    for r in H.with_slots(written, written).collect():
        cells.setdefault((r.shard, r.bucket), []).append((r.place, r.doc_id, r.text))
        slots.setdefault(r.shard, []).append((r.slot, r.bucket, r.place))
    assert sorted((i, t or "") for c in cells.values() for _, i, t in c) == sorted((i, t or "") for i, t in texts) and len(cells) > 16
    for (shard, bucket), held in cells.items():
        plain = sorted(((i, t) for _, i, t in held), key=lambda x: (x[0], x[1] is None, x[1] or ""))
        order = np.random.default_rng([H.SEED, shard, bucket]).permutation(len(plain))
        assert [(i, t) for _, i, t in sorted(held, key=lambda x: x[0])] == [plain[k] for k in order]
    for held in slots.values():
        assert [s for s, *_ in sorted(held, key=lambda x: x[1:])] == list(range(len(held)))


def components(sets, percent):
    """(component, linked) of rows numbered in order, by all pairs."""
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(x) for x in range(len(sets))]


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_minhash_query(spark, sf, texts):
    rows = sorted(texts, key=lambda r: (r[0], r[1] or ""))
    sets = [shingles(t, 3) for _, t in rows]
    low = [rows[c][0] for c in components(sets, 85)]
    want = sorted((i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, low, strict=True))
    assert sorted(map(tuple, run("op9_minhash", spark, sf).collect())) == want


def hits(words, items, size=10):
    hit, found = set(), set()
    for item, w in items:
        k = min(size, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1) if windows else ():
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(str(item))
    return hit, found


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def test_decontamination_query(spark, sf, texts):
    items = [(r.item_id, words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = []
    for i, t in texts:
        hit, found = hits(words_of(t), items)
        want.append((i, len(words_of(t)), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = sorted(map(tuple, run("op10_decontamination", spark, sf).collect()))
    assert got == sorted(want) and any(r[5] for r in want)


def test_pipeline_against_brute_force(spark, sf, texts):
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline
    from packreview.llm import bpe as B
    from packreview.llm import secrets as S
    from packreview.llm import toxicity as X

    model = X.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    score = X.score_texts([t for _, t in texts], X.WordScores(model.subword, X.ORDERS), model.bias)
    rows = sorted((r for r, s in zip(texts, score, strict=True) if s < X.THRESHOLD), key=lambda r: (r[0], r[1] or ""))
    sets = [shingles(t, 5) for _, t in rows]
    rows = [r for k, (r, c) in enumerate(zip(rows, components(sets, 80), strict=True)) if k == c]
    items = [(r.item_id, words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not hits(words_of(t), items)[0]]
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(P.path(B.VOCABULARY)), special_tokens={})

    def clean(t):
        found = [m for r in S.RULES for m in re.finditer(r.pattern, t) if len(m.group(r.group)) >= r.least]
        spans, out, at = sorted(m.span() for m in found), "", 0
        for a, b in spans:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        return out + t[at:]

    want = []
    for i, t in rows:
        c = clean(t or "")
        ids = lib.encode_ordinary(c)
        want.append((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), hashlib.sha256(c.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in got) == sorted(want)
    assert {r.doc_id: r.n_chars for r in got}[10_006] == len(clean(dict(texts)[10_006])) != len(dict(texts)[10_006])
