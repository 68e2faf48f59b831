"""Skewed labels: rare languages, many grades."""

import random
import zlib

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rare_language_leaves_the_others_whole(spark):
    from packreview.llm import langid as L

    rng = random.Random(16)
    letters = {"aa": "etaoinshrdlu", "bb": "etaoinshrdlu", "cc": "kwzxqjyvbpgm"}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(3, 8))) for _ in range(60)] for k, v in letters.items()}
    make = lambda k, n=60: " ".join(rng.choice(words[k]) for _ in range(n))
    learned = {k: [make(k) for _ in range(120)] for k in ("aa", "bb")} | {"cc": [make("cc", 16)], "dd": ["  ", ""]}
    dicts = L.dictionaries(learned)
    whole = {k: "\n".join(v).encode() for k, v in learned.items()}
    assert list(dicts) == ["aa", "bb", "cc"] and len(whole["cc"]) < 200 and whole["aa"][:30_000] == dicts["aa"][:30_000]
    assert len({len(b) for b in dicts.values()}) == 1 and set(dicts["cc"].split(b"\n")[:-1]) == {whole["cc"]}
    rows = [(i, make(k), k, "s", 0) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    got = {r.doc_id: r.lang_pred for r in L.identify(spark.createDataFrame(rows, DOCS), dicts).collect()}
    right = {k: np.mean([got[i] == k for i, _, lang, *_ in rows if lang == k]) for k in ("aa", "bb", "cc")}
    assert right["aa"] > 0.95 and right["bb"] > 0.95 and right["cc"] > 0.6, right


@pytest.mark.parametrize(("grades", "kind"), [([float(g) for g in range(20)], "int"), ([1.0, 2.5, 3.25, 3.5], "double"), ([1.0, 2.5, 3.25, 3.5], "decimal(4,2)")])
def test_every_grade_is_learned(spark, grades, kind):
    from packreview.llm import quality as Q
    from packreview.llm.toxicity import training_sample

    rows = [(i, f"word{grades[i % len(grades)]} other{i % 7} text", grades[i % len(grades)]) for i in range(40 * len(grades))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, y0 double").select("doc_id", Q.F.col("y0").cast(kind).alias("quality"))
    sample = training_sample(docs, labels, "quality", 9).collect()
    assert sorted({r.y for r in sample}) == grades and all(f"word{float(r.y)} " in r.text for r in sample)
    assert all(sum(r.y == g for r in sample) <= 9 for g in grades)
    model = Q.train(docs, labels)
    assert model.grades == grades and len(model.thresholds) == len(grades) - 1 and (np.diff(model.thresholds) > 0).all()
    out = Q.grade(docs, model).agg(Q.F.min("expected_grade"), Q.F.max("expected_grade")).first()
    assert grades[0] <= out[0] < out[1] <= grades[-1]


def test_shares_of_fractional_grades(spark):
    from packreview.llm import quality as Q
    from packreview.llm.toxicity import training_sample

    rows = [(i, 3.5 if i % 4 else 1.5) for i in range(400)]
    labels = spark.createDataFrame(rows, "doc_id long, quality double")
    shares = Q.grade_shares(labels, "quality")
    assert set(shares) == {1.5, 3.5} and sum(shares.values()) == pytest.approx(1)
    docs = spark.createDataFrame([(i, "t") for i, _ in rows], "doc_id long, text string")
    assert {r.y for r in training_sample(docs, labels, "quality").collect()} == set(shares)


def test_many_grades_are_binned(spark):
    from packreview.llm import quality as Q
    from packreview.llm import toxicity as X

    labels = spark.range(2000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "doc_id / 2000 as quality")
    docs = labels.selectExpr("doc_id", "'t' as text")
    sample = X.training_sample(docs, labels, "quality").collect()
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(sample) == len(held) and len({r.y for r in sample}) == 128
    assert all(0 <= int(r.key) / 2000 - r.y < 0.0079 for r in sample)
    assert sum(Q.grade_shares(labels, "quality").values()) == pytest.approx(1)
    assert Q.grade(docs, Q.train(docs, labels)).count() == 2000


def test_many_and_tiny_languages_are_all_learned(spark):
    from packreview.llm import langid as L

    rows = [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26 % 26) * 3} " * 30, f"l{i % 260}", "s", 0) for i in range(2600)] + [(9000, "q", "one", "s", 0), (9001, "", "none", "s", 0), (9004, "", "none", "s", 0)]
    texts = L.training_texts(spark.createDataFrame(rows, DOCS))
    dicts = L.dictionaries(texts)
    assert {f"l{i}" for i in range(260)} <= set(dicts) and "none" not in dicts and ("one" in dicts) == ("one" in texts)
    assert len(L.dictionaries({f"x{i}": ["ab" * 60_000] for i in range(1300)})["x7"]) <= (64 << 20) // 1300
    assert L.dictionaries({"one": ["q"]})["one"].startswith(b"q")


def test_each_text_gives_its_share(spark):
    from packreview.llm import langid as L

    rows = [(i, chr(97 + i % 20) * 50_000 + f" {i}", "en", "s", 0) for i in range(20)]
    got = L.training_texts(spark.createDataFrame(rows, DOCS))["en"]
    learned = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(got) == len(learned) and all(len(t) == -(-L.DICT_BYTES * 125 // (100 * len(learned))) for t in got)
    assert sorted(set(L.dictionaries({"en": got})["en"].decode()) - {"\n"}) == sorted({chr(97 + i) for i in learned}) or len(got) > 15


@pytest.mark.parametrize("text", ["same", "other"])
def test_one_id_fills_no_bucket(spark, text):
    """A third of all bytes under one id, with equal or different texts, or without an id."""
    from packreview.llm import shards as H
    from packreview.llm.common import fresh_path

    hot = [(7 if i % 2 else None, "x" * 99 if text == "same" else f"{i:099d}") for i in range(600)]
    rows = hot + [(1000 + i, "y" * 99) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    limit = 5000
    got = H.with_slots(w := H.shuffle_to_shards(docs, fresh_path(spark, "hot"), bucket_bytes=limit), w).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in rows)
    assert len({r.shard for r in got if r.doc_id == 7}) == len({r.shard for r in got if r.doc_id is None}) == 1
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    sizes = {}
    for r in got:
        sizes[r.shard, r.bucket] = sizes.get((r.shard, r.bucket), 0) + 100
    assert max(sizes.values()) <= 1.8 * limit, sizes


@pytest.mark.parametrize(("parts", "hubs"), [(64, 16), (1, 1)])
def test_a_large_group_of_near_copies_against_all_pairs(spark, monkeypatch, parts, hubs):
    """Copies of one text with changed words, about as many pairs under the threshold as over it."""
    from packreview.llm import minhash as M

    monkeypatch.setattr(M, "PARTS", parts)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 3, 4, 5, 6])):
            w[rng.randrange(120)] = rng.choice(["x", "y", f"own{i}"])
        rows.append((i, " ".join(w), "en", "s", 0))
    sets = [{tuple(t.split()[a : a + 3]) for a in range(118)} for _, t, *_ in rows]
    low = list(range(90))
    for _ in range(90):
        for a in range(90):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
    found = M.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5), M.NearDup(hubs=hubs))
    got = {r.id: r.component for r in found.collect()}
    assert got == dict(enumerate(low)) and 3 < len(set(low)) < 80


def test_the_sample_is_that_of_the_least_hashes(spark):
    from packreview.llm import toxicity as X

    labels = spark.range(60_000).selectExpr("id as doc_id", "cast(id % 50 = 0 as int) as toxic")
    got = X.training_sample(labels.selectExpr("doc_id", "'t' as text"), labels, "toxic", 200).collect()
    rows = X.rated(labels, "toxic").select("doc_id", "y", X.F.xxhash64(X.F.col("doc_id").cast("string"), X.F.lit(11)).alias("h")).collect()
    want = [r.doc_id for y in (0, 1) for r in sorted((r for r in rows if r.y == y), key=lambda r: (r.h, r.doc_id))[:200]]
    assert sorted(int(r.key) for r in got) == sorted(want)
