"""Personal data, divergence of sources and spelling variants against brute force, on small tables with awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packreview.llm import divergence as D
from packreview.llm import pii as P
from packreview.llm import skipchain as S
from packreview.llm import spelling as W
from packreview.llm.automaton import Automaton, one_error

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        own = digits[::-1]
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(own)) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if valid(k, m.group())]


def own_base(text):
    return [(P.KINDS[k], a, b) for k, a, b in sorted(P.pattern_spans(text)[0])]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a0123.@+-() é_%", max_size=40))
def test_patterns_equal_the_plain_ones(text):
    assert own_base(text) == base(text)


@pytest.mark.parametrize("text", [
    "4845168114407329", "4845-1681 1440 7329", "0" * 13, "x@y", "a@b.c.d@e.f", "a@b.c_d@e.f x@-.-", "001.002.255.256", "1.2.3.4.5.6.7.8", "+1 (521) 555-2373.", "+1-2-3-4-5-6-7-8-9",
    "1" * 5000 + "." + "0" * 5000 + ".1.1", "@" * 50, "a" * 100_000, "9" * 100_000, "+" * 1000 + "1" * 12, "",
])
def test_patterns_on_awkward_texts(text):
    long_part = any(len(p) > 4000 for p in text.split("."))
    assert own_base(text) == ([] if long_part else base(text))


def exact(field, g):
    """Marginals by enumeration of all labellings."""
    n, labels = len(g.sizes), field.unary.shape[1]
    own, pot = field.node_scores(g, True), field.potentials()
    total = np.zeros((n, labels))
    for y in itertools.product(range(labels), repeat=n):
        s = sum(own[i, y[i]] for i in range(n)) + sum(pot[0 if k == 0 else k + 1][y[u], y[v]] for u, v, k in g.edges)
        total[range(n), y] += np.exp(s)
    return total / total.sum(axis=1, keepdims=True)


def random_field(seed, kinds=2, features=6):
    rng = np.random.default_rng(seed)
    f = S.Field.blank(kinds, features)
    f.unary, f.chain = rng.normal(size=f.unary.shape), rng.normal(size=f.chain.shape)
    x = rng.normal(size=f.links.shape)
    f.links = x + x.transpose(0, 2, 1)
    return f


def graph(edges, n=4, label=None, seed=0):
    sizes = np.full(n, 2)
    linked = {v for _, v, k in edges if k == 0}
    return S.Graph(
        np.random.default_rng(seed).integers(0, 6, 2 * n), sizes, np.array(edges, np.int64).reshape(-1, 3), np.array([i for i in range(n) if i not in linked]), np.array(label or [-1] * n)
    )


@pytest.mark.parametrize("edges", [[], [(0, 1, 0), (1, 2, 0), (2, 3, 0)], [(0, 1, 0), (0, 2, 1), (2, 3, 2)]])
def test_messages_are_exact_without_loops(edges):
    for seed in range(5):
        f, g = random_field(seed), graph(edges, label=[-1, -1, -1, seed % 5], seed=seed)
        got, pairs = S.beliefs(f, g)
        assert np.allclose(got, exact(f, g), atol=2e-3)
        for (u, v, _), p in zip(g.edges, pairs, strict=True):
            assert np.allclose(p.sum(axis=1), got[u], atol=1e-2) and np.allclose(p.sum(axis=0), got[v], atol=1e-2)


def test_messages_come_near_with_a_loop():
    f, g = random_field(3), graph([(0, 1, 0), (1, 2, 0), (0, 2, 1), (2, 3, 2)])
    f.unary /= 2
    f.links /= 4
    f.chain /= 2
    assert np.abs(S.beliefs(f, g)[0] - exact(f, g)).max() < 0.05


def test_no_entity_begins_inside():
    f = random_field(1)
    f.unary[:, 2] += 5
    node, _ = S.beliefs(f, graph([(0, 1, 0)]))
    assert node[0, 2] < 1e-7 and node[2, 2] < 1e-7 and node[1, 2] > 0.1


CARD, OTHER = "4845168114407329", "4736962573099581"
SEEN = [
    f"the {w} of {x} was here again {i % 7} times"
    for i, (w, x) in enumerate(itertools.product(["number", "mail", "name"], [CARD, OTHER, "a.b7@mail.example.com", "10.20.30.40", "+1 (521) 555-2373", "4.0", "1234567890123456", "x17", "2024-05-06", f"{CARD} and {CARD}"] * 6))
]


@pytest.fixture(scope="module")
def field():
    return P.train_on(SEEN)


def test_like_tokens_take_the_label_of_their_kin(field):
    texts = [
        f"the number {CARD} and 4845.1681.1440.7329 again", f"the number of {OTHER} {CARD} was here", "the number of 1234567890123456 was 4845.1681.1440.7328 again", "see 4.0 and 2024-05-06 twice", None, "", "no number",
    ]
    got = P.spans_of(texts, field)
    cut = [[(P.KINDS[k], t[a:b], by) for k, a, b, by, _ in own] for t, own in zip(texts, got, strict=True)]
    assert cut[0] == [("card", CARD, True), ("card", "4845.1681.1440.7329", False)]
    assert cut[1] == [("card", OTHER, False), ("card", CARD, False)]
    assert all(not own for own in cut[2:])
    assert P.redacted(texts[0], got[0]) == "the number [CARD] and [CARD] again" and P.redacted(None, []) is None


def test_links_grow_with_the_tokens_alone():
    page = P.page_of(" ".join([CARD] * 500 + ["x " + OTHER] * 300))
    assert len(P.links_of(page.tokens, page.label)) <= len(page.tokens)


def test_pii_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(SEEN), "en", "s", 1) for i in range(300)]
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "x " * 60_000 + CARD, "en", "s", 0), (1003, f"{CARD} a@b.co 1.2.3.4 +12 345 678 901", "en", "s", 0), (1003, f"{CARD} a@b.co 1.2.3.4 +12 345 678 901", "en", "s", 0), (None, "a@b.co", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = P.op11_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    text = defaultdict(list)
    for i, t, *_ in rows:
        text[i].append(t or "")
    for r in got:
        want = base(text[r.doc_id][0])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x == k for x, *_ in want) for k in P.KINDS]
        assert set(line.split(",")) - {""} <= set(r.spans.split(",")) and r.n_added == len(r.spans.split(",")) * (r.spans != "") - len(want)
    clash = P.find(docs.withColumn("findings", F.lit(1)).withColumn("redacted", F.lit(2)), P.train(docs.where("false")), redact=True)
    assert clash.columns == ["doc_id", "text", "lang", "source", "n_chars", "findings", "redacted"] and clash.count() == len(rows)
    assert P.find(docs.where("false"), P.train_on([])).count() == 0


# Divergence of sources

def divergence_by_hand(rows, top=200):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        own = {s: {t: c[t] for t in kept} for (la, s), c in groups.items() if la == lang}
        p = lambda counts: {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts.values()) + len(kept)) for t in kept}
        parts, every = {s: p(c) for s, c in own.items()}, p({t: sum(c[t] for c in own.values()) for t in kept})
        value = lambda a, b, t: (a[t] - b[t]) ** 2 // b[t]
        for s in own:
            pairs = [("pair", o, sum(value(parts[s], parts[o], t) for t in kept)) for o in own if o != s]
            terms = [("term", t, value(parts[s], every, t)) for t in kept if own[s][t] > 0 and parts[s][t] > every[t]]
            for xs, most in ((pairs, None), (terms, top)):
                for rank, (part, item, v) in enumerate(sorted(xs, key=lambda x: (-x[2], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, v, rank))
    return sorted(out)


def divergence_rows(seed, n=160):
    rng = random.Random(seed)
    words = ["a", "B", "é", "É", "zz", "日本", "x1y", "Don't", "\U0001f600"] + [f"w{'abcdefgh'[i % 8] * (i % 5 + 1)}" for i in range(30)]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S2", "é", None])) for _ in range(n)]
    return rows + [(None, "en", "only null"), ("", "en", "empty"), ("1 2 3", "digits", "a"), ("7", "digits", "b"), ("one source", "lone", "x"), ("a " * 20_000, "en", "s1")] + rows[:5] * 3


@pytest.mark.parametrize(("block", "chunk", "cells", "scale"), [(256, 1 << 15, 500_000, 1 << 11), (2, 4, 500_000, 3), (3, 1000, 7, 2)])
def test_divergence_by_hand(spark, monkeypatch, block, chunk, cells, scale):
    for name, value in (("BLOCK", block), ("CELLS", cells), ("SLICE", scale)):
        monkeypatch.setattr(D, name, value)
    rows = divergence_rows(block)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("x")).withColumn("n", F.lit(3)).repartition(5)
    got = D.divergence(docs, top=9, chunk=chunk)
    assert [f"{n} {t}" for n, t in got.dtypes] == ["lang string", "source string", "part string", "item string", "value bigint", "rank int"]
    assert sorted(map(tuple, got.collect())) == divergence_by_hand(rows, 9)


def test_divergence_of_an_empty_table(spark):
    assert D.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


@given(st.integers(0, 9 * 10**14), st.integers(1, 10**15))
def test_parts_are_exact(count, more):
    total = count + more
    assert int(D.parts_of(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 1) // total


# Spelling variants

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=6), min_size=1, max_size=40))
def test_automaton_numbers_and_errors(words):
    known = sorted({w.encode("latin-1") for w in words})
    a = Automaton(known)
    for n, w in enumerate(known):
        state, number = a.root, 0
        for c in w:
            t = a.step(np.array([state]), np.array([c]))[0]
            state, number = a.to[t], number + a.skip[t]
        assert a.final[state] and number == n
    for length in {len(w) for w in known}:
        rows = [w for w in known if len(w) == length]
        letters = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, length)
        for same in range(length):
            for longer in (True, False):
                r, k = one_error(a, letters, same, longer)
                got = sorted((rows[i], known[j]) for i, j in zip(r.tolist(), k.tolist(), strict=True))
                fits = lambda w, v: near(w, v) and v[:same] == w[:same] and (len(v) >= len(w) if longer else len(v) < len(w))
                assert got == sorted((w, v) for w in rows for v in known if fits(w, v))


def variants_by_hand(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 5}
    kin = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: f if (f := min(kin[w], key=lambda v: (-n[v], v), default=None)) and n[f] >= 5 * n[w] else None for w in n}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(kin[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def spelling_rows(seed):
    rng = random.Random(seed)
    stems = ["abcdef", "abcdeg", "abcdefg", "aabbcc", "Übergrößenträger", "naïveté", "xabcdef", "b" * 9, "b" * 10, "b" * 11, "résumés", "resumes", "résumes", "×÷×÷×÷", "œuvres", "short", "abcdeā"]
    rows = []
    for i in range(300):
        words = [rng.choice(stems[:6]) if rng.random() < 0.5 else rng.choice(stems) for _ in range(40)]
        for k in range(len(words)):
            if rng.random() < 0.2:
                at = rng.randrange(len(words[k]) + 1)
                words[k] = words[k][:at] + rng.choice(["", "e", "x", "é"]) + words[k][at + rng.choice([0, 1]) :]
        rows.append((i, rng.choice([" ", "-", "1", "_ "]).join(words)))
    long = "".join(rng.choice("abc") for _ in range(3000))
    return rows + [(None, "abcdef abcdef"), (900, None), (901, ""), (902, f"{long} {long} " * 3), (903, f"{long[:-1]} " * 5), (1, rows[1][1]), (1, rows[1][1])]


@pytest.mark.parametrize(("group", "seed"), [(50_000, 1), (50_000, 3), (3, 3), (8, 2)])
def test_variants_by_hand(spark, monkeypatch, group, seed):
    monkeypatch.setattr(W, "BATCH_WORDS", 20)
    rows = spelling_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit("n")).repartition(4)
    words = W.word_counts(docs)
    got = {r.word: (r.n, r.n_near, r.best_n, r.best) for r in W.near_words(words, group).collect()}
    want = variants_by_hand(rows)
    assert sorted((w, n, k) for w, (n, k, *_) in got.items()) == [(w, n, k) for w, _, _, n, k, _ in want]
    out = W.variants(docs)
    assert [f"{n} {t}" for n, t in out.dtypes] == ["word string", "form string", "root string", "n bigint", "n_near bigint", "form_n bigint"]
    assert sorted(map(tuple, out.collect())) == want
    assert sum(r[1] is not None for r in want) > 20


def test_long_chains_of_forms(spark):
    names = [f"word{i:02d}" for i in range(26)]
    forms = spark.createDataFrame(list(itertools.pairwise(names)), "word string, form string")
    assert {(r.word, r.root) for r in W.roots(forms).collect()} == {(w, names[-1]) for w in names[:-1]}


def test_variants_of_an_empty_table(spark):
    assert W.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
