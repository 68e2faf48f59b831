"""Personal data by a skip-chain conditional random field, beside patterns that always hold.

Patterns find e-mail and IP addresses, card numbers (Luhn) and phone numbers. Tokens that hold a digit or an at sign are
the nodes of a field over labels begin and inside of each kind, and none; tokens that stand side by side form a chain,
and tokens of a document that are the same or similar (equal letters and digits, the same last seven digits, the same
name before the at sign) are linked wherever they stand. All other words are outside every entity, so chains end there.

Loopy message passing gives the marginals, with what the patterns found held as known: a number written with other
separators, a card beside another one or a phone without its plus is labelled like its kin in the document. Of each
group of like tokens one is linked to all others, never each to each.

The field is learned from the patterns' own finds in a bounded sample: TRAIN_TEXTS different texts of at most
TRAIN_CHARS characters. Where a pattern matched and its check failed because the match took in more than one number, the
tokens have no known label. Half of the linked tokens are learned without the features of their shape, so that the links
learn to carry a label to what the patterns do not know.

An added span is a run of tokens with marginals of at least SURE for its kind. It never touches a pattern's span.

Edge cases: null, empty and clean texts have no spans; repeated rows get the same ones; a sample without personal data gives a
field that adds nothing; ties of marginals go to the kind that is listed first; a text is taken whole whatever its
length, and its tokens cost memory in proportion; an empty table gives no rows; columns called findings or redacted are replaced.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packreview.llm.common import fitted, map_rows, table
from packreview.llm.skipchain import Field, Graph, beliefs, learn

KINDS = ("email", "ip", "card", "phone")
#: The documented bound of the sample that the field is learned from.
TRAIN_TEXTS, TRAIN_CHARS = 1500, 20_000
SURE = 0.9
#: Letters and digits that a token needs to be linked to its like.
LEAST_LINKED = 5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# possessive, and begun at the first digit alone: the same matches as of the plain patterns, in one pass
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<![0-9A-Za-z._%+@()#*\u0080-\U0010ffff-])[A-Za-z._%+()#*\u0080-\U0010ffff-]*+[0-9@][0-9A-Za-z._%+@()#*\u0080-\U0010ffff-]*+")
_SIGN = re.compile("[0-9@]")
_EDGE = "().,#*_%-"
_GAP = re.compile(r"[\s(),./-]{1,3}")
_NOT_DIGIT = re.compile("[^0-9]+")

Span = tuple[int, int, int]  # number of the kind, start, end


def digits_of(s: str) -> str:
    return _NOT_DIGIT.sub("", s)


def luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return sum(own[::2] + [x * 2 - 9 * (x > 4) for x in own[1::2]]) % 10 == 0


def _emails(text: str) -> list[Span]:
    """Each at sign with the run of name characters before it, from the end of the last match on, and the domain behind it."""
    out, begin, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > begin and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            begin = m.end()
        at = text.find("@", max(at + 1, begin))
    return out


def pattern_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """The patterns' spans by kind, then start, and stretches of card matches that hold more digits than a card."""
    spans, open_ = _emails(text), []
    for m in _IP.finditer(text):
        if all(len(q) <= 3 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in m.group().split("."))):
            spans.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = digits_of(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            spans.append((2, m.start(), m.end()))
        elif len(d) > 19:
            open_.append(m.span())
    if "+" in text:
        spans += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return spans, open_


@dataclass
class Token:
    start: int
    end: int
    core: str
    chained: bool  # to the token before it


def tokens_of(text: str) -> list[Token]:
    out: list[Token] = []
    for m in _TOKEN.finditer(text):
        core = m.group().strip(_EDGE)
        if not core:
            continue
        start = m.start() + m.group().index(core)
        before = out[-1] if out else None
        chained = before is not None and start - before.end <= 3 and _GAP.fullmatch(text, before.end, start) is not None
        out.append(Token(start, start + len(core), core, chained))
    return out


_BUCKETS, _CONTEXT = 256, 128
_FIXED = 40
FEATURES = _FIXED + _BUCKETS + 2 * _CONTEXT
_WORD_BEFORE, _WORD_AFTER = re.compile(r"([^\W\d_]{2,})\W*$"), re.compile(r"\W*([^\W\d_]{2,})")
_QUAD = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")
_RUNS = re.compile(r"([^\W\d_])[^\W\d_]*|(\d)\d*")


def _hashed(s: str, n: int) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % n


def features_of(text: str, tokens: list[Token]) -> tuple[list[list[int]], list[list[int]]]:
    """Features of each token's shape and of what stands about it."""
    shape, about = [], []
    group_begin = 0
    groups = []  # (first, after last) of the chain that a token is in
    for i, t in enumerate(tokens):
        if not t.chained:
            group_begin = i
        groups.append(group_begin)
    last = len(tokens)
    ends = [0] * len(tokens)
    for i in range(len(tokens) - 1, -1, -1):
        ends[i] = last
        if not tokens[i].chained:
            last = i
    joined: dict[int, str] = {}
    for i, t in enumerate(tokens):
        d, core = digits_of(t.core), t.core
        n = len(d)
        f = [0, 1 + min(n, 4) if n < 5 else 6 + (n > 6) + (n > 8) + (n > 12) + (n > 15) + (n > 16) + (n > 19)]
        if "@" in core[1:-1]:
            f.append(14)
            if _emails(core) == [(0, 0, len(core))]:
                f.append(15)
        if q := _QUAD.fullmatch(core):
            f.append(16 + all(int(x) < 256 for x in q.groups()))
        if 13 <= n <= 19:
            f.append(18 + luhn(d))
        if core[0] == "+" or (t.start and text[t.start - 1] == "+"):
            f.append(20)
        if t.start and text[t.start - 1] == "(":
            f.append(21)
        letters = sum(map(str.isalpha, core))
        f.append(22 + (letters > 0) + (letters > n))
        f.append(_FIXED + _hashed(_RUNS.sub(lambda m: "a" if m[1] else "9" * min(4, len(m[0])), core)[:40], _BUCKETS))
        a = [26 + (i == groups[i]), 28 + (i + 1 == ends[i]), 30 + min(3, ends[i] - groups[i] - 1)]
        g = groups[i]
        if ends[i] - g > 1 and ends[i] - g <= 8:
            if g not in joined:
                joined[g] = "".join(digits_of(x.core) for x in tokens[g : ends[i]])
            k = len(joined[g])
            a.append(34 + (9 <= k <= 15) + 2 * (13 <= k <= 19 and luhn(joined[g])))
        if m := _WORD_BEFORE.search(text, max(0, t.start - 24), t.start):
            a.append(_FIXED + _BUCKETS + _hashed(m[1].lower(), _CONTEXT))
        if m := _WORD_AFTER.match(text, t.end, t.end + 24):
            a.append(_FIXED + _BUCKETS + _CONTEXT + _hashed(m[1].lower(), _CONTEXT))
        shape.append(f)
        about.append(a)
    return shape, about


def links_of(tokens: list[Token], label: list[int]) -> list[tuple[int, int, int]]:
    """(token, token, 1 same or 2 similar): all like tokens to one of them, a known entity if there is one."""
    same: dict[str, list[int]] = {}
    for i, t in enumerate(tokens):
        plain = t.core.lower()
        if sum(map(str.isalnum, plain)) >= LEAST_LINKED:
            same.setdefault(plain, []).append(i)
    hub = lambda at: next((i for i in at if label[i] > 0), at[0])
    out, alike = [], {}
    for plain, at in same.items():
        h = hub(at)
        out += [(h, i, 1) for i in at if i != h]
        d = digits_of(plain)
        keys = {("all", "".join(filter(str.isalnum, plain)))}
        if len(d) >= 7:
            keys.add(("tail", d[-7:]))
        if "@" in plain:
            keys.add(("name", plain.split("@")[0]))
        for key in keys:
            alike.setdefault(key, []).append(h)
    pairs = set()
    for at in alike.values():
        if len(at) > 1:
            h = hub(at)
            pairs |= {(h, i) for i in at if i != h}
    return out + [(a, b, 2) for a, b in sorted(pairs)]


@dataclass
class Page:
    """A text with its tokens, the patterns' spans and the tokens' labels: -1 unknown, 0 none, then begin and inside of each kind."""

    text: str
    spans: list[Span]
    tokens: list[Token]
    label: list[int]
    held: list[bool]  # the label is of a pattern's span


def page_of(text: str | None) -> Page:
    if not text or not _SIGN.search(text):
        return Page(text or "", [], [], [], [])
    spans, open_ = pattern_spans(text)
    tokens = tokens_of(text)
    label, held = [0] * len(tokens), [False] * len(tokens)
    starts = [t.start for t in tokens]
    for a, b in open_:
        for i in range(max(0, bisect_right(starts, a) - 1), len(tokens)):
            if tokens[i].start >= b:
                break
            if tokens[i].end > a:
                label[i] = -1
    for kind, a, b in reversed(spans):  # a token in two spans is of the kind that is listed first
        before = False
        for i in range(max(0, bisect_right(starts, a) - 1), len(tokens)):
            if tokens[i].start >= b:
                break
            if tokens[i].end > a:
                label[i], held[i] = 1 + 2 * kind + (before and tokens[i].chained), True
                before = True
    return Page(text, spans, tokens, label, held)


def graph_of(pages: list[Page], known: str, seed: int | None = None) -> Graph:
    """One graph of all pages. known: 'all' labels, or those 'held' by patterns; with a seed, half of the linked tokens lose
    the features of their shape."""
    rng = np.random.default_rng(seed)
    features: list[int] = []
    sizes, edges, first, label = [], [], [], []
    for p in pages:
        base = len(sizes)
        links = links_of(p.tokens, p.label)
        bare = {i for a, b, _ in links for i in (a, b) if rng.random() < 0.5} if seed is not None else set()
        for i, (shape, about) in enumerate(zip(*features_of(p.text, p.tokens), strict=True)):
            own = about + [0] if i in bare else shape + about
            features += own
            sizes.append(len(own))
            if p.tokens[i].chained:
                edges.append((base + i - 1, base + i, 0))
            else:
                first.append(base + i)
            label.append(p.label[i] if known == "all" or p.held[i] else -1)
        edges += [(base + a, base + b, k) for a, b, k in links]
    whole = lambda x: np.array(x, np.int64)
    return Graph(whole(features), whole(sizes), whole(edges).reshape(-1, 3), whole(first), whole(label))


def train_on(texts: list[str], seed: int = 5) -> Field:
    pages = [p for t in sorted(texts) if (p := page_of(t)).tokens]
    if not pages:
        return learn(graph_of([], "all"), len(KINDS), FEATURES)
    # each page once as it is and once with linked tokens laid bare
    plain, bare = graph_of(pages, "all"), graph_of(pages, "all", seed)
    n = len(plain.sizes)
    both = Graph(*(np.concatenate([getattr(plain, f), getattr(bare, f) + k]) for f, k in (("features", 0), ("sizes", 0), ("edges", np.array([n, n, 0])), ("first", n), ("label", 0))))
    return learn(both, len(KINDS), FEATURES)


def added_spans(page: Page, marginal: np.ndarray) -> list[tuple[Span, float]]:
    """Runs of tokens outside the patterns' spans that are surely of a kind, with the least marginal of their tokens."""
    out: list[tuple[Span, float]] = []
    of_kind = marginal[:, 1::2] + marginal[:, 2::2]
    best = of_kind.argmax(axis=1)
    open_ = False
    for i, t in enumerate(page.tokens):
        k, p = int(best[i]), float(of_kind[i, best[i]])
        if page.held[i] or p < SURE:
            open_ = False
            continue
        inside = marginal[i, 2 + 2 * k] > marginal[i, 1 + 2 * k]
        if open_ and t.chained and inside and out[-1][0][0] == k:
            (_, a, _), least = out[-1]
            out[-1] = ((k, a, t.end), min(least, p))
        else:
            out.append(((k, t.start, t.end), p))
        open_ = True
    return out


def spans_of(texts: list[str | None], field: Field) -> list[list[tuple[int, int, int, bool, float]]]:
    """(kind, start, end, by a pattern, marginal) of each text, by kind, then start."""
    pages = [page_of(t) for t in texts]
    node, _ = beliefs(field, graph_of(pages, "held"))
    out, at = [], 0
    for p in pages:
        n = len(p.tokens)
        more = added_spans(p, node[at : at + n]) if n else []
        out.append(sorted([(*s, True, 1.0) for s in p.spans] + [(*s, False, m) for s, m in more]))
        at += n
    return out


def redacted(text: str | None, spans: list[tuple]) -> str | None:
    """text with each span, or run of overlapping spans, replaced by the name of its kind."""
    parts, at = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return text if not parts else "".join([*parts, text[at:]])


def training_texts(docs: DataFrame) -> DataFrame:
    """(text): at most TRAIN_TEXTS different texts that hold a digit or an at sign, those with the least hashes."""
    some = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]") & (F.length("text") <= TRAIN_CHARS))
    some = some.withColumn("h", F.xxhash64("text"))
    least = [r.h for r in some.select("h").distinct().orderBy("h").limit(TRAIN_TEXTS).collect()]
    drawn = some.where(F.col("h").isin(least)) if least else some.where("false")
    return drawn.groupBy("h").agg(F.min("text").alias("text")).select("text")


def train(docs: DataFrame) -> Field:
    """The field of docs(text), learned in one task from the bounded sample."""
    return fitted(training_texts(docs), lambda rows: train_on([t for (t,) in rows]))


FINDINGS = "findings array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def find(docs: DataFrame, field: Field, redact: bool = False) -> DataFrame:
    """Adds findings, by kind, then start in code points, to docs(text, ...) and, if asked for, redacted; other columns pass through. No shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(field)  # some 50 KB whatever the input

    def run(texts: list[str | None]) -> dict[str, list]:
        spans = spans_of(texts, shipped.value)
        out = {"findings": [[{"kind": KINDS[k], "start": a, "end": b, "base": base, "score": s} for k, a, b, base, s in own] for own in spans]}
        return out | ({"redacted": [redacted(t, own) for t, own in zip(texts, spans, strict=True)]} if redact else {})

    made = ("findings", "redacted") if redact else ("findings",)
    return map_rows(docs, run, FINDINGS + (", redacted string" if redact else ""), [c for c in docs.columns if c not in made])


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs))
    joined = lambda f: F.array_join(F.transform(f, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("findings", lambda f: f["base"])
    count = lambda kind: F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"),
        (F.size("findings") - F.size(base)).cast("long").alias("n_added"),
    )
