"""Column functions on procurement text: tokens, sentences, amounts, dates, cues. All are built-in expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lists and patterns below decide results and must stay as they are.
SHORT_CUES = ("gst", "pan", "emd", "iso")
CUES = {
    "v1": (
        "turnover", "solvency", "net worth", "similar work", "similar works", "gst", "pan card", "permanent account", "pan",
        "blacklisted", "black-listed", "iso", "psara", "manpower", "class-i", "class i local", "local supplier", "make in india",
        "msme", "udyam", "earnest money", "emd", "bid security", "shall submit", "must submit", "undertaking", "audited balance",
        "not have incurred", "not incurred", "pre-qualification", "prequalification", "eligibility criteria", "work experience",
        "satisfactorily completed", "successfully completed",
    ),
    "v2": (
        "turnover", "solvency", "net worth", "similar work", "similar works", "gst", "pan", "blacklisted", "black-listed", "psara",
        "iso", "manpower", "earnest money", "emd", "local supplier", "make in india", "not have incurred", "not incurred",
        "successfully completed", "satisfactorily completed",
    ),
}
DEADLINE_CUES = ("bid submission", "submission end", "pre-bid", "prebid", "opening of", "bid opening", "clarification", "due date", "last date")
RISK_CUES = ("liquidated", "penalty", "forfeiture", "forfeited", "damages", "earnest", "emd", "bid security", "validity of the bid", "bid validity")
STRONG_WORDS = ("turnover", "solvency", "similar work", "gst", "earnest", "emd", "pan", "psara")
DOMAINS = ("civil", "construction", "security", "forensic", "interior", "software", "ambulance")
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "ten": 10, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
SIMILAR_WORK = r"similar(?:\s+[a-z]+){0,4}\s+works?\b"
# Where \d stands in a pattern it is any decimal digit; [0-9] is the ASCII ones alone.
PREFIXED_AMOUNT = r"(?i)(?:₹|rs\.?|inr)\s*([0-9]{1,3}(?:,[0-9]{2,3})+|[0-9]{4,})"
SCALED_AMOUNT = (
    r"(?iU)(?:(?:rs\.?|inr|₹)\s*)?"
    r"(\d+(?:\.\d+)?|one|two|three|four|five|ten|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)"
    r"\s*(lakh|lakhs|crore|crores)\b"
)
DATE = (
    r"(?iU)\b(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|"
    r"\d{1,2}[\s-](?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*[\s-]\d{2,4})\b"
)
CLAUSE = r"(?iU)^(?:clause\s+)?(\d+(?:\.\d+)*)(?:\s*[).:-]|\s+)"
ALTERNATIVE = (
    r"(?isU)(?:(\d+)\s*\(\s*(one|two|three|four)\s*\)|(one|two|three|four|\d+))\s+similar(?:\s+[a-z]+){0,4}\s+works?\b"
    r".{0,220}?(?:not less than|at least)(?:\s*(?:rs\.?|inr|₹|rupees))?\s*([0-9][0-9,]*(?:\.\d+)?)"
    r"(?:\s*(lakh|lakhs|crore|crores))?"
)
PERCENT = r"(?iU)(\d{1,3}(?:\.\d+)?)\s*(?:%|percent)"
HEADCOUNTS = (
    r"(?iU)(?:not less than|not be less than|at least|minimum of|minimum)\s+(\d{2,5})",
    r"(?iU)(?:manpower on roll is|on roll is)\s+(\d{1,5})",
    r"(?iU)(\d{2,5})\s+security guards",
)
SENTENCE_END = r"""(?<=\.)(?<!(?:^|[\s(])(?i:rs|mr|mrs|ms|dr|no|cl|fig|vol|vs|etc)\.)\s+(?=[A-Z0-9("'])"""
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85  ]"
MONEY_WORD = r"(?i)\b(shall|must|should|rs\.?|inr|rupees?|lakh|lakhs|crore|crores)\b|₹"
PART_WORD = r"(?i)^(section|annexure|appendix|schedule|chapter|part|clause)\b"
NEW_ITEM = r"(?iU)^(?:\d+(?:\.\d+)*\s*[).:\-]\s+\S|(?::\s*)?(?:bidder\b|the\s+bidder\b|earnest\b|emd\b))"
MODAL = r"(?i)\b(shall|must|should|required|requirement)\b"
OBLIGATION = r"(?i)\b(shall|should|must|required|bidder|emd|earnest)\b"
SECTION_HINT = r"(?i)eligib|qualif|earnest|\bemd\b|turnover|solvency|criteria|experience|blacklist|document"
BANNER = r"(?i)synthetic|fictional|udin"
FACT = r"(?iU)turnover|gst|pan\b|blacklist|solvency|manpower|psara|iso|licen[cs]e|loss|work|\brs\.?\b|₹|\binr\b|\d"

#: Every decimal digit beyond ASCII, and the digits they stand for.
_DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
_VALUES = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def ascii_digits(number: Column) -> Column:
    """A number's digits, whatever their script, as 0 to 9."""
    return F.when(number.rlike(r"[^\x00-\x7f]"), F.translate(number, "".join(_DIGITS), _VALUES)).otherwise(number)


#: Letters whose capitals are several code points, and the one that stands for each (itself, if there is none).
_WIDENED = [c for c in map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]) if len(c.upper()) > 1]
_ONE_CAPITAL = "".join("\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in _WIDENED)


def upper_each(text: Column) -> Column:
    """Capitals code point by code point, so that the length stays: upper() makes two letters of a sharp s."""
    wide = "[" + "".join(_WIDENED) + "]"
    parts = F.split(text, f"(?<={wide})|(?={wide})")
    each = F.transform(parts, lambda p: F.when(p.rlike(wide), F.translate(p, "".join(_WIDENED), _ONE_CAPITAL)).otherwise(F.upper(p)))
    return F.when(text.rlike(wide), F.array_join(each, "")).otherwise(F.upper(text))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _longs() -> Column:
    return F.array().cast("array<bigint>")


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def contains_any(lowered: Column, words: tuple[str, ...]) -> Column:
    return any_of([F.contains(lowered, F.lit(w)) for w in words])


def word(lowered: Column, w: str) -> Column:
    return lowered.rlike(rf"\b{w}\b")


def cue_test(lowered: Column, cue: str) -> Column:
    return word(lowered, cue) if cue in SHORT_CUES else F.contains(lowered, F.lit(cue))


def tokenize(text: Column) -> Column:
    """TXT1: lower-case runs of a-z and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def whitespace_norm(text: Column) -> Column:
    """TXT2: white space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


#: What \s stands for in patterns with (?U).
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def sentences(text: Column) -> Column:
    """TXT3: array of sentences of at least 20 characters, in order."""
    pieces = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n+"), lambda p: F.split(p, SENTENCE_END)))
    return F.filter(F.transform(pieces, strip), lambda s: F.length(s) >= 20)


def amounts_in(text: Column) -> Column:
    """TXT4: array<bigint> of rupee amounts: prefixed figures first, then scaled ones."""
    t = F.coalesce(text, F.lit(""))
    figures = F.regexp_extract_all(t, F.lit(PREFIXED_AMOUNT), F.lit(1))
    plain = F.transform(figures, lambda x: F.regexp_replace(x, ",", "").try_cast("bigint"))
    words = F.create_map(*[F.lit(v) for kv in NUMBER_WORDS.items() for v in (kv[0], float(kv[1]))])

    def amount(n: Column, scale: Column) -> Column:
        value = F.coalesce(ascii_digits(n).try_cast("double"), F.try_element_at(words, F.lower(n)), F.lit(0.0))
        return F.bround(value * F.when(F.lower(scale).startswith("lakh"), 100_000.0).otherwise(10_000_000.0), 0).cast("bigint")

    group = lambda g: F.regexp_extract_all(t, F.lit(SCALED_AMOUNT), F.lit(g))
    scaled = F.when(t.rlike("(?iU)lakh|crore"), F.zip_with(group(1), group(2), amount)).otherwise(_longs())  # the pattern asks for the word, and is slow
    every = F.filter(F.concat(plain, scaled), lambda a: a > 0)
    return F.when(t.rlike(r"[0-9]|(?i)lakh|crore"), every).otherwise(_longs())


def has_date(text: Column) -> Column:
    """TXT5."""
    return F.coalesce(text, F.lit("")).rlike(DATE)


def clause_number(text: Column, stripped: bool = False) -> Column:
    """CHK4: leading clause number or null."""
    return F.nullif(F.regexp_extract(text if stripped else strip(text), CLAUSE, 1), F.lit(""))


def quote_supported(quote: Column, source: Column, min_len: int = 20) -> Column:
    """TXT6: the quote has min_len characters when normalised and is a span of the source, as it is or normalised."""
    folded = whitespace_norm(quote)
    there = F.contains(source, quote) | F.contains(whitespace_norm(source), folded)
    return F.coalesce((F.length(folded) >= min_len) & (F.length(source) > 0) & there, F.lit(False))


def trigrams(text: Column) -> Column:
    """TXT7: distinct character trigrams of the folded text."""
    none = F.array().cast("array<string>")
    # of single characters, as finding a place within a long text takes as many steps as there are characters before it
    grams = lambda c: F.when(
        F.size(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))
    ).otherwise(none)
    return let(F.split(whitespace_norm(F.lower(text)), ""), grams)


def jaccard(a: Column, b: Column) -> Column:
    """0 when either set is empty. Either may be an expression: it is worked out once."""

    def share(x: Column) -> Column:
        both = let(F.size(F.array_intersect(x["a"], x["b"])), lambda n: n / (F.size(x["a"]) + F.size(x["b"]) - n))
        return F.when((F.size(x["a"]) == 0) | (F.size(x["b"]) == 0), 0.0).otherwise(both)

    return let(F.struct(a.alias("a"), b.alias("b")), share)


def trigram_jaccard(query: Column, text: Column) -> Column:
    return jaccard(trigrams(query), trigrams(text))


def has_cue(lowered: Column, policy: str = "v1") -> Column:
    """TXT8: any cue of the policy, or "similar ... works"."""
    return any_of([lowered.rlike(SIMILAR_WORK), *[cue_test(lowered, c) for c in CUES.get(policy, CUES["v1"])]])


def cue_hits(lowered: Column, policy: str = "v1") -> Column:
    return reduce(lambda a, b: a + b, [cue_test(lowered, c).cast("int") for c in CUES.get(policy, CUES["v1"])])


def has_modal(text: Column) -> Column:
    """TXT9."""
    return text.rlike(MODAL)


def kind(lowered: Column) -> Column:
    """TXT10: financial, technical, document or eligibility; the first rule that holds."""
    money = contains_any(lowered, ("turnover", "solvency", "net worth", "earnest money", "bid security")) | word(lowered, "emd")
    craft = lowered.rlike(SIMILAR_WORK) | contains_any(lowered, ("manpower", "psara", "iso", "work experience", "successfully completed", "satisfactorily completed"))
    paper = contains_any(lowered, ("gst", "pan card", "permanent account", "undertaking", "shall submit", "must submit", "msme", "udyam")) | word(lowered, "pan")
    return F.when(money, "financial").when(craft, "technical").when(paper, "document").otherwise("eligibility")


def is_deadline(text: Column) -> Column:
    return has_date(text) & contains_any(F.lower(text), DEADLINE_CUES)


def is_pure_deadline(text: Column) -> Column:
    """TXT11."""
    return is_deadline(text) & ~contains_any(F.lower(text), STRONG_WORDS)


def deadline_label(lowered: Column) -> Column:
    """TXT12."""
    return (
        F.when(contains_any(lowered, ("pre-bid", "prebid")), "pre-bid meeting").when(F.contains(lowered, F.lit("opening")), "bid opening")
        .when(F.contains(lowered, F.lit("clarification")), "clarification window")
        .when(contains_any(lowered, ("submission", "due date", "last date")), "bid submission").otherwise("dated event")
    )


def risk_severity(lowered: Column) -> Column:
    return F.when(contains_any(lowered, ("liquidated", "forfeit", "penalty")), "high").otherwise("medium")


def window_round(text: Column, keyword: Column, before: int, after: int) -> Column:
    """text from `before` characters ahead of the keyword to `after` from its start; the whole text without it."""
    at = F.position(keyword, F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at == 0, text).otherwise(F.substring(text, start, at + after - start))


def threshold_near(text: Column, keyword: Column) -> Column:
    """TXT13: the largest amount round the keyword, else in the text; null without any."""
    near = amounts_in(window_round(text, keyword, 90, 180))
    return let(near, lambda x: F.array_max(F.when(F.size(x) > 0, x).otherwise(amounts_in(text))))


def percent_near(text: Column, keyword: Column) -> Column:
    """TXT14: a percentage above 0 and up to 100 round the keyword, else null."""
    found = F.regexp_extract(window_round(text, keyword, 80, 100), PERCENT, 1)
    return let(ascii_digits(found).try_cast("double"), lambda x: F.when((x > 0) & (x <= 100), x))


def headcount(text: Column) -> Column:
    """TXT15: the first of three patterns that is there."""
    t = F.coalesce(text, F.lit(""))
    found = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in HEADCOUNTS])
    return ascii_digits(found).try_cast("int")


def alternatives(text: Column) -> Column:
    """TXT16: array<struct<count:int,amount:bigint>> of similar-work alternatives in text order."""
    t = F.coalesce(text, F.lit(""))
    group = lambda g: F.regexp_extract_all(t, F.lit(ALTERNATIVE), F.lit(g))
    zipped = F.arrays_zip(group(1).alias("a"), group(3).alias("b"), group(4).alias("n"), group(5).alias("s"))
    counts = F.create_map(*[F.lit(v) for k, v in {"one": 1, "two": 2, "three": 3, "four": 4, "1": 1, "2": 2, "3": 3, "4": 4}.items() for v in (k, v)])

    def one(x: Column) -> Column:
        scale = F.when(F.lower(x["s"]).startswith("lakh"), 100_000.0).when(F.lower(x["s"]).startswith("crore"), 10_000_000.0).otherwise(1.0)
        number = ascii_digits(F.regexp_replace(x["n"], ",", ""))
        amount = F.bround(number.try_cast("double") * scale, 0).cast("bigint")
        count = F.try_element_at(counts, ascii_digits(F.lower(F.when(x["a"] != "", x["a"]).otherwise(x["b"]))))
        return F.struct(count.alias("count"), amount.alias("amount"))

    return F.filter(F.transform(zipped, one), lambda x: x["count"].isNotNull() & (x["amount"] > 0))


def domain_ok(requirement: Column, evidence: Column) -> Column:
    """TXT17: no domain asked for, or one of those asked for is in the evidence."""
    asked = F.filter(F.array(*map(F.lit, DOMAINS)), lambda d: F.contains(F.lower(requirement), d))
    return (F.size(asked) == 0) | F.exists(asked, lambda d: F.contains(F.lower(evidence), d))


def amount_hint(text: Column) -> Column:
    """TXT18: the first four amounts as a suffix, or nothing."""
    a = F.slice(amounts_in(text), 1, 4)
    return F.when(F.size(a) > 0, F.concat(F.lit(" [amounts: "), F.array_join(F.transform(a, lambda x: F.concat(x.cast("string"), F.lit(" INR"))), ", "), F.lit("]"))).otherwise("")


def is_banner(text: Column) -> Column:
    """TXT18: a banner that says the file is made up and states no fact."""
    return text.rlike(BANNER) & ~text.rlike(FACT)


def contains_all(text: Column, phrases: Column) -> Column:
    """TXT19: every phrase, whatever its case."""
    return F.forall(phrases, lambda p: F.contains(F.lower(text), F.lower(p)))


def norm_eq(a: Column, b: Column) -> Column:
    return whitespace_norm(F.lower(a)) == whitespace_norm(F.lower(b))


def safe_file_name(name: Column) -> Column:
    """TXT20."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.substring(F.when(clean == "", "document").otherwise(clean), 1, 180)


# What a heading is told by, in whole numbers: length, currency or duty words, an opening part word, an opening bracket or
# colon, digits, letters, capitals, words. Lines joined by a space measure as their sums, but for what only an opening has.
SPACE_TRAITS = (1, 0, 0, 0, 0, 0, 0, 0)
GOES_ON_TRAITS = (1, 1, 0, 0, 1, 1, 1, 1)


HEADING_MAX = 90


def line_traits(line: Column) -> Column:
    """array<int>: the measures of a stripped line; but for the length they are 0 where it is too long for a heading, as it
    then is in whatever it is joined to."""
    count = lambda but: F.length(F.regexp_replace(line, but, ""))
    flag = lambda p: line.rlike(p).cast("int")
    words = F.greatest(F.regexp_count(line, F.lit(r"(?U)\S+")), F.lit(1))
    measured = F.array(
        F.length(line), flag(MONEY_WORD), flag(PART_WORD), flag("^[(:/]"), flag(r"\p{Nd}"), count(r"[^\p{L}]+"), count(r"[^\p{Lu}]+"), words,
    )
    return F.when(F.length(line) <= HEADING_MAX, measured).otherwise(F.array(F.length(line), *[F.lit(0)] * (len(SPACE_TRAITS) - 1)))


def measures_as_heading(n, money, part, bracket, digits, letters, capitals, words):
    """CHK3 on measures, which may be Columns, arrays or numbers."""
    shouted = (bracket == 0) & (digits == 0) & (letters > 0) & (4 * capitals > 3 * letters) & (words <= 12)
    return (n >= 4) & (n <= HEADING_MAX) & (money == 0) & ((part > 0) | shouted)


def is_heading(line: Column) -> Column:
    """CHK3."""
    return let(line_traits(line), lambda t: measures_as_heading(*[F.get(t, F.lit(i)) for i in range(len(SPACE_TRAITS))]))


def opens_item(line: Column) -> Column:
    """A line that begins a numbered item or a duty of the bidder, which no line before it takes in."""
    return line.rlike(NEW_ITEM)
