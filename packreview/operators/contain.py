"""Which phrases stand in which texts of their own case, without comparing every phrase with every text.

A word of a phrase that has a separator on both sides within the phrase stands as a whole word in any text that holds the
phrase. Of these words the one that fewest texts of the case have is looked up among the words of the texts, and only the
pairs that it finds are compared. Phrases without such a word, of one or two words, are looked up alike by the rarest of
their runs of three characters; only phrases of one or two characters meet all texts of their case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packreview.functions import text as T

_INNER = "(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])"


def inner_words(phrases: Column) -> Column:
    """array<string>: the words of an array of phrases that are bounded within their phrase."""
    each = F.transform(phrases, lambda p: F.regexp_extract_all(F.lower(p), F.lit(_INNER), F.lit(0)))
    return F.array_distinct(F.flatten(each))


def grams(text: Column) -> Column:
    """array<string>: the different runs of three characters of a text in lower case."""
    low = F.lower(text)
    runs = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.length(low) >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _by_rarest(asked: DataFrame, has: DataFrame, key: str, place: str) -> DataFrame:
    """(case_id, key, place): asked(case_id, key, word) met with has(case_id, place, word) by the word that fewest places have."""
    has = has.join(asked.select("case_id", "word").distinct(), ["case_id", "word"], "left_semi")
    known = has.groupBy("case_id", "word").agg(F.count("*").alias("df"))
    # a word that no text has leaves its needle without a match
    count = F.coalesce("df", F.lit(0))
    rarest = asked.join(known, ["case_id", "word"], "left").groupBy("case_id", key).agg(F.min_by("word", F.struct(count, "word")).alias("word"))
    return rarest.join(has, ["case_id", "word"]).select("case_id", key, place)


def pairs_to_compare(needles: DataFrame, texts: DataFrame, key: str, phrases: Column, place: str = "chunk_id") -> DataFrame:
    """(case_id, key, place): pairs of needles(case_id, key, ...) and texts(case_id, place, text) that can match.

    phrases: array<string>, all of which must stand in the text, whatever their case. `key` and `place` name rows within
    their case.
    """
    none = F.array().cast("array<string>")
    of_phrases = F.array_distinct(F.flatten(F.transform(phrases, lambda p: F.coalesce(grams(p), none))))
    n = needles.select("case_id", key, inner_words(phrases).alias("words"), of_phrases.alias("grams"))
    worded, short = n.where(F.size("words") > 0), n.where(F.size("words") == 0)
    by_word = texts.select("case_id", place, F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("word"))
    found = _by_rarest(worded.select("case_id", key, F.explode("words").alias("word")), by_word, key, place)
    spelt = short.where(F.size("grams") > 0).select("case_id", key, F.explode("grams").alias("word"))
    some = texts.join(short.select("case_id").distinct(), "case_id", "left_semi")  # cases without short phrases have no part in it
    found = found.unionByName(_by_rarest(spelt, some.select("case_id", place, F.explode(grams(F.col("text"))).alias("word")), key, place))
    tiny = short.where(F.size("grams") == 0).select("case_id", key).join(texts.select("case_id", place), "case_id")
    return found.unionByName(tiny.select("case_id", key, place))
