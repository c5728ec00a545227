"""Error words: a text is flagged when a word has the Porter stem of an error keyword."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keywords whose stems mark an error, and the first letters every
# word with such a stem must have (stemming never changes the first four).
ERROR_KEYWORDS = ("error", "fail", "failure", "failed", "exception", "invalid", "incorrect", "unable", "cannot",
                  "could not")
PREFIXES = ("erro", "fail", "exce", "inva", "inco", "unab", "cann")

# Suffix tables of the published algorithm (Porter, 1980).
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
         ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
         ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
         ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
         "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """Word as v (vowel) and c (consonant) letters; y after a consonant is a vowel."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, table, least: int) -> str:
    for suffix, new in sorted(table, key=lambda p: -len(p[0])):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if _measure(stem) > least else word
    return word


@lru_cache(maxsize=100_000)
def porter_stem(word: str) -> str:
    """Porter stem of a lower-cased word."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            stem = word[: len(word) - len(suffix)]
            if word.endswith(suffix) and "v" in _shape(stem):
                word = stem
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word[-1:] == word[-2:-1] and _shape(word)[-1:] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(word, STEP2, 0)
    word = _swap(word, STEP3, 0)
    for suffix in sorted(STEP4, key=lambda s: -len(s)):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


ERROR_STEMS = frozenset(porter_stem(w) for w in ERROR_KEYWORDS)


@F.pandas_udf(T.BooleanType())
def _any_error(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: ws is not None and any(porter_stem(w) in ERROR_STEMS for w in ws))


def has_error_stems(text: Column) -> Column:
    """Does a word of the text stem to an error keyword?

    The JVM picks the distinct words with a possible beginning; only those few
    words travel to Python.
    """
    pattern = r"(?U)\b(?:" + "|".join(PREFIXES) + r")\w*"
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))
    return F.coalesce(_any_error(words), F.lit(False))
