"""Text functions: whitespace, hashes, tokens, accent folding, stemming."""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space of Unicode, as a character class that Java and RE2 understand alike.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}]"
TOKEN = r"[\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}_]+"


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text without outer white space, in
    lower case, with white space collapsed."""
    collapsed = F.regexp_replace(F.lower(F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")), rf"{SPACE}+", " ")
    return F.substring(F.sha2(collapsed, 256), 1, 16)


def word_count(text: Column) -> Column:
    """Number of words between white space; null counts as no words."""
    return F.coalesce(F.size(F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")), F.lit(0)).cast("long")


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Lower-case tokens of a text, in order; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1)), F.array().cast("array<string>"))


def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


# --- the stemmer of M. F. Porter, "An algorithm for suffix stripping" (1980), from its published rules
_VOWELS = frozenset("aeiou")
# fixed values: suffix rules of steps 2, 3 and 4
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """Consonants (c) and vowels (v) of a word; y after a consonant is a vowel."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in _VOWELS or (letter == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    return len(word) >= 3 and _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _shape(word)[-1] == "c"


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Porter stem of a lower-case word; words of one or two letters and words
    with other than ASCII letters stay as they are."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                base = w[: -len(suffix)]
                if "v" in _shape(base):
                    if base.endswith(("at", "bl", "iz")):
                        w = base + "e"
                    elif _double(base) and base[-1] not in "lsz":
                        w = base[:-1]
                    elif _measure(base) == 1 and _short_end(base):
                        w = base + "e"
                    else:
                        w = base
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        suffix = max((s for s in rules if w.endswith(s)), key=len, default=None)
        if suffix and _measure(w[: -len(suffix)]) > 0:
            w = w[: -len(suffix)] + rules[suffix]
    suffix = max((s for s in _STEP4 if w.endswith(s)), key=len, default=None)
    if suffix:
        base = w[: -len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
            w = base
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            w = base
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def analyse(word: str) -> str:
    """Term of a token: accents folded, then stemmed."""
    return stem(_fold(word))


@F.pandas_udf(StringType())
def _analyse_terms(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else analyse(w))


def analyse_terms(words: Column | str) -> Column:
    """Folded and stemmed terms; meant for distinct tokens.  Declared
    non-deterministic, else filters on terms would be copied to before the
    distinct and analyse every token."""
    return _analyse_terms.asNondeterministic()(words)


@F.pandas_udf(ArrayType(StringType()))
def most_frequent(lists: pd.Series, most: pd.Series) -> pd.Series:
    """The most frequent elements of each list, ties by first occurrence: linear in
    the length of the list, however long the text."""
    return pd.Series([None if x is None else [w for w, _ in Counter(x).most_common(int(n))] for x, n in zip(lists, most)], dtype=object)
