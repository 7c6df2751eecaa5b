"""English word stems (Porter 1980) for search terms."""

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and what takes their place where the rest of the word has a vowel-consonant pair.
STEP_2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
STEP_3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
# Suffixes that go where the rest has two such pairs.
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _kinds(part: str) -> str:
    """``v`` for each vowel (and a y after a consonant), ``c`` for any other letter."""
    out = ""
    for c in part:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _pairs(part: str) -> int:
    return len(re.findall("v+c+", _kinds(part)))


def _short(part: str) -> bool:
    """Ends in consonant, vowel, consonant, the last none of w, x and y."""
    return _kinds(part).endswith("cvc") and part[-1] not in "wxy"


def _ending(word: str, endings) -> str | None:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    end = _ending(word, ("sses", "ies", "ss", "s"))
    word = word[: -2 if end in ("sses", "ies") else -1 if end == "s" else None]
    end = _ending(word, ("eed", "ed", "ing"))
    if end == "eed":
        word = word[:-1] if _pairs(word[:-3]) else word
    elif end and "v" in _kinds(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _pairs(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        end = _ending(word, table)
        if end and _pairs(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    end = _ending(word, STEP_4)
    if end and _pairs(word[: -len(end)]) > 1 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (_pairs(word[:-1]) > 1 or (_pairs(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _pairs(word) > 1 else word


def stems(words: str | Column) -> Column:
    """The stem of each word of an array; null stays null."""

    @F.pandas_udf("array<string>")
    def each(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: None if ws is None else [stem(w) if w is not None else None for w in ws])

    return each(words)


def search_form(token: str) -> str:
    """The stem of a token without its accents."""
    return stem("".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c)))
