"""Porter stems (M. F. Porter, 1980).

The stemmer is a small word helper that runs on Arrow batches: tokens are stemmed inside their rows, and a worker
remembers the stems of words it has met, so a frequent word costs nothing and nothing is shuffled.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffix tables of the published algorithm.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
    "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP4 = (
    "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize"
).split()


def _shape(stem: str) -> str:
    """Consonant/vowel pattern: y is a vowel after a consonant."""
    shape = ""
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and shape[-1] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter_stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        ending = _longest(word, ("ed", "ing"))
        if ending and _has_vowel(word[: -len(ending)]):
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"

    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"

    for table in (STEP2, STEP3):
        suffix = _longest(word, table)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + table[suffix]

    suffix = _longest(word, STEP4)
    if suffix:
        cut = 3 if suffix in ("sion", "tion") else len(suffix)
        if _measure(word[:-cut]) > 1:
            word = word[:-cut]

    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem_table(words: DataFrame, word_col: str = "word") -> DataFrame:
    """``word -> stem`` for the distinct words of a column."""

    @F.pandas_udf("string")
    def stem(series: pd.Series) -> pd.Series:
        return series.map(porter_stem)

    vocabulary = words.select(F.col(word_col).alias("word")).distinct()
    return vocabulary.select("word", stem("word").alias("stem"))


_STEMS: dict[str, str] = {}
REMEMBERED = 500_000


def _stem(word: str) -> str:
    found = _STEMS.get(word)
    if found is None:
        if len(_STEMS) >= REMEMBERED:
            _STEMS.clear()
        found = _STEMS[word] = porter_stem(word)
    return found


def stemmed(tokens: Column) -> Column:
    """Each token's stem, in the same order."""

    @F.pandas_udf("array<string>")
    def stems(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ts: None if ts is None else [_stem(t) for t in ts])

    return stems(tokens)


def stem_tokens(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """``(id, stems)``; a document without tokens has an empty array."""
    none = F.array().cast("array<string>")
    return df.select(id_col, F.coalesce(stemmed(F.col(tokens_col)), none).alias("stems"))
