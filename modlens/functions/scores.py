"""Lexical and readability measures: characters and words are counted by batches, the rest is column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from modlens.functions import characters as C
from modlens.functions import patterns as P
from modlens.functions import text as T

LEXICAL = [
    "char_count", "word_count", "unique_word_count", "sentence_count", "avg_word_len",
    "avg_sentence_len", "punctuation_count", "uppercase_count", "digit_count", "type_token_ratio",
]
READABILITY = ["flesch_ease", "fk_grade", "smog", "coleman_liau", "ari"]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def longs(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


OF_TEXT = ["sentence_ends", "punctuation_count", "uppercase_count", "digit_count"]
OF_WORDS = ["word_count", "unique_word_count", "letters"]
OF_SENTENCES = ["n_sentences", "n_chars"]
OF_SYLLABLES = ["n_words", "n_letters", "n_syllables", "n_polysyllables"]


@F.arrow_udf(longs(OF_TEXT))
def lexical_counts(texts: pa.Array) -> pa.Array:
    return C.counted([texts], C.lexical_counts, OF_TEXT)


@F.arrow_udf(longs(OF_WORDS))
def word_counts(texts: pa.Array, tokens: pa.Array) -> pa.Array:
    return C.counted([texts, tokens], lambda _, t: C.word_counts(t), OF_WORDS)


@F.arrow_udf(longs(OF_SENTENCES))
def sentence_counts(texts: pa.Array) -> pa.Array:
    return C.counted([texts], C.sentence_counts, OF_SENTENCES)


@F.arrow_udf(longs(OF_SYLLABLES))
def syllable_counts(lowered: pa.Array) -> pa.Array:
    return C.counted([lowered], C.syllable_counts, OF_SYLLABLES)


def lexical_features(
    df: DataFrame, input_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] = ()
) -> DataFrame:
    """Ten counts and ratios per document; null or empty text gives zeros.

    Like every row-local feature it is a pure projection: ``keep`` carries other columns along, so that
    several families read the text once.
    """
    text = T.fill_text(F.col(input_col))
    base = df.select(id_col, *keep, text.alias("t"), T.treebank_tokens(text).alias("tokens"))
    t = F.col("t")
    base = base.select(
        id_col, *keep, t, lexical_counts(t).alias("own"), word_counts(t, F.col("tokens")).alias("of_words")
    )
    counted = base.select(
        id_col,
        *keep,
        t,
        F.length(t).alias("char_count"),
        (F.col("own.sentence_ends") + 1).alias("sentences"),
        *[F.col(f"own.{c}").alias(c) for c in OF_TEXT[1:]],
        *[F.col(f"of_words.{c}").alias(c) for c in OF_WORDS],
    )
    n = F.col("word_count")
    return counted.select(
        id_col,
        *keep,
        *[F.col(c).cast("bigint").alias(c) for c in ("char_count", "word_count", "unique_word_count")],
        F.when(t == "", 0).otherwise(F.col("sentences")).cast("bigint").alias("sentence_count"),
        ratio(F.col("letters"), n).alias("avg_word_len"),
        ratio(n, F.col("sentences")).alias("avg_sentence_len"),
        *[F.col(c).cast("bigint").alias(c) for c in ("punctuation_count", "uppercase_count", "digit_count")],
        ratio(F.col("unique_word_count"), n).alias("type_token_ratio"),
    )


def vowel_groups(words: Column) -> Column:
    """Syllables of each word: vowel groups after dropping silent endings, at least one."""
    s = T.replace(F.array_join(words, " "), P.SILENT, "")
    s = T.replace(T.replace(s, f"[{P.VOWELS}]+", "*"), "[^* ]", "")
    return F.transform(F.split(s, " "), lambda g: F.greatest(F.lit(1), F.length(g)))


def half_up(x: Column, places: int) -> Column:
    """Round away from zero on ties, then towards minus infinity: ``floor(x*10^p + sign/2)/10^p``."""
    return F.floor(x * 10**places + F.signum(x) * 0.5) / float(10**places)


def readability_counts(
    df: DataFrame, input_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] = ()
) -> DataFrame:
    text = T.fill_text(F.col(input_col))
    base = df.select(
        id_col, *keep, text.alias("t"), sentence_counts(text).alias("own"), syllable_counts(F.lower(text)).alias("of_words")
    )
    return base.select(
        id_col,
        *keep,
        F.length(F.trim("t")).cast("bigint").alias("n_trimmed"),
        F.greatest(F.lit(1), F.col("own.n_sentences")).cast("bigint").alias("n_sentences"),
        F.col("own.n_chars").alias("n_chars"),
        *[F.col(f"of_words.{c}").alias(c) for c in OF_SYLLABLES],
    )


def readability_features(
    df: DataFrame, input_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] = ()
) -> DataFrame:
    """Five published readability indexes; text under ten characters gives zeros."""
    c = readability_counts(df, input_col, id_col, keep)
    w, s, syl = F.col("n_words"), F.col("n_sentences"), F.col("n_syllables")
    per_sentence, per_word = half_up(ratio(w, s), 1), half_up(ratio(syl, w), 1)
    per_100 = lambda x: half_up(half_up(ratio(x, w), 2) * 100, 2)
    values = {
        "flesch_ease": half_up(206.835 - per_sentence * 1.015 - per_word * 84.6, 2),
        "fk_grade": half_up(per_sentence * 0.39 + per_word * 11.8 - 15.59, 1),
        "smog": F.when(s < 3, F.lit(0.0)).otherwise(
            half_up(F.sqrt(ratio(F.col("n_polysyllables") * 30, s)) * 1.043 + 3.1291, 1)
        ),
        "coleman_liau": half_up(per_100(F.col("n_letters")) * 0.058 - per_100(s) * 0.296 - 15.8, 2),
        "ari": half_up(
            half_up(ratio(F.col("n_chars"), w), 2) * 4.71 + half_up(ratio(w, s), 2) * 0.5 - 21.43, 1
        ),
    }
    usable = (F.col("n_trimmed") >= 10) & (w > 0)
    return c.select(
        id_col, *keep, *[F.when(usable, v + 0.0).otherwise(F.lit(0.0)).alias(k) for k, v in values.items()]
    )
