"""Part-of-speech shares from a word-to-tag table with suffix rules for the rest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modlens.functions import wordlists as W
from modlens.functions.lookup import map_words
from modlens.functions.scores import longs
from modlens.functions.text import fill_text, treebank_tokens
from modlens.sources.tables import local_table

POS = list(W.TAG_CATEGORIES)
# Tag of a word the table does not know: first rule that matches its lower-case form.
SUFFIX_TAGS = [
    (r"^[0-9][0-9.,]*$", "CD"),
    (r"^[^\p{L}\p{N}]+$", "SYM"),
    ("ly$", "RB"),
    ("ing$", "VBG"),
    ("ed$", "VBD"),
    ("(ous|ful|able|ible|ish|ive|ic|al|less)$", "JJ"),
    ("est$", "JJS"),
    ("[^s]s$", "NNS"),
]


def suffix_tag(word: Column) -> Column:
    rule = F.when(word.rlike(SUFFIX_TAGS[0][0]), SUFFIX_TAGS[0][1])
    for pattern, tag in SUFFIX_TAGS[1:]:
        rule = rule.when(word.rlike(pattern), tag)
    return rule.otherwise("NN")


def starter_tags(spark: SparkSession, tags: Mapping[str, Sequence[str]] = W.TAGS) -> DataFrame:
    pairs = [(w, t) for t, words in tags.items() for w in words]
    return local_table(spark, {"word": [p[0] for p in pairs], "tag": [p[1] for p in pairs]})


def category_table(spark: SparkSession) -> DataFrame:
    pairs = [(t, c) for c, tags in W.TAG_CATEGORIES.items() for t in tags]
    return local_table(spark, {"tag": [p[0] for p in pairs], "category": [p[1] for p in pairs]})


def token_rows(df: DataFrame, input_col: str, id_col: str) -> DataFrame:
    """One row per token; a document without tokens keeps one row with a null word."""
    tokens = treebank_tokens(fill_text(F.col(input_col)))
    return df.select(id_col, F.explode_outer(tokens).alias("token")).select(id_col, F.lower("token").alias("word"))


def tagged(tokens: DataFrame, tag_table: DataFrame) -> DataFrame:
    known = tokens.join(tag_table, "word", "left")
    return known.withColumn("tag", F.coalesce("tag", suffix_tag(F.col("word"))))


def learn_tags(tagged_tokens: DataFrame) -> DataFrame:
    """Most frequent tag of each word, ties to the alphabetically first tag.

    The counts are merged per (word, tag) before any shuffle by word, so a very frequent word is a
    handful of rows when the arg-max is taken.
    """
    counts = tagged_tokens.groupBy("word", "tag").agg(F.count("*").alias("n"))
    best = Window.partitionBy("word").orderBy(F.desc("n"), "tag")
    return counts.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("word", "tag", "n")


def _known_tags() -> dict[str, str]:
    """Tag of each word of the starter table; the first one, where it has several."""
    return {w: tag for tag, words in reversed(W.TAGS.items()) for w in words}


def _categories(tags: list[str | None]) -> np.ndarray:
    """Place in ``POS`` of each tag's category, or -1."""
    place = {t: POS.index(c) for c, own in reversed(W.TAG_CATEGORIES.items()) for t in own}
    return np.array([place.get(t, -1) for t in tags], dtype=np.int64)


def _suffix_tags(words: pa.Array) -> list[str]:
    """``suffix_tag`` of distinct words."""
    tags = np.full(len(words), "NN", dtype=object)
    for pattern, tag in reversed(SUFFIX_TAGS):
        tags[pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)] = tag
    return tags.tolist()


def _counts(tokens: pa.Array, found: pa.Array | None) -> pa.Array:
    """Tokens of each category in each list; the tags of each distinct word are looked up once a batch."""
    encoded = tokens.flatten().dictionary_encode()
    words, word = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
    suffix = _suffix_tags(words)
    if found is None:
        known = _known_tags()
        suffix = [known.get(w, s) for w, s in zip(words.to_pylist(), suffix, strict=True)]
    category = _categories(suffix)[word]
    if found is not None:
        tags = found.flatten().dictionary_encode()
        tag = pc.fill_null(tags.indices, -1).to_numpy(zero_copy_only=False)
        category = np.where(tag >= 0, np.append(_categories(tags.dictionary.to_pylist()), -1)[tag], category)
    sizes = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    cell = np.repeat(np.arange(len(sizes)) * len(POS), sizes) + category
    counts = np.bincount(cell[category >= 0], minlength=len(sizes) * len(POS)).reshape(-1, len(POS))
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in counts.T], POS)


@F.arrow_udf(longs(POS))
def category_counts(tokens: pa.Array) -> pa.Array:
    return _counts(tokens, None)


@F.arrow_udf(longs(POS))
def category_counts_with(tokens: pa.Array, found: pa.Array) -> pa.Array:
    return _counts(tokens, found)


def pos_features(
    df: DataFrame, input_col: str = "text", id_col: str = "doc_id", keep: Sequence[str] = (),
    tag_table: DataFrame | None = None,
) -> DataFrame:
    """Share of nine categories among all tokens; zeros for documents without tokens.

    Tags are looked up inside the rows, whatever the size of the tag table, so no token is shuffled but the rare
    ones of a very long table.
    """
    tokens = F.transform(treebank_tokens(fill_text(F.col(input_col))), F.lower)
    rows = df.select(id_col, *keep, tokens.alias("_tokens"))
    if tag_table is None:
        counts = category_counts("_tokens")
    else:
        rows = map_words(rows, id_col, "_tokens", tag_table.select("word", F.col("tag").alias("value")), "_tags")
        counts = category_counts_with("_tokens", "_tags")
    rows = rows.select(id_col, *keep, F.size("_tokens").alias("_n"), counts.alias("_counts"))

    def share(c: str) -> Column:
        return F.coalesce(F.try_divide(F.col(f"_counts.{c}").cast("double"), F.col("_n")), F.lit(0.0)).alias(f"pos_{c}")

    return rows.select(id_col, *keep, *[share(c) for c in POS])
