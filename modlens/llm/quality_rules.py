"""Quality rules by distribution divergence, in native expressions alone.

Each document has a histogram over character classes and one over common words (one bin per word of
``COMMON_WORDS``, one for all other words). The histograms of a language's documents, added up over the whole corpus,
are its references. The Jensen-Shannon distance (root of the divergence, base 2) to the nearest language must not
exceed a limit. Short texts have wide histograms by chance alone, so each rule has a minimum length below which it
does not judge.

The base rules come first: fewer than 50 words, or more than half of the words in repeated three-word windows, fail.

Edge cases: null and empty texts have 0 words and fail the base; a corpus without language labels has no reference,
and then nothing diverges; repeated rows are judged alike; other columns of the input are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, written

# Frequent function words of the four languages, of at most four letters.
COMMON_WORDS = (
    "the of and to in is that for it as "
    "le la les et est pour dans qui sur du "
    "der die das und ist mit von auf zu den "
    "el los las y por con para su al que"
).split()
BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CHAR_LIMIT, WORD_LIMIT = 0.26, 0.42
MIN_CHARS, MIN_WORDS = 200, 80
# Languages with a smaller share of the documents are no reference; at most 1 / MIN_SHARE are collected.
MIN_SHARE = 0.001
CLASSES = ("lower", "upper", "digit", "blank", "symbol", "other")


def measured(docs: DataFrame) -> DataFrame:
    """The counts of the base rules, n_chars, and the histograms chars and common, of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", text.alias("text")))
    rows = slim.select(
        "doc_id", "lang", "text",
        F.array_remove(F.split("text", BREAK), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length("text").alias("n_chars"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Ll}+", ""))).alias("lower"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).alias("upper"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Nd}+", ""))).alias("digit"),
    )
    n = F.size("words")
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    heads = F.slice("hashes", 1, F.greatest(n - 2, F.lit(0)))
    after = lambda i, k: F.get(F.col("hashes"), i + k)
    rows = rows.select(
        "*",
        n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(heads, lambda h, i: F.xxhash64(h, after(i, 1), after(i, 2))).alias("windows"),
    ).drop("lines", "hashes")
    # Windows in the order of their hash: those next to an equal one are repeated.
    numbered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn(
        "sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), numbered).otherwise(F.array())
    ).drop("windows")
    hash_at = lambda j: F.get(F.col("sorted"), j)["h"]
    repeated = F.transform(
        "sorted",
        lambda x, j: F.when(x["h"].eqNullSafe(hash_at(j - 1)) | x["h"].eqNullSafe(hash_at(j + 1)), x["i"]),
    )
    rows = rows.withColumn("repeated", F.sort_array(F.array_compact(repeated))).drop("sorted")
    # Each repeated window covers three words, less what the next one covers too.
    covered = F.transform(
        "repeated", lambda i, j: F.coalesce(F.least(F.get(F.col("repeated"), j + 1) - i, F.lit(3)), F.lit(3))
    )
    # Each common word becomes one letter of its own, so that bins are counted as letters of a string.
    letters = string.ascii_letters[: len(COMMON_WORDS)]
    lists = F.array(*map(F.lit, COMMON_WORDS))
    letter = lambda w: F.substring(
        F.lit("-" + letters), (F.array_position(lists, F.lower(w)) + 1).cast("int"), F.lit(1)
    )
    known = F.array_join(F.transform(F.filter("words", lambda w: F.length(w) <= 4), letter), "")
    known = F.replace(known, F.lit("-"), F.lit(""))
    rows = rows.select(
        "*", F.aggregate(covered, F.lit(0), lambda s, x: s + x).cast("long").alias("n_repeat_words"), known.alias("known")
    ).drop("repeated", "words", "text")
    common = [F.length("known") - F.length(F.replace(F.col("known"), F.lit(x), F.lit(""))) for x in letters]
    blank = F.col("n_chars") - F.col("word_chars")
    other = F.col("word_chars") - F.col("lower") - F.col("upper") - F.col("digit") - F.col("n_symbols")
    return rows.select(
        "doc_id", "lang", "n_words", F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.array(*(x.cast("double") for x in (F.col("lower"), F.col("upper"), F.col("digit"), blank, F.col("n_symbols"), other))).alias("chars"),
        F.array(*(x.cast("double") for x in (*common, F.col("n_words") - F.length("known")))).alias("common"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(rows: DataFrame) -> list[tuple[list[float], list[float]]]:
    """Histograms (chars, common) of each language, over its documents that pass the base rules."""
    sizes = {"chars": len(CLASSES), "common": len(COMMON_WORDS) + 1}
    sums = [F.sum(F.col(h)[k]).alias(f"{h}_{k}") for h, n in sizes.items() for k in range(n)]
    table = rows.where("lang is not null").where(~base_failed()).groupBy("lang").agg(F.count("*").alias("n"), *sums)
    total = table.agg(F.sum("n")).first()[0] or 0
    found = table.where(F.col("n") >= MIN_SHARE * total).orderBy("lang").collect()
    return [tuple([r[f"{h}_{k}"] for k in range(n)] for h, n in sizes.items()) for r in found]


def js_distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares."""

    def term(p, q):
        return F.when(p > 0, p * F.log2(p / ((p + q) / 2))).otherwise(0.0)

    terms = F.zip_with(shares, reference, lambda p, q: (term(p, q) + term(q, p)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def nearest(shares: str, references: list[list[float]]) -> Column:
    """Distance to the nearest reference; 0 without references."""
    distances = [js_distance(F.col(shares), F.array(*map(F.lit, r))) for r in references]
    return F.round(F.least(*distances, F.lit(1.0)), 4) if distances else F.lit(0.0)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance,
    word_distance of every document."""
    # A table of its own: read twice, and no filter on it is pushed into the expressions that made it.
    rows = written(measured(docs), "measured")
    share = lambda h: [x / sum(h) for x in h]
    found = references(rows)
    total = F.aggregate("chars", F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("size", F.greatest(total, F.lit(1.0))).withColumn("words", F.greatest("n_words", F.lit(1)))
    rows = rows.withColumn("chars", F.transform("chars", lambda x: x / F.col("size")))
    rows = rows.withColumn("common", F.transform("common", lambda x: x / F.col("words")))
    rows = rows.withColumn("char_distance", nearest("chars", [share(c) for c, _ in found]))
    rows = rows.withColumn("word_distance", nearest("common", [share(w) for _, w in found]))
    diverges = ((F.col("size") >= MIN_CHARS) & (F.col("char_distance") > CHAR_LIMIT)) | (
        (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > WORD_LIMIT)
    )
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~diverges).alias("kept"), "char_distance", "word_distance",
    )
