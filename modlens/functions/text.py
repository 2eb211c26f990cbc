"""Text cleaning and tokenising as native column expressions (Arrow batches where a rule has no expression)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.functions import patterns as P
from modlens.functions import wordlists as W
from modlens.functions.lookup import map_words
from modlens.functions.stemming import stemmed
from modlens.sources.tables import materialise

# A word list up to this size is compiled into the plan as a hash set; a longer one goes to the tasks or is joined.
LITERAL_WORDS = 20_000


def replace(col: Column, pattern: str, replacement: str) -> Column:
    """``regexp_replace`` taking the portable ``\\1`` group notation."""
    return F.regexp_replace(col, pattern, re.sub(r"\\(\d)", r"$\1", replacement))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a computed value to a name, so that several uses of it cost one evaluation."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def guarded(col: Column, substrings: Sequence[str], change: Callable[[Column], Column], lower: bool = False) -> Column:
    """Apply a regex step only to texts that contain one of the substrings it needs."""

    def found(text: Column) -> Column:
        return reduce(Column.__or__, [text.contains(s) for s in substrings])

    if not substrings:
        return change(col)
    return let(col, lambda c: F.when(let(F.lower(c), found) if lower else found(c), change(c)).otherwise(c))


def fill_text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip_urls(col: Column) -> Column:
    return guarded(col, ("http", "www"), lambda c: replace(c, P.URL, ""))


def strip_mentions(col: Column) -> Column:
    return guarded(col, ("@",), lambda c: replace(c, P.MENTION, ""))


def strip_punctuation(col: Column) -> Column:
    return replace(col, P.PUNCT, "")


def split_spaces(col: Column) -> Column:
    return F.filter(F.split(col, P.SPACES), lambda t: t != "")


def split_fused(col: Column) -> Column:
    def change(c: Column) -> Column:
        for pattern, replacement in P.FUSED:
            c = replace(c, pattern, replacement)
        return c

    return guarded(col, P.FUSED_WORDS, change, lower=True)


def treebank_tokens(col: Column) -> Column:
    """Penn Treebank style tokens of raw or cleaned text."""
    for pattern, replacement, needed in P.TREEBANK:
        col = guarded(col, needed, lambda c, p=pattern, r=replacement: replace(c, p, r))
    return split_spaces(split_fused(col))


def clean_tokens(col: Column) -> Column:
    """Tokens of text whose punctuation is already gone: only fused words still split."""
    return split_spaces(split_fused(col))


def vector_terms(col: Column) -> Column:
    """Vectoriser tokens: runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(col), F.lit(P.WORD2), F.lit(0))


def sql_list(words: Iterable[str]) -> str:
    """Word list as SQL text: one parse instead of one call per word when the plan is built."""
    quoted = (w.replace("\\", "\\\\").replace("'", "\\'") for w in words)
    return "(" + ", ".join(f"'{w}'" for w in quoted) + ")"


def apply_lambda(function: str, tokens: Column, body: str) -> Column:
    """A higher-order function with its lambda given as SQL text."""
    return F.call_function(function, tokens, F.expr(body))


def drop_stopwords(tokens: Column, stop_words: Sequence[str] = tuple(W.STOP_WORDS)) -> Column:
    return apply_lambda("filter", tokens, f"t -> t NOT IN {sql_list(stop_words)}") if stop_words else tokens


def noun_rule(nouns: Sequence[str]) -> str:
    """SQL lambda: the shortest singular of a token that the noun table knows, else the token."""
    table = sql_list(nouns)

    def known(condition: str, candidate: str) -> str:
        return f"CASE WHEN {condition} AND {candidate} IN {table} THEN {candidate} END"

    cut1, cut2, cut3 = (f"left(w, length(w) - {k})" for k in (1, 2, 3))
    exceptions = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.NOUN_EXCEPTIONS.items())
    rules = [
        known("(w LIKE '%ses' OR w LIKE '%xes' OR w LIKE '%zes' OR w LIKE '%ches' OR w LIKE '%shes')", cut2),
        known("w LIKE '%ves'", f"concat({cut3}, 'f')"),
        known("w LIKE '%ies'", f"concat({cut3}, 'y')"),
        known("w LIKE '%s'", cut1),
        known("w LIKE '%men'", f"concat({cut3}, 'man')"),
        f"CASE w {exceptions} END",
    ]
    may_change = f"w LIKE '%s' OR w LIKE '%men' OR w IN {sql_list(W.NOUN_EXCEPTIONS)}"
    return f"w -> CASE WHEN {may_change} THEN coalesce({', '.join(rules)}, w) ELSE w END"


def noun_lemma(word: str, nouns: frozenset[str]) -> str:
    """The rule of ``noun_rule`` for one word."""
    candidates = (
        word[:-2] if word.endswith(("ses", "xes", "zes", "ches", "shes")) else None,
        word[:-3] + "f" if word.endswith("ves") else None,
        word[:-3] + "y" if word.endswith("ies") else None,
        word[:-1] if word.endswith("s") else None,
        word[:-3] + "man" if word.endswith("men") else None,
    )
    found = next((c for c in candidates if c is not None and c in nouns), None)
    return found if found is not None else W.NOUN_EXCEPTIONS.get(word, word)


def lemmatise(tokens: Column, nouns: Sequence[str] = tuple(W.NOUNS)) -> Column:
    """Noun lemmas inside the row. A list beyond ``LITERAL_WORDS`` goes to the tasks as a set; for a table that the
    driver should not hold, use ``lemmatise_with_table``."""
    if len(nouns) <= LITERAL_WORDS:
        return apply_lambda("transform", tokens, noun_rule(nouns))
    known = frozenset(nouns)

    @F.pandas_udf("array<string>")
    def lemmas(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ts: None if ts is None else [noun_lemma(t, known) for t in ts])

    return lemmas(tokens)


def noun_lemmas_of(vocabulary: DataFrame, nouns: DataFrame) -> DataFrame:
    """``(word, value)``: lemmas of the distinct words that a noun table of any size changes."""
    w, n = F.col("word"), F.length("word")
    cuts = F.array(
        F.when(w.rlike("(s|x|z|ch|sh)es$"), F.substring(w, F.lit(1), n - 2)),
        F.when(w.endswith("ves"), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("f"))),
        F.when(w.endswith("ies"), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y"))),
        F.when(w.endswith("s"), F.substring(w, F.lit(1), n - 1)),
        F.when(w.endswith("men"), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("man"))),
    )
    return (
        vocabulary.filter(w.rlike("(s|men)$"))
        .select("word", F.posexplode(cuts).alias("rule", "noun"))
        .filter(F.col("noun").isNotNull())
        .join(nouns.select(F.col(nouns.columns[0]).alias("noun")).distinct(), "noun")
        .groupBy("word")
        .agg(F.min_by("noun", "rule").alias("value"))
    )


def lemmatise_with_table(df: DataFrame, id_col: str, tokens_col: str, nouns: DataFrame, output_col: str = "lemmas") -> DataFrame:
    """Same rule with a noun table of any size: it meets the distinct words of the corpus, and the lemmas are put back
    inside the rows."""
    df = materialise(df, "tokens")
    vocabulary = df.select(F.explode(F.array_distinct(tokens_col)).alias("word")).distinct()
    lemmas = materialise(noun_lemmas_of(vocabulary, nouns), "lemmas")
    irregular = "w -> CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.NOUN_EXCEPTIONS.items()) + " ELSE w END"
    found = map_words(df, id_col, tokens_col, lemmas, "_found")
    found = found.withColumn("_other", apply_lambda("transform", F.col(tokens_col), irregular))
    value = F.zip_with("_found", "_other", lambda f, o: F.coalesce(f, o))
    return found.withColumn(output_col, F.coalesce(value, F.array().cast("array<string>"))).drop("_found", "_other")


@dataclass(frozen=True)
class CleanOptions:
    """Switches of the cleaning step, in the order in which they act."""

    lowercase: bool = True
    remove_urls: bool = True
    remove_mentions: bool = True
    remove_punctuation: bool = True
    remove_stopwords: bool = True
    lemmatization: bool = True
    stemming: bool = False
    stop_words: tuple[str, ...] = field(default=tuple(W.STOP_WORDS), repr=False)
    nouns: tuple[str, ...] = field(default=tuple(W.NOUNS), repr=False)
    noun_table: str | None = None  # path of a table of nouns, instead of ``nouns``; see ``clean_columns``


def _split(col: Column, options: CleanOptions) -> Column:
    """Tokens before lemmas and stems."""
    col = fill_text(col)
    if options.lowercase:
        col = F.lower(col)
    if options.remove_urls:
        col = strip_urls(col)
    if options.remove_mentions:
        col = strip_mentions(col)
    tokens = clean_tokens(strip_punctuation(col)) if options.remove_punctuation else treebank_tokens(col)
    return drop_stopwords(tokens, options.stop_words) if options.remove_stopwords else tokens


def preprocess_tokens(col: Column, options: CleanOptions = CleanOptions()) -> Column:
    if options.lemmatization and options.noun_table:
        raise ValueError("a table of nouns needs a DataFrame; use clean_columns")
    tokens = _split(col, options)
    if options.lemmatization:
        tokens = lemmatise(tokens, options.nouns)
    return stemmed(tokens) if options.stemming else tokens


def preprocess(col: Column, options: CleanOptions = CleanOptions()) -> Column:
    return F.array_join(preprocess_tokens(col, options), " ")


def clean_columns(df: DataFrame, input_col: str, output_col: str, id_col: str, options: CleanOptions = CleanOptions()) -> DataFrame:
    """``df`` with its cleaned text, also with the nouns in a table (``options.noun_table``)."""
    if not (options.lemmatization and options.noun_table):
        return df.withColumn(output_col, preprocess(F.col(input_col), options))
    nouns = df.sparkSession.read.parquet(options.noun_table)
    rows = lemmatise_with_table(df.withColumn("_tokens", _split(F.col(input_col), options)), id_col, "_tokens", nouns, "_lemmas")
    tokens = stemmed(F.col("_lemmas")) if options.stemming else F.col("_lemmas")
    return rows.withColumn(output_col, F.array_join(tokens, " ")).drop("_tokens", "_lemmas")


def preview(col: Column, width: int = 100) -> Column:
    """First ``width`` characters, with dots where something was cut off."""
    return F.when(F.length(col) > width, F.concat(F.left(col, F.lit(width)), F.lit("..."))).otherwise(col)
