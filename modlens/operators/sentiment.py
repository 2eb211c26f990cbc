"""Rule-based sentiment (Hutto and Gilbert 2014) over a valence table.

Context is read inside each document's own token array; only tokens that carry valence are exploded
and joined, so the shuffle holds a few rows per document instead of every token.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.functions import patterns as P
from modlens.functions import wordlists as W
from modlens.functions.text import LITERAL_WORDS, apply_lambda, fill_text, split_spaces, sql_list, vector_terms
from modlens.sources.tables import local_table

SENTIMENT = ["sent_pos", "sent_neg", "sent_neu", "sent_compound"]


def sentiment_tokens(col: Column) -> Column:
    """Whitespace tokens of two or more characters."""
    return F.filter(split_spaces(col), lambda t: F.length(t) > 1)


def bare(token: str) -> str:
    """A token without its outer punctuation, if that leaves two or more characters."""
    inner = token.strip(P.PUNCT_CHARS)
    return inner if len(inner) > 1 else token


READ = "struct<n_caps: bigint, but_at: bigint, hits: array<struct<pos: int, token: string, p1: string, p2: string, p3: string>>>"


def reader(words: frozenset[str] | None) -> Callable[[pa.Array], pa.Array]:
    """Capitals, the place of "but", and each of the words (None: every token) with the three tokens before it, in each
    list of tokens. The distinct tokens of a batch are examined once."""

    def read(tokens: pa.Array) -> pa.Array:
        encoded = tokens.flatten().dictionary_encode()
        own = [bare(t) for t in encoded.dictionary.to_pylist()]
        low = [t.lower() for t in own]
        caps = np.array([t != s and t == t.upper() for t, s in zip(own, low, strict=True)], dtype=bool)
        rated = np.array([words is None or s in words for s in low], dtype=bool)
        but = np.array([s == "but" for s in low], dtype=bool)
        word = encoded.indices.to_numpy(zero_copy_only=False)
        sizes = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        doc, start = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        n_caps = np.bincount(doc[caps[word]], minlength=len(sizes))
        buts = np.flatnonzero(but[word])
        with_but, first = np.unique(doc[buts], return_index=True)
        but_at = np.full(len(sizes), -1, dtype=np.int64)
        but_at[with_but] = buts[first] - start[with_but]
        at = np.flatnonzero(rated[word])
        place, texts = at - start[doc[at]], pa.array(own, pa.string())
        context = [texts.take(pa.array(word[np.maximum(at - k, 0)], mask=place < k)) for k in range(4)]
        hits = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), *context], ["pos", "token", "p1", "p2", "p3"])
        ends = np.cumsum(np.bincount(doc[at], minlength=len(sizes)))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), hits)
        return pa.StructArray.from_arrays([pa.array(n_caps.astype(np.int64)), pa.array(but_at), lists], ["n_caps", "but_at", "hits"])

    return read


def is_caps(t: Column) -> Column:
    return (t != F.lower(t)) & (t == F.upper(t))


def lexicon_table(spark, lexicon: Mapping[str, float]) -> DataFrame:
    boosters = {*W.BOOST_UP, *W.BOOST_DOWN}
    kept = {w: float(v) for w, v in lexicon.items() if w not in boosters}
    return local_table(spark, {"word": list(kept), "valence": list(kept.values())})


def _with_valence(hits: DataFrame) -> DataFrame:
    """Capitals, then boosters and negations at distance one to three, then the word "least", then
    the weights around "but".  Tokens that the lexicon does not rate stay at zero, however they were found.

    Each step is a projection of its own: the running value is used several times per step, and
    written as one expression it would be repeated at every use.
    """
    v, mixed = F.col("v"), F.col("mixed")
    shout = F.when(v > 0, W.CAPS).when(v < 0, -W.CAPS).otherwise(0.0)
    df = hits.withColumn("v", F.coalesce("valence", F.lit(0.0)))
    df = df.withColumn("v", v + F.when(is_caps(F.col("token")) & mixed, shout).otherwise(0.0))
    for distance, weight in ((1, 1.0), (2, 0.95), (3, 0.9)):
        word = F.col(f"p{distance}")
        low = F.lower(word)
        # The boost of the word before, in the direction of a positive value.
        within = lambda items, p=f"lower(p{distance})": F.expr(f"{p} IN {sql_list(items)}")
        boost = F.when(within(W.BOOST_UP), W.BOOST).when(within(W.BOOST_DOWN), -W.BOOST)
        loud = F.when(is_caps(word) & mixed, W.CAPS).otherwise(0.0)
        negated = within(W.NEGATIONS) | low.contains("n't")
        df = (
            df.withColumn("step", F.coalesce((boost + loud) * weight, F.lit(0.0)))
            .withColumn("turn", F.when(negated, W.NEGATION).otherwise(1.0))
            .withColumn("acts", word.isNotNull() & ~F.col(f"known{distance}"))
        )
        signed = F.when(v > 0, F.col("step")).otherwise(-F.col("step"))
        df = df.withColumn("v", F.when(F.col("acts"), (v + signed) * F.col("turn")).otherwise(v))
    p1, p2 = F.lower("p1"), F.lower(F.coalesce("p2", F.lit("")))
    least = (p1 == "least") & ~F.col("known1") & ~p2.isin("at", "very")
    pos, but = F.col("pos"), F.col("but_at")
    around_but = F.when((but >= 0) & (pos < but), 0.5).when((but >= 0) & (pos > but), 1.5).otherwise(1.0)
    value = v * F.when(least, W.NEGATION).otherwise(1.0) * around_but
    return df.withColumn("v", F.when(F.col("valence").isNotNull(), value).otherwise(0.0))


def sentiment_features(
    df: DataFrame, input_col: str = "text", id_col: str = "doc_id", lexicon: Mapping[str, float] = W.VALENCE
) -> DataFrame:
    """Shares of positive, negative and neutral weight, and the compound score."""
    spark = df.sparkSession
    table = lexicon_table(spark, lexicon)
    text = fill_text(F.col(input_col))
    words = list(lexicon)
    kept = frozenset(words) if len(words) <= LITERAL_WORDS else None

    @F.arrow_udf(READ)
    def read(tokens: pa.Array) -> pa.Array:
        return reader(kept)(tokens)

    tokens = F.col("tokens")
    base = df.select(id_col, text.alias("t"), sentiment_tokens(text).alias("tokens"))
    base = base.select(id_col, "t", F.size(tokens).alias("n_tokens"), read(tokens).alias("own"))
    bangs = F.least(F.regexp_count("t", F.lit("!")), F.lit(4))
    questions = F.regexp_count("t", F.lit(r"\?"))
    emphasis = bangs * 0.292 + F.when(questions > 3, 0.96).when(questions > 1, questions * 0.18).otherwise(0.0)
    n_caps = F.col("own.n_caps")
    base = base.select(
        id_col,
        "n_tokens",
        emphasis.alias("emphasis"),
        ((n_caps > 0) & (n_caps < F.col("n_tokens"))).alias("mixed"),
        F.col("own.but_at").alias("but_at"),
        F.col("own.hits").alias("hits"),
    )
    exploded = base.withColumn("hit", F.explode_outer("hits")).drop("hits")
    exploded = exploded.select("*", "hit.*").drop("hit")
    for col, out in (("token", "valence"), ("p1", "known1"), ("p2", "known2"), ("p3", "known3")):
        side = table.select(F.col("word").alias(f"_{col}"), F.col("valence").alias(out))
        exploded = exploded.join(side, F.lower(F.col(col)) == F.col(f"_{col}"), "left").drop(f"_{col}")
    for k in (1, 2, 3):
        exploded = exploded.withColumn(f"known{k}", F.col(f"known{k}").isNotNull())
    per_doc = (
        _with_valence(exploded)
        .groupBy(id_col)
        .agg(
            F.max("n_tokens").alias("n"),
            F.max("emphasis").alias("emphasis"),
            F.sum("v").alias("s"),
            F.sum(F.when(F.col("v") > 0, F.col("v") + 1).otherwise(0.0)).alias("up"),
            F.sum(F.when(F.col("v") < 0, 1 - F.col("v")).otherwise(0.0)).alias("down"),
            F.count(F.when(F.col("v") != 0, 1)).alias("rated"),
        )
    )
    s, up, down, e = F.round("s", 6), F.round("up", 6), F.round("down", 6), F.col("emphasis")
    total = s + F.when(s > 0, e).when(s < 0, -e).otherwise(0.0)
    strong_up = up + F.when(up > down, e).otherwise(0.0)
    strong_down = down + F.when(up < down, e).otherwise(0.0)
    weight = strong_up + strong_down + F.col("n") - F.col("rated")
    share = lambda x: F.coalesce(F.round(F.try_divide(x, weight), 3), F.lit(0.0))
    return per_doc.select(
        id_col,
        share(strong_up).alias("sent_pos"),
        share(strong_down).alias("sent_neg"),
        share(F.col("n") - F.col("rated")).alias("sent_neu"),
        F.round(total / F.sqrt(total * total + W.NORMALISER), 4).alias("sent_compound"),
    )


def lexicon_hits(col: Column, terms=tuple(W.ABUSE_TERMS)) -> Column:
    """Number of words of a text that are in a short term list."""
    return F.size(apply_lambda("filter", vector_terms(fill_text(col)), f"t -> t IN {sql_list(terms)}"))
