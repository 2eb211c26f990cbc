"""Document embeddings from word vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.functions.lookup import split_join
from modlens.operators.factors import item_factors
from modlens.operators.skipgram import SkipGramParams, skip_gram
from modlens.operators.vectorize import TfidfParams, bag_of_words, vocabulary
from modlens.sources.tables import materialise, numbered


@dataclass(frozen=True)
class Word2VecParams:
    vector_size: int = 100
    window: int = 5
    min_count: int = 1
    max_iter: int = 5
    seed: int = 42
    blocks: int | None = None  # None: by the number of distinct words


@dataclass(frozen=True)
class FactorParams:
    vector_size: int = 100
    min_count: int = 2
    epochs: int = 40
    seed: int = 42


@dataclass(frozen=True)
class SubwordParams:
    vector_size: int = 100
    window: int = 5
    min_count: int = 1
    min_gram: int = 3
    max_gram: int = 6
    buckets: int = 2_000_000
    seed: int = 42


FULL_JOB_WORD2VEC = Word2VecParams(300, 5, 5)


def word_vectors(df: DataFrame, tokens_col: str, params: Word2VecParams = Word2VecParams()) -> DataFrame:
    """``(word, vector)`` learned with skip-gram on blocks of words; vocabulary and weights stay distributed."""
    return skip_gram(df, tokens_col, SkipGramParams(
        params.vector_size, params.window, params.min_count, params.max_iter, seed=params.seed, blocks=params.blocks,
    ))


def mean_pool(df: DataFrame, tokens_col: str, vectors: DataFrame, size: int, id_col: str = "doc_id",
              weight_col: str | None = None) -> DataFrame:
    """``(id, embedding)``: mean vector of the known tokens of a document, zeros if there is none.

    Repeats of a word are merged inside the document. The vectors of the most frequent words are broadcast, the
    rest meets its words by a shuffle, and the mean is combined before the shuffle by document.
    """
    terms = df.select(id_col, F.col(tokens_col).alias("terms"))
    counts = bag_of_words(terms, id_col).select(id_col, F.col("term").alias("word"), F.col("tf").cast("double").alias("n"))
    weight = F.col("n") * F.col(weight_col) if weight_col else F.col("n")
    joined = split_join(counts, vectors, "word").withColumn("w", weight)
    pooled = joined.groupBy(id_col).agg(vector_to_array(Summarizer.mean(F.col("vector"), F.col("w"))).alias("m"))
    zeros = F.array_repeat(F.lit(0.0), size)
    return df.select(id_col).join(pooled, id_col, "left").select(id_col, F.coalesce("m", zeros).alias("embedding"))


@dataclass
class WordEmbedding:
    """Fitted word vectors; the same table serves training and new documents."""

    vectors: DataFrame
    size: int

    @classmethod
    def fit(cls, df: DataFrame, tokens_col: str, params: Word2VecParams = Word2VecParams()) -> WordEmbedding:
        return cls(materialise(word_vectors(df, tokens_col, params), "word-vectors"), params.vector_size)

    def transform(self, df: DataFrame, tokens_col: str, id_col: str = "doc_id") -> DataFrame:
        return mean_pool(df, tokens_col, self.vectors, self.size, id_col)

    def tables(self) -> dict[str, DataFrame]:
        return {"vectors": self.vectors}

    @classmethod
    def of_tables(cls, read: Callable[[str], DataFrame], params: Word2VecParams) -> WordEmbedding:
        return cls(read("vectors"), params.vector_size)


@dataclass
class FactorEmbedding:
    """Document vectors from a factorised document-term table.

    Positive pointwise mutual information weighs the table, implicit ALS factorises it, and any
    document, old or new, is the idf-weighted mean of its term factors.  ALS numbers its rows with
    32-bit integers, so documents are numbered from zero, each with a number of its own.
    """

    terms: DataFrame  # (word, vector, idf)
    size: int

    @classmethod
    def fit(cls, df: DataFrame, tokens_col: str, params: FactorParams = FactorParams(), id_col: str = "doc_id") -> FactorEmbedding:
        terms = df.select(id_col, F.col(tokens_col).alias("terms"))
        vocab = materialise(
            vocabulary(terms, TfidfParams(None, params.min_count, 1.0, (1, 1))), "factor-terms"
        )
        counts = bag_of_words(terms, id_col).withColumnRenamed("tf", "n")
        total = float(vocab.agg(F.sum("tf")).first()[0] or 1)
        length = materialise(numbered(df.select(id_col, F.size(tokens_col).alias("len")), "user"), "factor-docs")
        weighted = (
            counts.join(vocab.select("term", "tf", "idx"), "term")
            .join(length, id_col)
            .withColumn("ppmi", F.log(F.col("n") * total / (F.col("len") * F.col("tf"))))
            .filter("ppmi > 0")
            .select(F.col("user").cast("int").alias("user"), F.col("idx").cast("int").alias("item"), F.col("ppmi").alias("rating"))
        )
        found = item_factors(weighted, params.vector_size, params.epochs, params.seed)
        factors = found.join(vocab.select(F.col("idx").alias("id"), "term", "idf"), "id").select(
            F.col("term").alias("word"), array_to_vector(F.col("features").cast("array<double>")).alias("vector"), "idf"
        )
        return cls(materialise(factors, "factors"), params.vector_size)

    def transform(self, df: DataFrame, tokens_col: str, id_col: str = "doc_id") -> DataFrame:
        return mean_pool(df, tokens_col, self.terms, self.size, id_col, "idf")

    def tables(self) -> dict[str, DataFrame]:
        return {"terms": self.terms}

    @classmethod
    def of_tables(cls, read: Callable[[str], DataFrame], params: FactorParams) -> FactorEmbedding:
        return cls(read("terms"), params.vector_size)


def char_grams(word: Column, low: int, high: int) -> Column:
    """Character n-grams of ``<word>``."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))

    def of_size(n: int) -> Column:
        starts = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - (n - 1)))
        return F.coalesce(
            F.transform(starts, lambda i: F.substring(marked, i, F.lit(n))), F.array().cast("array<string>")
        )

    return F.array_distinct(F.concat(*[of_size(n) for n in range(low, high + 1)]))


@dataclass
class SubwordEmbedding:
    """Word vectors spread over hashed character n-grams, so that unseen words get vectors too."""

    words: DataFrame  # (word, vector)
    grams: DataFrame  # (gram, vector)
    params: SubwordParams

    @staticmethod
    def _grams(words: DataFrame, p: SubwordParams) -> DataFrame:
        grams = F.explode(char_grams(F.col("word"), p.min_gram, p.max_gram))
        return words.withColumn("g", grams).withColumn("gram", F.pmod(F.xxhash64("g"), F.lit(p.buckets))).drop("g")

    @classmethod
    def fit(cls, df: DataFrame, tokens_col: str, params: SubwordParams = SubwordParams()) -> SubwordEmbedding:
        base = Word2VecParams(params.vector_size, params.window, params.min_count, seed=params.seed)
        words = materialise(word_vectors(df, tokens_col, base), "subword-words")
        grams = cls._grams(words, params).groupBy("gram").agg(Summarizer.mean(F.col("vector")).alias("vector"))
        return cls(words, materialise(grams, "subword-grams"), params)

    def vectors_for(self, words: DataFrame) -> DataFrame:
        """``(word, vector)`` for any distinct words: mean of the word's own vector and its n-grams."""
        parts = self._grams(words.select("word"), self.params).join(self.grams, "gram").select("word", "vector")
        own = words.select("word").join(self.words, "word").select("word", "vector")
        return parts.unionByName(own).groupBy("word").agg(Summarizer.mean(F.col("vector")).alias("vector"))

    def transform(self, df: DataFrame, tokens_col: str, id_col: str = "doc_id") -> DataFrame:
        words = df.select(F.explode(tokens_col).alias("word")).distinct()
        return mean_pool(df, tokens_col, self.vectors_for(words), self.params.vector_size, id_col)

    def tables(self) -> dict[str, DataFrame]:
        return {"words": self.words, "grams": self.grams}

    @classmethod
    def of_tables(cls, read: Callable[[str], DataFrame], params: SubwordParams) -> SubwordEmbedding:
        return cls(read("words"), read("grams"), params)
