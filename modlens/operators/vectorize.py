"""Bag of words and TF-IDF.

Fitting aggregates the corpus to a vocabulary table with map-side partial counts.  Transforming is
map-only: the capped vocabulary travels with the model, so no document is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modlens.functions.text import vector_terms
from modlens.sources.tables import local_table, materialise, numbered, settle

# Words whose n-grams a task counts at a time, n-grams that it passes on at a time: a batch may hold millions of words.
WORDS, ROWS = 1 << 18, 1 << 16


@dataclass(frozen=True)
class TfidfParams:
    max_features: int | None = 5000
    min_df: int = 2
    max_df: float = 0.95
    ngram_range: tuple[int, int] = (1, 2)


FULL_JOB = TfidfParams(1000, 3, 0.9, (1, 2))
DEMO = TfidfParams(10, 1, 0.9, (1, 3))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams with low <= n <= high, words joined by a space.

    Single elements are read by position; ``slice`` would copy the document once per n-gram.
    """

    def of_size(n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))
        grams = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]))
        return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))

    return of_size(low) if low == high else F.concat(*[of_size(n) for n in range(low, high + 1)])


def terms_of(
    df: DataFrame, input_col: str, id_col: str, ngram_range: tuple[int, int] = (1, 1), keep: Sequence[str] = ()
) -> DataFrame:
    """``(id, terms)`` of a cleaned text column."""
    words = df.select(id_col, *keep, vector_terms(F.coalesce(F.col(input_col), F.lit(""))).alias("words"))
    return words.select(id_col, *keep, ngrams(F.col("words"), *ngram_range).alias("terms"))


def bag_of_words(terms: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, term, tf)`` for every term, with no vocabulary limit and no shuffle.

    A document's own terms are sorted; each run of equal ones is a row.
    """
    ordered = terms.select(id_col, F.sort_array("terms").alias("t"))
    starts = F.transform("t", lambda w, i: F.when((i == 0) | (F.get(F.col("t"), i - 1) != w), i))
    ordered = ordered.select("*", F.array_compact(starts).alias("s"))
    runs = F.transform(
        "s",
        lambda i, k: F.struct(
            F.get(F.col("t"), i).alias("term"),
            (F.coalesce(F.get(F.col("s"), k + 1), F.size("t")) - i).cast("bigint").alias("tf"),
        ),
    )
    return ordered.select(id_col, F.inline(runs))


def _counted(words: pa.ListArray, low: int, high: int) -> list[pa.RecordBatch]:
    """``(term, df, tf)`` of the n-grams of some documents.

    An n-gram is the number of its first n-1 words and that of the last; only distinct ones become text.
    """
    flat, sizes = words.flatten(), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    doc, left = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    encoded = flat.dictionary_encode()
    single, word = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    gram, known, parts = word, single, []
    for n in range(1, high + 1):
        if n > 1:  # an n-gram starts where n words are left
            starts = np.flatnonzero(left >= n)
            number, keys = pd.factorize(gram[starts] * len(single) + word[starts + n - 1])
            gram = np.zeros(len(word), np.int64)
            gram[starts] = number
            known = known.take(pa.array(keys // max(len(single), 1)))
            known = pc.binary_join_element_wise(known, single.take(pa.array(keys % max(len(single), 1))), " ")
        else:
            starts = np.arange(len(word))
        if n >= low:
            pairs = pd.unique(gram[starts] * len(sizes) + doc[starts]) // max(len(sizes), 1)
            df, tf = (np.bincount(x, minlength=len(known)) for x in (pairs, gram[starts]))
            parts.append(pa.table({"term": known, "df": df, "tf": tf}))
    return pa.concat_tables(parts).combine_chunks().to_batches(max_chunksize=ROWS)


def _slices(words: pa.ListArray) -> Iterator[pa.ListArray]:
    """Documents of about ``WORDS`` words at a time (a longer one alone)."""
    upto, start = np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < len(words):
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + WORDS, side="right")))
        yield words.slice(start, end - start)
        start = end


def document_frequency(terms: DataFrame, ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """``(term, df, tf)`` of the n-grams of the terms in one pass over the text: a task counts the documents of a slice
    of a batch at a time, and these counts are combined before the shuffle."""

    def counts(batches):
        for batch in batches:
            for words in _slices(batch.column(0)):
                yield from _counted(words, *ngram_range)

    counted = terms.select("terms").mapInArrow(counts, "term string, df bigint, tf bigint")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def vocabulary(terms: DataFrame, params: TfidfParams, ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """``(term, df, tf, idx, idf)``: document-frequency limits, then the most frequent terms, or n-grams of the terms.

    Ties at the cut go to the alphabetically first term; indexes follow the alphabet.
    """
    n_docs = terms.count()
    kept = document_frequency(terms, ngram_range).filter(
        (F.col("df") >= params.min_df) & (F.col("df") <= params.max_df * n_docs)
    )
    idf = F.log((1.0 + n_docs) / (F.col("df") + 1.0)) + 1.0
    if params.max_features is None:  # all terms: a table that stays distributed
        ordered = numbered(materialise(kept, "terms").orderBy("term"), "idx")
        return ordered.select("term", "df", "tf", F.col("idx").cast("int").alias("idx"), idf.alias("idf"))
    chosen = settle(kept.orderBy(F.desc("tf"), "term").limit(params.max_features), params.max_features)
    order = Window.partitionBy(F.lit(0)).orderBy("term")
    return chosen.select("term", "df", "tf", (F.row_number().over(order) - 1).alias("idx"), idf.alias("idf"))


@dataclass
class TfidfModel:
    """Vocabulary with idf; turns cleaned text into L2-normalised sparse vectors."""

    terms: list[str]
    idf: np.ndarray
    params: TfidfParams
    use_idf: bool = True

    @classmethod
    def fit(cls, df: DataFrame, input_col: str, params: TfidfParams = TfidfParams(), id_col: str = "doc_id",
            use_idf: bool = True) -> TfidfModel:
        if params.max_features is None:
            raise ValueError("a model that tasks carry needs max_features; use bag_of_words and vocabulary for all terms")
        rows = vocabulary(terms_of(df, input_col, id_col), params, params.ngram_range).orderBy("idx").toPandas()
        if rows.empty:
            raise ValueError("no term passes the document-frequency limits")
        return cls(rows["term"].tolist(), rows["idf"].to_numpy(), params, use_idf)

    @property
    def size(self) -> int:
        return len(self.terms)

    def table(self, spark: SparkSession) -> DataFrame:
        return local_table(
            spark, {"idx": list(range(self.size)), "term": self.terms, "idf": self.idf.tolist()}
        )

    def transform(
        self, df: DataFrame, input_col: str, output_col: str = "tfidf", id_col: str = "doc_id", keep: Sequence[str] = ()
    ) -> DataFrame:
        """``(id, vector)``; a document without known terms gets the zero vector."""
        terms = terms_of(df, input_col, id_col, self.params.ngram_range, keep)
        counts = CountVectorizerModel.from_vocabulary(self.terms, inputCol="terms", outputCol="_counts")
        counted = counts.transform(terms)
        if not self.use_idf:
            return counted.select(id_col, *keep, F.col("_counts").alias(output_col))
        weigh = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_weighted")
        unit = Normalizer(p=2.0, inputCol="_weighted", outputCol=output_col)
        return unit.transform(weigh.transform(counted)).select(id_col, *keep, output_col)

    def save(self, spark: SparkSession, path: str) -> None:
        p = self.params
        self.table(spark).withColumn(
            "params", F.lit(f"{p.max_features}|{p.min_df}|{p.max_df}|{p.ngram_range[0]}|{p.ngram_range[1]}|{int(self.use_idf)}")
        ).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfModel:
        rows = spark.read.parquet(path).orderBy("idx").toPandas()
        features, min_df, max_df, low, high, use_idf = rows["params"].iloc[0].split("|")
        params = TfidfParams(
            None if features == "None" else int(features), int(min_df), float(max_df), (int(low), int(high))
        )
        return cls(rows["term"].tolist(), rows["idf"].to_numpy(), params, use_idf == "1")


def sparse_entries(vectors: DataFrame, vector_col: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, idx, value)`` for the stored entries of sparse vectors."""
    raw = vectors.select(id_col, F.unwrap_udt(vector_col).alias("v"))
    return raw.select(id_col, F.explode(F.arrays_zip("v.indices", "v.values")).alias("e")).select(
        id_col, F.col("e.indices").alias("idx"), F.col("e.values").alias("value")
    )


def tfidf_entries(model: TfidfModel, df: DataFrame, input_col: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, term, weight)`` view of the vectors."""
    entries = sparse_entries(model.transform(df, input_col, "v", id_col), "v", id_col)
    return entries.join(model.table(df.sparkSession), "idx").select(
        id_col, "term", F.col("value").alias("weight")
    )
