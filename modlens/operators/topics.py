"""Topic shares: unigram TF-IDF, then latent Dirichlet allocation on the sparse vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.operators.vectorize import TfidfModel, TfidfParams
from modlens.sources.tables import materialise


@dataclass(frozen=True)
class TopicParams:
    n_topics: int = 10
    max_features: int = 5000
    max_iter: int = 10
    seed: int = 42
    sampling: float = 1.0  # share of the documents used per iteration


@dataclass
class TopicModel:
    """The topic model together with its own vocabulary."""

    vocabulary: TfidfModel
    lda: LDAModel
    params: TopicParams

    @classmethod
    def fit(cls, df: DataFrame, input_col: str, params: TopicParams = TopicParams(), id_col: str = "doc_id") -> TopicModel:
        terms = TfidfModel.fit(df, input_col, TfidfParams(params.max_features, 1, 1.0, (1, 1)), id_col)
        vectors = materialise(terms.transform(df, input_col, "features", id_col), "topic-input")
        lda = LDA(
            k=params.n_topics, maxIter=params.max_iter, seed=params.seed, optimizer="online",
            subsamplingRate=params.sampling,
        ).fit(vectors)
        return cls(terms, lda, params)

    def transform(self, df: DataFrame, input_col: str, id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
        """``(id, topics)``: shares that sum to one; documents without terms get equal shares."""
        vectors = self.vocabulary.transform(df, input_col, "features", id_col, keep)
        shares = vector_to_array("topicDistribution")
        total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
        even = F.array_repeat(F.lit(1.0 / self.params.n_topics), self.params.n_topics)
        return self.lda.transform(vectors).select(id_col, *keep, F.when(total > 0, shares).otherwise(even).alias("topics"))

    def top_terms(self, spark, n: int = 5) -> DataFrame:
        """``(topic, rank, term, weight)``."""
        described = self.lda.describeTopics(n).select(
            "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "t")
        )
        return described.join(self.vocabulary.table(spark), F.col("t.termIndices") == F.col("idx")).select(
            "topic", (F.col("pos") + 1).alias("rank"), "term", F.col("t.termWeights").alias("weight")
        )
