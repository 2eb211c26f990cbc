"""Fitted feature families as Spark ML transformers that are saved and loaded with their pipeline.

A stage has parameters and, if it was fitted, a state: a vocabulary, a topic model, tables of vectors. Its writer puts
the parameters next to the state, its reader gives the same stage back, so a pipeline of families, assembler and
classifier is saved as one and scores batches and streams.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.ml import Transformer
from pyspark.ml.clustering import LocalLDAModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.functions import scores as S
from modlens.functions.text import CleanOptions, clean_columns
from modlens.operators import embed as E
from modlens.operators.pos import POS, pos_features
from modlens.operators.sentiment import SENTIMENT, sentiment_features
from modlens.operators.topics import TopicModel, TopicParams
from modlens.operators.vectorize import TfidfModel
from modlens.sources.tables import materialise

RAW, CLEAN = "_raw", "_clean"


class CleanText(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Raw and cleaned text by id. ``store`` writes it once, for pipelines in which several branches read it."""

    textCol = Param(Params._dummy(), "textCol", "text column", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "id column", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "json of the cleaning switches", TypeConverters.toString)
    store = Param(Params._dummy(), "store", "write the cleaned text once", TypeConverters.toBoolean)

    def __init__(self, textCol="text", idCol="doc_id", options="{}", store=False):
        super().__init__()
        self._set(textCol=textCol, idCol=idCol, options=options, store=store)

    def _transform(self, df: DataFrame) -> DataFrame:
        options = CleanOptions(**{
            k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(self.getOrDefault(self.options)).items()
        })
        text, id_col = self.getOrDefault(self.textCol), self.getOrDefault(self.idCol)
        extra = [c for c in df.columns if c not in (text, id_col)]
        rows = clean_columns(df.select(id_col, *extra, F.col(text).alias(RAW)), RAW, CLEAN, id_col, options)
        return materialise(rows, "clean") if self.getOrDefault(self.store) and not df.isStreaming else rows


class FamilyStage(Transformer, HasInputCol):
    """A family: ``apply(df, id_col, keep)`` adds its columns to raw and cleaned text."""

    name = Param(Params._dummy(), "name", "family", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "id column", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "json of the family's parameters", TypeConverters.toString)

    row_local = True

    def __init__(self, name: str = "", input_col: str = CLEAN, id_col: str = "doc_id", settings: str = "{}"):
        super().__init__()
        self._set(name=name, inputCol=input_col, idCol=id_col, settings=settings)

    @property
    def family(self) -> str:
        return self.getOrDefault(self.name)

    @property
    def input_col(self) -> str:
        return self.getInputCol()

    @property
    def columns(self) -> list[str]:
        return [self.family]

    @property
    def size(self) -> int:
        raise NotImplementedError

    def apply(self, df: DataFrame, id_col: str, keep: Sequence[str]) -> DataFrame:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        id_col = self.getOrDefault(self.idCol)
        if self.row_local:
            return self.apply(df, id_col, [c for c in df.columns if c != id_col])
        return df.join(self.apply(df, id_col, []), id_col, "left")


class StateWriter(MLWriter):
    def __init__(self, stage: StateStage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.save_state(self.sparkSession, f"{path}/state")


class StateReader(MLReader):
    def __init__(self, cls: type[StateStage]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> StateStage:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage.load_state(self.sparkSession, f"{path}/state")
        return stage


class StateStage(FamilyStage, MLWritable, MLReadable):
    """A family with a fitted state."""

    model = None

    @classmethod
    def of(cls, name: str, model, id_col: str, settings: str = "{}") -> StateStage:
        stage = cls(name, CLEAN, id_col, settings)
        stage.model = model
        return stage

    def write(self) -> StateWriter:
        return StateWriter(self)

    @classmethod
    def read(cls) -> StateReader:
        return StateReader(cls)

    def copy(self, extra=None):
        other = super().copy(extra)
        other.model = self.model
        return other

    def save_state(self, spark: SparkSession, path: str) -> None:
        raise NotImplementedError

    def load_state(self, spark: SparkSession, path: str) -> None:
        raise NotImplementedError


class TfidfStage(StateStage):
    @property
    def size(self) -> int:
        return self.model.size

    def apply(self, df: DataFrame, id_col: str, keep: Sequence[str]) -> DataFrame:
        return self.model.transform(df, self.input_col, self.family, id_col, keep)

    def save_state(self, spark: SparkSession, path: str) -> None:
        self.model.save(spark, path)

    def load_state(self, spark: SparkSession, path: str) -> None:
        self.model = TfidfModel.load(spark, path)


class TopicStage(StateStage):
    """The topic model with the vocabulary that it was fitted on."""

    @property
    def size(self) -> int:
        return self.model.params.n_topics

    def apply(self, df: DataFrame, id_col: str, keep: Sequence[str]) -> DataFrame:
        out = self.model.transform(df, self.input_col, id_col, keep)
        return out.select(id_col, *keep, array_to_vector("topics").alias(self.family))

    def save_state(self, spark: SparkSession, path: str) -> None:
        self.model.vocabulary.save(spark, f"{path}/vocabulary")
        self.model.lda.write().overwrite().save(f"{path}/lda")

    def load_state(self, spark: SparkSession, path: str) -> None:
        params = TopicParams(**json.loads(self.getOrDefault(self.settings)))
        lda = LocalLDAModel.load(f"{path}/lda")
        self.model = TopicModel(TfidfModel.load(spark, f"{path}/vocabulary"), lda, params)


def split_tokens(df: DataFrame, input_col: str, id_col: str) -> DataFrame:
    return df.select(id_col, F.filter(F.split(input_col, " "), lambda t: t != "").alias("tokens"))


EMBEDDINGS = {
    "WordEmbedding": (E.WordEmbedding, E.Word2VecParams),
    "FactorEmbedding": (E.FactorEmbedding, E.FactorParams),
    "SubwordEmbedding": (E.SubwordEmbedding, E.SubwordParams),
}


class EmbeddingStage(StateStage):
    """Document vectors from tables of vectors. The tables stay tables: they are joined, never collected."""

    row_local = False

    @property
    def size(self) -> int:
        return json.loads(self.getOrDefault(self.settings))["vector_size"]

    @classmethod
    def fitted(cls, name: str, model, params, id_col: str) -> EmbeddingStage:
        return cls.of(name, model, id_col, json.dumps({"kind": type(model).__name__, **asdict(params)}))

    def apply(self, df: DataFrame, id_col: str, keep: Sequence[str]) -> DataFrame:
        out = self.model.transform(split_tokens(df, self.input_col, id_col), "tokens", id_col)
        return out.select(id_col, array_to_vector("embedding").alias(self.family))

    def save_state(self, spark: SparkSession, path: str) -> None:
        for table, rows in self.model.tables().items():
            rows.write.mode("overwrite").parquet(f"{path}/{table}")

    def load_state(self, spark: SparkSession, path: str) -> None:
        settings = json.loads(self.getOrDefault(self.settings))
        cls, params = EMBEDDINGS[settings.pop("kind")]
        self.model = cls.of_tables(lambda table: spark.read.parquet(f"{path}/{table}"), params(**settings))


SCALARS = {
    "lexical": (S.LEXICAL, S.lexical_features, True),
    "pos": ([f"pos_{c}" for c in POS], pos_features, True),
    "readability": (S.READABILITY, S.readability_features, True),
    "sentiment": (SENTIMENT, sentiment_features, False),
}


class ScalarStage(FamilyStage, DefaultParamsReadable, DefaultParamsWritable):
    """A family of plain numbers, which needs no fitting."""

    @property
    def columns(self) -> list[str]:
        return list(SCALARS[self.family][0])

    @property
    def size(self) -> int:
        return len(self.columns)

    @property
    def row_local(self) -> bool:
        return SCALARS[self.family][2]

    def apply(self, df: DataFrame, id_col: str, keep: Sequence[str]) -> DataFrame:
        function = SCALARS[self.family][1]
        return function(df, self.input_col, id_col, keep) if self.row_local else function(df, self.input_col, id_col)
