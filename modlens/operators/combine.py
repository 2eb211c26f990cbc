"""Feature families, their combination by document id, and the column layout.

A fitted family is applied unchanged to training and new text.  Row-local families are chained in one
projection, so the text is read once; the others are joined by id.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modlens.functions.text import CleanOptions, clean_columns
from modlens.operators import embed as E
from modlens.operators.family_stages import (
    CLEAN,
    RAW,
    SCALARS,
    CleanText,
    EmbeddingStage,
    FamilyStage,
    ScalarStage,
    TfidfStage,
    TopicStage,
    split_tokens,
)
from modlens.operators.topics import TopicModel, TopicParams
from modlens.operators.vectorize import TfidfModel, TfidfParams
from modlens.sources.tables import local_table, materialise


@dataclass
class Fitted:
    """A family ready to be applied: ``apply(df, id_col, keep)`` adds ``columns``. With a ``stage`` it can be saved."""

    columns: list[str]
    size: int
    apply: Callable[[DataFrame, str, Sequence[str]], DataFrame]
    row_local: bool = False
    input_col: str = CLEAN
    stage: FamilyStage | None = None

    @classmethod
    def of(cls, stage: FamilyStage) -> Fitted:
        return cls(stage.columns, stage.size, stage.apply, stage.row_local, stage.input_col, stage)


@dataclass
class Family:
    """How to fit a family on a table with raw and cleaned text."""

    fit: Callable[[DataFrame, str], Fitted]
    input_col: str = CLEAN


@dataclass(frozen=True)
class FeatureConfig:
    tfidf: TfidfParams = TfidfParams()
    word2vec: E.Word2VecParams = E.Word2VecParams()
    doc2vec: E.FactorParams = E.FactorParams()
    fasttext: E.SubwordParams = E.SubwordParams()
    topic: TopicParams = TopicParams()
    clean: CleanOptions = CleanOptions()
    lexical_input: str = RAW
    pos_input: str = CLEAN
    skip_failing: bool = False
    include: tuple[str, ...] = (
        "tfidf", "word2vec", "doc2vec", "fasttext", "lexical", "pos", "readability", "sentiment", "topic",
    )


SCALAR_FAMILIES = ("lexical", "pos", "readability", "sentiment")


def _scalar(name: str, input_col: str) -> Family:
    return Family(lambda df, id_col: Fitted.of(ScalarStage(name, input_col, id_col)), input_col)


def _embedding(cls, params, name) -> Family:
    def fit(df: DataFrame, id_col: str) -> Fitted:
        tokens = split_tokens(df, CLEAN, id_col)
        model = cls.fit(tokens, "tokens", params) if cls is not E.FactorEmbedding else cls.fit(tokens, "tokens", params, id_col)
        return Fitted.of(EmbeddingStage.fitted(name, model, params, id_col))

    return Family(fit)


def default_families(config: FeatureConfig) -> dict[str, Family]:
    """All families in the order of the combined columns."""

    def tfidf(df: DataFrame, id_col: str) -> Fitted:
        return Fitted.of(TfidfStage.of("tfidf", TfidfModel.fit(df, CLEAN, config.tfidf, id_col), id_col))

    def topic(df: DataFrame, id_col: str) -> Fitted:
        model = TopicModel.fit(df, CLEAN, config.topic, id_col)
        return Fitted.of(TopicStage.of("topic", model, id_col, json.dumps(asdict(config.topic))))

    return {
        "tfidf": Family(tfidf),
        "word2vec": _embedding(E.WordEmbedding, config.word2vec, "word2vec"),
        "doc2vec": _embedding(E.FactorEmbedding, config.doc2vec, "doc2vec"),
        "fasttext": _embedding(E.SubwordEmbedding, config.fasttext, "fasttext"),
        "lexical": _scalar("lexical", config.lexical_input),
        "pos": _scalar("pos", config.pos_input),
        "readability": _scalar("readability", RAW),
        "sentiment": _scalar("sentiment", RAW),
        "topic": Family(topic),
    }


def layout(spark: SparkSession, sizes: Sequence[tuple[str, int]]) -> DataFrame:
    """``(family, start, end, size)``: running offsets in family order."""
    table = local_table(
        spark, {"pos": list(range(len(sizes))), "family": [s[0] for s in sizes], "size": [s[1] for s in sizes]}
    )
    upto = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("pos"))
    return table.select("family", (upto - F.col("size")).alias("start"), upto.alias("end"), "size")


@dataclass
class FeatureModel:
    """Fitted families in a fixed order; one layout serves training and new text."""

    config: FeatureConfig
    families: dict[str, Fitted]
    skipped: dict[str, str] = field(default_factory=dict)

    def prepare(self, df: DataFrame, text_col: str, id_col: str) -> DataFrame:
        return with_clean(df, text_col, id_col, self.config.clean)

    def columns(self, df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
        """All family columns (scalars and vectors) by id."""
        base = self.prepare(df, text_col, id_col)
        joined = [f for f in self.families.values() if not f.row_local]
        chained = any(f.row_local and f.input_col == CLEAN for f in self.families.values())
        if chained + sum(f.input_col == CLEAN for f in joined) > 1:
            base = materialise(base, "clean")  # several branches read the cleaned text
        source = base
        keep = [RAW, CLEAN]
        for f in (f for f in self.families.values() if f.row_local):
            base = f.apply(base, id_col, keep)
            keep += f.columns
        out = base.select(id_col, *keep[2:])
        for f in joined:
            out = out.join(f.apply(source, id_col, []), id_col, "left")
        return out.select(id_col, *[c for f in self.families.values() for c in f.columns])

    def transform(self, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", output_col: str = "features") -> DataFrame:
        """``(id, features)``: one vector in layout order."""
        if not self.families:
            raise ValueError("not fitted")
        inputs = [c for f in self.families.values() for c in f.columns]
        assembler = VectorAssembler(inputCols=inputs, outputCol=output_col)
        return assembler.transform(self.columns(df, text_col, id_col)).select(id_col, output_col)

    def pipeline(self, text_col: str = "text", id_col: str = "doc_id", output_col: str = "features") -> PipelineModel:
        """The same as a pipeline of stages, to be saved alone or with a classifier behind it."""
        unsaved = [name for name, f in self.families.items() if f.stage is None]
        if unsaved:
            raise ValueError(f"families without a stage cannot be part of a pipeline: {unsaved}")
        stages = [f.stage for f in self.families.values()]
        # Row-local families first: they are one projection, which the joins of the others then read.
        ordered = sorted(stages, key=lambda s: not s.row_local)
        branches = sum(not s.row_local for s in stages)
        options = json.dumps(asdict(self.config.clean))
        inputs = [c for s in stages for c in s.columns]
        return PipelineModel([
            CleanText(text_col, id_col, options, store=branches > 0), *ordered,
            VectorAssembler(inputCols=inputs, outputCol=output_col),
        ])

    def save(self, path: str, text_col: str = "text", id_col: str = "doc_id") -> None:
        """Configuration, order of the families and their fitted state; ``load`` gives the same model back."""
        spark = SparkSession.getActiveSession()
        self.pipeline(text_col, id_col).write().overwrite().save(f"{path}/pipeline")
        head = {"config": [config_json(self.config)], "families": [json.dumps(list(self.families))], "skipped": [json.dumps(self.skipped)]}
        local_table(spark, head).write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        head = spark.read.parquet(f"{path}/head").first()
        stages = PipelineModel.load(f"{path}/pipeline").stages
        found = {s.family: Fitted.of(s) for s in stages if isinstance(s, FamilyStage)}
        order = json.loads(head["families"])
        return cls(config_of_json(head["config"]), {name: found[name] for name in order}, json.loads(head["skipped"]))

    def layout(self, spark: SparkSession) -> DataFrame:
        return layout(spark, [(name, f.size) for name, f in self.families.items()])

    def names(self) -> list[str]:
        """``FAMILY_i`` with i from 1."""
        return [f"{name}_{i}" for name, f in self.families.items() for i in range(1, f.size + 1)]

    def info(self, features: DataFrame, vector_col: str = "features", id_col: str = "doc_id") -> DataFrame:
        """Layout with row count and the first five values of the first document."""
        n = features.count()
        first = features.orderBy(id_col).limit(1).select(vector_to_array(vector_col).alias("v")).first()
        spark = features.sparkSession
        table = self.layout(spark)
        values = F.array(*[F.lit(float(x)) for x in (first["v"] if first else [])])
        sample = F.slice(values, F.col("start").cast("int") + 1, F.least(F.lit(5), F.col("size").cast("int")))
        return table.withColumn("rows", F.lit(n)).withColumn("sample", sample)


def config_json(config: FeatureConfig) -> str:
    return json.dumps(asdict(config))


def config_of_json(text: str) -> FeatureConfig:
    kinds = {
        "tfidf": TfidfParams, "word2vec": E.Word2VecParams, "doc2vec": E.FactorParams, "fasttext": E.SubwordParams,
        "topic": TopicParams, "clean": CleanOptions,
    }
    whole = lambda v: tuple(v) if isinstance(v, list) else v
    values = json.loads(text)
    nested = {k: kind(**{n: whole(v) for n, v in values.pop(k).items()}) for k, kind in kinds.items()}
    return FeatureConfig(**nested, **{k: whole(v) for k, v in values.items()})


def scoring_pipeline(features: FeatureModel, classifier: PipelineModel, text_col: str = "text", id_col: str = "doc_id") -> PipelineModel:
    """Cleaning, families and classifier in one pipeline: text in, score out."""
    return PipelineModel([*features.pipeline(text_col, id_col).stages, *classifier.stages])


def with_clean(df: DataFrame, text_col: str, id_col: str, options: CleanOptions = CleanOptions()) -> DataFrame:
    return clean_columns(df.select(id_col, F.col(text_col).alias(RAW)), RAW, CLEAN, id_col, options)


class FeatureExtractor:
    """Fits the chosen families; ``register`` adds a family of one's own."""

    def __init__(self, config: FeatureConfig = FeatureConfig()):
        self.config = config
        self.families = default_families(config)

    def register(self, name: str, family: Family) -> None:
        self.families[name] = family

    def fit(self, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", include: Sequence[str] | None = None) -> FeatureModel:
        chosen = [n for n in self.families if n in (include if include is not None else (*self.config.include, *self._own()))]
        if not chosen:
            raise ValueError("no feature family is switched on")
        base = with_clean(df, text_col, id_col, self.config.clean)
        if any(n not in SCALAR_FAMILIES for n in chosen):
            base = materialise(base, "clean")  # fitting scans the cleaned text again and again
        fitted, skipped = {}, {}
        for name in chosen:
            try:
                fitted[name] = self.families[name].fit(base, id_col)
            except Exception as error:
                if not self.config.skip_failing:
                    raise
                skipped[name] = str(error)
        if not fitted:
            raise ValueError(f"every feature family failed: {skipped}")
        return FeatureModel(self.config, fitted, skipped)

    def _own(self) -> list[str]:
        return [n for n in self.families if n not in default_families(self.config)]


def scalar_features(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", config: FeatureConfig = FeatureConfig(),
                    families: Sequence[str] = SCALAR_FAMILIES) -> DataFrame:
    """The families that need no fitting, as plain columns."""
    extractor = FeatureExtractor(config)
    return extractor.fit(df, text_col, id_col, families).columns(df, text_col, id_col)


def scalar_columns(families: Sequence[str] = SCALAR_FAMILIES) -> list[str]:
    return [c for f in families for c in SCALARS[f][0]]
