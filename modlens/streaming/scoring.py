"""Scoring of a stream of documents: the batch expressions on ``readStream``.

``start_scoring`` uses row-local features only, so the query keeps no state and needs no watermark.
``start_pipeline_scoring`` scores with a fitted pipeline whose families look words up in tables: every micro-batch is
joined with the static tables and written to a folder of its own, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from modlens.functions.scores import LEXICAL, READABILITY, lexical_features, readability_features
from modlens.operators.models import score
from modlens.operators.sentiment import lexicon_hits
from modlens.sources.tables import is_folder

STREAM_FEATURES = [*LEXICAL, *READABILITY, "hits"]


def stream_features(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Row-local features of batch or streaming documents."""
    rows = lexical_features(df.select(id_col, text_col), text_col, id_col, [text_col])
    rows = readability_features(rows, text_col, id_col, [text_col, *LEXICAL])
    return rows.withColumn("hits", lexicon_hits(F.col(text_col))).drop(text_col)


def score_documents(df: DataFrame, model: PipelineModel, text_col: str = "text", id_col: str = "doc_id",
                    threshold: float = 0.5) -> DataFrame:
    """``(id, p, flagged)`` for batch or streaming documents."""
    vec = VectorAssembler(inputCols=STREAM_FEATURES, outputCol="features")
    rows = vec.transform(stream_features(df, text_col, id_col)).select(id_col, "features")
    return score(model, rows, id_col).withColumn("flagged", (F.col("p") >= threshold).cast("int"))


def read_documents(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """The parquet table at ``path`` as a stream, whether it is one file or a folder of part files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if not is_folder(spark, path):
        folder, _, name = path.rstrip("/").rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def start_scoring(stream: DataFrame, model: PipelineModel, output: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Score into parquet files; ``once`` processes what is there and stops. The documents of a micro-batch are dealt to all
    slots: its files are few, and may hold one row group each."""
    dealt = stream.repartition(stream.sparkSession.sparkContext.defaultParallelism)
    writer = (
        score_documents(dealt, model, **options)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def start_pipeline_scoring(stream: DataFrame, pipeline: PipelineModel, output: str, checkpoint: str, id_col: str = "doc_id",
                           once: bool = True) -> StreamingQuery:
    """Score documents with cleaning, fitted families and classifier into ``output/batch=N``."""

    def scored(batch: DataFrame, number: int) -> None:
        score(pipeline, batch, id_col).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = stream.writeStream.foreachBatch(scored).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
