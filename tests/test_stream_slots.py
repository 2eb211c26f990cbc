"""A stream of one file is scored in all slots."""

from __future__ import annotations

from modlens.operators import models
from modlens.streaming import scoring


def test_one_file_is_dealt_to_all_slots(spark, make, tmp_path):
    docs = make([(i, f"Text number {i}. It is {'bad' if i % 2 else 'good'}!") for i in range(64)], "doc_id bigint, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    rows = scoring.stream_features(docs).selectExpr("*", "cast(doc_id % 2 as int) AS toxic")
    model = models.logistic(models.assemble(rows, scoring.STREAM_FEATURES, "toxic"), max_iter=2)
    stream = scoring.read_documents(spark, str(tmp_path / "docs"), docs.schema)
    scoring.start_scoring(stream, model, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    scored = spark.read.parquet(str(tmp_path / "out"))
    assert len(scored.inputFiles()) == spark.sparkContext.defaultParallelism
    assert sorted(r["doc_id"] for r in scored.collect()) == list(range(64))
