"""Evaluation tables for scored rows ``(model, doc_id, label, p)``.

Everything starts from one aggregation per model (and score value); curves run over range buckets,
so a model's scores are never sorted in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.operators.ranking import running_totals
from modlens.sources.tables import materialise

SWEEP = [(10 + 5 * i) / 100 for i in range(12)]
DEFAULT_THRESHOLD = 0.5


def div0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def outcome_counts(scores: DataFrame, threshold: Column | float = DEFAULT_THRESHOLD, by: str = "model") -> DataFrame:
    """``(model, tp, fp, fn, tn)`` at ``p >= threshold``."""
    hit, y = F.col("p") >= threshold, F.col("label")
    return scores.groupBy(by).agg(
        F.count_if(hit & (y == 1)).alias("tp"),
        F.count_if(hit & (y == 0)).alias("fp"),
        F.count_if(~hit & (y == 1)).alias("fn"),
        F.count_if(~hit & (y == 0)).alias("tn"),
    )


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return div0(tp * 2, tp * 2 + fp + fn)


def score_counts(scores: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score: equal scores collapse before any ordering."""
    return scores.groupBy("model", "p").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )


def cumulative_counts(scores: DataFrame) -> DataFrame:
    """Running totals by descending score.  The merged counts are written once: finding the range
    limits, the offsets and the totals takes three scans of them."""
    counts = materialise(score_counts(scores.filter("p is not null")), "score-counts", even=True)
    return running_totals(counts, "model", "p", ["pos", "neg"])


def roc_auc(scores: DataFrame) -> DataFrame:
    """Exact area under the ROC curve; ties count half.  Models without probabilities get null."""
    c = cumulative_counts(scores)
    area = F.sum(F.col("neg") * (F.col("pos_cum") - F.col("pos") / 2.0))
    auc = c.groupBy("model").agg(F.try_divide(area, F.max(F.col("pos_total") * F.col("neg_total"))).alias("roc_auc"))
    return scores.select("model").distinct().join(auc, "model", "left")


def eval_metrics(scores: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Accuracy, F1 and ROC-AUC per model."""
    c = outcome_counts(scores, threshold)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return (
        c.select("model", div0(tp + tn, tp + fp + fn + tn).alias("accuracy"), _f1(tp, fp, fn).alias("f1"))
        .join(roc_auc(scores), "model")
    )


def confusion(scores: DataFrame, threshold: Column | float = DEFAULT_THRESHOLD) -> DataFrame:
    """Full 2x2 grid with counts and row shares."""
    cells = F.array(
        *[
            F.struct(F.lit(y).alias("label"), F.lit(p).alias("pred"), F.col(n).alias("n"))
            for y, p, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        ]
    )
    counts = outcome_counts(scores, threshold)
    row = F.when(F.col("label") == 0, F.col("tn") + F.col("fp")).otherwise(F.col("fn") + F.col("tp"))
    return counts.select("*", F.inline(cells)).select(
        "model", "label", "pred", "n", div0(F.col("n"), row).alias("row_share")
    )


def report_from_counts(counts: DataFrame) -> DataFrame:
    """Classification report rows from per-model outcome counts."""
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    n0, n1 = tn + fp, tp + fn
    total = n0 + n1
    p0, r0, f0 = div0(tn, tn + fn), div0(tn, n0), _f1(tn, fn, fp)
    p1, r1, f1 = div0(tp, tp + fp), div0(tp, n1), _f1(tp, fp, fn)
    weighted = lambda a, b: div0(a * n0 + b * n1, total)
    accuracy = div0(tp + tn, total)
    rows = {
        "0": (p0, r0, f0, n0),
        "1": (p1, r1, f1, n1),
        "accuracy": (accuracy, accuracy, accuracy, total),
        "macro avg": ((p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, total),
        "weighted avg": (weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), total),
    }
    structs = [
        F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), n.alias("support")
        )
        for name, (p, r, f, n) in rows.items()
    ]
    return counts.select("model", F.inline(F.array(*structs)))


def class_report(scores: DataFrame, threshold: Column | float = DEFAULT_THRESHOLD) -> DataFrame:
    return report_from_counts(outcome_counts(scores, threshold))


def macro_scores(scores: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    report = class_report(scores, threshold)
    macro = report.filter("class = 'macro avg'").select("model", "f1", "precision", "recall")
    accuracy = report.filter("class = 'accuracy'").select("model", F.col("precision").alias("accuracy"))
    return macro.join(accuracy, "model")


def pr_curve(scores: DataFrame) -> DataFrame:
    """One point per distinct score, then the end point (precision 1, recall 0) without threshold."""
    c = cumulative_counts(scores)
    points = c.select(
        "model",
        F.col("p").alias("threshold"),
        div0(F.col("pos_cum"), F.col("pos_cum") + F.col("neg_cum")).alias("precision"),
        div0(F.col("pos_cum"), F.col("pos_total")).alias("recall"),
    )
    end = scores.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def roc_curve(scores: DataFrame) -> DataFrame:
    """All points of the curve, starting at the origin (no threshold)."""
    points = cumulative_counts(scores).select(
        "model",
        F.col("p").alias("threshold"),
        div0(F.col("neg_cum"), F.col("neg_total")).alias("fpr"),
        div0(F.col("pos_cum"), F.col("pos_total")).alias("tpr"),
    )
    start = scores.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def best_thresholds(scores: DataFrame) -> DataFrame:
    """Per model: the threshold of the largest F1, the lowest one on ties, 0.5 at the end point."""
    p, r = F.col("precision"), F.col("recall")
    points = pr_curve(scores).withColumn("f1", p * r * 2 / (p + r + 1e-9))
    best = points.groupBy("model").agg(
        F.max(F.struct(F.col("f1"), F.coalesce(-F.col("threshold"), F.lit(-float("inf"))).alias("neg"))).alias("b")
    )
    threshold = F.when(F.col("b.neg") == -float("inf"), DEFAULT_THRESHOLD).otherwise(-F.col("b.neg"))
    return best.select("model", (threshold + 0.0).alias("threshold"), F.col("b.f1").alias("f1"))


def best_overall(scores: DataFrame) -> DataFrame:
    """The best (model, threshold) pair, the first model by name on ties."""
    return best_thresholds(scores).orderBy(F.desc("f1"), "model").limit(1)


def errors_at(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """False positives and negatives at each model's own threshold."""
    joined = scores.join(thresholds.select("model", "threshold"), "model")
    hit, y = F.col("p") >= F.col("threshold"), F.col("label")
    return joined.groupBy("model").agg(
        F.max("threshold").alias("threshold"),
        F.count_if(hit & (y == 0)).alias("false_positives"),
        F.count_if(~hit & (y == 1)).alias("false_negatives"),
    )


def threshold_sweep(scores: DataFrame, thresholds: Sequence[float] = tuple(SWEEP)) -> DataFrame:
    """F1, precision, recall and errors at fixed thresholds, from one count per threshold band."""
    lits = F.array(*[F.lit(t) for t in thresholds])
    band = F.size(F.filter(lits, lambda t: F.col("p") >= t))
    banded = scores.withColumn("band", band).groupBy("model", "band").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    at = banded.select("*", F.posexplode(lits).alias("i", "threshold"))
    above = F.col("band") > F.col("i")
    counts = at.groupBy("model", "threshold").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "model",
        "threshold",
        _f1(tp, fp, fn).alias("f1"),
        div0(tp, tp + fp).alias("precision"),
        div0(tp, tp + fn).alias("recall"),
        fp.alias("false_positives"),
        fn.alias("false_negatives"),
    )


def sweep_optima(sweep: DataFrame) -> DataFrame:
    """Threshold of the best F1, of the best balanced errors, and the smallest one; first wins."""
    gap = F.abs(F.col("false_positives") - F.col("false_negatives"))
    return sweep.groupBy("model").agg(
        (-F.max(F.struct("f1", (-F.col("threshold")).alias("t")))["t"]).alias("best_f1_threshold"),
        F.min(F.struct(gap.alias("gap"), "threshold"))["threshold"].alias("balanced_threshold"),
        F.min("threshold").alias("min_threshold"),
    )


def best_model(metrics: DataFrame, preferred: str | None = None) -> DataFrame:
    """Model of the largest F1, unless a preferred one is among them."""
    first = F.coalesce(F.col("model") == F.lit(preferred).cast("string"), F.lit(False))
    return metrics.orderBy(F.desc(first), F.desc("f1"), "model").limit(1).select("model", "f1")


def metrics_long(metrics: DataFrame) -> DataFrame:
    """``(model, metric, value)`` with readable names; missing values are left out."""
    named = metrics.select(
        F.initcap(F.replace(F.col("model"), F.lit("_"), F.lit(" "))).alias("model"),
        F.col("accuracy").alias("Accuracy"),
        F.col("f1").alias("F1 Score"),
        F.col("roc_auc").alias("ROC AUC"),
    )
    return named.unpivot("model", ["Accuracy", "F1 Score", "ROC AUC"], "metric", "value").filter("value is not null")


def top_importances(importances: DataFrame, n: int = 20) -> DataFrame:
    """Largest importances per model; the rank limit is applied before the shuffle."""
    w = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    return importances.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def effective_threshold(given: float | None, optimised: float | None) -> float:
    """A given threshold wins over the optimised one; the default stands in for both."""
    return next((t for t in (given, optimised) if t is not None), DEFAULT_THRESHOLD)


def sample_predictions(examples: DataFrame, scores: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Text, predicted class at the threshold, probability and actual class."""
    named = lambda c: F.when(c, "Toxic").otherwise("Non-toxic")
    return examples.join(scores.select("doc_id", "model", "p"), "doc_id").select(
        "doc_id",
        "model",
        "text",
        named(F.col("p") >= threshold).alias("predicted"),
        "p",
        named(F.col("label") == 1).alias("actual"),
    )


def performance_at(scores: DataFrame, threshold: float) -> DataFrame:
    """Report at a tuned threshold next to the accuracy at the default cut."""
    report = class_report(scores, threshold)
    c = outcome_counts(scores, DEFAULT_THRESHOLD)
    default = c.select(
        "model",
        div0(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("default_accuracy"),
    )
    return report.join(default, "model")
