"""Metrics over probability or logit arrays with an integer class label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.functions.features import first_argmax, softmax
from evalframe.metrics import binary


def auroc_per_class(df: DataFrame, label: str, probs: str, keys: list[str]) -> DataFrame:
    """One-vs-rest AUROC of each class, with its number of rows (``pos``)."""
    exploded = df.select(*keys, F.col(label).alias("_label"), F.posexplode(probs).alias("class", "_p"))
    hit = exploded.withColumn("_y", (F.col("_label") == F.col("class")).cast("int"))
    return binary.scores(hit, "_y", "_p", [*keys, "class"], ["roc_auc"], counts=True)


def auroc_weighted(df: DataFrame, label: str, probs: str, keys: list[str] | None = None) -> DataFrame:
    """Prevalence-weighted one-vs-rest AUROC; NaN unless every class occurs."""
    keys = list(keys or [])
    per_class = auroc_per_class(df, label, probs, keys)
    complete = F.count_if(F.col("pos") > 0) == F.count("*")
    weighted = F.sum(F.col("roc_auc") * F.col("pos")) / F.sum("pos")
    return per_class.groupBy(*keys).agg(F.when(complete, weighted).otherwise(F.lit(binary.NAN)).alias("roc_auc"))


def accuracy(df: DataFrame, label: str, probs: str, keys: list[str] | None = None) -> DataFrame:
    """Share of rows whose first maximum is the label."""
    hit = (first_argmax(F.col(probs)) == F.col(label)).cast("double")
    return df.groupBy(*(keys or [])).agg(F.avg(hit).alias("accuracy"))


def metrics_from_logits(df: DataFrame, label: str, logits: str, keys: list[str] | None = None) -> DataFrame:
    """The original-task report: softmax, then accuracy and multiclass AUROC."""
    keys = list(keys or [])
    probs = df.select(*keys, label, softmax(F.col(logits)).alias("_probs"))
    decided = accuracy(probs, label, "_probs", keys)
    ranked = auroc_weighted(probs, label, "_probs", keys)
    if keys:
        return decided.join(ranked, keys)
    return decided.withColumn("roc_auc", ranked.scalar())


def binary_metrics_from_logits(
    df: DataFrame, label: str, logits: str, keys: list[str] | None = None, metrics: list[str] | None = None
) -> DataFrame:
    """Two logits: keep P(class 1), then the binary metrics."""
    p = F.element_at(softmax(F.col(logits)), 2)
    return binary.scores(df.withColumn("_p1", p), label, "_p1", keys, metrics)


# Registry of what takes (df, label, probs, keys) with an array of class probabilities.
METRICS = {"accuracy": accuracy, "roc_auc_multiclass": auroc_weighted}
