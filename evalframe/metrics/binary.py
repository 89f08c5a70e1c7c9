"""Metrics of a probability column against a 0/1 label, per group, in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.metrics import histogram as H
from evalframe.runtime import join_per_key, materialize

NAN = float("nan")


def _sums() -> tuple[Column, ...]:
    n, pos, tp, pp = (F.col(c) for c in ("n", "pos", "tp", "pp"))
    return n, pos, tp, pp


def _or_zero(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(0.0)


def accuracy() -> dict[str, Column]:
    n, pos, tp, pp = _sums()
    return {"accuracy": (n - pos - pp + 2 * tp) / n}


def precision() -> dict[str, Column]:
    _, _, tp, pp = _sums()
    return {"precision": _or_zero(tp, pp)}


def recall() -> dict[str, Column]:
    _, pos, tp, _ = _sums()
    return {"recall": _or_zero(tp, pos)}


def f1() -> dict[str, Column]:
    _, pos, tp, pp = _sums()
    return {"f1": _or_zero(2 * tp, pp + pos)}


def balanced_accuracy() -> dict[str, Column]:
    """Mean recall over the classes that occur."""
    n, pos, tp, pp = _sums()
    neg = n - pos
    recall_1, recall_0 = F.try_divide(tp, pos), F.try_divide(neg - pp + tp, neg)
    present = F.when((pos > 0) & (neg > 0), 2.0).otherwise(1.0)
    return {"balanced_accuracy": (F.coalesce(recall_1, F.lit(0.0)) + F.coalesce(recall_0, F.lit(0.0))) / present}


def roc_auc(single_class: float = NAN) -> dict[str, Column]:
    """Area under the ROC curve, ties counted half; ``single_class`` without both classes."""
    n, pos, _, _ = _sums()
    neg = n - pos
    return {"roc_auc": F.when((pos > 0) & (neg > 0), F.col("u") / (pos * neg)).otherwise(F.lit(single_class))}


def brier() -> dict[str, Column]:
    return {"bs": F.col("sq") / F.col("n")}


def brier_score() -> dict[str, Column]:
    """Brier score and its CORP parts: bs = bs_mcb - bs_dsc + bs_unc."""
    n, pos, _, _ = _sums()
    bs, iso, rate = F.col("sq") / n, F.col("iso") / n, pos / n
    unc = rate * (1 - rate)
    return {"bs": bs, "bs_mcb": bs - iso, "bs_dsc": unc - iso, "bs_unc": unc}


def confusion() -> dict[str, Column]:
    """Rows by label and decision: true and false negatives, false and true positives."""
    n, pos, tp, pp = _sums()
    return {"tn": n - pos - pp + tp, "fn": pos - tp, "fp": pp - tp, "tp": tp}


# Registry: extend it with functions returning named columns over the sums.
METRICS: dict[str, Callable[[], dict[str, Column]]] = {
    "accuracy": accuracy,
    "precision": precision,
    "recall": recall,
    "f1": f1,
    "roc_auc": roc_auc,
    "brier": brier,
    "brier_score": brier_score,
    "balanced_accuracy": balanced_accuracy,
    "confusion_matrix": confusion,
}
TEST_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "brier_score", "balanced_accuracy"]
NEEDS_RANKS = {"roc_auc"}
NEEDS_FIT = {"brier_score"}


def metric_columns(names: list[str]) -> list[str]:
    return [c for name in names for c in METRICS[name]()]


def scores(
    df: DataFrame,
    label: str,
    p: str,
    keys: list[str] | None = None,
    metrics: list[str] | None = None,
    single_class: float = NAN,
    counts: bool = False,
) -> DataFrame:
    """One row per group with the metrics asked for (``keys=[]``: one row for everything).

    ``counts`` adds ``n`` and ``pos``.
    """
    keys, names = list(keys or []), list(metrics or TEST_METRICS)
    unknown = [m for m in names if m not in METRICS]
    if unknown:
        raise KeyError(f"Unknown metrics: {unknown}")
    hist = H.histogram(df, label, p, keys)
    if NEEDS_FIT & set(names):
        sums = H.calibrated_totals(hist, keys)
    else:
        sums = H.totals(hist, keys, bool(NEEDS_RANKS & set(names)))
    columns: dict[str, Column] = {}
    for name in names:
        columns |= roc_auc(single_class) if name == "roc_auc" else METRICS[name]()
    extra = [F.col("n").cast("bigint").alias("n"), F.col("pos").cast("bigint").alias("pos")] if counts else []
    return sums.where("n > 0").select(*keys, *[c.alias(name) for name, c in columns.items()], *extra)


def confusion_matrix(df: DataFrame, label: str, p: str, keys: list[str] | None = None) -> DataFrame:
    """Counts by decision and label."""
    decided = df.select(*(keys or []), (F.col(p) > 0.5).cast("int").alias("prediction"), F.col(label).cast("int").alias("label"))
    return decided.groupBy(*(keys or []), "prediction", "label").agg(F.count("*").alias("n"))


def recalibrated(df: DataFrame, label: str, p: str, keys: list[str] | None = None, name: str = "p_iso") -> DataFrame:
    """Add the isotonic-recalibrated probability of each row.

    The fit of a group is looked up per (group, p): block values are carried
    forward inside each probability range of the histogram.
    """
    keys = list(keys or [])
    hist = H.histogram(df, label, p, keys)
    parts = materialize(H.cut_into_ranges(hist, keys), "ranged")
    blocks = H.isotonic_blocks(parts, keys, H.max_parts(df))
    value = F.least(F.greatest(F.col("pos") / F.col("n"), F.lit(0.0)), F.lit(1.0))
    starts = blocks.select(*keys, "part_lo", "p_lo", value.alias("_f"), F.explode(F.sequence("part_lo", "part_hi")).alias("_part"))
    starts = starts.select(
        *keys, "_part", F.when(F.col("_part") == F.col("part_lo"), F.col("p_lo")).otherwise(float("-inf")).alias("p"),
        "_f", F.lit(0).alias("_row"),
    )
    points = parts.select(*keys, "_part", "p", F.lit(None).cast("double").alias("_f"), F.lit(1).alias("_row"))
    order = Window.partitionBy(*keys, "_part").orderBy("p", "_row").rowsBetween(Window.unboundedPreceding, 0)
    fitted = starts.unionByName(points).withColumn("_f", F.last("_f", ignorenulls=True).over(order))
    fitted = fitted.where("_row = 1").select(*keys, F.col("p").alias("_p"), F.col("_f").alias(name))
    rows = df.withColumn("_p", F.col(p).cast("double"))
    return join_per_key(rows, fitted, [*keys, "_p"], "left").drop("_p")
