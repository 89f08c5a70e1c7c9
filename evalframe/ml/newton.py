"""Assessors on a few dense features, fitted by Newton steps that are sums over rows.

One step is one aggregation: every group (a task, a setting, or everything) sums its own
gradient and Hessian, whatever its size; the row of sums per group then solves its own small
system of equations. Nothing is gathered and nothing is random, so SQL can say the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.operators.quality import binary_label
from evalframe.runtime import join_null_safe, materialize, ship_by_value

ship_by_value(__name__)

STEPS = 8
RIDGE = 0.001
EVERYTHING = "all_rows"


def _weights(n: int) -> list[str]:
    return [f"w{j}" for j in range(n)]


def _probability(features: list[Column]) -> Column:
    """The logistic function of the weighted features; weights are columns ``w0`` (the intercept) to ``wd``."""
    margin = F.col("w0")
    for j, x in enumerate(features, 1):
        margin = margin + F.col(f"w{j}") * x
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _stepped(n: int):
    """Take the Newton step of every group: w -= H^-1 g, with g in ``g_i`` and the lower half of H in ``h_i_j``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            h = np.stack([np.stack([number(f"h_{max(i, j)}_{min(i, j)}") for j in range(n)], -1) for i in range(n)], 1)
            step = np.linalg.solve(h, np.stack([number(f"g_{i}") for i in range(n)], -1)[..., None])[..., 0]
            keys = [c for c in batch.schema.names if c[:2] not in ("g_", "h_") and c not in _weights(n)]
            weights = [pa.array(number(w) - step[:, i]) for i, w in enumerate(_weights(n))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *weights], names=[*keys, *_weights(n)])

    return rows


def _grouped(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn(EVERYTHING, F.lit(0)), [EVERYTHING])


def fit(
    train: DataFrame,
    features: dict[str, str],
    keys: list[str] | None = None,
    label: str = "correct",
    steps: int = STEPS,
    ridge: float = RIDGE,
) -> DataFrame:
    """A model per group of ``keys`` (one without): a stored table (keys…, w0, w1, …).

    ``features`` maps a name to a SQL expression; a NULL feature counts as 0, and rows without a
    binary label take no part. Minimised is the mean log-loss plus ridge / 2 times the squared weights,
    the intercept's included, so that a group of one class has finite weights. Features
    should be of a size around 1. A group of NULL keys is a group like any other.
    """
    rows, keys = _grouped(train.where(binary_label(label)), list(keys or []))
    columns = [f"x{j}" for j in range(1, len(features) + 1)]
    values = [F.coalesce(F.expr(e).cast("double"), F.lit(0.0)).alias(x) for x, e in zip(columns, features.values())]
    rows = materialize(rows.select(*keys, F.col(label).cast("double").alias("y"), *values), "features")
    n = len(columns) + 1
    weights = materialize(rows.select(*keys).distinct().withColumns({w: F.lit(0.0) for w in _weights(n)}), "weights")
    x = [F.lit(1.0), *map(F.col, columns)]
    for _ in range(steps):
        scored = join_null_safe(rows, weights, keys).withColumn("p", _probability(x[1:]))
        curvature = F.col("p") * (1 - F.col("p"))
        mean = lambda value: F.sum(value) / F.count("*")  # noqa: E731  no value is NULL, so all means share one count
        sums = scored.groupBy(*keys, *_weights(n)).agg(
            *[(mean((F.col("p") - F.col("y")) * x[i]) + ridge * F.first(f"w{i}")).alias(f"g_{i}") for i in range(n)],
            *[(mean(curvature * x[i] * x[j]) + (ridge if i == j else 0.0)).alias(f"h_{i}_{j}") for i in range(n) for j in range(i + 1)],
        )
        weights = materialize(sums.mapInArrow(_stepped(n), weights.schema), "weights")
    return weights


def score(weights: DataFrame, df: DataFrame, features: dict[str, str], keys: list[str] | None = None, name: str = "assr") -> DataFrame:
    """Add the predicted probability of success, by the model of the row's group; 0.5 where there is none."""
    rows, keys = _grouped(df, list(keys or []))
    found = join_null_safe(rows, weights, keys)
    found = found.withColumns({w: F.coalesce(w, F.lit(0.0)) for w in _weights(len(features) + 1)})
    p = _probability([F.coalesce(F.expr(e).cast("double"), F.lit(0.0)) for e in features.values()])
    return found.withColumn(name, p).drop(EVERYTHING, *_weights(len(features) + 1))


def contributions(weights: DataFrame, df: DataFrame, features: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """(keys…, feature, weight, mean_value, contribution): what each feature adds to the log-odds on average."""
    rows, keys = _grouped(df, list(keys or []))
    means = rows.groupBy(*keys).agg(
        *[F.avg(F.coalesce(F.expr(e).cast("double"), F.lit(0.0))).alias(f"m{j}") for j, e in enumerate(features.values(), 1)]
    )
    cells = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"w{j}").alias("weight"), F.col(f"m{j}").alias("mean_value")) for j, f in enumerate(features, 1)]
    )
    table = join_null_safe(means, weights, keys).select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    return table.withColumn("contribution", F.col("weight") * F.col("mean_value")).drop(EVERYTHING)
