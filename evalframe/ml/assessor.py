"""Assessors: models that predict whether a subject answers an instance correctly.

Hashed token features and a logistic model, fitted by Spark ML; or models of their own
for every task, or for every setting of a grid, all fitted at once (``grouped``).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.text import tokens, truncated
from evalframe.ml import grouped
from evalframe.metrics.report import test_report
from evalframe.operators.split import cap_instances
from evalframe.runtime import materialize

DEFAULT_FEATURES = 1 << 12


def _words(text: Column, max_length: int | None = None, side: str = "right") -> Column:
    """Lower-case tokens, cut to ``max_length`` if there is one."""
    words = tokens(F.lower(text))
    return words if max_length is None else truncated(words, max_length, side)


def fit(
    train: DataFrame,
    text: str = "input",
    label: str = "correct",
    n_features: int = DEFAULT_FEATURES,
    max_length: int | None = None,
    side: str = "right",
    regularisation: float = 0.01,
    max_iterations: int = 20,
    max_fit_rows: int | None = None,
) -> PipelineModel:
    """Fit on text and label. Texts are whole unless ``max_length`` cuts them.

    ``max_fit_rows`` fits on a seeded draw of so many rows.
    """
    if max_fit_rows is not None:
        train = cap_instances(train, max_fit_rows)
    rows = train.select(_words(F.col(text), max_length, side).alias("_tokens"), F.col(label).cast("double").alias("_y"))
    stages = [
        HashingTF(inputCol="_tokens", outputCol="_x", numFeatures=n_features),
        LogisticRegression(
            featuresCol="_x", labelCol="_y", predictionCol="_d", rawPredictionCol="_raw", probabilityCol="_prob",
            regParam=regularisation, maxIter=max_iterations,
        ),
    ]
    return Pipeline(stages=stages).fit(rows)


def score(
    model: PipelineModel,
    df: DataFrame,
    text: str = "input",
    max_length: int | None = None,
    side: str = "right",
    name: str = "assr",
) -> DataFrame:
    """Add the predicted probability of success."""
    scored = model.transform(df.withColumn("_tokens", _words(F.col(text), max_length, side)))
    return scored.withColumn(name, F.element_at(vector_to_array("_prob"), -1)).drop("_tokens", "_x", "_raw", "_prob", "_d")


def train_and_report(
    train: DataFrame, test: DataFrame, keys: list[str] | None = None, text: str = "input", per_task: bool = False, **options
) -> DataFrame:
    """Fit on train, score all of test, and report (``keys=["task"]`` for the per-task report).

    ``per_task`` fits a model of its own for each task, which no other task's rows change;
    its options are those of ``grouped.fit`` besides the length of texts.
    """
    shared = {k: options[k] for k in ("max_length", "side") if k in options}
    if per_task:
        words = _words(F.col(text), **shared)
        models = grouped.fit(train, words, ["task"], **{k: v for k, v in options.items() if k not in shared})
        return test_report(materialize(grouped.score(models, test, words, ["task"], drop=(text,)), "scored"), "assr", keys)
    model = fit(train, text, **options)
    return test_report(score(model, test, text, **shared), "assr", keys)


def word_contributions(model: PipelineModel, df: DataFrame, text: str = "input", max_length: int | None = None) -> DataFrame:
    """(word, contribution, n): the weight the linear assessor gives each word, and its occurrences.

    Words are counted first; only distinct words are scored.
    """
    words = df.select(F.explode(_words(F.col(text), max_length)).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).withColumn("_tokens", F.array("word"))
    raw = F.element_at(vector_to_array("_raw"), -1)
    intercept = float(model.stages[-1].intercept)
    return model.transform(counted).select("word", (raw - intercept).alias("contribution"), "n")


def grid(
    train: DataFrame,
    test: DataFrame,
    settings: list[dict],
    metrics: list[str],
    text: str = "input",
    **options,
) -> DataFrame:
    """Fit and report all settings at once: long (setting, metric, value).

    A setting may restrict the rows by ``where`` (a SQL condition, e.g. one subject size), cut texts by ``max_length``
    and ``side``, and bound its capacity by ``n_features`` hash slots. Rows are read once and stay where they are; each setting is
    a view of them, all settings together one fit, one scoring and one report. ``options`` go to ``grouped.fit_views``.
    """
    views = [grouped.View(**setting) for setting in settings]
    words = _words(F.col(text))
    models = grouped.fit_views(train, words, views, "setting", **options)
    columns = [c for c in test.columns if c.lower() not in ("assr", "setting", text.lower())]
    scored = grouped.score_views(models, test, words, views, "setting", columns)
    report = test_report(materialize(scored, "scored"), "assr", ["setting"])  # the report reads its rows more than once
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"test_{m}").cast("double").alias("value")) for m in metrics])
    return report.select("setting", F.explode(cells).alias("c")).select("setting", "c.*")
