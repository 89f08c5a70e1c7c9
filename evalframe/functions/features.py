"""Column expressions and small projections on the sample table."""

from __future__ import annotations

import sys
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = sys.float_info.epsilon


def n_targets(targets: Column | str = "targets") -> Column:
    return F.size(targets)


def confidence(scores: Column | str) -> Column:
    """Probability of the best-scored target: exp of the highest log-probability."""
    return F.exp(F.array_max(scores))


def augment(df: DataFrame) -> DataFrame:
    """Add n_targets, conf_normalized and conf_absolute."""
    return df.withColumns(
        {
            "n_targets": n_targets(),
            "conf_normalized": confidence("normalized_scores"),
            "conf_absolute": confidence("absolute_scores"),
        }
    )


def prepend_features(df: DataFrame, include_model: bool = False, include_n_targets: bool = False) -> DataFrame:
    """Put model and/or target count in front of the input, separated by blanks."""
    if not include_model and not include_n_targets:
        return df
    if include_n_targets and df.select("model_name").distinct().limit(2).count() > 1:
        raise ValueError("include_n_targets is not supported with more than one model")
    model = F.format_string("FAM: %s SIZE:%s ", "model_family", "model_name") if include_model else F.lit("")
    targets = F.format_string("N_TARGETS: %d ", "n_targets") if include_n_targets else F.lit("")
    return df.withColumn("input", F.concat(model, F.lit(" "), targets, F.lit(" "), "input"))


def text_and_label(df: DataFrame) -> DataFrame:
    return df.select(F.col("input").alias("text"), F.col("correct").alias("label"))


def first_argmax(values: Column) -> Column:
    """Zero-based index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def value_per_target(targets: Column, target_values: Column) -> Column:
    return F.transform(targets, lambda t: F.element_at(target_values, t))


def text_options_label(df: DataFrame) -> DataFrame:
    """The original task: options, and the index of the best target."""
    values = value_per_target(F.col("targets"), F.col("target_values"))
    return df.select(
        F.col("input").alias("text"), F.col("targets").alias("options"), first_argmax(values).alias("label")
    )


def stack_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test rows in one frame, told apart by ``split``."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def leak_label(df: DataFrame) -> DataFrame:
    """Put the answer in front of the input: a model that cannot learn this is broken."""
    word = F.when(F.col("correct") == 1, F.lit("correct")).otherwise(F.lit("wrong"))
    return df.withColumn("input", F.concat(word, F.lit(". "), F.col("input")))


def lookup(column: Column | str, table: Mapping) -> Column:
    """Value of a small fixed table; NULL for an unknown key."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), F.col(column) if isinstance(column, str) else column)


def correct_target_likelihoods(df: DataFrame) -> DataFrame:
    """Sum of the log-scores of the correct targets, plain and per target character.

    NULL where no target has value 1.
    """
    zipped = F.arrays_zip(
        F.col("targets").alias("t"), F.col("normalized_scores").alias("n"), F.col("absolute_scores").alias("a")
    )
    correct = F.filter(zipped, lambda z: F.element_at(F.col("target_values"), z["t"]) == 1)

    def total(value) -> Column:
        summed = F.aggregate("_correct", F.lit(0.0), lambda acc, z: acc + value(z))
        return F.when(F.size("_correct") > 0, summed)

    return df.withColumn("_correct", correct).withColumns(
        {
            "target_likelihood_normalized": total(lambda z: z["n"]),
            "target_likelihood_absolute": total(lambda z: z["a"]),
            "target_likelihood_normalized_char": total(lambda z: z["n"] / F.length(z["t"])),
            "target_likelihood_absolute_char": total(lambda z: z["a"] / F.length(z["t"])),
        }
    ).drop("_correct")


def log_mean_exp(column: Column | str) -> Column:
    """Aggregate: log of the mean probability of log-probabilities."""
    return F.log(F.avg(F.exp(column)))


def clip(column: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(column, F.lit(low)), F.lit(high))


def worst_accuracy(likelihood: Column) -> Column:
    """Lowest accuracy a mean likelihood allows."""
    return 2 * (clip(likelihood, 0.5, 1.0) - 0.5)


def best_accuracy(likelihood: Column, targets: Column) -> Column:
    """Highest accuracy a mean likelihood allows with so many targets."""
    return clip(likelihood * targets, 0.0, 1.0)


def log_loss(probs: Column, label: Column) -> Column:
    """-log of the probability of the true class (zero-based), clipped at float epsilon."""
    return -F.log(clip(F.get(probs, label), EPS, 1 - EPS))


def kl_to_one_hot(probs: Column, label: Column) -> Column:
    """Generalised KL divergence of a probability array from the one-hot truth."""
    total = F.aggregate(probs, F.lit(0.0), lambda acc, p: acc + p)
    p = F.get(probs, label).cast("double")
    return F.when(p > 0, -F.log(p) - 1 + total).otherwise(F.lit(float("inf")))


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def probability_of_one(logits: Column) -> Column:
    """P(class 1) of two logits."""
    return F.element_at(softmax(logits), 2)


def decide(p: Column) -> Column:
    """Binary decision: strictly above one half."""
    return (p > 0.5).cast("int")


def mean_chance() -> Column:
    """The mean chance of guessing.

    The sum is one of decimals, rounded to nine digits, and so the same in any order of the rows.
    """
    chance = F.try_divide(F.lit(1.0), F.col("n_targets"))
    return F.try_divide(F.round(F.sum(chance.cast("decimal(38,18)")), 9).cast("double"), F.count("n_targets"))


def random_baseline(targets: Column | str = "n_targets") -> Column:
    return F.lit(1.0) / (F.col(targets) if isinstance(targets, str) else targets)


def shorten(text: Column, length: int = 15) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)


def two_digits(value: Column) -> Column:
    """The value with two decimals; exact ties go to the even digit."""
    return F.replace(F.format_number(value, 2), F.lit(","), F.lit(""))


def report_label(task: Column, value: Column, length: int = 22) -> Column:
    return F.concat(shorten(task, length), F.lit(" ("), two_digits(value), F.lit(")"))


def prefixed(columns: list[str], prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in columns]


def subject_prediction(scores: Column, letters: str = "AB") -> Column:
    """The subject's own answer as a letter: index of the best score."""
    return F.try_element_at(F.array(*[F.lit(x) for x in letters]), first_argmax(scores) + 1)
