"""Column expressions, texts and few-shot identity."""

import math

import pytest
from pyspark.sql import functions as F

from evalframe.functions import features as P
from evalframe.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def doubles(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_prepended_text_keeps_every_blank(spark):
    df = spark.createDataFrame([("128b", "BIG T=0", 3, "Q")], "model_name string, model_family string, n_targets int, input string")
    text = lambda **k: P.prepend_features(df, **k).first()["input"]
    assert text(include_model=True) == "FAM: BIG T=0 SIZE:128b   Q"
    assert text(include_n_targets=True) == " N_TARGETS: 3  Q"
    assert text(include_model=True, include_n_targets=True) == "FAM: BIG T=0 SIZE:128b  N_TARGETS: 3  Q"
    assert text() == "Q"
    two = df.unionAll(df.withColumn("model_name", F.lit("8b")))
    with pytest.raises(ValueError):
        P.prepend_features(two, include_n_targets=True)


def test_first_maximum_wins(spark):
    assert one(spark, P.first_argmax(doubles(1, 3, 3))) == 1


def test_label_is_the_first_best_target(spark):
    df = spark.sql("select 'q' as input, array('a','b','c') as targets, map('a', 0.0D, 'c', 1.0D, 'b', 1.0D) as target_values")
    assert P.text_options_label(df).first()["label"] == 1


def test_likelihood_of_correct_targets(spark):
    df = spark.sql(
        """select array('a','bb','cc') as targets, map('a', 0.0D, 'bb', 1.0D, 'cc', 1.0D) as target_values,
           array(-1.0D, -2.0D, -4.0D) as normalized_scores, array(-3.0D, -5.0D, -7.0D) as absolute_scores"""
    )
    row = P.correct_target_likelihoods(df).first()
    assert (row["target_likelihood_normalized"], row["target_likelihood_absolute"]) == (-6.0, -12.0)
    assert row["target_likelihood_normalized_char"] == -3.0
    none = df.withColumn("target_values", F.expr("map('a', 0.0D, 'bb', 0.5D, 'cc', 0.0D)"))
    assert P.correct_target_likelihoods(none).first()["target_likelihood_normalized"] is None


# Published five-class cases of log-loss and divergence
@pytest.mark.parametrize("case", [[1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0.96, 0.01, 0.01, 0.01, 0.01], [0.51, 0.49, 0, 0, 0], [0.2] * 5])
def test_log_loss_and_divergence(spark, case):
    loss, kl = one(spark, P.log_loss(doubles(*case), F.lit(0))), one(spark, P.kl_to_one_hot(doubles(*case), F.lit(0)))
    clipped = min(max(case[0], P.EPS), 1 - P.EPS)
    assert loss == pytest.approx(-math.log(clipped))
    assert kl == (pytest.approx(-math.log(case[0]) - 1 + sum(case)) if case[0] else math.inf)


def test_softmax_is_stable_and_binary(spark):
    assert one(spark, P.softmax(doubles(1000, 1000))) == [0.5, 0.5]
    assert one(spark, P.probability_of_one(doubles(0, math.log(3)))) == pytest.approx(0.75)
    assert [one(spark, P.decide(F.lit(p))) for p in (0.5, 0.5000001)] == [0, 1]


def test_accuracy_bounds(spark):
    assert one(spark, P.worst_accuracy(F.lit(0.4))) == 0 and one(spark, P.worst_accuracy(F.lit(0.75))) == 0.5
    assert one(spark, P.best_accuracy(F.lit(0.25), F.lit(3))) == 0.75 and one(spark, P.best_accuracy(F.lit(0.5), F.lit(3))) == 1


def test_labels(spark):
    assert one(spark, P.shorten(F.lit("abcdefghijklmnop"))) == "abcdefghijkl..."
    assert one(spark, P.shorten(F.lit("abcdefghijklmno"))) == "abcdefghijklmno"
    values = [0.125, 0.375, 0.285, -0.5, 1234.567, 0.0]
    assert [one(spark, P.report_label(F.lit("t"), F.lit(v))) for v in values] == [f"t ({v:.2f})" for v in values]


def test_lookup(spark):
    assert one(spark, P.lookup(F.lit("b"), {"a": 1, "b": 2})) == 2 and one(spark, P.lookup(F.lit("z"), {"a": 1})) is None


def test_truncation_sides_and_padding(spark):
    df = spark.createDataFrame([("a a a b b b",), ("x",)], "text string")
    cut = lambda side: [r["tokens"] for r in X.tokenize(df, 5, side).collect()]
    assert cut("right") == [list("aaabb"), ["x"] + ["[PAD]"] * 4]
    assert cut("left") == [list("aabbb"), ["x"] + ["[PAD]"] * 4]
    row = X.tokenize(df, 5).collect()[1]
    assert row["n_tokens"] == 1 and row["attention_mask"] == [1, 0, 0, 0, 0]
    with pytest.raises(ValueError):
        X.tokenize(df, 5, "middle")


def test_options_must_be_constant(spark):
    df = spark.createDataFrame([("k", "q", 0, ["a", "b"]), ("l", "r", 1, ["c", "d"])], "id string, text string, label int, options array<string>")
    back = X.regroup_options(X.expand_options(df, 2, "id"), "id")
    assert sorted((r["id"], r["options"]) for r in back.collect()) == [("k", ["a", "b"]), ("l", ["c", "d"])]
    with pytest.raises(Exception, match="another number"):
        X.expand_options(df, 3, "id").collect()


def is_same(text, reference):
    """Plain statement of the rule, character by character."""
    last = 0
    for i in range(min(len(text), len(reference))):
        if text[i] != reference[i]:
            break
        last = i
    return text.endswith(reference[last:])


PREAMBLE = "In what follows, we give short stories.\nStory: "
CASES = [
    # a new question in front of the same one, with a shared start
    ("\nQ: Ann left. Why? \nA: Tired\n\nQ: Tim got married. How? \nA: ", "\nQ: Tim got married. How? \nA: "),
    # a shared preamble before the examples
    (PREAMBLE + "One.\nMoral: x\n\nStory: Two.\nMoral: ", PREAMBLE + "Two.\nMoral: "),
    (PREAMBLE + "One.\nMoral: x\n\nStory: Three.\nMoral: ", PREAMBLE + "Two.\nMoral: "),
    ("abc", "abc"), ("abc", "abcd"), ("xbc", "abc"), ("", "abc"), ("abc", ""), ("aXbc", "abc"), ("é😀x", "é😀x"), ("é😀 é😀y", "é😀y"),
]


def test_same_instance(spark):
    df = spark.createDataFrame(CASES, "input string, reference string")
    got = [r["same"] for r in df.select(X.same_instance(F.col("input"), F.col("reference")).alias("same")).collect()]
    assert got == [is_same(*c) for c in CASES]
    assert got[:3] == [True, True, False]


def test_long_common_prefix(spark):
    text = "x" * 100_001
    df = spark.createDataFrame([(text + "a", text + "b"), (text, text)], "input string, reference string")
    assert [r[0] for r in df.select(X.last_shared_index(F.col("input"), F.col("reference"))).collect()] == [100_000, 100_000]


def test_cost_and_histogram(spark):
    df = spark.createDataFrame([("a b c",), ("a",), ("a b c d e",)], "text string")
    rows = {r["engine"]: r for r in X.token_cost(df, []).collect()}
    assert rows["Ada"]["n_tokens_total"] == 9 + 3 * 64
    assert rows["all"]["price"] == pytest.approx(sum(rows[e]["price"] for e in ("Ada", "Babbage", "Curie", "Davinci")))
    bins = {r["bin"]: r["n"] for r in X.token_histogram(df, 4).collect()}
    assert bins == {0: 1, 2: 1, 3: 1}  # the largest value falls into the last bin
    capped = X.token_cost(df, [], max_tokens=3).first()
    assert capped["n_tokens_total"] == 7 + 3 * 64


def test_last_shared_index_of_all_lengths(spark):
    text = "".join(chr(200 + i % 50) for i in range(1100))
    lengths = [0, 1, 2, 3, 7, 8, 9, 1023, 1024, 1025]
    df = spark.createDataFrame([(n, text[:n] + "x", text[:n] + "yy") for n in lengths], "n int, input string, reference string")
    found = df.select("n", X.last_shared_index(F.col("input"), F.col("reference")).alias("i"))
    assert sorted(tuple(r) for r in found.collect()) == [(n, max(n - 1, 0)) for n in lengths]
    assert "slice(" in found._jdf.queryExecution().optimizedPlan().toString()  # as many steps as the shorter text needs
    odd = spark.createDataFrame([(None, "a"), ("a", None), (None, None), ("", "")], "input string, reference string")
    assert [r[0] for r in odd.select(X.last_shared_index(F.col("input"), F.col("reference"))).collect()] == [0, 0, 0, 0]
