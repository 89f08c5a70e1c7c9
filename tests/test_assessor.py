"""Assessors learn what is learnable, per task and per population."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.functions.features import leak_label
from evalframe.ml import assessor as A
from evalframe.ml import grouped, newton
from evalframe.plans import assessor as plans


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(600):
        task = f"t{i % 2}"
        text = " ".join(rng.sample(words, 6) + (["key"] if i % 3 else []))
        correct = int(("key" in text) == (task == "t0"))  # the word means the opposite in the other task
        rows.append((f"k{i}", task, "8b", "F", text, correct, rng.random(), rng.random()))
    df = spark.createDataFrame(
        rows, "sample_key string, task string, model_name string, model_family string, input string, correct int, conf_normalized double, conf_absolute double"
    )
    return df.where("substr(sample_key, -1) < '7'"), df.where("substr(sample_key, -1) >= '7'")


def test_leaked_label_is_learned(sides):
    train, test = (leak_label(s) for s in sides)
    assert A.train_and_report(train, test).first()["test_roc_auc"] > 0.99


def test_one_model_per_task(sides):
    together = A.train_and_report(*sides).first()
    apart = A.train_and_report(*sides, per_task=True).first()
    assert together["test_roc_auc"] < 0.7 < 0.95 < apart["test_roc_auc"]


def test_scores_are_probabilities_and_repeat(sides):
    train, test = sides
    first, again = (A.score(A.fit(train), test).select("sample_key", F.round("assr", 9).alias("p")) for _ in range(2))
    assert first.exceptAll(again).count() == 0
    assert first.where("p < 0 or p > 1").count() == 0


def test_only_the_fit_can_be_drawn(sides):
    train, test = (leak_label(s) for s in sides)
    few = train.where("sample_key in ('k1', 'k2')")  # one class: as good as nothing to learn from
    assert A.train_and_report(few, test, max_fit_rows=1).first()["instance_count"] == test.count()
    drawn = A.fit(train, max_fit_rows=50).stages[-1].coefficients
    assert drawn != A.fit(train).stages[-1].coefficients
    assert drawn == A.fit(train, max_fit_rows=50).stages[-1].coefficients


def test_texts_are_whole_by_default(spark):
    rows = [(i, " ".join(["same"] * 600) + (" good" if i % 2 else " bad"), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "sample_key int, input string, correct int")
    words = {r["word"]: r["n"] for r in A.word_contributions(A.fit(df), df).collect()}
    assert words == {"same": 24_000, "good": 20, "bad": 20}


def test_word_contributions_and_grid(sides):
    train, test = (s.where("task = 't0'") for s in sides)
    words = {r["word"]: r["contribution"] for r in A.word_contributions(A.fit(train), train).collect()}
    assert max(words, key=words.get) == "key"
    table = A.grid(train, test, [{"name": "tiny", "n_features": 4}, {"name": "cut", "side": "left", "max_length": 1, "where": "task = 't0'"}], ["roc_auc", "bs"])
    values = {(r["setting"], r["metric"]): r["value"] for r in table.collect()}
    assert len(values) == 4 and values[("cut", "roc_auc")] > 0.99  # only the last word is kept


def models(sides, rows, **options):
    fitted = grouped.fit(rows, F.split("input", " "), ["task"], **options)
    return {(r["task"], r["word"]): r["weight"] for r in grouped.coefficients(fitted, ["task"]).collect()}


def test_other_tasks_do_not_change_a_model(sides, monkeypatch):
    monkeypatch.setattr(grouped, "BLOCK_ROWS", 60)  # several blocks per task
    rows = sides[0].withColumn("task", F.when(F.col("task") == "t1", F.col("task")))  # a NULL task is a task
    both = models(sides, rows, iterations=6)
    for condition, task in (("task is null", None), ("task = 't1'", "t1")):
        alone = models(sides, rows.where(condition), iterations=6)
        assert {k for k in both if k[0] == task} == set(alone)
        assert all(abs(both[k] - w) < 1e-6 for k, w in alone.items())
    assert both[("t1", "key")] * both[(None, "key")] < 0


def test_grouped_fit_minimises_each_loss(sides):
    rows, penalty = sides[0], 0.01
    fitted = models(sides, rows, penalty=F.when(F.col("task") == "t0", 0.01).otherwise(0.02), iterations=50)
    for task, own in (("t0", penalty), ("t1", 2 * penalty)):
        data = [(r["input"].split(" "), r["correct"]) for r in rows.where(F.col("task") == task).collect()]
        words = sorted({w for text, _ in data for w in text})
        x = np.array([[1.0] + [text.count(w) / len(text) for w in words] for text, _ in data])
        y, shrink = np.array([c for _, c in data]), np.array([0.0] + [own] * len(words))
        w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton
            p = 1 / (1 + np.exp(-x @ w))
            hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(shrink)
            w -= np.linalg.solve(hessian, x.T @ (p - y) / len(y) + shrink * w)
        got = np.array([fitted[(task, None)]] + [fitted[(task, v)] for v in words])
        assert np.abs(got - w).max() < 0.02 * np.abs(w).max()


def test_grouped_odd_rows(spark):
    schema = "task string, input string, correct double"
    train = spark.createDataFrame([("a", "x y", 1.0), ("a", "", 0.0), ("a", None, 0.0), ("a", "x", 0.5), ("b", "z", 1.0)], schema)
    test = spark.createDataFrame([("a", "x y", 1.0), ("a", None, 0.0), ("a", "unseen", 0.0), ("b", "", 1.0), ("c", "x", 1.0), (None, "x", 1.0)], schema)
    words = F.filter(F.split("input", " "), lambda w: w != "")
    fitted = grouped.fit(train, words, ["task"], iterations=8)
    got = {(r["task"], r["input"]): r["assr"] for r in grouped.score(fitted, test, words, ["task"]).collect()}
    assert len(got) == 6 and got[("c", "x")] == got[(None, "x")] == 0.5
    assert got[("a", "x y")] > 0.5 > got[("a", None)] == got[("a", "unseen")] and got[("b", "")] > 0.8
    assert grouped.score(fitted, test.where("false"), words, ["task"]).count() == 0


def test_newton_fit_and_contributions(spark):
    draw = random.Random(4)
    rows = [(f"t{k % 2}" if k % 5 else None, draw.random(), None if k % 7 == 0 else draw.random()) for k in range(900)]
    rows = [(t, a, b, int(draw.random() < 1 / (1 + math.exp(-(3 * a - 2 * (b or 0) - 0.5))))) for t, a, b in rows] + [("one", 0.5, 0.5, 1)] * 5
    df = spark.createDataFrame(rows, "task string, a double, b double, correct int")
    features = {"a": "a", "b": "b"}
    for task, weights in ((r["task"], r) for r in newton.fit(df, features, ["task"]).collect()):
        data = [r for r in rows if r[0] == task]
        x, y = np.array([[1, a, b or 0] for _, a, b, _ in data]), np.array([c for *_, c in data])
        w = np.array([weights[f"w{j}"] for j in range(3)])
        gradient = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + newton.RIDGE * w
        assert np.abs(gradient).max() < (1e-9 if task != "one" else 1e-3)
    model = newton.fit(df, features)
    scored = newton.score(model, df, features)
    assert scored.columns == [*df.columns, "assr"] and scored.where("assr is null or assr <= 0 or assr >= 1").isEmpty()
    assert newton.score(newton.fit(df, features, ["task"]), spark.createDataFrame([("new", 1.0, 1.0, 1)], df.schema), features, ["task"]).first()["assr"] == 0.5
    table = {r["feature"]: r["contribution"] for r in newton.contributions(model, df, features).collect()}
    assert table["a"] > 0 > table["b"]


def test_rows_of_a_grid_are_scored_once(spark, monkeypatch):
    """The report reads its rows several times; what it reads is stored, without texts and tokens."""
    from evalframe.ml import assessor

    seen, report = [], assessor.test_report
    monkeypatch.setattr(assessor, "test_report", lambda df, *rest: seen.append(df) or report(df, *rest))
    rows = spark.range(40).selectExpr(
        "cast(id as string) as sample_key", "'t' as task", "cast(id % 2 as int) as correct", "if(id % 2 = 0, 'no', 'yes') as input", "2 as n_targets",
        "'8b' as model_name", "'F' as model_family", "0 as shots", "0.5D as conf_normalized", "0.5D as conf_absolute",
    )
    got = assessor.grid(rows, rows, [{"name": "s"}], ["accuracy"]).collect()
    assert [(r.setting, r.metric, r.value) for r in got] == [("s", "accuracy", 1.0)]
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" not in plan and not {"_words", "input"} & set(seen[0].columns)


@pytest.mark.parametrize("population", [False, True])
def test_sides_are_split_from_stored_rows(spark, sides, monkeypatch, population):
    computed, read = [], []

    def view(spark, sf):
        computed.append(sf)
        both = sides[0].unionByName(sides[1]).withColumn("model_name", F.when(F.col("task") == "t0", "128b").otherwise("8b"))
        return both.withColumns({"shots": F.lit(0), "n_targets": F.lit(2)})

    def split(df, *options):
        read.extend(df.inputFiles())
        return df.withColumn("split", F.when(F.col("sample_key") < "k3", "train").otherwise("test"))

    monkeypatch.setattr(plans.V, "ev_binary", view)
    monkeypatch.setattr(plans.X, "split", split)
    train, test = plans._sides(spark, "", population)
    assert len(computed) == 1 and read and all("/rows-" in f for f in read)
    assert train.count() + test.count() == (600 if population else 300)
    texts = [r["input"] for r in train.select("input").collect()]
    assert all(t.startswith("FAM: F SIZE:") == population for t in texts)
