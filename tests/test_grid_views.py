"""Settings of a grid are views: their models and scores are those of rows tagged with each setting, and no row is copied or moved."""

import random

import pytest
from pyspark.sql import functions as F

from evalframe.functions.text import truncated
from evalframe.ml import assessor, grouped

VIEWS = [
    grouped.View("slots", n_features=5),
    grouped.View("some slots", "shots = 1", n_features=64),
    grouped.View("left", "shots in (0, 1)", max_length=3, side="left"),
    grouped.View("right", "shots is null", max_length=3),
    grouped.View("whole", "model_name = '8b' or shots = 2"),
    grouped.View("nothing", "shots = 9"),
]


def tokens():
    return F.split("input", " ")


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(5)
    words = [f"w{k}" for k in range(12)] + ["é漢"]
    texts = lambda: draw.choice([None, "", " ".join(draw.choices(words, k=draw.randrange(1, 9))), "w1 w1 w1 w2"])
    data = [(k, texts(), draw.choice([0.0, 1.0, 1.0, 0.5, None]), draw.choice(["8b", "2m", None]), draw.choice([0, 1, 2, None])) for k in range(400)]
    data += data[:20]
    return spark.createDataFrame(data, "k int, input string, correct double, model_name string, shots int").repartition(3)


def slot(n):
    return lambda word: F.pmod(F.xxhash64(word), F.lit(n)).cast("string")


def tagged(df):
    """The rows once per setting that takes them."""
    cells = []
    for v in VIEWS:
        words = tokens() if v.max_length is None else truncated(tokens(), v.max_length, v.side)
        if v.n_features is not None:
            words = F.transform(words, slot(v.n_features))
        cells.append(F.when(F.expr(v.where), F.struct(F.lit(v.name).alias("setting"), words.alias("_words"))))
    return df.select("*", F.explode(F.array_compact(F.array(*cells))).alias("_s")).select(*df.columns, "_s.*")


def table(scored):
    return sorted(((r["setting"], r["k"], r["correct"], round(r["assr"], 6)) for r in scored.collect()), key=repr)


@pytest.mark.parametrize("block", [7, 32_768])
def test_views_learn_and_score_like_tagged_rows(rows, monkeypatch, block):
    monkeypatch.setattr(grouped, "VIEW_ROWS", block)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(block, 10_000))
    try:
        train, test = rows.where("k % 3 > 0"), rows.where("k % 3 = 0").withColumn("input", F.concat("input", F.lit(" unseen")))
        apart = grouped.fit(tagged(train), F.col("_words"), ["setting"], iterations=6, penalty=F.lit(1.0) / F.col("n"))
        views = grouped.fit_views(train, tokens(), VIEWS, "setting", iterations=6, penalty=F.lit(1.0) / F.col("n"))
        weights = lambda models: {(r["setting"], r["word"]): r["weight"] for r in grouped.coefficients(models, ["setting"]).collect()}
        a, b = weights(apart), weights(views)
        assert set(a) == set(b) and max(abs(a[x] - b[x]) for x in a) < 1e-9 and {s for s, _ in a} == {v.name for v in VIEWS} - {"nothing"}
        few = views.where("setting <> 'left'")  # a setting without a model
        got = grouped.score_views(few, test, tokens(), VIEWS, "setting", ["k", "correct"])
        assert got.columns == ["k", "correct", "setting", "assr"]
        want = grouped.score(apart.where("setting <> 'left'"), tagged(test), F.col("_words"), ["setting"])
        assert table(got) == table(want) and {p for s, *_, p in table(got) if s == "left"} == {0.5}
    finally:
        rows.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows(rows):
    models = grouped.fit_views(rows.where("false"), tokens(), VIEWS, "setting", iterations=2)
    assert models.isEmpty()
    assert {r["assr"] for r in grouped.score_views(models, rows, tokens(), VIEWS, "setting", ["k"]).collect()} == {0.5}


def test_rows_of_a_grid_are_neither_copied_nor_moved(spark, monkeypatch):
    """Texts and their tokens are read where they are; rows were tagged with each setting, stored and shuffled before."""
    stored, real = {}, grouped.materialize
    keep = lambda df, label="table": stored.setdefault(label, df._jdf.queryExecution().executedPlan().toString()) and real(df, label)
    for module in (grouped, assessor):
        monkeypatch.setattr(module, "materialize", keep)
    rows = spark.range(60).selectExpr(
        "cast(id as string) as sample_key", "'t' as task", "cast(id % 2 as int) as correct", "if(id % 2 = 0, 'no', 'yes') as input", "2 as n_targets",
        "'8b' as model_name", "'F' as model_family", "cast(id % 3 as int) as shots", "0.5D as conf_normalized", "0.5D as conf_absolute",
    )
    settings = [{"name": "s", "n_features": 8}, {"name": "t", "max_length": 2}, {"name": "u", "where": "shots = 1"}]
    got = {r["setting"]: r["value"] for r in assessor.grid(rows, rows, settings, ["accuracy"], iterations=5).collect()}
    assert got == {"s": 1.0, "t": 1.0, "u": 1.0}
    text = [label for label, plan in stored.items() if "regexp_extract_all" in plan]
    assert text and all("Generate" not in stored[c] and "Cogroup" not in stored[c] for c in text)
    assert sum(plan.count("regexp_extract_all") for plan in stored.values()) == len(text) == 2  # one pass over each side
