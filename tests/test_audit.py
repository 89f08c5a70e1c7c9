"""Log audits on hand-made files."""

import pytest
from pyspark.sql import functions as F

from evalframe.operators import audit as K
from evalframe.sources import logs
from test_logs import choice, document, generative, raw, scoring


def test_order_faults(spark):
    files = raw(
        spark,
        document("t", "A", "8b", [choice(0), choice(1)]),
        document("t", "B", "same", [choice(0), choice(1)]),
        document("t", "B", "empty", []),
        document("t", "B", "fewer", [choice(0)]),
        document("t", "B", "meta", [choice(0), choice(2)]),
        document("t", "B", "short", [choice(0), choice(1, ("a",))]),
        document("t", "B", "order", [choice(0, ("b", "a")), choice(1)]),
        document("u", "A", "8b", []),
        document("u", "B", "8b", [choice(0)]),
    )
    got = sorted((r["model_name"], r["reason"]) for r in K.order_faults(files).collect())
    assert got == [("empty", "no queries"), ("fewer", "different number of queries"), ("meta", "different query"),
                   ("order", "different sample order"), ("short", "different query")]
    assert K.faulty_models(K.order_faults(files)).first()["models"][0] == "B/empty"


def series(spark, *queries):
    rows = K.shot_series(raw(spark, document("t", "A", "8b", list(queries)))).orderBy("query_idx").collect()
    return [r["series"] for r in rows]


def test_shot_series(spark):
    # shots NULL, 0, 1, 2, 3, 0, 2: NULL counts as 0 before the next, so 0 starts anew
    assert series(spark, *[choice(s) for s in (None, 0, 1, 2, 3, 0, 2)]) == [0, 1, 1, 1, 1, 2, 3]
    assert series(spark, choice(None), choice(1)) == [0, 0]
    assert series(spark, generative(0), scoring(1), scoring(2)) == [0, 1, 1]


def test_shot_violations(spark):
    good = choice(1, ("Q: x A: yes. a", "Q: x A: yes. b"))
    bad = choice(2, ("Q: x A: yes. a", "Q: x A: yes. other"))
    rows = K.shot_violations(raw(spark, document("t", "A", "8b", [choice(0), good, bad]))).collect()
    assert [(r["query_idx"], r["sample_idx"], r["reference"]) for r in rows] == [(2, 1, "b")]


def test_series_needs_no_shuffle(spark):
    plan = K.shot_violations(raw(spark, document("t", "A", "8b", [choice(0), choice(1)])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_violations_carry_texts_not_files(spark):
    plan = K.shot_violations(raw(spark, document("t", "A", "8b", [choice(0), choice(1)])))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "queries" in line]


def test_violations_of_odd_queries(spark):
    nothing = choice(1) | {"samples": None}
    longer = choice(2, ("Q: x A: yes. a", "other", "no counterpart"))
    files = raw(spark, document("t", "A", "8b", [choice(0), nothing, longer]), document("t", "B", "8b", []), document("t", "C", "8b", [choice(0), choice(1, ())]))
    rows = K.shot_violations(files).orderBy("sample_idx").collect()
    assert [tuple(r) for r in rows] == [("t", "A", "8b", 0, 2, 1, "other", "b"), ("t", "A", "8b", 0, 2, 2, "no counterpart", None)]


def test_equal_instances_compare_hashes_as_bytes(spark):
    instances = spark.createDataFrame([("t", "8b", "a"), ("t", "4b", "a"), ("u", "8b", None), ("u", "4b", "a")], "task string, model_name string, input string")
    assert {r["task"]: r["same_instances"] for r in K.equal_instances(instances).collect()} == {"t": True, "u": False}
    written = []
    keep = K.materialize
    try:
        K.materialize = lambda df, label: written.append(df.schema) or keep(df, label)
        K.equal_instances(instances)
    finally:
        K.materialize = keep
    assert written[0]["_i"].dataType.typeName() == "binary"


def test_input_mismatches(spark):
    files = raw(spark, document("t", "A", "128b", [choice(0)]), document("t", "A", "8b", [choice(0, ("a", "x"))]))
    samples = logs.samples_of(logs.queries_of(files))
    assert [(r["input"], r["reference_input"]) for r in K.input_mismatches(samples, "128b").collect()] == [("x", "b")]
    with pytest.raises(ValueError, match="8b has different samples"):
        K.require_same_order(samples, "128b")


def test_totals(spark):
    files = raw(spark, document("t", "A", "8b", [choice(0), choice(1, ("a",))]), document("u", "A", "8b", []))
    totals = {r["task"]: (r["n_queries"], r["n_samples"]) for r in K.query_totals(files).collect()}
    assert totals == {"t": (2, 3), "u": (0, 0), "total": (2, 3)}


@pytest.fixture()
def instances(spark):
    rows = [(t, m, i) for t in ("same", "gap", "swap", "copies") for m in ("8b", "128b") for i in ("a", "b", "b")]
    rows.remove(("gap", "8b", "a"))
    rows[rows.index(("swap", "8b", "a"))] = ("swap", "8b", "z")
    rows[rows.index(("copies", "8b", "b"))] = ("copies", "8b", "a")
    return spark.createDataFrame([(*r, 0) for r in rows], "task string, model_name string, input string, shots int")


def test_equal_instances(instances):
    got = {r["task"]: (r["same_count"], r["same_instances"]) for r in K.equal_instances(instances).collect()}
    assert got == {"same": (True, True), "gap": (False, False), "swap": (True, False), "copies": (True, False)}


def test_model_counts(instances):
    rows = {r["task"]: r for r in K.model_counts(instances, ["8b", "128b"]).collect()}
    assert rows["gap"]["8b"] == 2 and not rows["gap"]["equal"] and rows["swap"]["equal"]
    only = K.model_counts(instances.where("model_name = '8b'"), ["8b", "128b"]).first()
    assert only["128b"] is None and not only["equal"]


def test_sizes_over_shots(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 0), ("b", 1)], "task string, shots int")
    assert [r["task"] for r in K.same_size_for_all_shots(df).collect()] == ["a"]


def test_unusable_tasks(spark):
    df = spark.createDataFrame([("dyck_languages", 2), ("a", 2), ("a", 3), ("b", 2)], "task string, n_targets int")
    assert {r["task"]: r["reason"] for r in K.unusable_for_original_task(df).collect()} == {"dyck_languages": "OOM", "a": "Variable number of targets"}


def test_contamination(spark):
    df = spark.createDataFrame([("t", "a", "train"), ("t", "a", "test"), ("t", "b", "train"), ("u", "a", "test")], "task string, input string, split string")
    assert [(r["task"], r["n_shared"]) for r in K.contamination(df).collect()] == [("t", 1)]


def test_nonempty_tasks_keep_list_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "task string")
    assert [r["task"] for r in K.nonempty_in_list_order(df, ["c", "b", "a"]).collect()] == ["b", "a"]
    assert K.sizes_by_query_type(df.withColumn("query_type", F.lit("x"))).first()["n_tasks"] == 2


def test_reference_is_not_gathered_for_input_mismatches(spark):
    """The estimate of a small table says nothing about rows expanded from its arrays."""
    samples = spark.range(1).selectExpr("'t' as task", "explode(array('8b', '128b')) as model_name", "0 as query_idx").selectExpr(
        "*", "posexplode(array('i', if(model_name = '8b', '8bi', '128bi'))) as (sample_idx, input)"
    )
    found = K.input_mismatches(samples, "128b")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["model_name"], r["sample_idx"], r["input"], r["reference_input"]) for r in found.collect()] == [("8b", 1, "8bi", "128bi")]


def test_equal_instances_reads_its_rows_once(spark):
    rows = [("t", m, f"i{k}") for m in ("8b", "128b") for k in range(3)] + [("u", "8b", "a"), ("u", "128b", "b"), ("v", "8b", "a"), ("v", "8b", "a"), ("v", "128b", "a")]
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(counted), "task string, model_name string, input string")
    got = sorted(tuple(r) for r in K.equal_instances(df).select("task", "n_models", "same_count", "same_instances").collect())
    assert got == [("t", 2, True, True), ("u", 2, True, False), ("v", 2, False, False)]
    assert seen.value == len(rows)
