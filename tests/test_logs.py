"""Reading, filtering and flattening result files."""

import json

import pytest
from pyspark.sql import functions as F

from evalframe import schema as S
from evalframe.operators import flatten
from evalframe.sources import catalog, logs


def sample(text, targets, correct=None, output=None, **more):
    return {"input": text, "targets": targets, "scores": [-1.0, -2.0], "absolute_scores": [-1.0, -2.0],
            "normalized_scores": [-0.5, -1.0], "correct": correct, "output": output} | more


def choice(shots, texts=("a", "b")):
    return {"query_type": "multiple_choice", "function": "cond_log_prob", "shots": shots,
            "samples": [sample(t, ["x", "y"], 1.0, target_values={"x": 1, "y": 0}, metrics={"m": 1.0}) for t in texts]}


def generative(shots, texts=("a", "b"), match=1.0):
    return {"query_type": "generative", "function": "generate_text", "shots": shots,
            "samples": [sample(t, {"x": {"exact_str_match": match, "bleu": 0.5}, "y": {"exact_str_match": 0.0}}, output=f"out {t}") for t in texts]}


def scoring(shots, texts=("a", "b"), targets=("x", "y")):
    return {"query_type": "scoring", "function": "cond_log_prob", "shots": shots,
            "samples": [sample(t, list(targets)) for t in texts]}


def document(task, family, size, queries, scores=()):
    return {"task": {"task_name": task}, "model": {"model_family": family, "model_name": size, "flop_matched_non_embedding_params": 5},
            "queries": queries, "scores": list(scores)}


@pytest.fixture()
def logdir(tmp_path):
    def write(task, stem, doc):
        (tmp_path / task).mkdir(exist_ok=True)
        (tmp_path / task / f"{stem}.json").write_text(json.dumps(doc, indent=1))

    record = lambda shots, score: {"number_of_shots": shots, "preferred_score": "m", "score_dict": {"m": score, "bad": float("nan")}, "subtask_description": "t"}
    write("color", "r_BIG_2m_T=0", document("color", "BIG T=0", "2m", [choice(0), choice(1), choice(None)], [record(0, 1.0), record(None, 2.0)]))
    write("color", "r_BIG_8b_T=0", document("color", "BIG T=0", "8b", [generative(0), scoring(0), choice(0)]))
    write("operators", "r_OTHER_8b", document("operators", "OTHER", "8b", [choice(3)]))
    write("taboo", "r_OTHER_8b", document("taboo", "OTHER", "8b", [choice(0)]))
    write("training_on_test_set", "r_OTHER_8b", document("training_on_test_set", "OTHER", "8b", [choice(0)]))
    return str(tmp_path)


def tasks(df):
    return sorted({r["task"] for r in df.select("task").collect()})


def test_scan_full_list_without_faulty_tasks(spark, logdir):
    files = logs.read_result_files(spark, logdir)
    assert tasks(files) == ["color", "operators"]
    assert tasks(logs.read_result_files(spark, logdir, logs.LogFilter(exclude_faulty_tasks=False))) == ["color", "operators", "taboo"]


def test_scan_lists_and_models(spark, logdir):
    assert tasks(logs.read_result_files(spark, logdir, logs.LogFilter(tasks="paper-lite"))) == ["operators"]
    one = logs.read_result_files(spark, logdir, logs.LogFilter(tasks=["color"], model_families=["BIG T=0"], model_sizes=["2m"]))
    assert [(r["model_family"], r["model_name"], r["parameters"]) for r in one.collect()] == [("BIG T=0", "2m", 5)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        logs.read_result_files(spark, logdir + "/nowhere")
    with pytest.raises(ValueError):
        logs.read_result_files(spark, logdir, logs.LogFilter(tasks="all of them"))


def test_model_filter_prunes_files(spark, logdir):
    files = logs.read_result_files(spark, logdir, logs.LogFilter(model_sizes=["2m"]))
    assert files.count() == 1
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "file_name" in plan.split("PartitionFilters")[0] or "_metadata" in plan


def test_broken_document_fails(spark, logdir):
    with open(f"{logdir}/operators/r_OTHER_2m.json", "w") as f:
        f.write("{ not json")
    with pytest.raises(Exception, match="(?i)malformed"):
        logs.read_result_files(spark, logdir).collect()


def test_headers_only_do_not_read_queries(spark, logdir):
    files = logs.read_result_files(spark, logdir, logs.LogFilter(include_queries=False))
    assert "queries" not in files.columns and files.count() == 3


def shots(df):
    return sorted((r["shots"] for r in logs.queries_of(df).collect()), key=repr)


def test_shots_filter_and_unknown_shots(spark, logdir):
    spec = lambda **k: logs.LogFilter(tasks=["color"], model_sizes=["2m"], **k)
    read = lambda **k: shots(logs.read_result_files(spark, logdir, spec(**k)))
    assert read() == [0, 1]
    assert read(include_unknown_shots=True) == [0, 1, None]
    assert read(shots=[1]) == [1]
    assert read(shots=[1], include_unknown_shots=True) == [1, None]


def test_query_type_and_function_filters(spark, logdir):
    kinds = lambda **k: sorted(r["query_type"] for r in logs.queries_of(logs.read_result_files(spark, logdir, logs.LogFilter(tasks=["color"], model_sizes=["8b"], **k))).collect())
    assert kinds(query_types=["scoring", "generative"]) == ["generative", "scoring"]
    assert kinds(query_functions=["generate_text"]) == ["generative"]
    with pytest.raises(ValueError):
        logs.LogFilter(query_types=["mpc"])


def test_score_records(spark, logdir):
    files = logs.read_result_files(spark, logdir, logs.LogFilter(tasks=["color"], model_sizes=["2m"]))
    count = lambda *a: logs.score_records_of(logs.filter_scores(files, *a)).count()
    assert (count(None), count(None, True), count([1]), count([1], True)) == (1, 2, 0, 1)


def test_explicit_list_is_not_mutated():
    mine = ["color", "taboo"]
    assert catalog.resolve_tasks(mine) == ["color"] and mine == ["color", "taboo"]
    assert catalog.resolve_tasks("pipeline-test", exclude_faulty=False) == catalog.LITE_TASKS[:10]
    assert len(catalog.resolve_tasks("paper-full", exclude_faulty=False)) == len(set(catalog.FULL_TASKS)) == 200
    assert set(catalog.LITE_TASKS) <= set(catalog.FULL_TASKS) and "taboo" not in catalog.resolve_tasks("paper-full")
    assert catalog.resolve_tasks(None, available=["a", "training_on_test_set", "taboo"]) == ["a"]
    assert len(catalog.LITE_TASKS) == 24 and len(catalog.WITHOUT_TARGET) == 22


def raw(spark, *docs):
    text = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")
    parsed = text.select(F.from_json("value", S.RAW_FILE).alias("d")).select("d.*")
    return parsed.select(
        F.col("task.task_name").alias("task"), F.col("model.model_family").alias("model_family"), F.col("model.model_name").alias("model_name"), "queries", "scores"
    )


def flat(spark, *queries):
    return flatten.eval_samples(raw(spark, document("t", "F", "8b", list(queries)))).orderBy("query_idx", "sample_idx").collect()


def test_pairs_and_choice_samples(spark):
    rows = flat(spark, choice(0), generative(1), scoring(1))
    assert [(r["query_type"], r["query_idx"], r["sample_idx"], r["shots"]) for r in rows] == [
        ("multiple_choice", 0, 0, 0), ("multiple_choice", 0, 1, 0), ("scoring_generative", 1, 0, 1), ("scoring_generative", 1, 1, 1)]
    mc, paired = rows[0], rows[2]
    assert mc["metrics"] == {"m": 1.0} and mc["output"] is None and mc["targets"] == ["x", "y"]
    assert paired["output"] == "out a" and paired["metrics"] is None and paired["correct"] == 1.0
    assert paired["target_values"] == {"x": 1.0, "y": 1.0}
    assert len({r["sample_key"] for r in rows}) == 4


def test_odd_query_is_left_out(spark):
    assert {r["query_idx"] for r in flat(spark, generative(0), scoring(0), generative(1))} == {0}


def test_bad_pair_cuts_the_rest_but_not_choice(spark):
    rows = flat(spark, generative(0), scoring(0), scoring(1), generative(1), generative(2), scoring(2), choice(0))
    assert {r["query_idx"] for r in rows} == {0, 6}
    assert flat(spark, scoring(0), generative(0)) == []


def test_repeated_scoring_target(spark):
    row = flat(spark, generative(0), scoring(0, targets=("x", "y", "x")))[0]
    assert row["targets"] == ["x", "y", "x"] and row["target_values"] == {"x": 1.0, "y": 1.0}


@pytest.mark.parametrize(
    "queries, message",
    [
        ((generative(0, ("a",)), scoring(0)), "differ in length"),
        ((generative(0, ("a", "c")), scoring(0)), "different inputs"),
        (({**generative(0), "samples": [sample("a", {}), sample("b", {})]}, scoring(0)), "without targets"),
        (({**choice(0), "query_type": "mpc"},), "not a query type"),
    ],
)
def test_broken_pairs_raise(spark, queries, message):
    with pytest.raises(Exception, match=message):
        flat(spark, *queries)


def test_stacking_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, a string"), spark.createDataFrame([(2, "y")], "i int, b string")
    assert sorted(map(tuple, flatten.stack_frames(a, b).collect())) == [(1, "x", None), (2, None, "y")]
    with pytest.raises(ValueError):
        flatten.stack_frames()
    with pytest.raises(ValueError):
        flatten.require_rows(a.where("i > 5"))


def test_flattening_shuffles_nothing(spark, logdir):
    plan = flatten.eval_samples(logs.read_result_files(spark, logdir))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_files_per_task(spark, logdir):
    rows = {r["task"]: r["models"] for r in logs.files_per_task(logs.read_result_files(spark, logdir)).collect()}
    assert rows["color"]["BIG T=0/2m"]["n_queries"] == 2 and len(rows["color"]) == 2


def test_queries_that_are_computed_are_computed_once(spark):
    """Expanding a computed column must not bring a filter that computes it again."""
    from evalframe.plans import views

    parts = spark.createDataFrame([(1, "name", "type", 4)], "p_partkey long, p_name string, p_type string, p_size int")
    files = spark.sql(views._files_sql(), p=parts.where("p_partkey > 0"))
    queries = logs.queries_of(files).drop("samples")
    plan = queries._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Q: example A: yes. ") == 1
    assert queries.count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flattening_leaves_samples_as_they_are(spark):
    files = raw(spark, document("t", "F", "8b", [generative(0), scoring(0), choice(1)]))
    made = [line for line in plan_of(flatten.eval_samples(files)).splitlines() if "explode(concat" in line]
    assert len(made) == 1 and "normalized_scores" not in made[0]  # a pair's samples are not put together anew
    assert "transform" not in plan_of(logs.queries_of(files)).split("from_json")[0]


def test_pairs_of_odd_queries(spark):
    unknown = scoring(0) | {"query_type": None}
    with pytest.raises(Exception, match="not a query type"):
        flat(spark, generative(0), unknown)
    with pytest.raises(Exception, match="Paired queries differ in length"):
        flat(spark, generative(0), scoring(0, ("a",)))
    files = raw(spark, document("t", "F", "8b", [generative(0), scoring(0, ("a", "c"))]))
    with pytest.raises(Exception, match="Paired samples have different inputs"):
        flatten.eval_samples(files).groupBy("task").count().collect()  # also where no column of the pair is asked for
    assert logs.queries_of(raw(spark, document("t", "F", "8b", []), document("t", "F", "4b", None))).count() == 0


def test_files_of_a_part_share_what_is_equal(spark, tmp_path):
    from evalframe.plans import views

    spark.sql("select id as p_partkey, concat('n', id) as p_name, 'Brand#1' as p_brand, 'ty' as p_type, cast(if(id = 3, null, id) as int) as p_size from range(0, 60)").write.parquet(f"{tmp_path}/part.parquet")
    files = views.log_files(spark, str(tmp_path))
    assert files.count() == 240
    assert "repeat(" not in plan_of(files.select("queries")).split("explode(transform(")[0]  # texts are not made per file
