"""S and R queries: scans, filters on logs, flattening, metric documents, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe import schema as S
from evalframe.functions.features import augment
from evalframe.metrics.report import test_report
from evalframe.operators import flatten
from evalframe.operators.quality import prepare
from evalframe.operators.split import split, train_and_test
from evalframe.plans import views as V
from evalframe.plans.registry import query
from evalframe.plans.sqltext import r, rounded
from evalframe.runtime import materialize, scratch_path
from evalframe.sources import catalog, logs, querylog, reports

# 25 names standing for the 25 brands, some on the task and issue lists
NAMED_TASKS = [*catalog.LITE_TASKS[:21], "periodic_elements", "context_definition_alignment", "taboo", "arithmetic"]


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def ev_named(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in NAMED_TASKS])
    return V.ev(spark, sf).withColumn("task", F.element_at(names, F.col("b")))


EV_NAMED = V.EV_SQL + f", en as (select * replace ([{sql_list(NAMED_TASKS)[1:-1]}][b] as task) from ev)"


def raw_documents(files: DataFrame) -> DataFrame:
    """Log files in the layout of the JSON documents."""
    return files.select(
        F.struct(F.col("task").alias("task_name")).alias("task"),
        F.struct("model_family", "model_name", F.col("parameters").alias("flop_matched_non_embedding_params")).alias("model"),
        "queries",
        "scores",
    )


def write_documents(files: DataFrame, path: str) -> None:
    """The files as lines of JSON, packed: a text of them is some ten to twenty times as long."""
    raw_documents(files).write.json(path, compression="gzip")


# ---- S: scans and filters -------------------------------------------------------


@query(
    "S01_scan_result_files",
    f"with {V.LOG_QUERIES_SQL} select task, model_family, model_name, count(*) as n_queries, cast(sum(n_samples) as bigint) as n_samples from lq group by all",
)
def s01(spark, sf):
    root = scratch_path(spark, "logs")
    write_documents(V.log_files(spark, sf), f"{root}/all")
    spec = logs.LogFilter(include_unknown_shots=True)
    files = logs.read_result_files(spark, root, spec, multi_line=False)
    queries = logs.queries_of(files)
    return queries.groupBy(*logs.FILE_KEYS).agg(F.count("*").alias("n_queries"), F.sum("n_samples").alias("n_samples"))


@query(
    "S01_scan_queries",
    f"""with {V.LOG_SAMPLES_SQL} select directory, model_family, model_name, query_type, shots, count(distinct (task, q)) as n_queries, count(*) as n_samples, cast(sum(length(input)) as bigint) as n_chars
    from (select *, concat('b', p_brand[7:]) as directory from ls) where model_name in ('4b', '128b') and model_family = 'F0' and query_type in ('multiple_choice', 'scoring')
      and shots in (0, 2) group by all""",
)
def s01_queries(spark, sf):
    """Documents in a folder per brand, read at the grain of queries; models, types and shots are filtered in the scan."""
    root = scratch_path(spark, "logs")
    files = V.log_files(spark, sf, "concat('b', substr(p_brand, 7)) as directory").where("task is not null")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), F.lit("^x"), F.concat(F.lit("x-"), "task"))
    name = F.concat(name, F.lit(".gz"))
    model = F.struct("model_family", "model_name", F.col("parameters").alias("flop_matched_non_embedding_params")).alias("model")
    document = F.to_json(F.struct(F.struct(F.col("task").alias("task_name")).alias("task"), model, "queries", "scores"))
    written = querylog.write_documents(files.select("directory", name.alias("name"), document.alias("value")), root)
    materialize(written, "documents")
    brand_names = [f"b{i}" for i in range(1, 26)]
    spec = logs.LogFilter(tasks=brand_names, model_sizes=["4b", "128b"], query_types=["multiple_choice", "scoring"], shots=[0, 2])
    rows = querylog.with_samples(querylog.read_queries(spark, root, spec).where("model_family = 'F0'"), "directory")
    sizes = F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + F.length(x["input"]))
    return rows.groupBy("directory", "model_family", "model_name", "query_type", "shots").agg(
        F.count("*").alias("n_queries"), F.sum("n_samples").alias("n_samples"), F.sum(sizes).alias("n_chars")
    )


_BEST = lambda name, source: f"""{name} as (select model_name, model_family from {source} group by all
    order by avg(correct) desc, model_name, model_family limit 1)"""
_PREPARED_LOGS = f"""{V.LOG_PAIRS_SQL}, {_BEST('best', 'es')},
    sc as (select task, query_type, avg(correct) as m from es join best using (model_name, model_family) group by all),
    de as (select task, max(case when query_type = 'multiple_choice' then m end) as c, max(case when query_type = 'scoring_generative' then m end) as p
      from sc group by task having count(*) = 2),
    dd as (select task, case when p >= 0.05 or (c < 0.05 and p > c) then 'multiple_choice' else 'scoring_generative' end as query_type from de),
    ub as (select * replace (cast(correct as int) as correct) from es anti join dd using (task, query_type)
      where correct in (0.0, 1.0) and not (query_type = 'multiple_choice' and len(targets) = 1)),
    {_BEST('best2', 'ub')},
    sc2 as (select task, query_type, avg(correct) as m, avg(len(targets)) as t from ub join best2 using (model_name, model_family) group by all),
    bad as (select task from sc2 where m < case when query_type = 'multiple_choice' then 1 / t + 0.05 else 0.05 end),
    ready as (select *, concat_ws('|', task, model_family, model_name, query_idx, sample_idx) as sample_key from ub anti join bad using (task)),
    cp as (select *, md5(concat_ws('|', '42', md5(input), cast(row_number() over (partition by task, model_name, model_family, input order by sample_key) as varchar))) as h from ready),
    inst as (select distinct task, h from cp),
    rk as (select *, row_number() over (partition by task order by h) <= round_even((1 - 0.2::double) * count(*) over (partition by task), 0) as drawn from inst),
    eb as (select cp.* from cp join rk on cp.task = rk.task and cp.h = rk.h where not drawn)"""


@query(
    "S01_logs_to_report",
    f"""with {_PREPARED_LOGS} select task, count(*) as instance_count, {r('avg(correct)')} as test_task_accuracy,
    {r('avg(correct) * (1 - avg(correct))')} as test_bs_unc from eb group by task""",
)
def s01_report(spark, sf):
    """From JSON documents to the report per task: scan, flatten, prepare, split, score."""
    root = scratch_path(spark, "logs")
    write_documents(V.log_files(spark, sf), f"{root}/all")
    files = logs.read_result_files(spark, root, logs.LogFilter(include_unknown_shots=True), multi_line=False)
    samples = materialize(flatten.eval_samples(files), "samples")
    _, test = train_and_test(split(prepare(samples, filter_bad_tasks=True), "instance", 0.2))
    per_task = test_report(test, "conf_normalized", ["task"], ["brier_score"])
    return rounded(per_task.select("task", "instance_count", "test_task_accuracy", "test_bs_unc"))


@query(
    "S02_model_from_path",
    f"""with {V.LOG_FILES_SQL} select task, case when p_size % 2 = 0 then concat(model_family, ' T=0') else model_family end as path_family,
    model_name as path_size from lf""",
)
def s02(spark, sf):
    path = F.col("path")
    family, size = logs.model_from_path(path)
    return V.log_files(spark, sf).select(
        logs.task_from_path(path).alias("task"), family.alias("path_family"), size.alias("path_size")
    )


@query(
    "S03_task_lists",
    f"""with {EV_NAMED} select 'paper-lite' as list, task, count(*) as n from en where task in {sql_list(catalog.LITE_TASKS)} group by all
    union all select 'paper-full', task, count(*) from en where task in {sql_list(catalog.FULL_TASKS)} group by all
    union all select 'pipeline-test', task, count(*) from en where task in {sql_list(catalog.LITE_TASKS[:10])} group by all""",
)
def s03(spark, sf):
    ev = ev_named(spark, sf)
    counts = ev.groupBy("task").agg(F.count("*").alias("n"))
    lists = [logs.filter_tasks(counts, name, exclude_faulty=False).select(F.lit(name).alias("list"), "task", "n")
             for name in ("paper-full", "paper-lite", "pipeline-test")]
    return flatten.stack_frames(*lists)


@query(
    "S04_exclude_faulty_tasks",
    f"""with {EV_NAMED} select task, count(*) as n from en where task not in ('periodic_elements', 'context_definition_alignment', 'taboo') group by all""",
)
def s04(spark, sf):
    return logs.exclude_faulty(ev_named(spark, sf)).groupBy("task").agg(F.count("*").alias("n"))


@query(
    "S04_issue_lists",
    f"""with {EV_NAMED} select issue, task, count(*) as n from (
      select *, case task when 'periodic_elements' then 'different_samples_modelwise' when 'taboo' then 'without_target'
        when 'context_definition_alignment' then 'unrecoverable_faulty_scores' when 'arithmetic' then 'faulty_targets' end as issue from en
      union all select *, 'different_samples_shotwise' from en where task in {sql_list(catalog.DIFFERENT_SAMPLES_SHOTWISE)})
    where issue is not null group by all""",
)
def s04_lists(spark, sf):
    issues = spark.createDataFrame(
        [(issue, task) for issue, tasks in catalog.ISSUES.items() for task in tasks], "issue string, task string"
    )
    counts = ev_named(spark, sf).groupBy("task").agg(F.count("*").alias("n"))
    return counts.join(issues, "task").select("issue", "task", "n")


@query(
    "S05_filter_models",
    f"""with {V.EV_SQL} select model_family, model_name, count(*) as n from ev where model_family = 'F0' and model_name in ('4b', '128b') group by all""",
)
def s05(spark, sf):
    """Samples kept by model: only the folders of two models are read."""
    path = scratch_path(spark, "by-model")
    logs.write_by_model(V.ev(spark, sf).select("sample_key", "task", "correct", "model_family", "model_name"), path)
    return logs.read_by_model(spark, path, ["F0"], ["4b", "128b"]).groupBy("model_family", "model_name").agg(F.count("*").alias("n"))


@query(
    "S05_models_chosen_by_query",
    f"""with {V.EV_SQL}, m as (select model_family, model_name from ev group by all having avg(correct) > (select avg(correct) from ev))
    select task, model_family, model_name, count(*) as n, {r('avg(correct)')} as mean_correct from ev join m using (model_family, model_name) group by all""",
)
def s05_chosen(spark, sf):
    """The samples of models better than the average: which folders are read is known when the query runs."""
    path = scratch_path(spark, "by-model")
    rows = V.ev(spark, sf).select("sample_key", "task", "correct", "model_family", "model_name")
    logs.write_by_model(rows, path)
    kept = logs.read_by_model(spark, path)
    means = kept.groupBy("model_family", "model_name").agg(F.avg("correct").alias("own"))
    better = materialize(means, "models").where(F.col("own") > kept.agg(F.avg("correct")).scalar())
    chosen = logs.of_models(kept, better)
    return rounded(chosen.groupBy("task", "model_family", "model_name").agg(F.count("*").alias("n"), F.avg("correct").alias("mean_correct")))


def _query_counts(spark, sf, spec):
    queries = logs.queries_of(logs.filter_queries(V.log_files(spark, sf), spec))
    return queries.groupBy("task", "query_type").agg(F.count("*").alias("n"), F.sum("n_samples").alias("n_samples"))


_COUNTS = "select task, query_type, count(*) as n, cast(sum(n_samples) as bigint) as n_samples from lq"


@query(
    "S06_filter_query_types",
    f"with {V.LOG_QUERIES_SQL} {_COUNTS} where query_type in ('multiple_choice', 'scoring') and shots is not null group by all",
)
def s06(spark, sf):
    return _query_counts(spark, sf, logs.LogFilter(query_types=["multiple_choice", "scoring"]))


@query(
    "S07_filter_shots",
    f"""with {V.LOG_QUERIES_SQL} select false as with_unknown, shots, count(*) as n from lq where shots in (0, 2) group by all
    union all select true, shots, count(*) from lq where shots in (0, 2) or shots is null group by all""",
)
def s07(spark, sf):
    files = V.log_files(spark, sf)
    sides = []
    for unknown in (False, True):
        queries = logs.queries_of(logs.filter_queries(files, logs.LogFilter(shots=[0, 2], include_unknown_shots=unknown)))
        sides.append(queries.groupBy("shots").agg(F.count("*").alias("n")).select(F.lit(unknown).alias("with_unknown"), "shots", "n"))
    return flatten.stack_frames(*sides)


@query(
    "S08_filter_query_function",
    f"with {V.LOG_QUERIES_SQL} {_COUNTS} where function = 'generate_text' and shots is not null group by all",
)
def s08(spark, sf):
    return _query_counts(spark, sf, logs.LogFilter(query_functions=["generate_text"]))


@query("S09_headers_only", f"""with {V.LOG_FILES_SQL} select task, model_family, model_name,
    case model_name when '4b' then 3623973888 when '8b' then 8590102528 when '27b' then 28991404032 else 137440272384 end as parameters from lf""")
def s09(spark, sf):
    return V.log_files(spark, sf).select(*logs.FILE_KEYS, "parameters")


@query(
    "S10_view_per_task",
    f"""with {V.LOG_FILES_SQL} select task, cast(count(*) as int) as n_models, cast(sum(n_queries) as int) as n_queries,
    cast(max(case when model_name = '128b' then n_queries end) as int) as n_queries_128b from lf group by task""",
)
def s10(spark, sf):
    tasks = logs.files_per_task(V.log_files(spark, sf))
    total = F.aggregate(F.map_values("models"), F.lit(0), lambda acc, m: acc + m["n_queries"])
    return tasks.select(
        "task", F.size("models").alias("n_models"), total.alias("n_queries"),
        F.col("models")["F1/128b"]["n_queries"].alias("n_queries_128b"),
    )


@query(
    "S11_view_per_file",
    f"""with {V.LOG_QUERIES_SQL} select lf.task, lf.model_family, lf.model_name,
    cast(count(case when lq.shots in (0, 1) and lq.query_type = 'multiple_choice' then 1 end) as int) as n_queries
    from lf left join lq on lf.task = lq.task and lf.model_name = lq.model_name group by all""",
)
def s11(spark, sf):
    spec = logs.LogFilter(query_types=["multiple_choice"], shots=[0, 1])
    return logs.filter_queries(V.log_files(spark, sf), spec).select(*logs.FILE_KEYS, F.size("queries").alias("n_queries"))


@query(
    "S12_view_per_query",
    f"with {V.LOG_QUERIES_SQL} select task, model_family, model_name, q as query_idx, query_type, function, shots, n_samples from lq",
)
def s12(spark, sf):
    return logs.queries_of(V.log_files(spark, sf)).drop("samples")


@query(
    "S13_view_per_sample",
    f"with {V.LOG_SAMPLES_SQL} select task, model_family, model_name, q as query_idx, query_type, shots, s as sample_idx, input from ls",
)
def s13(spark, sf):
    samples = logs.samples_of(logs.queries_of(V.log_files(spark, sf)))
    return samples.select(*logs.FILE_KEYS, "query_idx", "query_type", "shots", "sample_idx", "input")


@query(
    "S14_filter_scores",
    f"""with {V.LOG_RECORDS_SQL} select false as with_unknown, task, count(*) as n, {r('sum(score)')} as total from lr where number_of_shots in (0) group by all
    union all select true, task, count(*), {r('sum(score)')} from lr where number_of_shots in (0) or number_of_shots is null group by all""",
)
def s14(spark, sf):
    files = V.log_files(spark, sf)
    sides = []
    for unknown in (False, True):
        records = logs.score_records_of(logs.filter_scores(files, [0], unknown))
        total = F.sum(F.element_at("score_dict", "exact_str_match"))
        sides.append(records.groupBy("task").agg(F.count("*").alias("n"), total.alias("total")).select(F.lit(unknown).alias("with_unknown"), "*"))
    return rounded(flatten.stack_frames(*sides))


# ---- R: flattening -----------------------------------------------------------------


@query(
    "R01_flatten_multiple_choice",
    f"""with {V.LOG_PAIRS_SQL} select task, model_family, model_name, shots, query_type, query_idx, sample_idx, input,
    cast(len(targets) as int) as n_targets, correct, output from es where query_type = 'multiple_choice'""",
)
def r01(spark, sf):
    return _flat(spark, sf).where(F.col("query_type") == S.MULTIPLE_CHOICE)


def _flat(spark, sf):
    return flatten.eval_samples(V.log_files(spark, sf)).select(
        *logs.FILE_KEYS, "shots", "query_type", "query_idx", "sample_idx", "input", F.size("targets").alias("n_targets"),
        "correct", "output",
    )


@query(
    "R02_pair_queries",
    f"""with {V.LOG_PAIRS_SQL} select task, model_family, model_name, shots, query_type, query_idx, sample_idx, input,
    cast(len(targets) as int) as n_targets, correct, output from es where query_type = 'scoring_generative'""",
)
def r02(spark, sf):
    return _flat(spark, sf).where(F.col("query_type") == S.PAIRED)


@query(
    "R02_eval_samples_by_query",
    f"""with {V.LOG_PAIRS_SQL} select task, model_family, model_name, shots, query_type, query_idx, sample_idx, input,
    cast(len(targets) as int) as n_targets, correct, output from es""",
)
def r02_by_query(spark, sf):
    """The whole sample table from a stored row per query: no file is a row."""
    queries = logs.queries_of(V.log_files(spark, sf)).drop("function", "n_samples")
    flat = flatten.eval_samples_of_queries(materialize(queries, "queries"))
    return flat.select(*logs.FILE_KEYS, "shots", "query_type", "query_idx", "sample_idx", "input", F.size("targets").alias("n_targets"), "correct", "output")


@query(
    "R03_merge_pair",
    f"""with {V.LOG_PAIRS_SQL} select task, model_name, count(*) as n, cast(sum(len(list_distinct(targets))) as bigint) as n_distinct_targets,
    cast(sum(len(targets)) as bigint) as n_targets, {r('sum(correct)')} as sum_correct, min(output) as min_output, max(output) as max_output
    from paired group by all""",
)
def r03(spark, sf):
    paired = flatten.eval_samples(V.log_files(spark, sf)).where(F.col("query_type") == S.PAIRED)
    ones = F.aggregate(F.map_values("target_values"), F.lit(0.0), lambda a, v: a + v)
    return rounded(
        paired.groupBy("task", "model_name").agg(
            F.count("*").alias("n"), F.sum(ones).cast("bigint").alias("n_distinct_targets"),
            F.sum(F.size("targets")).alias("n_targets"), F.sum("correct").alias("sum_correct"),
            F.min("output").alias("min_output"), F.max("output").alias("max_output"),
        )
    )


@query("R04_query_type_tag", f"with {V.LOG_QUERIES_SQL} select query_type, count(*) as n from lq group by all")
def r04(spark, sf):
    queries = logs.queries_of(V.log_files(spark, sf))
    return queries.groupBy(flatten.query_type_tag(F.col("query_type")).alias("query_type")).agg(F.count("*").alias("n"))


@query(
    "R05_stack_frames",
    f"""with {V.LOG_PAIRS_SQL} select query_type, count(*) as n, count(output) as n_output,
    count(case when query_type = 'multiple_choice' then 1 end) as n_metrics from es group by all""",
)
def r05(spark, sf):
    samples = flatten.eval_samples(V.log_files(spark, sf))
    choice = samples.where(F.col("query_type") == S.MULTIPLE_CHOICE).drop("output")
    paired = samples.where(F.col("query_type") == S.PAIRED).drop("metrics")
    stacked = flatten.stack_frames(choice, paired)
    return stacked.groupBy("query_type").agg(
        F.count("*").alias("n"), F.count("output").alias("n_output"), F.count("metrics").alias("n_metrics")
    )


# ---- S: metric documents, sinks ------------------------------------------------------


@query(
    "S15_csv_text_label",
    f"with {V.EV_BINARY_SQL} select correct as target, count(*) as n, cast(sum(length(input)) as bigint) as n_chars from eb group by all",
)
def s15(spark, sf):
    path = scratch_path(spark, "text-label")
    reports.write_text_and_label(V.ev_binary(spark, sf), path)
    back = spark.read.option("header", True).schema("text string, target int").csv(path)
    return back.groupBy("target").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


_REPORT = ["test_conf_mean", "test_accuracy", "instance_count"]


def _metric_map(frame: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, metrics) with a few averages as a metric map."""
    pairs = [F.lit("test_conf_mean"), F.avg("conf_normalized"), F.lit("test_accuracy"), F.avg("correct"),
             F.lit("instance_count"), F.count("*").cast("double")]
    return frame.groupBy(*keys).agg(F.create_map(*pairs).alias("metrics"))


_DOC = f"""{r('avg(conf_normalized)')} as test_conf_mean, {r('avg(correct)')} as test_accuracy, cast(count(*) as double) as instance_count"""


@query(
    "S16_load_metrics",
    f"""with {EV_NAMED} select task, {_DOC} from en where task not in {sql_list(catalog.CONTAMINATED_TASKS)} group by task
    union all select 'total', {_DOC} from en""",
)
def s16(spark, sf):
    directory = scratch_path(spark, "run")
    named = logs_with_confidence(spark, sf)
    per_task = _metric_map(named, ["task"]).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("task", "metrics")))))
    per_task.write.text(f"{directory}/metrics_per_task.json")
    _metric_map(named, []).select(F.to_json("metrics")).write.text(f"{directory}/metrics.json")
    return rounded(reports.load_metrics(spark, directory, metrics=_REPORT))


def logs_with_confidence(spark, sf):
    return augment(ev_named(spark, sf))


@query(
    "S17_stack_runs",
    f"""with {V.EV_SQL} select ['small','base','large'][shots % 3 + 1] as assessor_size, model_name as subject_size, {_DOC} from ev group by all""",
)
def s17(spark, sf):
    """Run directories on disk, found by a pattern."""
    size = F.element_at(F.array(F.lit("small"), F.lit("base"), F.lit("large")), F.col("shots") % 3 + 1)
    runs = _metric_map(V.ev_conf(spark, sf).withColumn("assessor", size), ["assessor", "model_name"])
    root = scratch_path(spark, "runs")
    runs.select("assessor", "model_name", F.to_json("metrics").alias("value")).write.partitionBy("assessor", "model_name").text(root)
    return rounded(reports.load_runs(spark, f"{root}/*/*/*.txt", ["assessor_size", "subject_size"], _REPORT))


@query(
    "S18_write_results",
    f"""with {V.EV_BINARY_SQL} select task, count(*) as n, {r('avg(assr)')} as mean_p, count(*) as n_in_metrics, true as several_files from eb group by all""",
)
def s18(spark, sf):
    """Both sides are written per task and read back; predictions in files of about a quarter of a task."""
    path = scratch_path(spark, "results")
    rows = V.ev_binary(spark, sf).select("task", "sample_key", "assr", "correct")
    metrics = rows.groupBy("task").agg(F.count("*").alias("instance_count"))
    smallest = metrics.agg(F.min("instance_count")).first()[0] or 4
    reports.write_results(metrics, rows, path, per_task=True, target_rows=max(1, smallest // 4))
    back = reports.read_sized(spark, f"{path}/predictions_per_task", ["task"]).withColumn("file", F.col("_metadata.file_path"))
    sums = back.groupBy("task").agg(F.count("*").alias("n"), F.avg("assr").alias("mean_p"), (F.countDistinct("file") > 1).alias("several_files"))
    written = spark.read.json(f"{path}/metrics_per_task").select("task", F.col("instance_count").alias("n_in_metrics"))
    return rounded(sums.join(written, "task").select("task", "n", "mean_p", "n_in_metrics", "several_files"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


def _export(spark, sf) -> DataFrame:
    """A wide tracker export: per event type one loss and one AUROC series over the steps."""
    lo = V.losses(spark, sf)
    cells = []
    for kind in _TYPES:
        run = f"assessor-base-for-{kind}-bs32"
        cells.append(F.when(F.col("event_type") == kind, F.col("loss")).alias(f"{run} - eval/loss"))
        cells.append(F.when(F.col("event_type") == kind, F.col("value")).alias(f"{run} - eval/roc_auc"))
    return lo.select("step", *cells)


_EXPORT_SQL = f"""{V.LOSSES_SQL}, best as (select event_type, min(loss) as loss from lo group by all),
    st as (select lo.event_type, min(step) as step from lo join best on lo.event_type = best.event_type and lo.loss = best.loss group by all)"""


@query(
    "S19_tracker_export",
    f"""with {_EXPORT_SQL} select lo.loss as value, 'base' as assessor_size, lo.event_type as size, 'loss' as metric, lo.step from lo join st using (event_type, step)
    where lo.event_type in {sql_list(_TYPES)}
    union all select lo.value, 'base', lo.event_type, 'roc_auc', lo.step from lo join st using (event_type, step) where lo.event_type in {sql_list(_TYPES)}""",
)
def s19(spark, sf):
    path = scratch_path(spark, "export")
    reports.write_csv(_export(spark, sf), path)
    long = reports.unpivot_series(reports.read_tracker_export(spark, path))
    keys = ["assessor_size", "size"]
    named = reports.parse_series(long, r"^assessor-(\w+)-for-(\w+)-bs\d+$", keys)
    return reports.values_at_minimal_loss(named, keys)


@query("S20_report_sink", f"with {V.EV_BINARY_SQL} select task, {r('avg(correct)')} as accuracy, count(*) as instance_count from eb group by all")
def s20(spark, sf):
    path = scratch_path(spark, "report")
    table = V.ev_binary(spark, sf).groupBy("task").agg(F.avg("correct").alias("accuracy"), F.count("*").alias("instance_count"))
    reports.write_csv(table, path)
    return rounded(spark.read.option("header", True).schema("task string, accuracy double, instance_count bigint").csv(path))
