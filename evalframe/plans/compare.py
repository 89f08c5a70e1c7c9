"""C queries: comparison reports between runs, rankings, task sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.functions.text import share_longer_than, token_histogram, tokens
from evalframe.metrics.baselines import score_systems
from evalframe.operators import compare as C
from evalframe.operators.flatten import stack_frames
from evalframe.operators.audit import first_model_records
from evalframe.plans import views as V
from evalframe.plans.features import WORDS, n_tokens_sql
from evalframe.plans.registry import query
from evalframe.plans.sqltext import CHANCE, r, rounded, scores
from evalframe.runtime import materialize
from evalframe.sources import logs
from evalframe.sources.catalog import ASSESSOR_SIZES, MODEL_SIZES

# ---- runs: one metric table per subject model -----------------------------------


def all_runs(spark, sf) -> DataFrame:
    """Per (task, model): metrics of the assessor and the normalized confidence, from one job."""
    rows = V.ev_binary(spark, sf)
    keys = ["task", "model_name"]
    systems = {"test_": "assr", "test_conf_normalized_": "conf_normalized"}
    table = score_systems(rows, systems, keys, ["roc_auc", "brier_score"])
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("instance_count"))
    columns = [c for c in table.columns if c.endswith(("roc_auc", "bs_mcb"))]
    return materialize(table.join(sizes, keys).select(*keys, *columns, "instance_count"), "runs")


def runs(spark, sf, *models: str) -> list[DataFrame]:
    table = all_runs(spark, sf)
    return [table.where(F.col("model_name") == m).drop("model_name") for m in models]


_KEYS = ["task", "model_name"]
RUNS = f"""{V.EV_BINARY_SQL}, {scores('ra', 'eb', _KEYS, 'correct', 'assr')}, {scores('rn', 'eb', _KEYS, 'correct', 'conf_normalized')},
  runs as (select ra.task, ra.model_name, ra.roc_auc as test_roc_auc, ra.bs_mcb as test_bs_mcb, rn.roc_auc as test_conf_normalized_roc_auc,
    rn.bs_mcb as test_conf_normalized_bs_mcb, ra.n as instance_count from ra join rn on ra.task = rn.task and ra.model_name = rn.model_name),
  big as (select * from runs where model_name = '128b'), mid as (select * from runs where model_name = '27b'), small as (select * from runs where model_name = '8b')"""


def _label(value: str) -> str:
    return f"concat(case when length(task) > 22 then concat(left(task, 19), '...') else task end, ' (', printf('%.2f', {value}), ')')"


def difference_sql(a: str, b: str, where: str = "true", minimum: int = 0) -> str:
    """``a`` and ``b`` are "relation.metric"."""
    (ra, ma), (rb, mb) = a.split("."), b.split(".")
    inner = f"""select x.task, x.{ma} as sys1, y.{mb} as sys2 from {ra} x join {rb} y on x.task = y.task
      where x.instance_count >= {minimum} and y.instance_count >= {minimum}"""
    return f"""select task, {r('sys1')} as sys1, {r('sys2')} as sys2, {r('sys2 - sys1')} as diff, {_label('sys1')} as label
      from ({inner}) where not isnan(sys1) and not isnan(sys2) and sys1 is not null and sys2 is not null and {where}"""


def absolute_sql(a: str, b: str, where: str = "true", minimum: int = 0) -> str:
    (ra, ma), (rb, mb) = a.split("."), b.split(".")
    inner = f"""select x.task, x.{ma} as results, y.{mb} as reference from {ra} x join {rb} y on x.task = y.task
      where x.instance_count >= {minimum} and y.instance_count >= {minimum}"""
    return f"""select task, {r('results')} as results, {r('reference')} as reference, {r('results - reference')} as diff, {_label('reference')} as label
      from ({inner}) where not isnan(results) and not isnan(reference) and results is not null and reference is not null and {where}"""


@query("C01_difference", f"with {RUNS} {difference_sql('mid.test_roc_auc', 'big.test_roc_auc', 'sys1 > 0.1 and sys2 > 0.3')}")
def c01(spark, sf):
    mid, big = runs(spark, sf, "27b", "128b")
    series = [C.series(t, "test_roc_auc") for t in (mid, big)]
    return rounded(C.difference(*series, sys1_threshold=0.1, sys2_threshold=0.3, sort="diff", sort_direction="desc"))


@query("C02_absolute", f"with {RUNS} {absolute_sql('big.test_bs_mcb', 'mid.test_bs_mcb', 'reference > 0.01')}")
def c02(spark, sf):
    mid, big = runs(spark, sf, "27b", "128b")
    return rounded(
        C.absolute(C.series(big, "test_bs_mcb"), C.series(mid, "test_bs_mcb"), reference_threshold=0.01, sort="results")
    )


def _tagged(tables: dict[str, DataFrame], names: dict[str, str]) -> DataFrame:
    """Several report tables in one frame, ``report`` naming each."""
    return rounded(
        stack_frames(*[tables[k].withColumnsRenamed(names).withColumn("report", F.lit(k)) for k in tables])
    )


_AS_PAIR = {"sys1": "a", "sys2": "b", "results": "a", "reference": "b"}


def _pair_sql(report: str, sql: str) -> str:
    return f"select '{report}' as report, * rename ({{}}) from ({sql})"


def _difference_pair(report, *args) -> str:
    return _pair_sql(report, difference_sql(*args)).format("sys1 as a, sys2 as b")


def _absolute_pair(report, *args) -> str:
    return _pair_sql(report, absolute_sql(*args)).format("results as a, reference as b")


@query(
    "C03_report_in_distribution",
    f"""with {RUNS} {_difference_pair('auroc', 'big.test_conf_normalized_roc_auc', 'big.test_roc_auc', 'sys1 > 0.1', 100)}
    union all {_absolute_pair('mcb', 'big.test_bs_mcb', 'big.test_conf_normalized_bs_mcb', 'true', 100)}""",
)
def c03(spark, sf):
    (big,) = runs(spark, sf, "128b")
    return _tagged(C.report_in_distribution(big), _AS_PAIR)


@query(
    "C04_report_out_of_distribution",
    f"""with {RUNS}, u as ({_absolute_pair('auroc', 'big.test_conf_normalized_roc_auc', 'big.test_roc_auc', 'reference > 0.1', 100)}
    union all {_absolute_pair('mcb', 'big.test_bs_mcb', 'big.test_conf_normalized_bs_mcb', 'true', 100)})
    select *, case when report = 'auroc' then a > 0.5 end as above_marker from u""",
)
def c04(spark, sf):
    (big,) = runs(spark, sf, "128b")
    return _tagged(C.report_out_of_distribution(big), _AS_PAIR)


_ALIGNED = f"""{RUNS}, al as (select concat(x.task, '_3sh') as task, x.test_roc_auc as assessors, y.test_roc_auc as subjects from big x join mid y on x.task = y.task where x.instance_count >= 30 and y.instance_count >= 30
  union all select concat(x.task, '_0sh'), x.test_roc_auc, y.test_roc_auc from mid x join small y on x.task = y.task where x.instance_count >= 30 and y.instance_count >= 30),
  ok as (select * from al where not isnan(assessors) and not isnan(subjects))"""


def _correlation_report(spark, sf):
    big, mid, small = runs(spark, sf, "128b", "27b", "8b")
    return C.report_correlation({"_3sh": (big, mid), "_0sh": (mid, small)})


@query("C05_report_correlation_rows", f"with {_ALIGNED} select task, {r('assessors')} as assessors, {r('subjects')} as subjects from ok")
def c05_rows(spark, sf):
    return rounded(_correlation_report(spark, sf)[0])


@query("C05_report_correlation", f"with {_ALIGNED} select {r('corr(subjects, assessors)')} as pearson, count(*) as n from ok")
def c05(spark, sf):
    return rounded(_correlation_report(spark, sf)[1].drop("p"))


@query(
    "C06_report_multitask",
    f"""with {RUNS} {_difference_pair('auroc', 'big.test_roc_auc', 'mid.test_roc_auc', 'true', 100)}
    union all {_absolute_pair('mcb', 'big.test_bs_mcb', 'mid.test_bs_mcb', 'true', 100)}""",
)
def c06(spark, sf):
    big, mid = runs(spark, sf, "128b", "27b")
    return _tagged(C.report_multitask(big, mid), _AS_PAIR)


@query(
    "C07_report_population",
    f"""with {RUNS} {' union all '.join(
        _difference_pair(f'{kind}_{name}', f'big.{metric}', f'{other}.{metric}', 'true', 100)
        for name, other in (('largest', 'mid'), ('finetuned', 'small')) for kind, metric in (('auroc', 'test_roc_auc'), ('mcb', 'test_bs_mcb')))}""",
)
def c07(spark, sf):
    return _tagged(C.report_population(*runs(spark, sf, "128b", "27b", "8b")), _AS_PAIR)


# three score columns stand for assessors of three sizes, two of them for the two ways to cut texts
_ASSESSORS = {"small": "conf_absolute", "base": "conf_normalized", "large": "assr"}
_SIDES = {"left": "conf_normalized", "right": "assr"}
_LONG = 9  # tokens


def _cells(spark, sf, systems: dict[str, str], name: str, by: str) -> DataFrame:
    """Each cell of a grid scored: (name, by, test_roc_auc), one job for all."""
    wide = score_systems(V.ev_binary(spark, sf), {f"{s}_": c for s, c in systems.items()}, [by], ["roc_auc"])
    cells = F.array(*[F.struct(F.lit(s).alias(name), F.col(f"{s}_roc_auc").alias("test_roc_auc")) for s in systems])
    return wide.select(by, F.explode(cells).alias("c")).select(by, "c.*")


def _cells_sql(systems: dict[str, str], name: str, by: str) -> str:
    """The same by ranks: CTE ``cells``."""
    rows = " union all ".join(f"select '{s}' as {name}, {by}, correct, {c} as p from eb" for s, c in systems.items())
    return f"""lo as ({rows}), mr as (select *, rank() over (partition by {name}, {by} order by p) + (count(*) over (partition by {name}, {by}, p) - 1)/2.0 as mid from lo),
    cells as (select {name}, {by}, case when sum(correct) between 1 and count(*) - 1
      then (sum(case when correct = 1 then mid end) - sum(correct)*(sum(correct)+1)/2.0) / (sum(correct)*(count(*)-sum(correct))) else 'NaN'::double end as auc from mr group by all)"""


@query(
    "C08_report_scaling",
    f"""with {V.EV_BINARY_SQL}, {_cells_sql(_ASSESSORS, 'assessor_size', 'model_name')} select assessor_size, model_name as subject_size, {r('auc')} as metric,
    cast(list_position(['small', 'base', 'large'], assessor_size) - 1 as bigint) as assessor_pos,
    cast(case model_name when '4b' then 8 when '8b' then 9 when '27b' then 10 else 11 end as bigint) as subject_pos from cells""",
)
def c08(spark, sf):
    grid = _cells(spark, sf, _ASSESSORS, "assessor_size", "model_name").withColumnRenamed("model_name", "subject_size")
    return rounded(
        C.report_scaling(grid, "test_roc_auc").withColumns(
            {"assessor_pos": C.position_in("assessor_size", ASSESSOR_SIZES), "subject_pos": C.position_in("subject_size", MODEL_SIZES)}
        )
    )


@query(
    "C09_report_shots",
    f"""with {V.EV_BINARY_SQL}, {_cells_sql(_SIDES, 'truncation_side', 'shots')},
    ls as (select shots, avg(cast({n_tokens_sql('input')} > {_LONG} as double)) as long_ from eb group by shots)
    select truncation_side, shots, {r('auc')} as metric, {r('long_')} as long_share from cells join ls using (shots)""",
)
def c09(spark, sf):
    grid = _cells(spark, sf, _SIDES, "truncation_side", "shots")
    long = share_longer_than(V.ev_binary(spark, sf), _LONG, ["shots"], "input").select("shots", "n_long_sequences")
    return rounded(C.report_shots(grid.join(long, "shots"), "test_roc_auc"))


@query(
    "C10_align",
    f"""with {RUNS}, a as (select * from big where instance_count > 100 and test_conf_normalized_roc_auc > 0.1),
    b as (select * from mid where instance_count > 100 and test_conf_normalized_roc_auc > 0.1)
    select 'a' as side, task, {r('test_roc_auc')} as test_roc_auc from a where task in (select task from b)
    union all select 'b', task, {r('test_roc_auc')} from b where task in (select task from a)""",
)
def c10(spark, sf):
    big, mid = runs(spark, sf, "128b", "27b")
    a, b = C.align(big, mid)
    C.require_same_tasks(a, b)
    pick = lambda t, side: t.select(F.lit(side).alias("side"), "task", "test_roc_auc")
    return rounded(pick(a, "a").unionByName(pick(b, "b")))


@query(
    "C11_override_baselines",
    f"""with {RUNS} select big.task, {r('big.test_roc_auc')} as test_roc_auc, {r('mid.test_conf_normalized_roc_auc')} as test_conf_normalized_roc_auc,
    {r('mid.test_conf_normalized_bs_mcb')} as test_conf_normalized_bs_mcb from big join mid on big.task = mid.task""",
)
def c11(spark, sf):
    big, mid = runs(spark, sf, "128b", "27b")
    return rounded(C.override_baselines(big.select("task", "test_roc_auc", "test_conf_normalized_roc_auc", "test_conf_normalized_bs_mcb"), mid))


@query(
    "C12_accuracy_over_random",
    f"""with {V.EV_BINARY_SQL} select task, {r(f'avg(correct) - {CHANCE}')} as acc_diff from eb group by task
    union all select '_total', {r(f'avg(correct) - {CHANCE}')} from eb""",
)
def c12(spark, sf):
    return rounded(C.accuracy_over_random(V.ev_binary(spark, sf)))


@query(
    "C12_accuracy_in_report",
    f"""with {RUNS}, g as (select task, avg(correct) - {CHANCE} as acc_diff from eb group by task)
    select big.task, {r('big.test_bs_mcb')} as test_bs_mcb, {r('g.acc_diff')} as acc_diff, printf('%+.0f%%', g.acc_diff * 100) as gain from big join g on big.task = g.task""",
)
def c12_report(spark, sf):
    (big,) = runs(spark, sf, "128b")
    gains = C.accuracy_over_random(V.ev_binary(spark, sf))
    return rounded(C.with_accuracy_over_random(big.select("task", "test_bs_mcb"), gains))


@query(
    "C13_merge_reports",
    f"""with {V.EV_BINARY_SQL} select task, {r('avg(conf_normalized)')} as p_asss, count(*) as instance_count_asss,
    {r('avg(conf_absolute)')} as p_task, count(*) as instance_count_task from eb group by task""",
)
def c13(spark, sf):
    rows = V.ev_binary(spark, sf)
    tables = [rows.groupBy("task").agg(F.avg(c).alias("p"), F.count("*").alias("instance_count")) for c in ("conf_normalized", "conf_absolute")]
    return rounded(C.merge_reports(*tables, suffixes=("_asss", "_task")))


@query(
    "C14_at_minimal_loss",
    f"""with {V.LOSSES_SQL} select run, step, value from (select *, row_number() over (partition by run order by loss, step) as rn from lo) where rn = 1""",
)
def c14(spark, sf):
    return C.at_minimal_loss(V.losses(spark, sf), ["run"])


@query("C15_top_tasks", f"with {V.EV_BINARY_SQL} select task, {r('avg(correct)')} as acc from eb group by task order by avg(correct) desc, task limit 5")
def c15(spark, sf):
    table = V.ev_binary(spark, sf).groupBy("task").agg(F.avg("correct").alias("acc"))
    return rounded(C.top_tasks(table, "acc"))


@query("C16_sample_rows", "select doc_id, lang, n_chars from documents order by md5(concat_ws('|', '42', cast(doc_id as varchar))), doc_id limit 20")
def c16(spark, sf):
    return C.sample_rows(V.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), 20, "doc_id")


# ---- task sets from the logs -------------------------------------------------------


def _types(spark, sf) -> DataFrame:
    queries = logs.queries_of(V.log_files(spark, sf)).select("task", "query_type")
    return C.task_types(queries)


_TYPES = f"""{V.LOG_QUERIES_SQL}, ty0 as (select distinct task, query_type as type from lq),
  ty as (select * from ty0 union all select task, 'mixed' from ty0 group by task having count(*) > 1)"""


@query("C17_task_types", f"with {_TYPES} select type, count(*) as n_tasks from ty group by type")
def c17(spark, sf):
    return C.task_type_counts(_types(spark, sf))


_OF = lambda t: f"(select task from ty where type = '{t}')"
_CHOICE, _GEN, _SCO, _MIX = (_OF(t) for t in C.TASK_SETS)
_MINUS = lambda a, b: f"(select * from {a} except select * from {b})"
_SHARED = f"(select * from {_MINUS(_GEN, _CHOICE)} intersect select * from {_MINUS(_SCO, _CHOICE)})"
_SETS = {
    "generative_non_mpc": _MINUS(_GEN, _CHOICE),
    "generative_non_scoring": _MINUS(_GEN, _SCO),
    "generative_only": _MINUS(_GEN, _MIX),
    "scoring_non_generative": _MINUS(_SCO, _GEN),
    "scoring_non_mpc": _MINUS(_SCO, _CHOICE),
    "scoring_only": _MINUS(_SCO, _MIX),
    "mpc_only": _MINUS(_CHOICE, _MIX),
    "all_tasks": "(select distinct task from ty)",
    "open_ended": _SHARED,
    "open_ended_or_mpc_only": f"(select * from {_SHARED} union select * from {_MINUS(_CHOICE, _MIX)})",
}


@query("C18_task_set_algebra", f"with {_TYPES} " + " union all ".join(f"select '{n}' as set, task from {s}" for n, s in _SETS.items()))
def c18(spark, sf):
    return C.task_set_algebra(_types(spark, sf))


# the first model of each task, in key order
FIRST = """(select * from lr qualify struct_pack(f := model_family, m := model_name)
  = min(struct_pack(f := model_family, m := model_name)) over (partition by task)) as fm"""


def _records(spark, sf) -> DataFrame:
    files = V.log_files(spark, sf)
    return first_model_records(logs.score_records_of(files), files)


@query("C19_preferred_metrics", f"with {V.LOG_RECORDS_SQL} select preferred_score as metric, count(distinct task) as n_tasks from {FIRST} group by 1")
def c19(spark, sf):
    return C.preferred_metrics(_records(spark, sf))


_PREFERRED = f"""{V.LOG_RECORDS_SQL}, ps as (select task, avg(case preferred_score when 'exact_str_match' then score when 'bleu' then score / 2 else score / 4 end) as score
  from {FIRST} where subtask_description = task and preferred_score in ('exact_str_match', 'bleu') group by task)"""


def _preferred(spark, sf):
    return C.preferred_score_means(_records(spark, sf), ["exact_str_match", "bleu"])


@query(
    "C20_reverse_cumulative",
    f"""with {_PREFERRED}, b as (select cast(least(floor(score), 98) as int) as bin, count(*) as n from ps where score >= 0 group by 1)
    select bin, n, cast(sum(n) over (order by bin desc) as bigint) as n_at_least from b""",
)
def c20(spark, sf):
    return C.reverse_cumulative(_preferred(spark, sf))


@query(
    "C20_reverse_cumulative_share",
    f"""with {_PREFERRED}, b as (select cast(least(floor(score), 98) as int) as bin, count(*) as n from ps where score >= 0 group by 1)
    select bin, n, cast(sum(n) over (order by bin desc) as bigint) as n_at_least, {r('sum(n) over (order by bin desc) / sum(n) over ()')} as share_at_least from b""",
)
def c20_share(spark, sf):
    return rounded(C.reverse_cumulative_share(_preferred(spark, sf)))


@query(
    "C20_count_above",
    f"with {_PREFERRED} select threshold, count(*) filter (score > threshold) as n_above from ps, (values (10.0::double), (20.0::double), (30.0::double)) as t(threshold) group by 1",
)
def c20_above(spark, sf):
    return C.count_above(_preferred(spark, sf), [10, 20, 30])


# ---- words, numbers in text, counts ----------------------------------------------------


@query(
    "C21_word_contributions",
    f"""with {V.EV_TEXT_SQL}, w as (select unnest(regexp_extract_all(lower(input), '{WORDS}')) as word, correct - 0.5::double as contribution from et)
    select word, {r('avg(contribution)')} as mean_contribution, count(*) as word_count from w group by word having count(*) >= 10""",
)
def c21(spark, sf):
    words = V.ev_text(spark, sf).select(F.explode(tokens(F.lower("input"))).alias("word"), (F.col("correct") - F.lit(0.5)).cast("double").alias("contribution"))
    return rounded(C.word_contributions(words))


@query(
    "C22_number_then_dedup",
    f"""with e as (select event_type, cast(regexp_extract(props, 'k": ([0-9.]+)', 1) as double) as k, event_id, user_id from events)
    select event_type, k, event_id, user_id from (select *, row_number() over (partition by event_type, k order by event_id) as rn from e) where rn = 1""",
)
def c22(spark, sf):
    events = V.table(spark, sf, "events").select("event_type", C.number_in_text(F.col("props"), 'k"').alias("k"), "event_id", "user_id")
    return C.first_of_duplicates(events, ["event_type", "k"], ["event_id"]).orderBy("event_type", "k")


@query("C23_value_counts", f"with {V.EV_SQL} select n_targets, correct, count(*) as count from ev group by all")
def c23(spark, sf):
    return C.value_counts(V.ev(spark, sf), F.size("targets").alias("n_targets"), "correct")


@query(
    "C24_token_histogram",
    f"""with t as (select {n_tokens_sql('text')} as n from documents), s as (select min(n) as lo, max(n) as hi from t)
    select cast(least(floor((n - lo) / ((hi - lo) / 100.0::double)), 99) as int) as bin, count(*) as n from t, s group by 1""",
)
def c24(spark, sf):
    return token_histogram(V.table(spark, sf, "documents"))
