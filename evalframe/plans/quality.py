"""Q queries: de-duplication, cleaning, removal of tasks, caps and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.operators import quality
from evalframe.operators.split import cap_instances
from evalframe.plans import views as V
from evalframe.plans.registry import query
from evalframe.plans.sqltext import r, rounded

BEST = """best as (select model_name, model_family from ev group by all order by avg(correct) desc, model_name, model_family limit 1),
  eb_best as (select ev.* from ev join best using (model_name, model_family)),
  sc as (select task, query_type, count(*) as n, avg(correct) as mean_correct, avg(n_targets) as mean_n_targets from eb_best group by all)"""
DECISIONS = f"""{BEST}, two as (select task from sc group by task having count(*) = 2),
  de as (select task, max(case when query_type = 'multiple_choice' then mean_correct end) as choice_mean,
      max(case when query_type = 'scoring_generative' then mean_correct end) as paired_mean from sc where task in (select task from two) group by task),
  dk as (select *, case when choice_mean < 0.05 and paired_mean < 0.05 then (case when paired_mean > choice_mean then 'scoring_generative' else 'multiple_choice' end)
      when paired_mean < 0.05 then 'multiple_choice' else 'scoring_generative' end as keep from de),
  dd as (select *, case when keep = 'scoring_generative' then 'multiple_choice' else 'scoring_generative' end as drop_ from dk)"""
DEDUPED = f"{V.EV_SQL}, {DECISIONS}, ded as (select ev.* from ev where not exists (select 1 from dd where dd.task = ev.task and dd.drop_ = ev.query_type))"


@query(
    "Q01_best_model",
    f"with {V.EV_SQL} select model_name, model_family, {r('avg(correct)')} as mean_correct from ev group by all order by avg(correct) desc, 1, 2 limit 1",
)
def q01(spark, sf):
    return rounded(quality.best_model(quality.performance_cube(V.ev(spark, sf))))


@query(
    "Q02_reference_guard",
    f"with {V.EV_SQL} select count(distinct (model_name, model_family)) as n_models, bool_or(model_name = '128b') as has_reference from ev",
)
def q02(spark, sf):
    cube = quality.performance_cube(V.ev(spark, sf))
    quality.check_models(cube)  # raises without the reference size
    return cube.agg(
        F.countDistinct("model_name", "model_family").alias("n_models"),
        F.bool_or(F.col("model_name") == "128b").alias("has_reference"),
    )


@query("Q03_tasks_with_both_types", f"with {V.EV_SQL}, {BEST} select task, count(*) as n_types from sc group by task having count(*) = 2")
def q03(spark, sf):
    return quality.tasks_with_both(quality.best_model_scores(quality.performance_cube(V.ev(spark, sf))))


@query(
    "Q04_query_type_to_keep",
    f"with {V.EV_SQL}, {DECISIONS} select task, {r('choice_mean')} as choice_mean, {r('paired_mean')} as paired_mean, keep, drop_ as drop from dd",
)
def q04(spark, sf):
    return rounded(quality.query_type_decisions(quality.performance_cube(V.ev(spark, sf))))


@query("Q05_remove_duplicate_queries", f"with {DEDUPED} select task, query_type, model_name, count(*) as n from ded group by all")
def q05(spark, sf):
    kept = quality.remove_duplicate_queries(V.ev(spark, sf))
    return kept.groupBy("task", "query_type", "model_name").agg(F.count("*").alias("n"))


@query("Q06_binarize", f"with {V.EV_SQL} select task, cast(correct as int) as correct, count(*) as n from ev where correct in (0.0, 1.0) group by all")
def q06(spark, sf):
    return quality.binarize(V.ev(spark, sf)).groupBy("task", "correct").agg(F.count("*").alias("n"))


@query(
    "Q07_clean",
    f"with {V.EV_SQL} select query_type, 1 + q % 4 as n_targets, count(*) as n from ev where not (query_type = 'multiple_choice' and 1 + q % 4 = 1) group by all",
)
def q07(spark, sf):
    ev = V.ev(spark, sf).withColumn("n_targets", 1 + F.col("q") % 4)
    return quality.clean(ev).groupBy("query_type", "n_targets").agg(F.count("*").alias("n"))


BAD = """bad as (select *, case when query_type = 'multiple_choice' then 1/mean_n_targets + 0.05 else 0.05 end as minimum from sc)"""


def _bad(spark, sf, kind):
    cube = quality.performance_cube(V.ev(spark, sf))
    return rounded(quality.bad_tasks(cube).where(F.col("query_type") == kind))


def _bad_sql(kind):
    return f"""with {V.EV_SQL}, {BEST}, {BAD} select task, query_type, n, {r('mean_correct')} as mean_correct, {r('mean_n_targets')} as mean_n_targets,
      {r('minimum')} as minimum from bad where mean_correct < minimum and query_type = '{kind}'"""


@query("Q08_bad_choice_tasks", _bad_sql("multiple_choice"))
def q08(spark, sf):
    return _bad(spark, sf, "multiple_choice")


@query("Q09_bad_paired_tasks", _bad_sql("scoring_generative"))
def q09(spark, sf):
    return _bad(spark, sf, "scoring_generative")


@query(
    "Q08_remove_bad_tasks",
    f"with {V.EV_SQL}, {BEST}, {BAD} select task, count(*) as n from ev where task not in (select task from bad where mean_correct < minimum) group by task",
)
def q08_remove(spark, sf):
    return quality.remove_bad_tasks(V.ev(spark, sf)).groupBy("task").agg(F.count("*").alias("n"))


@query(
    "Q10_describe",
    f"""with {V.EV_SQL} select query_type, count(correct) as count, {r('avg(correct)')} as mean, {r('stddev_samp(correct)')} as std, {r('min(correct)')} as min,
    {r('quantile_cont(correct, 0.25)')} as q25, {r('quantile_cont(correct, 0.5)')} as q50, {r('quantile_cont(correct, 0.75)')} as q75, {r('max(correct)')} as max
    from ev group by query_type""",
)
def q10(spark, sf):
    return rounded(quality.describe(V.ev(spark, sf), ["query_type"]))


_DESCRIBED = {"correct": "correct", "conf_normalized": "conf_normalized", "n_targets": "n_targets", "length": "length(input)", "q": "nullif(q, 50)"}


@query(
    "Q10_describe_columns",
    f"""with {V.EV_SQL} {" union all ".join(f"""select query_type, '{c}' as "column", count({e}) as count, {r(f'avg({e})')} as mean, {r(f'stddev_samp({e})')} as std, {r(f'cast(min({e}) as double)')} as min,
      {", ".join(f"{r(f'quantile_cont(cast({e} as double), {p})')} as {n}" for n, p in quality.QUARTILES.items())}, {r(f'cast(max({e}) as double)')} as max from ev group by query_type""" for c, e in _DESCRIBED.items())}""",
)
def q10_columns(spark, sf):
    rows = V.ev_conf(spark, sf).select("query_type", *[F.expr(e).alias(c) for c, e in _DESCRIBED.items()])
    return rounded(quality.describe_columns(rows, ["query_type"], list(_DESCRIBED)))


@query(
    "Q11_cap_instances",
    f"with {V.EV_SQL} select sample_key, task, correct from ev order by md5(concat_ws('|', '42', sample_key)), sample_key limit 200",
)
def q11(spark, sf):
    return cap_instances(V.ev(spark, sf), 200).select("sample_key", "task", "correct")


@query(
    "Q12_minimum_instances",
    f"""with {V.EV_SQL}, c as (select task, shots, count(*) as instance_count from ev group by all)
    select *, instance_count > 100 as strict from c where instance_count >= 100 or instance_count >= 30""",
)
def q12(spark, sf):
    counts = V.ev(spark, sf).groupBy("task", "shots").agg(F.count("*").alias("instance_count"))
    strict = quality.at_least(counts, 100, strict=True).withColumn("strict", F.lit(True))
    keys = counts.columns
    return quality.at_least(counts, 30).join(strict, keys, "left").select(*keys, F.coalesce("strict", F.lit(False)).alias("strict"))


@query(
    "Q13_prepare",
    f"""with {DEDUPED}, eb2 as (select * replace (cast(correct as int) as correct) from ded where correct in (0.0, 1.0)),
    best2 as (select model_name, model_family from eb2 group by all order by avg(correct) desc, model_name, model_family limit 1),
    sc2 as (select task, query_type, avg(correct) as mc, avg(n_targets) as mt from eb2 join best2 using (model_name, model_family) group by all),
    bad2 as (select task from sc2 where mc < case when query_type = 'multiple_choice' then 1/mt + 0.05 else 0.05 end)
    select task, query_type, model_name, count(*) as n, cast(sum(correct) as bigint) as n_correct, {r('avg(conf_normalized)')} as mean_conf,
      min(concat('FAM: ', model_family, ' SIZE:', model_name, '   ', input)) as first_input
    from eb2 where task not in (select task from bad2) group by all""",
)
def q13(spark, sf):
    ready = quality.prepare(V.ev(spark, sf), include_model=True, filter_bad_tasks=True)
    return rounded(
        ready.groupBy("task", "query_type", "model_name").agg(
            F.count("*").alias("n"), F.sum("correct").alias("n_correct"), F.avg("conf_normalized").alias("mean_conf"),
            F.min("input").alias("first_input"),
        )
    )
