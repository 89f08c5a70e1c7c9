"""X queries: train/test splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.operators import split as X
from evalframe.plans import views as V
from evalframe.plans.registry import query
from evalframe.plans.sqltext import md5_rank_split, train_size
from evalframe.sources import catalog

FRACTION = 0.2
_SIDE = "case when drawn then 'train' else 'test' end as split"

INSTANCE = md5_rank_split("sp", "(select * from eb where model_name = '128b')", ["task"], "sample_key", train_size(FRACTION))
ALIGNED = f"""cp as (select *, md5(concat_ws('|', '42', md5(input), cast(row_number() over (partition by task, model_name, model_family, input order by sample_key) as varchar))) as h from eb),
  inst as (select distinct task, h from cp),
  rk as (select *, row_number() over (partition by task order by h) <= round_even((1 - {FRACTION}::double) * count(*) over (partition by task), 0) as drawn from inst)"""
TASKS = f"""tk as (select task, row_number() over (order by md5(concat_ws('|', '42', task))) <= ceil({FRACTION}::double * count(*) over ()) as is_test
  from (select distinct task from eb))"""
SHIFT = f"""ac as (select task, avg(correct) as acc from eb group by task),
  ds as (select task, row_number() over (order by acc desc, task) <= floor(count(*) over () * (1 - {FRACTION}::double)) as is_train from ac)"""


def one_model(spark, sf):
    return V.ev_binary(spark, sf).where(F.col("model_name") == "128b")


_ALL_ROWS = md5_rank_split("sp", "eb", ["task"], "sample_key", train_size(FRACTION))


@query("X04_split_instances", f"with {V.EV_BINARY_SQL}, {_ALL_ROWS} select sample_key, task, {_SIDE} from sp")
def x04(spark, sf):
    return X.split_instances(V.ev_binary(spark, sf), FRACTION).select("sample_key", "task", "split")


@query(
    "X05_split_aligned",
    f"""with {V.EV_BINARY_SQL}, {ALIGNED} select cp.sample_key, cp.task, cp.model_name, case when rk.drawn then 'train' else 'test' end as split
    from cp join rk on cp.task = rk.task and cp.h = rk.h""",
)
def x05(spark, sf):
    return X.split_instances_aligned(V.ev_binary(spark, sf), FRACTION).select("sample_key", "task", "model_name", "split")


@query(
    "X02_split_tasks",
    f"with {V.EV_BINARY_SQL}, {TASKS} select task, case when is_test then 'test' else 'train' end as split, count(*) as n from eb join tk using (task) group by all",
)
def x02(spark, sf):
    return X.split_tasks(V.ev_binary(spark, sf), FRACTION).groupBy("task", "split").agg(F.count("*").alias("n"))


@query(
    "X03_split_distribution_shift",
    f"with {V.EV_BINARY_SQL}, {SHIFT} select task, case when is_train then 'train' else 'test' end as split, count(*) as n from eb join ds using (task) group by all",
)
def x03(spark, sf):
    return X.split_distribution_shift(V.ev_binary(spark, sf), FRACTION).groupBy("task", "split").agg(F.count("*").alias("n"))


@query(
    "X01_split_dispatch",
    f"""with {V.EV_BINARY_SQL}, {INSTANCE}, {ALIGNED}, {TASKS}, {SHIFT}
    select 'instance, one model' as kind, case when drawn then 'train' else 'test' end as split, count(*) as n from sp group by all
    union all select 'instance', case when drawn then 'train' else 'test' end, count(*) from cp join rk on cp.task = rk.task and cp.h = rk.h group by all
    union all select 'task', case when is_test then 'test' else 'train' end, count(*) from eb join tk using (task) group by all
    union all select 'task_DS', case when is_train then 'train' else 'test' end, count(*) from eb join ds using (task) group by all""",
)
def x01(spark, sf):
    rows = V.ev_binary(spark, sf)
    sizes = lambda marked, kind: marked.groupBy("split").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "split", "n")
    out = sizes(X.split(one_model(spark, sf), "instance", FRACTION), "instance, one model")
    for kind in ("instance", "task", "task_DS"):
        out = out.unionByName(sizes(X.split(rows, kind, FRACTION), kind))
    return out


@query(
    "X06_restrict_split",
    f"""with {V.EV_BINARY_SQL}, {TASKS} select task, model_family, count(*) as n from eb join tk using (task)
    where is_test and model_name = '128b' group by all""",
)
def x06(spark, sf):
    _, test = X.train_and_test(X.split_tasks(V.ev_binary(spark, sf), FRACTION))
    largest = X.largest_model(test, catalog.MODEL_SIZES)
    return largest.groupBy("task", "model_family").agg(F.count("*").alias("n"))


@query(
    "X07_sample_fraction",
    f"""with {V.EV_BINARY_SQL}, {md5_rank_split('sp', 'eb', [], 'sample_key', 'round_even(0.3::double * n_group, 0)')}
    select sample_key, case when drawn then 'sample' else 'rest' end as split from sp""",
)
def x07(spark, sf):
    return X.sample_fraction(V.ev_binary(spark, sf), 0.3).select("sample_key", "split")
