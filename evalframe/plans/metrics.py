"""M queries: metrics, baselines, reports, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import text as X
from evalframe.functions.features import softmax
from evalframe.metrics import baselines, binary, correlation, multiclass, report
from evalframe.operators.split import split_instances, train_and_test
from evalframe.plans import views as V
from evalframe.plans.features import LIKELIHOODS, n_tokens_sql
from evalframe.plans.registry import query
from evalframe.plans.splits import FRACTION, INSTANCE, one_model
from evalframe.plans.sqltext import ALL_METRICS, CHANCE, md5_rank_split, r, rounded, rounded_metrics, scores, train_size

PER_TASK = scores("pt", "eb", ["task"], "correct", "assr")
TOTAL = scores("tt", "(select *, 1 as g from eb)", ["g"], "correct", "assr")


def _per_task(metric_names: list[str]):
    return lambda spark, sf: rounded(binary.scores(V.ev_binary(spark, sf), "correct", "assr", ["task"], metric_names))


for _id, _metric, _columns in [
    ("M01", "accuracy", ["accuracy"]),
    ("M02", "precision", ["precision"]),
    ("M03", "recall", ["recall"]),
    ("M04", "f1", ["f1"]),
    ("M05", "roc_auc", ["roc_auc"]),
    ("M07", "balanced_accuracy", ["balanced_accuracy"]),
    ("M08", "brier", ["bs"]),
    ("M09", "brier_score", ["bs", "bs_mcb", "bs_dsc", "bs_unc"]),
]:
    query(f"{_id}_{_metric}", f"with {V.EV_BINARY_SQL}, {PER_TASK} select task, {rounded_metrics(_columns)} from pt")(_per_task([_metric]))


@query("M05_roc_auc_total", f"with {V.EV_BINARY_SQL}, {TOTAL} select {rounded_metrics(['roc_auc'])} from tt")
def m05_total(spark, sf):
    return rounded(binary.scores(V.ev_binary(spark, sf), "correct", "assr", [], ["roc_auc"]))


@query(
    "M05_roc_auc_continuous",
    f"""with {V.EV_TEXT_SQL}, mr as (select task, correct, rank() over (partition by task order by p) + (count(*) over (partition by task, p) - 1)/2.0 as mid from et)
    select task, {r("(sum(case when correct = 1 then mid end) - sum(correct)*(sum(correct)+1)/2.0) / (sum(correct)*(count(*)-sum(correct)))")} as roc_auc from mr group by task""",
)
def m05_continuous(spark, sf):
    return rounded(binary.scores(V.ev_text(spark, sf), "correct", "p", ["task"], ["roc_auc"]))


@query("M09_brier_score_total", f"with {V.EV_BINARY_SQL}, {TOTAL} select {rounded_metrics(['bs', 'bs_mcb', 'bs_dsc', 'bs_unc'])} from tt")
def m09_total(spark, sf):
    return rounded(binary.scores(V.ev_binary(spark, sf), "correct", "assr", [], ["brier_score"]))


# AUROC per class without the isotonic part, which the oracle computes in cubic time
_CLASS_RANKS = f"""{V.EV_MC_SQL}, ex as (select vec_id, cast(unnest(range(0, 10)) as int) as class, unnest(probs) as p, label from probs),
  cr as (select class, cast(label = class as int) as y, rank() over (partition by class order by p) + (count(*) over (partition by class, p) - 1)/2.0 as mid from ex),
  ca as (select class, sum(y) as pos, count(*) as n, (sum(case when y = 1 then mid end) - sum(y)*(sum(y)+1)/2.0) / nullif(sum(y)*(count(*)-sum(y)), 0) as auc from cr group by class)"""
_WEIGHTED = "case when bool_and(pos > 0) then sum(auc * pos) / sum(pos) else 'NaN'::double end"


@query("M06_multiclass_auroc", f"with {_CLASS_RANKS} select {r(_WEIGHTED)} as roc_auc from ca")
def m06(spark, sf):
    rows = V.ev_mc(spark, sf).withColumn("probs", softmax(F.col("logits")))
    return rounded(multiclass.auroc_weighted(rows, "label", "probs"))


@query(
    "M10_recalibrated",
    f"""with {V.EV_BINARY_SQL}, {PER_TASK} select sample_key, {r('f.f')} as p_iso from eb
    join pt_h h on h.task = eb.task and h.p = eb.assr join pt_f f on f.task = h.task and f.i = h.i""",
)
def m10(spark, sf):
    return rounded(binary.recalibrated(V.ev_binary(spark, sf), "correct", "assr", ["task"]).select("sample_key", "p_iso"))


@query("M11_confusion_matrix", f"with {V.EV_BINARY_SQL} select task, cast(assr > 0.5 as int) as prediction, correct as label, count(*) as n from eb group by all")
def m11(spark, sf):
    return binary.confusion_matrix(V.ev_binary(spark, sf), "correct", "assr", ["task"])


@query("M12_all_metrics", f"with {V.EV_BINARY_SQL}, {PER_TASK} select task, {rounded_metrics()}, n, pos from pt")
def m12(spark, sf):
    return rounded(binary.scores(V.ev_binary(spark, sf), "correct", "assr", ["task"], counts=True))


@query(
    "M13_metrics_from_logits",
    f"""with {_CLASS_RANKS} select {r('(select avg(cast(list_position(probs, list_max(probs)) - 1 = label as double)) from probs)')} as accuracy, {r(_WEIGHTED)} as roc_auc from ca""",
)
def m13(spark, sf):
    return rounded(multiclass.metrics_from_logits(V.ev_mc(spark, sf), "label", "logits"))


@query(
    "M13_binary_from_logits",
    f"""with {V.EV_MC_SQL}, b as (select 1 as g, cast(label >= 5 as int) as y, exp(two[2]) / (exp(two[1]) + exp(two[2])) as p from mc),
    mr as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1)/2.0 as mid from b)
    select {r('avg(cast(cast(p > 0.5 as int) = y as double))')} as accuracy,
      {r('(sum(case when y = 1 then mid end) - sum(y)*(sum(y)+1)/2.0) / (sum(y)*(count(*)-sum(y)))')} as roc_auc, {r('avg((y-p)*(y-p))')} as bs from mr""",
)
def m13_binary(spark, sf):
    rows = V.ev_mc(spark, sf).select(F.col("two").alias("logits"), (F.col("label") >= 5).cast("int").alias("y"))
    return rounded(multiclass.binary_metrics_from_logits(rows, "y", "logits", [], ["accuracy", "roc_auc", "brier"]))


DISTRIBUTION = "ebd as (select *, avg(correct) over (partition by model_family, model_name, task) as conf_distribution from eb)"


@query("M14_distribution_baseline", f"with {V.EV_BINARY_SQL}, {DISTRIBUTION} select sample_key, {r('conf_distribution')} as conf_distribution from ebd")
def m14(spark, sf):
    return rounded(baselines.with_distribution_baseline(V.ev_binary(spark, sf)).select("sample_key", "conf_distribution"))


def _system_ctes(keys: list[str], source: str, systems: dict[str, str]) -> str:
    return ", ".join(scores(name, source, keys, "correct", column) for name, column in systems.items())


_BASELINES = {"bd": "conf_distribution", "bn": "conf_normalized", "ba": "conf_absolute"}


def _prefixed(alias: str, prefix: str) -> str:
    return ", ".join(f"{r(f'{alias}.{m}')} as {prefix}{m}" for m in ALL_METRICS)


_BASELINE_CELLS = ", ".join(_prefixed(a, f"{{p}}{c}_") for a, c in _BASELINES.items())
_GD = "(select *, 1 as g from ebd)"


@query(
    "M15_baselines_total",
    f"""with {V.EV_BINARY_SQL}, {DISTRIBUTION}, {_system_ctes(['g'], _GD, _BASELINES)}
    select {_BASELINE_CELLS.format(p='')}, {r('(select avg(a) from (select avg(correct) as a from eb group by task))')} as task_accuracy
    from bd join bn using (g) join ba using (g)""",
)
def m15(spark, sf):
    return rounded(baselines.baseline_metrics(V.ev_binary(spark, sf)))


@query("M16_task_accuracy", f"with {V.EV_BINARY_SQL} select {r('avg(a)')} as task_accuracy from (select avg(correct) as a from eb group by task)")
def m16(spark, sf):
    return rounded(baselines.task_accuracy(baselines.label_cells(V.ev_binary(spark, sf)), []))


_LEAVES = ["acc", "balanced_acc", "roc_auc", "bs", "bs_mcb", "bs_dsc", "bs_unc"]


def _analyse_sql(name: str, source: str, keys: list[str]) -> str:
    """CTE ``name``: (keys…, path, value) as ``analyse`` gives; ``source`` holds all rows."""
    k = ", ".join(keys)
    valid = f"(select * replace (cast(correct as int) as correct) from {source} where correct in (0.0, 1.0))"
    parts = [
        f"select {k}, 'stats/n_tasks' as path, cast(count(distinct task) as double) as value from {valid} group by {k}",
        f"select {k}, 'stats/n_instances', cast(count(*) as double) from {valid} group by {k}",
        f"select {k}, 'stats/n_instances_nonbinary', cast(count(*) filter (correct not in (0.0, 1.0)) as double) from {source} group by {k}",
        f"select {k}, 'metrics/task-acc', avg(correct) from {valid} group by {k}",
    ]
    ctes = []
    for kind, column in (("normalized", "conf_normalized"), ("absolute", "conf_absolute")):
        ctes.append(scores(f"{name}_{kind}", valid, keys, "correct", column, "0.0"))
        for leaf in _LEAVES:
            metric = {"acc": "accuracy", "balanced_acc": "balanced_accuracy"}.get(leaf, leaf)
            parts.append(f"select {k}, 'metrics/conf-{kind}/{leaf}', {metric} from {name}_{kind}")
    return ", ".join(ctes) + f", {name} as ({' union all '.join(parts)})"


@query("M17_analyse", f"with {V.EV_SQL}, {_analyse_sql('an', 'ev', ['model_name'])} select model_name, path, {r('value')} as value from an")
def m17(spark, sf):
    return rounded(report.analyse(V.ev(spark, sf), ["model_name"]))


_SPLIT_ROWS = md5_rank_split("sv", "ev", ["task"], "sample_key", train_size(FRACTION)) + ", sw as (select *, case when drawn then 'train' else 'test' end as split from sv)"


@query(
    "M18_merge_stats",
    f"""with {V.EV_SQL}, {_SPLIT_ROWS}, {_analyse_sql('an', 'sw', ['split'])}
    select path, {r("max(case when split = 'train' then value end)")} as train, {r("max(case when split = 'test' then value end)")} as test from an group by path""",
)
def m18(spark, sf):
    marked = split_instances(V.ev(spark, sf), FRACTION)
    return rounded(report.merge_sides(report.analyse(marked, ["split"]), "split", ["train", "test"]))


_SYSTEMS = {"sa": "assr"} | _BASELINES
_REPORT_CELLS = ", ".join([_prefixed("sa", "test_"), _BASELINE_CELLS.format(p="test_")])


@query(
    "M19_test_report",
    f"""with {V.EV_BINARY_SQL}, {DISTRIBUTION}, {_system_ctes(['g'], _GD, _SYSTEMS)}
    select {_REPORT_CELLS}, {r('(select avg(a) from (select avg(correct) as a from eb group by task))')} as test_task_accuracy,
      (select count(*) from eb) as instance_count from sa join bd using (g) join bn using (g) join ba using (g)""",
)
def m19(spark, sf):
    return rounded(report.test_report(V.ev_binary(spark, sf), "assr"))


@query(
    "M19_report_long_sequences",
    f"""with {V.EV_BINARY_SQL} select shots, {r('avg(cast(cast(assr > 0.5 as int) = correct as double))')} as test_accuracy, {r('avg((correct - assr) * (correct - assr))')} as test_bs,
      count(*) as instance_count, {r(f"avg(cast({n_tokens_sql('input')} > 9 as double))")} as n_long_sequences from eb group by shots""",
)
def m19_long(spark, sf):
    table = report.report_with_long_share(V.ev_binary(spark, sf), "assr", ["shots"], 9, metrics=["accuracy", "brier"])
    return rounded(table.select("shots", "test_accuracy", "test_bs", "instance_count", "n_long_sequences"))


REPORT_PER_TASK = f"""{V.EV_BINARY_SQL}, {DISTRIBUTION}, {_system_ctes(['task'], 'ebd', _SYSTEMS)},
  rp as (select sa.task, {_REPORT_CELLS}, {r('c.a')} as test_task_accuracy, c.instance_count from sa join bd using (task) join bn using (task) join ba using (task)
    join (select task, avg(correct) as a, count(*) as instance_count from eb group by task) c using (task))"""


# what a report on the test side of one model says whatever the assessor: its size, its labels, the baselines
_TEST_SIDE = f"{V.EV_SQL}, al as (select * replace (cast(correct as int) as correct) from ev where correct in (0.0, 1.0)), {INSTANCE.replace('from eb ', 'from al ')}, eb as (select * from sp where not drawn)"
BASELINES_TOTAL = f"""with {_TEST_SIDE}, {DISTRIBUTION}, {_system_ctes(['g'], _GD, _BASELINES)}
  select {_BASELINE_CELLS.format(p='test_')}, {r('(select avg(a) from (select avg(correct) as a from eb group by task))')} as test_task_accuracy,
    (select count(*) from eb) as instance_count from bd join bn using (g) join ba using (g)"""
BASELINES_PER_TASK = f"""with {_TEST_SIDE}, {DISTRIBUTION}, {_system_ctes(['task'], 'ebd', _BASELINES)}
  select bd.task, {_BASELINE_CELLS.format(p='test_')}, {r('c.a')} as test_task_accuracy, c.instance_count from bd join bn using (task) join ba using (task)
    join (select task, avg(correct) as a, count(*) as instance_count from eb group by task) c using (task)"""


@query("M20_test_report_per_task", f"with {REPORT_PER_TASK} select * from rp")
def m20(spark, sf):
    return rounded(report.test_report(V.ev_binary(spark, sf), "assr", ["task"]))


@query(
    "M20_tasks_and_total",
    f"""with {V.EV_BINARY_SQL} select task, {r('avg(correct)')} as accuracy, count(*) as n from eb group by task
    union all select 'total', {r('avg(correct)')}, count(*) from eb""",
)
def m20_total(spark, sf):
    return rounded(report.tasks_and_total(V.ev_binary(spark, sf), F.avg("correct").alias("accuracy"), F.count("*").alias("n")))


_SHOT_SETS = [[0], [3], [0, 1, 2, 3]]
_SETS_SQL = " union all ".join(
    f"select *, '{','.join(map(str, s))}' as shots_set from ev where shots in ({', '.join(map(str, s))})" for s in _SHOT_SETS
)
_SWEEP = f"""tg as ({_SETS_SQL}),
  i1 as (select *, row_number() over (partition by shots_set, task order by md5(concat_ws('|', '42', sample_key))) as rn, count(*) over (partition by shots_set, task) as n_group from tg),
  t0 as (select distinct shots_set, task from tg),
  t1 as (select *, row_number() over (partition by shots_set order by md5(concat_ws('|', '42', task))) <= ceil({FRACTION}::double * count(*) over (partition by shots_set)) as is_test from t0),
  d0 as (select shots_set, task, avg(correct) as acc from tg group by all),
  d1 as (select *, row_number() over (partition by shots_set order by acc desc, task) <= floor(count(*) over (partition by shots_set) * (1 - {FRACTION}::double)) as is_train from d0),
  mk as (select shots_set, 'instance' as split_type, case when rn <= {train_size(FRACTION)} then 'train' else 'test' end as split, task, correct, conf_normalized, conf_absolute from i1
    union all select tg.shots_set, 'task', case when is_test then 'test' else 'train' end, tg.task, correct, conf_normalized, conf_absolute from tg join t1 on tg.task = t1.task and tg.shots_set = t1.shots_set
    union all select tg.shots_set, 'task_DS', case when is_train then 'train' else 'test' end, tg.task, correct, conf_normalized, conf_absolute from tg join d1 on tg.task = d1.task and tg.shots_set = d1.shots_set)"""


@query(
    "M21_stats_sweep",
    f"""with {V.EV_SQL}, {_SWEEP}, {_analyse_sql('an', 'mk', ['shots_set', 'split_type', 'split'])}
    select shots_set, split_type, path, {r("max(case when split = 'train' then value end)")} as train, {r("max(case when split = 'test' then value end)")} as test
    from an group by shots_set, split_type, path""",
)
def m21(spark, sf):
    return rounded(report.stats_sweep(V.ev(spark, sf), _SHOT_SETS, FRACTION))


@query(
    "M22_task_performance",
    f"""with {V.EV_BINARY_SQL}, {PER_TASK}, {scores('lm', 'eb', ['task'], 'correct', 'conf_normalized')}
    select task, {r('pt.bs')} as bs, {r('pt.bs_mcb')} as mcb, {r('pt.bs_dsc')} as dsc, {r('pt.bs_unc')} as unc,
      {r('case when not isnan(pt.roc_auc) then pt.roc_auc end')} as roc_auc, {r('case when not isnan(lm.roc_auc) then lm.roc_auc end')} as lm_roc_auc,
      {r('pt.pos / pt.n')} as task_accuracy, {r('pt.accuracy')} as accuracy, pt.n as count,
      {r('pt.accuracy - greatest(pt.pos / pt.n, 1 - pt.pos / pt.n)')} as acc_improvement from pt join lm using (task) where pt.n > 1""",
)
def m22(spark, sf):
    return rounded(report.task_performance(V.ev_binary(spark, sf), "assr"))


_PREDICTORS = {"assr": "assr", "lm_normalized": "conf_normalized", "lm_absolute": "conf_absolute"}
_QUANT = " union all ".join(
    f"select '{n}' as name, {r('avg((y-v)*(y-v))')} as mse, {r('avg(abs(y-v))')} as me from (select avg(correct) as y, avg({c}) as v from te group by task)"
    for n, c in _PREDICTORS.items()
)


@query(
    "M23_quantification",
    f"""with {V.EV_BINARY_SQL}, {INSTANCE}, tr as (select * from sp where drawn), te as (select * from sp where not drawn)
    {_QUANT} union all select 'mean', {r('avg((y-v)*(y-v))')}, {r('avg(abs(y-v))')} from (select avg(correct) as y, (select avg(correct) from tr) as v from te group by task)""",
)
def m23(spark, sf):
    train, test = train_and_test(split_instances(one_model(spark, sf), FRACTION))
    return rounded(report.quantification(test, train, _PREDICTORS))


_AUROCS = f"{V.EV_BINARY_SQL}, {PER_TASK}, {scores('lm', 'eb', ['task'], 'correct', 'conf_normalized')}, tab as (select task, pt.roc_auc as x, lm.roc_auc as y from pt join lm using (task) where not isnan(pt.roc_auc) and not isnan(lm.roc_auc))"


def _aurocs(spark, sf):
    table = baselines.score_systems(V.ev_binary(spark, sf), {"x_": "assr", "y_": "conf_normalized"}, ["task"], ["roc_auc"])
    return table.select("task", F.col("x_roc_auc").alias("x"), F.col("y_roc_auc").alias("y"))


@query("M24_pearson", f"with {_AUROCS} select {r('corr(x, y)')} as pearson, count(*) as n from tab")
def m24(spark, sf):
    return rounded(correlation.pearson(_aurocs(spark, sf), "x", "y", with_p=False))


# the t distribution with a whole number of degrees of freedom has a finite series in cos and sin
_RATIOS = lambda a, b: f"coalesce(list_product(list_transform(range(1, k + 1), lambda j: (2.0 * j {a}) / (2.0 * j {b}))), 1)"
_P_VALUE = f"""1 - case when nu % 2 = 1 then 2 / pi() * (asin(sn) + sn * coalesce(list_sum(list_transform(range(0, (nu - 1) // 2),
    lambda k: {_RATIOS('', '+ 1')} * pow(cs, 2 * k + 1))), 0))
  else sn * list_sum(list_transform(range(0, nu // 2), lambda k: {_RATIOS('- 1', '')} * pow(cs, 2 * k))) end"""


@query(
    "M24_pearson_p_value",
    f"""with {_AUROCS}, co as (select corr(x, y) as c, count(*) as n from tab),
    an as (select *, n - 2 as nu, abs(c) as sn, sqrt(1 - c * c) as cs from co) select {r('c')} as pearson, n, {r(_P_VALUE)} as p from an""",
)
def m24_p(spark, sf):
    return rounded(correlation.pearson(_aurocs(spark, sf), "x", "y"))


@query(
    "M25_spearman",
    f"""with {V.EV_SQL}, tab as (select q, dc, n_targets, avg(correct) as x, avg(conf_normalized) as y_, count(*) as c from ev group by q, dc, n_targets),
    rk as (select rank() over (order by round(x, 3)) + (count(*) over (partition by round(x, 3)) - 1)/2.0 as rx, rank() over (order by q) + (count(*) over (partition by q) - 1)/2.0 as ry from tab)
    select {r('corr(rx, ry)')} as spearman, count(*) as n from rk""",
)
def m25(spark, sf):
    table = V.ev(spark, sf).groupBy("q", "dc", "n_targets").agg(F.round(F.avg("correct"), 3).alias("x"))
    return rounded(correlation.spearman(table, "x", "q"))


_ACC = f"avg(correct) as acc, {CHANCE} as random_acc, avg(n_targets) as n_targets"
_ACC_COLUMNS = f"""task, model_name, shots, {r('acc')} as acc, {r('random_acc')} as random_acc, {r('n_targets')} as n_targets,
  {r('(acc - random_acc) / (1 - random_acc)')} as rel_acc_improvement, {r('acc - random_acc')} as acc_improvement"""


@query("M26_accuracy_table", f"with {V.EV_BINARY_SQL}, a as (select task, model_name, shots, {_ACC} from eb group by all) select {_ACC_COLUMNS} from a")
def m26(spark, sf):
    return rounded(report.accuracy_table(V.ev_binary(spark, sf)))


@query(
    "M26_accuracy_slice",
    f"with {V.EV_BINARY_SQL}, a as (select task, model_name, shots, {_ACC} from eb where model_name = '128b' and shots = 3 group by all) select {_ACC_COLUMNS} from a order by a.acc desc, task",
)
def m26_slice(spark, sf):
    return rounded(report.accuracy_slice(V.ev_binary(spark, sf), "128b", 3))


_PARAMS = "case model_name when '4b' then 3623973888.0 when '8b' then 8590102528.0 when '27b' then 28991404032.0 else 137440272384.0 end::double"
_SCALING = f"""{V.EV_SQL}, {LIKELIHOODS}, sc as (select {{keys}}, avg(correct) as correct, avg(n_targets) as n_targets, avg({_PARAMS}) as parameters,
  ln(avg(exp(target_likelihood_normalized))) as ln_, ln(avg(exp(target_likelihood_absolute))) as la_ from tv group by all)"""
_SCALING_COLUMNS = f"""{r('correct')} as correct, {r('n_targets')} as n_targets, {r('parameters')} as parameters,
  {r('ln_')} as target_likelihood_normalized, {r('la_')} as target_likelihood_absolute"""


@query("M27_scaling_by_shots", f"with {_SCALING.format(keys='task, model_name, shots')} select task, model_name, shots, {_SCALING_COLUMNS} from sc")
def m27(spark, sf):
    return rounded(report.scaling_table(V.ev(spark, sf), by_shots=True))


@query("M27_scaling", f"with {_SCALING.format(keys='task, model_name')} select task, model_name, {_SCALING_COLUMNS} from sc")
def m27_models(spark, sf):
    return rounded(report.scaling_table(V.ev(spark, sf)))


@query(
    "M28_accuracy_bounds",
    f"""with {_SCALING.format(keys='task, model_name')}, tn as (select task, avg(n_targets) as tn from ev group by task)
    select task, model_name, {r('parameters')} as parameters, {r('exp(ln_)')} as likelihood, {r('correct')} as correct,
      {r('2*(least(greatest(exp(ln_), 0.5), 1.0) - 0.5)')} as acc_worst, {r('least(greatest(exp(ln_) * tn, 0.0), 1.0)')} as acc_best from sc join tn using (task)""",
)
def m28(spark, sf):
    return rounded(report.accuracy_bounds(V.ev(spark, sf)))


@query(
    "M29_long_sequences",
    f"""with {V.EV_TEXT_SQL}, c as (select task, {n_tokens_sql('input')} as n from et)
    select task, count(*) as n_total, count(*) filter (n > 512) as n_long, {r('avg(cast(n > 512 as double))')} as n_long_sequences from c group by task""",
)
def m29(spark, sf):
    return rounded(X.share_longer_than(V.ev_text(spark, sf), 512, ["task"], "input"))
