"""A queries: assessors fitted and scored on the sample tables.

What is learned from tokens has no SQL twin; the rows scored, their labels and the baselines have one.
Assessors on dense features have one altogether: their Newton steps are sums over rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions.features import prepend_features
from evalframe.metrics.binary import TEST_METRICS, metric_columns
from evalframe.ml import assessor as A
from evalframe.ml import newton as N
from evalframe.operators import split as X
from evalframe.plans import views as V
from evalframe.plans.features import WORDS
from evalframe.plans.metrics import BASELINES_PER_TASK, BASELINES_TOTAL
from evalframe.plans.registry import query
from evalframe.plans.splits import ALIGNED, INSTANCE
from evalframe.plans.sqltext import r, rounded
from evalframe.runtime import materialize
from evalframe.sources import catalog

FRACTION = 0.2
LONG = 64  # tokens; leaves most texts whole
HEADLINE = ["accuracy", "roc_auc", "bs", "bs_mcb"]


def _sides(spark, sf, population: bool = False, prepend: bool = True):
    """Train and test rows, prepared and stored once; those of a population begin with the subject's features unless ``prepend`` is off.

    What is split is stored as well: the split reads its rows several times.
    """
    columns = ["sample_key", "task", "model_family", "model_name", "shots", "n_targets", "input", "correct", "conf_normalized", "conf_absolute"]
    rows = V.ev_binary(spark, sf).select(*columns)
    rows = materialize(rows if population else rows.where("model_name = '128b'"), "rows")
    marked = X.split(rows, "instance", FRACTION)
    if population and prepend:
        marked = prepend_features(marked, include_model=True)
    return X.train_and_test(materialize(marked.select(*columns, "split"), "sides"))


@query("A01_fit_assessor")
def a01(spark, sf):
    train, test = _sides(spark, sf)
    scored = A.score(A.fit(train), test)
    return scored.select("sample_key", "task", "correct", F.round("assr", 6).alias("assr"))


def _beside_learned(report):
    """The columns of a report that don't depend on the assessor."""
    learned = [f"test_{m}" for m in metric_columns(TEST_METRICS)]
    return rounded(report.drop(*learned))


@query(
    "A01_scored_rows",
    f"with {V.EV_BINARY_SQL}, {INSTANCE} select sample_key, task, correct, true as is_probability from sp where not drawn",
)
def a01_rows(spark, sf):
    train, test = _sides(spark, sf)
    scored = A.score(A.fit(train), test)
    return scored.select("sample_key", "task", "correct", F.col("assr").between(0, 1).alias("is_probability"))


@query("A02_baselines", BASELINES_TOTAL)
def a02_baselines(spark, sf):
    return _beside_learned(A.train_and_report(*_sides(spark, sf)))


@query("A02_baselines_per_task", BASELINES_PER_TASK)
def a02_baselines_task(spark, sf):
    return _beside_learned(A.train_and_report(*_sides(spark, sf), ["task"]))


@query("A03_baselines_per_task", BASELINES_PER_TASK)
def a03_baselines(spark, sf):
    return _beside_learned(A.train_and_report(*_sides(spark, sf), ["task"], per_task=True))


_POPULATION = f"""{V.EV_BINARY_SQL}, {ALIGNED},
  te as (select cp.* from cp join rk on cp.task = rk.task and cp.h = rk.h where not drawn)"""


@query(
    "A04_population_sizes",
    f"""with {_POPULATION}, sc as (select 'all' as scope, * from te union all select 'largest', * from te where model_name = '128b')
    select scope, cast(sum(n) as bigint) as instance_count, {r('avg(a)')} as test_task_accuracy
    from (select scope, task, count(*) as n, avg(correct) as a from sc group by all) group by scope""",
)
def a04_sizes(spark, sf):
    return a04(spark, sf).select("scope", "instance_count", "test_task_accuracy")


@query(
    "A05_grid_labels",
    f"""with {_POPULATION}, se as (
      select concat(z, '/', model_name) as setting, * from te cross join (select unnest(['small', 'base', 'large']) as z)
      union all select concat(z, '/', shots), * from te cross join (select unnest(['left', 'right']) as z))
    select setting, 'bs_unc' as metric, {r('avg(correct) * (1 - avg(correct))')} as value from se group by setting
    union all select setting, 'task_accuracy', {r('avg(a)')} from (select setting, task, avg(correct) as a from se group by all) group by setting""",
)
def a05_labels(spark, sf):
    return _grid(spark, sf, ["bs_unc", "task_accuracy"])


@query("A02_assessor_report")
def a02(spark, sf):
    train, test = _sides(spark, sf)
    return rounded(A.train_and_report(train, test))


@query("A02_assessor_report_per_task")
def a02_task(spark, sf):
    train, test = _sides(spark, sf)
    return rounded(A.train_and_report(train, test, ["task"]))


@query("A03_assessor_per_task")
def a03(spark, sf):
    train, test = _sides(spark, sf)
    return rounded(A.train_and_report(train, test, ["task"], per_task=True))


@query("A04_population_assessor")
def a04(spark, sf):
    train, test = _sides(spark, sf, population=True)
    model = A.fit(train)
    largest = X.largest_model(test, catalog.MODEL_SIZES)
    scopes = [("all", A.score(model, test)), ("largest", A.score(model, largest))]
    tables = [A.test_report(rows, "assr").withColumn("scope", F.lit(name)) for name, rows in scopes]
    return rounded(tables[0].unionByName(tables[1]))


def _grid(spark, sf, metrics):
    train, test = _sides(spark, sf, population=True)
    capacities = {"small": 1 << 8, "base": 1 << 10, "large": 1 << 12}
    settings = [
        {"name": f"{size}/{subject}", "n_features": n, "where": f"model_name = '{subject}'"}
        for size, n in capacities.items()
        for subject in ("4b", "8b", "27b", "128b")  # all sizes of the view
    ]
    settings += [
        {"name": f"{side}/{shots}", "side": side, "max_length": LONG, "where": f"shots = {shots}"}
        for side in catalog.TRUNCATION_SIDES
        for shots in range(4)
    ]
    return rounded(A.grid(train, test, settings, metrics))


@query("A05_assessor_grid")
def a05(spark, sf):
    return _grid(spark, sf, HEADLINE)


@query(
    "C21_assessor_word_counts",
    f"""with {V.EV_TEXT_SQL}, w as (select unnest(regexp_extract_all(lower(input), '{WORDS}')) as word from et)
    select word, count(*) as word_count from w group by word""",
)
def c21_counts(spark, sf):
    rows = V.ev_text(spark, sf)
    return A.word_contributions(A.fit(rows), rows).select("word", F.col("n").alias("word_count"))


@query("C21_assessor_words")
def c21_assessor(spark, sf):
    rows = V.ev_text(spark, sf)
    words = A.word_contributions(A.fit(rows), rows)
    frequent = words.where("n >= 10").select("word", F.col("contribution").alias("mean_contribution"), F.col("n").alias("word_count"))
    return rounded(frequent.orderBy(F.desc("mean_contribution"), "word"))


# ---- dense features: learned alike by SQL -----------------------------------------------------

FEATURES = {
    "conf_normalized": "conf_normalized",
    "conf_absolute": "conf_absolute",
    "n_targets": "n_targets / cast(5 as double)",
    "length": "length(input) / cast(50 as double)",
}
SIZE = {"size": "case model_name when '4b' then 0.25 when '8b' then 0.5 when '27b' then 0.75 else 1.0 end"}
# a grid's smaller capacity sees one feature; the others are 0 there, and so are their weights
CAPACITIES = {f: e if f == "conf_normalized" else f"case when setting like 'conf/%' then 0 else {e} end" for f, e in FEATURES.items()}
TEXT_FEATURES = {
    "n_chars": "n_chars / cast(5000 as double)",
    "digits": "(length(input) - length(translate(input, '0123456789', ''))) / cast(100 as double)",
    "lines": "(length(input) - length(replace(input, chr(10), ''))) / cast(50 as double)",
}
METRICS = ["accuracy", "roc_auc", "brier"]
METRIC_COLUMNS = ["accuracy", "roc_auc", "bs"]


def _margin(n: int, x: str = "x") -> str:
    return " + ".join(["w0", *(f"w{j} * {x}{j}" for j in range(1, n))])


def newton_sql(name: str, source: str, keys: list[str], features: dict[str, str], steps: int = N.STEPS, ridge: float = N.RIDGE) -> str:
    """CTEs ending in ``name``: (keys, w0, w1, …) of the model fitted to each group of ``source``."""
    n, k = len(features) + 1, ", ".join(keys)
    x = ["1", *(f"x{j}" for j in range(1, n))]
    values = ", ".join(f"coalesce(cast({e} as double), 0) as x{j}" for j, e in enumerate(features.values(), 1))
    ctes = [
        f"{name}_r as materialized (select {k}, cast(correct as double) as y, {values} from {source})",
        f"{name}_0 as (select distinct {k}, {', '.join(f'0::double as w{j}' for j in range(n))} from {name}_r)",
    ]
    # H = L D L' and its two triangular systems, a level of subqueries each: aliases within one are expanded
    levels = []
    for j in range(n):
        levels.append([f"h_{j}_{j}" + "".join(f" - l_{j}_{m} * l_{j}_{m} * d_{m}" for m in range(j)) + f" as d_{j}"])
        levels.append([f"(h_{i}_{j}" + "".join(f" - l_{i}_{m} * l_{j}_{m} * d_{m}" for m in range(j)) + f") / d_{j} as l_{i}_{j}" for i in range(j + 1, n)])
    levels += [[f"g_{i}" + "".join(f" - l_{i}_{m} * z_{m}" for m in range(i)) + f" as z_{i}"] for i in range(n)]
    levels += [[f"z_{i} / d_{i}" + "".join(f" - l_{m}_{i} * s_{m}" for m in range(i + 1, n)) + f" as s_{i}"] for i in reversed(range(n))]
    gradient = [f"avg((p - y) * {x[i]}) + {ridge} * any_value(w{i}) as g_{i}" for i in range(n)]
    hessian = [f"avg(p * (1 - p) * {x[i]} * {x[j]}) + {ridge if i == j else 0.0} as h_{i}_{j}" for i in range(n) for j in range(i + 1)]
    old = ", ".join(f"any_value(w{i}) as w{i}" for i in range(n))
    for step in range(steps):
        last = name if step == steps - 1 else f"{name}_{step + 1}"
        ctes.append(f"""{name}_s{step} as materialized (select {k}, {old}, {', '.join(gradient + hessian)}
          from (select *, 1 / (1 + exp(-({_margin(n)}))) as p from {name}_r join {name}_{step} using ({k})) group by {k})""")
        solved = f"{name}_s{step}"
        for level in filter(None, levels):
            solved = f"(select *, {', '.join(level)} from {solved})"
        ctes.append(f"{last} as materialized (select {k}, {', '.join(f'w{i} - s_{i} as w{i}' for i in range(n))} from {solved})")
    return ",\n  ".join(ctes)


def scored_sql(name: str, models: str, source: str, keys: list[str], features: dict[str, str]) -> str:
    """CTE ``name``: the rows of ``source`` with their probability ``assr``."""
    values = ", ".join(f"coalesce(cast({e} as double), 0) as x{j}" for j, e in enumerate(features.values(), 1))
    weights = ", ".join(f"coalesce(w{j}, 0) as w{j}" for j in range(len(features) + 1))
    return f"""{name} as materialized (select * exclude (assr), round(1 / (1 + exp(-({_margin(len(features) + 1)}))), 9) as assr
      from (select s.*, {values}, {weights} from {source} s left join {models} m using ({', '.join(keys)})))"""


def light_report_sql(name: str, source: str, keys: list[str]) -> str:
    """CTE ``name``: rows, accuracy, AUROC by ranks, and Brier score of ``assr`` per group."""
    k = ", ".join(keys)
    return f"""{name} as (select {k}, count(*) as instance_count, {r('avg(cast(cast(assr > 0.5 as int) = correct as double))')} as test_accuracy,
      {r("case when sum(correct) between 1 and count(*) - 1 then (sum(case when correct = 1 then mid end) - sum(correct)*(sum(correct)+1)/2.0) / (sum(correct)*(count(*)-sum(correct))) else 'NaN'::double end")} as test_roc_auc,
      {r('avg((correct - assr) * (correct - assr))')} as test_bs
      from (select *, rank() over (partition by {k} order by assr) + (count(*) over (partition by {k}, assr) - 1)/2.0 as mid from {source}) group by {k})"""


REPORT = "instance_count, test_accuracy, test_roc_auc, test_bs"
_ONE = f"""with {V.EV_BINARY_SQL}, {INSTANCE}, tr as (select *, 0 as g from sp where drawn), te as (select *, 0 as g from sp where not drawn)"""
_POP = f"""with {_POPULATION}, tr as (select cp.*, 0 as g from cp join rk on cp.task = rk.task and cp.h = rk.h where drawn)"""


def _scored(train, test, features, keys=None):
    scored = N.score(N.fit(train, features, keys), test, features, keys)
    return scored.withColumn("assr", F.round("assr", 9))


def _newton_report(scored, keys=None):
    report = A.test_report(scored, "assr", keys, METRICS)
    return rounded(report.select(*(keys or []), "instance_count", *[f"test_{m}" for m in METRIC_COLUMNS]))


@query(
    "A01_newton_scores",
    f"""{_ONE}, {newton_sql('nw', 'tr', ['g'], FEATURES)}, {scored_sql('sc', 'nw', 'te', ['g'], FEATURES)}
    select sample_key, task, correct, {r('assr')} as assr from sc""",
)
def a01_newton(spark, sf):
    return rounded(_scored(*_sides(spark, sf), FEATURES).select("sample_key", "task", "correct", "assr"))


@query(
    "A02_newton_report",
    f"""{_ONE}, {newton_sql('nw', 'tr', ['g'], FEATURES)}, {scored_sql('sc', 'nw', 'te', ['g'], FEATURES)}, {light_report_sql('lr', 'sc', ['g'])}
    select {REPORT} from lr""",
)
def a02_newton(spark, sf):
    return _newton_report(_scored(*_sides(spark, sf), FEATURES))


@query(
    "A02_newton_report_per_task",
    f"""{_ONE}, {newton_sql('nw', 'tr', ['g'], FEATURES)}, {scored_sql('sc', 'nw', 'te', ['g'], FEATURES)}, {light_report_sql('lr', 'sc', ['task'])}
    select task, {REPORT} from lr""",
)
def a02_newton_task(spark, sf):
    return _newton_report(_scored(*_sides(spark, sf), FEATURES), ["task"])


@query(
    "A03_newton_models",
    f"""{_ONE}, {newton_sql('nw', 'tr', ['task'], FEATURES)} select task, {', '.join(f'{r(f"w{j}")} as w{j}' for j in range(5))} from nw""",
)
def a03_models(spark, sf):
    return rounded(N.fit(_sides(spark, sf)[0], FEATURES, ["task"]))


@query(
    "A03_newton_per_task",
    f"""{_ONE}, {newton_sql('nw', 'tr', ['task'], FEATURES)}, {scored_sql('sc', 'nw', 'te', ['task'], FEATURES)}, {light_report_sql('lr', 'sc', ['task'])}
    select task, {REPORT} from lr""",
)
def a03_newton(spark, sf):
    return _newton_report(_scored(*_sides(spark, sf), FEATURES, ["task"]), ["task"])


@query(
    "A04_newton_population",
    f"""{_POP}, {newton_sql('nw', 'tr', ['g'], FEATURES | SIZE)}, {scored_sql('sc', 'nw', '(select *, 0 as g from te)', ['g'], FEATURES | SIZE)},
    al as (select 'all' as scope, correct, assr from sc union all select 'largest', correct, assr from sc where model_name = '128b'),
    {light_report_sql('lr', 'al', ['scope'])} select scope, {REPORT} from lr""",
)
def a04_newton(spark, sf):
    scored = _scored(*_sides(spark, sf, population=True, prepend=False), FEATURES | SIZE)
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.col("model_name") == "128b", F.lit("largest"))))
    return _newton_report(scored.withColumn("scope", F.explode(scopes)), ["scope"])


_SETTINGS = """select *, unnest(['conf/' || model_name, 'all/' || model_name, 'all/' || shots]) as setting from"""


@query(
    "A05_newton_grid",
    f"""{_POP}, trs as ({_SETTINGS} tr), tes as ({_SETTINGS} te), {newton_sql('nw', 'trs', ['setting'], CAPACITIES)},
    {scored_sql('sc', 'nw', 'tes', ['setting'], CAPACITIES)}, {light_report_sql('lr', 'sc', ['setting'])} select setting, {REPORT} from lr""",
)
def a05_newton(spark, sf):
    cells = F.array(*[F.concat(F.lit(f"{kind}/"), F.col(by).cast("string")) for kind, by in (("conf", "model_name"), ("all", "model_name"), ("all", "shots"))])
    train, test = (side.withColumn("setting", F.explode(cells)) for side in _sides(spark, sf, population=True, prepend=False))
    return _newton_report(_scored(train, test, CAPACITIES, ["setting"]), ["setting"])


@query(
    "C21_feature_contributions",
    f"""with {V.EV_TEXT_SQL}, tx as (select * from et where correct in (0, 1)), {newton_sql('nw', 'tx', ['task'], TEXT_FEATURES)},
    me as (select task, {', '.join(f'avg({e}) as m{j}' for j, e in enumerate(TEXT_FEATURES.values(), 1))} from tx group by task)
    {' union all '.join(f"select task, '{f}' as feature, {r(f'w{j}')} as weight, {r(f'm{j}')} as mean_value, {r(f'w{j} * m{j}')} as contribution from nw join me using (task)" for j, f in enumerate(TEXT_FEATURES, 1))}""",
)
def c21_features(spark, sf):
    rows = V.ev_text(spark, sf)
    return rounded(N.contributions(N.fit(rows, TEXT_FEATURES, ["task"]), rows, TEXT_FEATURES, ["task"]))
