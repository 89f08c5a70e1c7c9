"""P queries: projections and scalar functions on samples, texts and logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions import features as P
from evalframe.functions import text as X
from evalframe.operators.flatten import stack_frames
from evalframe.plans import views as V
from evalframe.plans.registry import query
from evalframe.plans.sources import EV_NAMED, ev_named, raw_documents, sql_list
from evalframe.plans.sqltext import r, rounded
from evalframe.sources import catalog
from evalframe.sources.documents import flatten_documents, paths_of
from evalframe.sources.reports import flatten_record

WORDS = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def n_tokens_sql(column: str) -> str:
    return f"len(regexp_extract_all({column}, '{WORDS}'))"


@query("P01_n_targets", f"with {V.EV_SQL} select sample_key, cast(len(targets) as int) as n_targets from ev")
def p01(spark, sf):
    return V.ev(spark, sf).select("sample_key", P.n_targets().alias("n_targets"))


@query("P02_conf_normalized", f"with {V.EV_SQL} select sample_key, {r('conf_normalized')} as conf_normalized from ev")
def p02(spark, sf):
    return rounded(V.ev(spark, sf).select("sample_key", P.confidence("normalized_scores").alias("conf_normalized")))


@query("P03_conf_absolute", f"with {V.EV_SQL} select sample_key, {r('conf_absolute')} as conf_absolute from ev")
def p03(spark, sf):
    return rounded(V.ev(spark, sf).select("sample_key", P.confidence("absolute_scores").alias("conf_absolute")))


@query(
    "P04_prepend_features",
    f"""with {V.EV_SQL} select sample_key, 'model' as kind, concat('FAM: ', model_family, ' SIZE:', model_name, '   ', input) as input from ev
    union all select sample_key, 'targets', concat(' N_TARGETS: ', n_targets, '  ', input) from ev where model_name = '128b'""",
)
def p04(spark, sf):
    ev = V.ev(spark, sf)
    one = ev.where(F.col("model_name") == "128b")
    pick = lambda df, kind: df.select("sample_key", F.lit(kind).alias("kind"), "input")
    return pick(P.prepend_features(ev, include_model=True), "model").unionByName(
        pick(P.prepend_features(one, include_n_targets=True), "targets")
    )


@query("P05_text_and_label", f"with {V.EV_BINARY_SQL} select input as text, correct as label from eb")
def p05(spark, sf):
    return P.text_and_label(V.ev_binary(spark, sf))


@query(
    "P06_text_options_label",
    f"""with {V.EV_SQL} select input as text, array_to_string(targets, ',') as options, cast(list_position(values_, list_max(values_)) - 1 as int) as label from ev""",
)
def p06(spark, sf):
    return P.text_options_label(V.ev(spark, sf)).withColumn("options", F.array_join("options", ","))


@query(
    "P07_stack_splits",
    f"with {V.EV_BINARY_SQL} select case when q <= 25 then 'train' else 'test' end as split, correct as label, count(*) as n from eb group by all",
)
def p07(spark, sf):
    rows = V.ev_binary(spark, sf)
    sides = [P.text_and_label(rows.where(c)) for c in (F.col("q") <= 25, F.col("q") > 25)]
    return P.stack_splits(*sides).groupBy("split", "label").agg(F.count("*").alias("n"))


@query(
    "P08_tokenize",
    f"""with t as (select doc_id, regexp_extract_all(text, '{WORDS}') as w from documents)
    select 'right' as side, doc_id, cast(len(w) as int) as n_tokens, array_to_string(w[1:8], ' ') || repeat(' [PAD]', greatest(8 - len(w), 0)) as tokens,
      cast(least(len(w), 8) as int) as n_real from t
    union all select 'left', doc_id, cast(len(w) as int), array_to_string(w[greatest(len(w) - 8, 0) + 1:len(w)], ' ') || repeat(' [PAD]', greatest(8 - len(w), 0)),
      cast(least(len(w), 8) as int) from t""",
)
def p08(spark, sf):
    documents = V.table(spark, sf, "documents").select("doc_id", "text")
    sides = []
    for side in ("right", "left"):
        done = X.tokenize(documents, 8, side)
        real = F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m)
        sides.append(done.select(F.lit(side).alias("side"), "doc_id", "n_tokens", F.array_join("tokens", " ").alias("tokens"), real.alias("n_real")))
    return stack_frames(*sides)


@query(
    "P09_expand_options",
    f"""with {V.EV_SQL} select sample_key, cast(len(targets) as int) as n_options, array_to_string(targets, ',') as options,
      cast(list_position(values_, list_max(values_)) - 1 as int) as label from ev""",
)
def p09(spark, sf):
    ev = V.ev(spark, sf)
    values = P.value_per_target(F.col("targets"), F.col("target_values"))
    rows = ev.select("sample_key", F.col("input").alias("text"), F.col("targets").alias("options"), P.first_argmax(values).alias("label"), "n_targets")
    back = X.regroup_options(X.expand_options(rows, F.col("n_targets"), "sample_key"), "sample_key")
    return back.select("sample_key", F.size("options").alias("n_options"), F.array_join("options", ",").alias("options"), "label")


@query(
    "P10_leak_label",
    f"with {V.EV_BINARY_SQL} select sample_key, concat(case when correct = 1 then 'correct' else 'wrong' end, '. ', input) as input from eb",
)
def p10(spark, sf):
    return P.leak_label(V.ev_binary(spark, sf)).select("sample_key", "input")


@query(
    "P11_model_parameters",
    f"""with {V.EV_SQL} select model_name, case model_name when '4b' then 3623973888 when '8b' then 8590102528 when '27b' then 28991404032
      when '128b' then 137440272384 end as parameters, count(*) as n from ev group by all""",
)
def p11(spark, sf):
    parameters = P.lookup("model_name", catalog.MODEL_PARAMETERS).cast("bigint")
    return V.ev(spark, sf).groupBy("model_name", parameters.alias("parameters")).agg(F.count("*").alias("n"))


LIKELIHOODS = """tl as (select *, list_filter(range(1, n_targets + 1), lambda i: values_[i] = 1) as hits from ev),
  tv as (select *, case when len(hits) > 0 then list_sum(list_transform(hits, lambda i: normalized_scores[i])) end as target_likelihood_normalized,
    case when len(hits) > 0 then list_sum(list_transform(hits, lambda i: absolute_scores[i])) end as target_likelihood_absolute,
    case when len(hits) > 0 then list_sum(list_transform(hits, lambda i: normalized_scores[i] / length(targets[i]))) end as target_likelihood_normalized_char,
    case when len(hits) > 0 then list_sum(list_transform(hits, lambda i: absolute_scores[i] / length(targets[i]))) end as target_likelihood_absolute_char from tl)"""
_LIKELIHOOD_NAMES = [f"target_likelihood_{k}{c}" for c in ("", "_char") for k in ("normalized", "absolute")]


@query(
    "P12_correct_target_likelihood",
    f"with {V.EV_SQL}, {LIKELIHOODS} select sample_key, {', '.join(f'{r(c)} as {c}' for c in _LIKELIHOOD_NAMES)} from tv",
)
def p12(spark, sf):
    return rounded(P.correct_target_likelihoods(V.ev(spark, sf)).select("sample_key", *_LIKELIHOOD_NAMES))


@query(
    "P13_log_mean_exp",
    f"with {V.EV_SQL}, {LIKELIHOODS} select task, {r('ln(avg(exp(target_likelihood_normalized)))')} as log_mean from tv group by task",
)
def p13(spark, sf):
    rows = P.correct_target_likelihoods(V.ev(spark, sf))
    return rounded(rows.groupBy("task").agg(P.log_mean_exp("target_likelihood_normalized").alias("log_mean")))


@query(
    "P14_accuracy_bounds",
    f"""with {V.EV_SQL} select sample_key, {r('2*(least(greatest(conf_normalized, 0.5), 1.0) - 0.5)')} as worst,
    {r('least(greatest(conf_normalized * n_targets, 0.0), 1.0)')} as best, {r('least(greatest(conf_normalized * 2, 0.0), 1.0)')} as best_binary from ev""",
)
def p14(spark, sf):
    x = F.col("conf_normalized")
    return rounded(
        V.ev_conf(spark, sf).select(
            "sample_key", P.worst_accuracy(x).alias("worst"), P.best_accuracy(x, F.col("n_targets")).alias("best"),
            P.best_accuracy(x, F.lit(2)).alias("best_binary"),
        )
    )


_EPS = "2.220446049250313e-16::double"


@query(
    "P15_log_loss_and_kl",
    f"""with {V.EV_MC_SQL} select vec_id, {r(f'-ln(least(greatest(probs[label + 1], {_EPS}), 1 - {_EPS}))')} as log_loss,
    {r('-ln(probs[label + 1]) - 1 + list_sum(probs)')} as kl from probs""",
)
def p15(spark, sf):
    probs = V.ev_mc(spark, sf).withColumn("probs", P.softmax(F.col("logits")))
    label = F.col("label")
    return rounded(
        probs.select("vec_id", P.log_loss(F.col("probs"), label).alias("log_loss"), P.kl_to_one_hot(F.col("probs"), label).alias("kl"))
    )


@query(
    "P16_softmax",
    f"""with {V.EV_MC_SQL} select vec_id, {r('probs[1]')} as p0, {r('probs[10]')} as p9,
    {r('exp(two[2]) / (exp(two[1]) + exp(two[2]))')} as p_binary from probs""",
)
def p16(spark, sf):
    probs = P.softmax(F.col("logits"))
    two = P.probability_of_one(F.col("two"))
    return rounded(V.ev_mc(spark, sf).select("vec_id", F.get(probs, F.lit(0)).alias("p0"), F.get(probs, F.lit(9)).alias("p9"), two.alias("p_binary")))


@query(
    "P17_decide",
    f"""with {V.EV_MC_SQL} select vec_id, cast(list_position(logits, list_max(logits)) - 1 as int) as choice,
    cast(exp(two[2]) / (exp(two[1]) + exp(two[2])) > 0.5 as int) as decision from mc""",
)
def p17(spark, sf):
    two = P.probability_of_one(F.col("two"))
    return V.ev_mc(spark, sf).select("vec_id", P.first_argmax(F.col("logits")).alias("choice"), P.decide(two).alias("decision"))


@query("P18_prefix_names", f"with {V.EV_BINARY_SQL} select task, {r('avg(correct)')} as test_accuracy, count(*) as test_n from eb group by task")
def p18(spark, sf):
    table = V.ev_binary(spark, sf).groupBy("task").agg(F.avg("correct").alias("accuracy"), F.count("*").alias("n"))
    return rounded(table.select("task", *P.prefixed(["accuracy", "n"], "test_")))


@query(
    "P19_labels",
    f"""with {EV_NAMED} select task, case when length(task) > 15 then concat(left(task, 12), '...') else task end as short,
    printf('%s (%.2f)', case when length(task) > 22 then concat(left(task, 19), '...') else task end, avg(correct)) as label from en group by task""",
)
def p19(spark, sf):
    table = ev_named(spark, sf).groupBy("task").agg(F.avg("correct").alias("acc"))
    return table.select("task", P.shorten(F.col("task")).alias("short"), P.report_label(F.col("task"), F.col("acc")).alias("label"))


@query(
    "P20_flatten_record",
    f"""with {V.LOG_FILES_SQL} select task as task_task_name, model_family as model_model_family, model_name as model_model_name,
    case model_name when '4b' then 3623973888 when '8b' then 8590102528 when '27b' then 28991404032 else 137440272384 end as model_flop_matched_non_embedding_params from lf""",
)
def p20(spark, sf):
    return flatten_record(raw_documents(V.log_files(spark, sf)).select("task", "model"), sep="_")


# documents of three shapes and depths
_SHAPES = """case event_id % 3
  when 0 then to_json(named_struct('id', event_id, 'user', named_struct('id', user_id, 'type', event_type)))
  when 1 then to_json(named_struct('id', event_id, 'user', named_struct('id', user_id, 'last', named_struct('value', named_struct('of', value)))))
  else to_json(named_struct('id', event_id, 'tags', array(event_type, props))) end"""


@query(
    "P20_flatten_documents",
    f"""select event_id, event_id as "id", case when event_id % 3 < 2 then user_id end as "user_id", case when event_id % 3 = 0 then event_type end as "user_type",
      case when event_id % 3 = 1 then {r('value')} end as "user_last_value_of",
      case when event_id % 3 = 2 then len(event_type) + 2 + len(to_json(props)) + 3 end as n_tags from events""",
)
def p20_documents(spark, sf):
    """Columns learned from the documents; arrays are JSON text."""
    docs = V.table(spark, sf, "events").select("event_id", F.expr(_SHAPES).alias("value"))
    flat = flatten_documents(docs, sep="_")
    return rounded(flat.withColumn("n_tags", F.length("tags").cast("long")).drop("tags"))


@query(
    "P20_document_paths",
    """with d as (select event_id % 3 as kind, count(*) as n from events group by 1),
    p as (select * from (values (0, 'id', 'BIGINT'), (0, 'user.id', 'BIGINT'), (0, 'user.type', 'STRING'), (1, 'id', 'BIGINT'), (1, 'user.id', 'BIGINT'),
      (2, 'id', 'BIGINT'), (2, 'tags', 'ARRAY')) as t(kind, path, type))
    select path, type, cast(sum(n) as bigint) as n from p join d using (kind) group by all""",
)
def p20_paths(spark, sf):
    docs = V.table(spark, sf, "events").select("event_id", F.expr(_SHAPES).alias("value"))
    paths = paths_of(docs, ["event_id"]).where("path <> 'user.last.value.of'")  # a number's own type differs from row to row
    return paths.groupBy("path", "type").agg(F.count("*").alias("n"))


_RATES = catalog.PRICES_PER_1000_TOKENS | {"all": sum(catalog.PRICES_PER_1000_TOKENS.values())}
_RATE_ROWS = ", ".join(f"('{k}', {v!r}::double)" for k, v in _RATES.items())


def _cost_sql(scope: str, source: str) -> str:
    total = f"select cast(sum({n_tokens_sql('input')}) + 64 * count(*) as bigint) as n_tokens_total from {source}"
    return f"""select '{scope}' as scope, engine, n_tokens_total, {r('rate * n_tokens_total / 1000')} as price
      from ({total}) x, (values {_RATE_ROWS}) as rt(engine, rate)"""


@query(
    "P21_token_cost",
    f"""with {EV_NAMED} {_cost_sql('all', 'en')} union all
    {_cost_sql('lite', f"(select * from en where task in {sql_list(catalog.LITE_TASKS)})")}""",
)
def p21(spark, sf):
    named = ev_named(spark, sf)
    scope = F.when(F.col("task").isin(catalog.LITE_TASKS), F.array(F.lit("all"), F.lit("lite"))).otherwise(F.array(F.lit("all")))
    return rounded(X.token_cost(named.select("input", F.explode(scope).alias("scope")), ["scope"], column="input"))


@query("P22_random_baseline", f"with {V.EV_SQL} select n_targets, {r('1.0::double / n_targets')} as random, count(*) as n from ev group by all")
def p22(spark, sf):
    return rounded(V.ev(spark, sf).groupBy("n_targets", P.random_baseline().alias("random")).agg(F.count("*").alias("n")))


@query(
    "P23_subject_prediction",
    f"""with {V.EV_BINARY_SQL} select sample_key, ['A','B','C','D','E'][list_position(normalized_scores, list_max(normalized_scores))] as subject, correct,
      cast(assr > 0.5 as int) as assessor from eb where correct <> cast(assr > 0.5 as int)""",
)
def p23(spark, sf):
    rows = V.ev_binary(spark, sf).select(
        "sample_key", P.subject_prediction(F.col("normalized_scores"), "ABCDE").alias("subject"), "correct", P.decide(F.col("assr")).alias("assessor")
    )
    return rows.where("correct <> assessor")


@query(
    "P24_same_instance",
    f"""with {V.FEWSHOT_SQL}, pf as (select *, (select coalesce(max(i), 0) from range(1, least(length(input), length(reference)) + 1) as g(i)
        where left(input, cast(i as int)) = left(reference, cast(i as int))) as shared from fs)
    select conv_id, turn, cast(greatest(shared - 1, 0) as int) as shared_index,
      ends_with(input, substr(reference, cast(greatest(shared - 1, 0) as int) + 1)) as same from pf""",
)
def p24(spark, sf):
    text, reference = F.col("input"), F.col("reference")
    return V.fewshot(spark, sf).select(
        "conv_id", "turn", X.last_shared_index(text, reference).alias("shared_index"), X.same_instance(text, reference).alias("same")
    )
