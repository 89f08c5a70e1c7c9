"""K queries: consistency audits of logs and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions.features import confidence
from evalframe.operators import audit as K
from evalframe.operators import quality
from evalframe.operators.flatten import eval_samples
from evalframe.operators.split import sample_fraction, split_instances_aligned
from evalframe.plans import views as V
from evalframe.plans.quality import DEDUPED
from evalframe.plans.registry import query
from evalframe.plans.splits import ALIGNED, FRACTION
from evalframe.plans.sqltext import md5_rank_split, r, rounded
from evalframe.sources import logs


def _samples(spark, sf):
    return logs.samples_of(logs.queries_of(V.log_files(spark, sf)))


@query(
    "K01_input_mismatches",
    f"""with {V.LOG_SAMPLES_SQL} select a.task, a.model_name, a.q as query_idx, a.s as sample_idx, a.input, b.input as reference_input
    from ls a join ls b on a.task = b.task and a.q = b.q and a.s = b.s and b.model_name = '128b' where a.model_name <> '128b' and a.input <> b.input""",
)
def k01(spark, sf):
    rows = K.input_mismatches(_samples(spark, sf), "128b")
    return rows.select("task", "model_name", "query_idx", "sample_idx", "input", "reference_input")


FAULTS = f"""{V.LOG_SAMPLES_SQL}, fm as (select task, min((model_family, model_name)) as m from lf group by task),
  rf as (select lf.* from lf join fm on lf.task = fm.task and (lf.model_family, lf.model_name) = fm.m where lf.n_queries > 0),
  ot as (select lf.task, lf.model_family, lf.model_name, lf.n_queries, rf.model_name as ref_name, rf.n_queries as ref_n from lf join rf on lf.task = rf.task and lf.model_name <> rf.model_name),
  qm as (select ot.task, ot.model_family, ot.model_name, a.q, ot.ref_name,
      (a.function = b.function and a.n_samples = b.n_samples and a.shots is not distinct from b.shots) as same_meta
    from ot join lq a on a.task = ot.task and a.model_name = ot.model_name join lq b on b.task = ot.task and b.model_name = ot.ref_name and b.q = a.q),
  so as (select distinct qm.task, qm.model_family, qm.model_name from qm join ls a on a.task = qm.task and a.model_name = qm.model_name and a.q = qm.q
    join ls b on b.task = qm.task and b.model_name = qm.ref_name and b.q = qm.q and b.s = a.s where qm.same_meta and a.input <> b.input),
  faults as (select task, model_family, model_name, 'no queries' as reason from ot where n_queries = 0
    union all select task, model_family, model_name, 'different number of queries' from ot where n_queries > 0 and n_queries <> ref_n
    union all select distinct task, model_family, model_name, 'different query' from qm where not same_meta
    union all select task, model_family, model_name, 'different sample order' from so)"""


@query("K02_order_faults", f"with {FAULTS} select * from faults")
def k02(spark, sf):
    return K.order_faults(V.log_files(spark, sf))


@query(
    "K02_faulty_models",
    f"with {FAULTS} select task, array_to_string(list_sort(list(distinct concat(model_family, '/', model_name))), ',') as models from faults group by task",
)
def k02_models(spark, sf):
    faulty = K.faulty_models(K.order_faults(V.log_files(spark, sf)))
    return faulty.select("task", F.array_join("models", ",").alias("models"))


@query(
    "K03_query_meta_equal",
    f"""with {V.LOG_QUERIES_SQL} select a.task, a.model_name, a.q as query_idx,
    (a.function is not distinct from b.function and a.n_samples is not distinct from b.n_samples and a.shots is not distinct from b.shots) as same
    from lq a join lq b on a.task = b.task and a.q = b.q and b.model_name = '128b' where a.model_name <> '128b'""",
)
def k03(spark, sf):
    meta = logs.queries_of(V.log_files(spark, sf)).select("task", "model_name", "query_idx", F.struct("function", "n_samples", "shots").alias("meta"))
    reference = meta.where("model_name = '128b'").select("task", "query_idx", F.col("meta").alias("expected"))
    pairs = meta.where("model_name <> '128b'").join(reference.hint("merge"), ["task", "query_idx"])  # as in input_mismatches
    return pairs.select("task", "model_name", "query_idx", K.query_meta_equal(F.col("meta"), F.col("expected")).alias("same"))


SERIES = """sr0 as (select *, case when lag(query_type) over w = query_type and shots is not null and coalesce(lag(shots) over w, 0) + 1 = shots then 0 else 1 end as fresh
    from lq window w as (partition by task, model_name order by q)),
  sr as (select *, cast(sum(fresh) over (partition by task, model_name order by q) - 1 as int) as series from sr0)"""


@query("K04_shot_series", f"with {V.LOG_QUERIES_SQL}, {SERIES} select task, model_family, model_name, q as query_idx, query_type, shots, series from sr")
def k04(spark, sf):
    return K.shot_series(V.log_files(spark, sf))


@query(
    "K05_shot_violations",
    f"""with {V.LOG_SAMPLES_SQL}, {SERIES}, hd as (select task, model_name, series, min(q) as head from sr group by all),
    pp as (select sr.task, sr.model_family, sr.model_name, sr.series, sr.q as query_idx, a.s as sample_idx, a.input, b.input as reference
      from sr join hd on sr.task = hd.task and sr.model_name = hd.model_name and sr.series = hd.series and sr.q > hd.head
      join ls a on a.task = sr.task and a.model_name = sr.model_name and a.q = sr.q
      join ls b on b.task = sr.task and b.model_name = sr.model_name and b.q = hd.head and b.s = a.s),
    px as (select *, (select coalesce(max(i), 0) from range(1, least(length(input), length(reference)) + 1) as g(i)
      where left(input, cast(i as int)) = left(reference, cast(i as int))) as shared from pp)
    select * exclude (shared) from px where not ends_with(input, substr(reference, cast(greatest(shared - 1, 0) as int) + 1))""",
)
def k05(spark, sf):
    return K.shot_violations(V.log_files(spark, sf))


@query(
    "K06_query_totals",
    f"""with {V.LOG_QUERIES_SQL}, t as (select lf.task, lf.n_queries, coalesce(sum(lq.n_samples), 0) as ns from lf left join lq on lf.task = lq.task and lf.model_name = lq.model_name group by lf.task, lf.model_name, lf.n_queries)
    select task, cast(sum(n_queries) as bigint) as n_queries, cast(sum(ns) as bigint) as n_samples from t group by task
    union all select 'total', cast(sum(n_queries) as bigint), cast(sum(ns) as bigint) from t""",
)
def k06(spark, sf):
    return K.query_totals(V.log_files(spark, sf))


@query(
    "K06_sample_sizes",
    f"""with {V.LOG_QUERIES_SQL} select lf.task, lf.model_family, lf.model_name, coalesce(string_agg(cast(lq.n_samples as varchar), ',' order by lq.q), '') as sizes
    from lf left join lq on lf.task = lq.task and lf.model_name = lq.model_name group by all""",
)
def k06_sizes(spark, sf):
    sizes = K.sample_sizes(V.log_files(spark, sf))
    return sizes.withColumn("sizes", F.array_join(F.transform("sizes", lambda s: s.cast("string")), ","))


_EQUAL = """pm as (select task, model_name, input, count(*) as c from {src} group by all), md as (select task, model_name, count(*) as n from {src} group by all),
  mt as (select task, count(*) as n_models, count(distinct n) = 1 as same_count from md group by task),
  pi as (select task, input, count(*) as k, min(c) = max(c) as even from pm group by all)
  select pi.task, mt.n_models, mt.same_count, bool_and(even and k = n_models) as same_instances from pi join mt using (task) group by all"""


@query("K07_equal_instances_in_split", f"with {V.EV_BINARY_SQL}, {ALIGNED}, te as (select cp.* from cp join rk on cp.task = rk.task and cp.h = rk.h where not rk.drawn), {_EQUAL.format(src='te')}")
def k07(spark, sf):
    test = split_instances_aligned(V.ev_binary(spark, sf), FRACTION).where("split = 'test'")
    return K.equal_instances(test)


@query("K07_equal_instances_in_logs", f"with {V.LOG_PAIRS_SQL}, {_EQUAL.format(src='es')}")
def k07_logs(spark, sf):
    return K.equal_instances(eval_samples(V.log_files(spark, sf)))


_CELL = lambda m: f"nullif(count(*) filter (model_name = '{m}'), 0) as \"{m}\""


@query(
    "K08_model_counts",
    f"""with {V.LOG_PAIRS_SQL}, c as (select task, {', '.join(_CELL(m) for m in V.MODELS)} from es group by task)
    select *, {' and '.join(f'coalesce("{m}" = "4b", false)' for m in V.MODELS[1:])} as equal from c""",
)
def k08(spark, sf):
    return K.model_counts(eval_samples(V.log_files(spark, sf)), V.MODELS)


@query(
    "K09_same_size_for_all_shots",
    f"with {V.LOG_PAIRS_SQL}, c as (select task, shots, count(*) as n from es group by all) select task from c group by task having count(distinct n) = 1",
)
def k09(spark, sf):
    return K.same_size_for_all_shots(eval_samples(V.log_files(spark, sf)))


@query(
    "K10_dataset_stats",
    f"""with {V.EV_SQL}, c as (select task, model_name, shots, count(*) as n from ev group by all)
    select (select count(distinct task) from ev) as n_tasks, (select count(*) from ev) as n_records, (select count(distinct shots) from ev) as n_shots,
      (select count(distinct model_name) from ev) as n_models, (select cast(max(n) as bigint) from (select sum(n) as n from c group by model_name, shots)) as n_unique_instances,
      (select count(distinct k) = 1 from (select count(distinct n) as k from c group by task)) as equal_per_shot_and_model""",
)
def k10(spark, sf):
    return K.dataset_stats(V.ev(spark, sf))


@query(
    "K11_target_mismatches",
    f"""with {V.LOG_PAIRS_SQL} select task, model_name, query_idx, sample_idx, cast(len(targets) as int) as n_targets,
    cast(len(list_distinct(targets)) as int) as n_values from paired where len(targets) <> len(list_distinct(targets))""",
)
def k11(spark, sf):
    rows = K.target_mismatches(eval_samples(V.log_files(spark, sf)))
    return rows.select("task", "model_name", "query_idx", "sample_idx", F.size("targets").alias("n_targets"), F.size("target_values").alias("n_values"))


@query(
    "K11_single_target_confidence",
    f"""with {V.EV_SQL} select task, correct, count(*) as count, {r('max(exp(absolute_scores[1]))')} as max_conf from ev where 1 + q % 4 = 1 group by all""",
)
def k11_single(spark, sf):
    kept = F.expr("1 + q % 4")
    rows = V.ev(spark, sf).withColumns({"targets": F.slice("targets", F.lit(1), kept), "absolute_scores": F.slice("absolute_scores", F.lit(1), kept)})
    return rounded(K.single_target_confidence(rows.withColumn("conf_absolute", confidence("absolute_scores"))))


@query(
    "K12_duplicate_instances",
    f"""with {DEDUPED}, ty as (select task, count(distinct query_type) as n_types from ev group by task having n_types > 1)
    select ty.task, ty.n_types, count(*) / 2 as n_duplicates from ded join ty using (task) group by all""",
)
def k12(spark, sf):
    ev = V.ev(spark, sf)
    return K.duplicate_instances(ev, quality.remove_duplicate_queries(ev))


@query(
    "K13_target_count_spread",
    f"with {V.EV_SQL}, s as (select task, {r('avg(n_targets)')} as mean, {r('var_samp(n_targets)')} as var, count(*) as count from ev group by task) select * from s",
)
def k13(spark, sf):
    return rounded(K.target_count_spread(V.ev(spark, sf)))


@query("K13_spread_counts", f"with {V.LOG_PAIRS_SQL}, s as (select task, {r('var_samp(len(targets))')} as var from es group by task) select var, count(*) as n from s group by var")
def k13_counts(spark, sf):
    samples = eval_samples(V.log_files(spark, sf)).withColumn("n_targets", F.size("targets"))
    return rounded(K.target_count_spread(samples)).groupBy("var").agg(F.count("*").alias("n"))


_LIST = ["Brand#9", "Brand#3", "Brand#404", "Brand#11", "Brand#1"]


@query("K14_nonempty_in_list_order", f"with {V.EV_SQL} select cast(list_position({_LIST!r}, task) - 1 as int) as pos, task from ev where task in {tuple(_LIST)!r} group by task")
def k14(spark, sf):
    return K.nonempty_in_list_order(V.ev(spark, sf), _LIST)


@query(
    "K15_sizes_by_query_type",
    f"""with {DEDUPED} select 'before' as stage, query_type, count(distinct task) as n_tasks, count(*) as n_rows from ev group by all
    union all select 'after', query_type, count(distinct task), count(*) from ded group by all""",
)
def k15(spark, sf):
    ev = V.ev(spark, sf)
    stage = lambda df, name: K.sizes_by_query_type(df).select(F.lit(name).alias("stage"), "query_type", "n_tasks", "n_rows")
    return stage(ev, "before").unionByName(stage(quality.remove_duplicate_queries(ev), "after"))


@query(
    "K16_unusable_for_original_task",
    f"""with {V.LOG_PAIRS_SQL}, k as (select task, case when task = 't3' then 'OOM' when count(distinct n) > 1 then 'Variable number of targets' end as reason
      from (select task, len(list_distinct(targets)) as n from es) group by task)
    select * from k where reason is not null""",
)
def k16(spark, sf):
    samples = eval_samples(V.log_files(spark, sf)).withColumn("n_targets", F.size(F.array_distinct("targets")))
    return K.unusable_for_original_task(samples, {"t3": "OOM"})


@query(
    "K17_contamination",
    f"""with dl as (select lang as task, text as input, doc_id from documents),
    {md5_rank_split('ds', 'dl', [], 'cast(doc_id as varchar)', 'round_even(0.5::double * n_group, 0)')}
    select task, count(*) as n_shared from (select task, input from ds where drawn intersect select task, input from ds where not drawn) group by task""",
)
def k17(spark, sf):
    documents = V.table(spark, sf, "documents").select(F.col("lang").alias("task"), F.col("text").alias("input"), F.col("doc_id").cast("string").alias("id"))
    sides = sample_fraction(documents, 0.5, key="id")
    return K.contamination(sides.withColumn("split", F.when(F.col("split") == "sample", "train").otherwise("test")))
