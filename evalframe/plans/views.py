"""Stand-ins for evaluation data, derived from the driver tables in both engines.

``ev`` imitates the flat sample table (25 tasks × 4 sizes × 2 families × 4
shots); ``log_files`` imitates nested result files (one task per part × 4
models) with the irregularities the log operators must handle. The DuckDB
texts are written as relations so a query can use them under WITH.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.functions.features import augment
from evalframe.operators.quality import binarize
from evalframe.runtime import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- ev: samples -----------------------------------------------------------------

_EV_CORE = """
 concat_ws('|',l_orderkey,l_linenumber,l_partkey,l_suppkey,cast(l_quantity as int)) as sample_key,
 p_brand as task, b, cast(l_linenumber % 4 as int) as shots,
 case when l_suppkey % 3 = 0 then 'F1' else 'F0' end as model_family,
 case cast(l_suppkey % 4 as int) when 0 then '4b' when 1 then '8b' when 2 then '27b' else '128b' end as model_name,
 case when b % 3 = 0 then 'multiple_choice' when b % 3 = 1 then 'scoring_generative'
      when l_linestatus='F' then 'multiple_choice' else 'scoring_generative' end as query_type,
 cast(case when b % 5 = 0 then (case when l_returnflag='R' and l_quantity>45 then 1.0 else 0.0 end)
      when l_returnflag='R' then 1.0 when l_returnflag='A' then 0.0
      when l_linenumber=7 then 0.5 when l_suppkey % 4 = 3 then 1.0 else 0.0 end as double) as correct,
 concat(p_name,' ',p_type,' q',cast(cast(l_quantity as int) as {string})) as input,
 cast(2 + p_size % 4 as int) as n_targets, cast(l_quantity as int) as q, cast(round(l_discount*100) as int) as dc
"""
_EV_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"
]
_EV_FROM = "(select l.*, p.*, cast(replace(p_brand,'Brand#','') as int) as b from {lineitem} l join {part} p on l_partkey = p_partkey) t"

# assr stands for an assessor's predicted probability: 20 distinct values
_ASSR = "(((q*3 + n_targets*7 + b) % 20) + 0.5) / 20.0"

EV_SQL = f"""ev as (
  select *, exp(list_max(normalized_scores)) as conf_normalized, exp(list_max(absolute_scores)) as conf_absolute,
    cast({_ASSR} as double) as assr
  from (select *,
    list_transform(range(0,n_targets), lambda i: concat('t',i)) as targets,
    list_transform(range(0,n_targets), lambda i: cast(((i*5+q) % 3)/2.0 as double)) as values_,
    list_transform(range(0,n_targets), lambda i: -(((i*7+q) % 10)+1+dc)/8.0::double) as normalized_scores,
    list_transform(range(0,n_targets), lambda i: -(((i*3+q) % 10)+1+dc)/4.0::double) as absolute_scores
  from (select {_EV_CORE.format(string='varchar')} from {_EV_FROM.format(lineitem='lineitem', part='part')}) c) a)"""


def ev(spark: SparkSession, sf: str) -> DataFrame:
    """The sample table; ``query_type`` etc. as in SURVEY §1.2."""
    core = spark.sql(
        f"select {_EV_CORE.format(string='string')} from {_EV_FROM.format(lineitem='{l}', part='{p}')}",
        l=spread(table(spark, sf, "lineitem").select(*_EV_COLUMNS)),
        p=table(spark, sf, "part"),
    )
    index = "sequence(0, n_targets-1)"
    arrays = core.selectExpr(
        "*",
        f"transform({index}, i -> concat('t',i)) as targets",
        f"map_from_arrays(transform({index}, i -> concat('t',i)), transform({index}, i -> cast(((i*5+q) % 3)/2.0D as double))) as target_values",
        f"transform({index}, i -> -(((i*7+q) % 10)+1+dc)/8.0D) as normalized_scores",
        f"transform({index}, i -> -(((i*3+q) % 10)+1+dc)/4.0D) as absolute_scores",
    )
    return arrays.selectExpr("*", f"cast({_ASSR} as double) as assr")


def ev_conf(spark: SparkSession, sf: str) -> DataFrame:
    """``ev`` with the confidences added."""
    return augment(ev(spark, sf))


def ev_binary(spark: SparkSession, sf: str) -> DataFrame:
    return binarize(ev_conf(spark, sf))


EV_BINARY_SQL = EV_SQL + """, eb as (select * replace (cast(correct as int) as correct) from ev where correct in (0.0, 1.0))"""

# ---- log files: nested results -----------------------------------------------------

MODELS = ["4b", "8b", "27b", "128b"]

# Columns of the flat form, shared text: p = part row, m = model index, q = query index, s = sample index.
_KIND = "p_size % 3"  # 0: four choice queries; 1: three pairs; 2: choice, pair, odd one out
_N_ALL = f"(case {_KIND} when 0 then 4 when 1 then 6 else 4 end)"
N_QUERIES = f"(case when m = 1 and p_size % 11 = 0 then 0 when m = 2 and p_size % 7 = 0 then {_N_ALL} - 1 else {_N_ALL} end)"
_SWAPPED = "(p_size % 10 = 4 and q in (2, 3))"
QUERY_TYPE = f"""(case when {_KIND} = 0 or ({_KIND} = 2 and q = 0) then 'multiple_choice'
  when (({_KIND} = 1 and q % 2 = 0) or ({_KIND} = 2 and q % 2 = 1)) <> ({_KIND} = 1 and {_SWAPPED}) then 'generative' else 'scoring' end)"""
_EXAMPLES = f"(case when {_KIND} = 0 then q when {_KIND} = 1 then cast(floor(q / 2) as int) when q = 3 then 1 else 0 end)"
SHOTS = f"(case when p_size % 13 = 0 and q = {N_QUERIES} - 1 then cast(null as int) else {_EXAMPLES} end)"
FUNCTION = f"(case when {QUERY_TYPE} = 'generative' then 'generate_text' else 'cond_log_prob' end)"
N_SAMPLES = "(2 + p_size % 3)"
_INSTANCE = f"(case when m = 1 and p_size % 5 = 0 then {N_SAMPLES} - 1 - s else s end)"
_BEFORE = f"'Task ', p_type, '. ', repeat('Q: example A: yes. ', {_EXAMPLES}), 'Q: ', p_name, ' '"
_AFTER = f"case when p_size % 9 = 0 and {_EXAMPLES} = 2 then ' other' else '' end, ' A:'"
_INPUT = f"""concat({_BEFORE}, cast({_INSTANCE} as {{string}}),
  {_AFTER})"""
N_TARGETS = "(2 + p_size % 4)"
_CORRECT = f"cast(({_INSTANCE} + p_size + m) % 2 as double)"
_MATCH = f"cast(case when (i + {_INSTANCE} + p_size + m) % 3 = 0 then 1.0 else 0.0 end as double)"
_OUTPUT = f"concat('out', cast({_INSTANCE} as {{string}}))"
_TARGET = f"concat('t', cast((case when p_size % 6 = 1 and {QUERY_TYPE} = 'scoring' and i = {N_TARGETS} - 1 then 0 else i end) as {{string}}))"
_PREFERRED = "(case p_size % 4 when 0 then 'exact_str_match' when 1 then 'bleu' else 'multiple_choice_grade' end)"
_SCORE = "cast((p_size * 37 + m * 11 + r * 5) % 100 as double)"
FAMILY = "(case when m = 3 then 'F1' else 'F0' end)"


def _files_sql(*more: str) -> str:
    """The files of part rows ``p`` and the expressions ``more`` over a part row, in steps: what is the same in all files of a part, in all queries of a file or for all samples of a query is made once.

    ``d`` holds what the files of a part share, ``f`` is a file, ``h`` the head of a query, ``x`` a place of its samples. Each is
    expanded, so that Spark makes it before it goes on instead of at every mention.
    """
    sequence = lambda n: f"sequence(0, {n} - 1)"
    text = lambda t: t.replace("{string}", "string")
    known = lambda t, kind="h.kind", instance="n": text(t).replace(_EXAMPLES, "h.examples").replace(QUERY_TYPE, kind).replace(_INSTANCE, instance)
    scores = lambda mul, div: f"transform({sequence(N_TARGETS)}, i -> -(((i*{mul} + s + p_size) % 10) + 1) / {div}D)"
    target_list = lambda kind: f"to_json(transform({sequence(N_TARGETS)}, i -> {known(_TARGET, repr(kind))}))"
    target_object = f"map_from_entries(transform({sequence(N_TARGETS)}, i -> struct({known(_TARGET, repr('generative'))}, struct({known(_MATCH)} as exact_str_match))))"
    values = f"map_from_entries(transform({sequence(N_TARGETS)}, i -> struct(concat('t', i), cast(i = p_size % {N_TARGETS} as double))))"
    no_map, no_number, no_text = (f"cast(null as {t})" for t in ("map<string,double>", "double", "string"))
    head = f"named_struct('kind', {QUERY_TYPE}, 'function', {FUNCTION}, 'examples', {_EXAMPLES}, 'before', concat({_BEFORE}), 'after', concat({_AFTER}))"
    shared = f"""named_struct('heads', transform({sequence(_N_ALL)}, q -> {head}), 'target_values', {values}, 'choice_targets', {target_list('multiple_choice')}, 'scoring_targets', {target_list('scoring')},
      'scores', transform({sequence(N_SAMPLES)}, s -> named_struct('scores', {scores(3, '4.0')}, 'normalized_scores', {scores(7, '8.0')})))"""
    place = f"""named_struct('label', cast(n as string), 'scores', y.scores, 'normalized_scores', y.normalized_scores, 'target_object', to_json({target_object}),
      'output', {known(_OUTPUT)}, 'correct', {known(_CORRECT)}, 'metrics', map('multiple_choice_grade', {known(_CORRECT)}))"""
    file = f"named_struct('m', m, 'places', zip_with(transform({sequence(N_SAMPLES)}, s -> {_INSTANCE}), d.scores, (n, y) -> {place}))"
    samples = lambda targets, values, correct, output, metrics: f"""transform(f.places, x -> named_struct(
      'input', concat(h.before, x.label, h.after), 'targets', {targets},
      'scores', x.scores, 'absolute_scores', x.scores, 'normalized_scores', x.normalized_scores,
      'target_values', {values}, 'correct', {correct}, 'output', {output}, 'metrics', {metrics}))"""
    query = f"""named_struct('query_type', h.kind, 'function', h.function, 'shots', {known(SHOTS)}, 'samples', case h.kind
      when 'multiple_choice' then {samples("d.choice_targets", "d.target_values", "x.correct", no_text, "x.metrics")}
      when 'generative' then {samples("x.target_object", no_map, no_number, "x.output", no_map)}
      else {samples("d.scoring_targets", no_map, no_number, no_text, no_map)} end)"""
    record = f"""named_struct('number_of_shots', if(r = 2, cast(null as int), r), 'preferred_score', {_PREFERRED},
      'score_dict', map('exact_str_match', {_SCORE}, 'bleu', {_SCORE} / 2, 'multiple_choice_grade', {_SCORE} / 4),
      'subtask_description', if(r = 1, 'subtask', concat('t', p_partkey)))"""
    return f"""
      select concat('t', p_partkey) as task, {FAMILY} as model_family,
        element_at(array('4b','8b','27b','128b'), m + 1) as model_name,
        element_at(array(3623973888L, 8590102528L, 28991404032L, 137440272384L), m + 1) as parameters,
        concat('/logs/t', p_partkey, '/x_', {FAMILY}, '_', element_at(array('4b','8b','27b','128b'), m + 1),
               if(p_size % 2 = 0, '_T=0', ''), '.json') as path,
        transform(slice(d.heads, 1, {N_QUERIES}), (h, q) -> {query}) as queries,
        transform(sequence(0, 2), r -> {record}) as scores{"".join(f", {c}" for c in more)}
      from (select *, f.m as m from (select *, explode(transform(sequence(0, 3), m -> {file})) as f
        from (select *, explode(array({shared})) as d from {{p}})))"""


PARTS_PER_TASK = 10_000


def log_files(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """One nested row per (task, model); built per part row, without any grouping.

    A part row grows a hundredfold here, so a task takes a bounded number of them. ``more`` are further
    columns, expressions over a part row, so that no file is moved to meet them.
    """
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    return spark.sql(_files_sql(*more), p=spread(parts, PARTS_PER_TASK))


_duck = lambda t: t.replace("{string}", "varchar")
LOG_FILES_SQL = f"""lf as (select *, concat('t', p_partkey) as task, {FAMILY} as model_family,
    ['4b','8b','27b','128b'][m + 1] as model_name, cast({N_QUERIES} as int) as n_queries
  from (select *, cast(unnest(range(0, 4)) as int) as m from part))"""
LOG_QUERIES_SQL = LOG_FILES_SQL + f""", lq as (select *, {QUERY_TYPE} as query_type, cast({SHOTS} as int) as shots, {FUNCTION} as function,
    cast({N_SAMPLES} as int) as n_samples
  from (select *, cast(unnest(range(0, n_queries)) as int) as q from lf))"""
LOG_SAMPLES_SQL = LOG_QUERIES_SQL + f""", ls as (select *, {_duck(_INPUT)} as input, {_CORRECT} as choice_correct, {_duck(_OUTPUT)} as generated,
    list_transform(range(0, {N_TARGETS}), lambda i: {_duck(_TARGET)}) as targets,
    list_max(list_transform(range(0, {N_TARGETS}), lambda i: {_MATCH})) as best_match
  from (select *, cast(unnest(range(0, n_samples)) as int) as s from lq))"""
LOG_RECORDS_SQL = LOG_FILES_SQL + f""", lr as (select *, case when r = 2 then null else r end as number_of_shots, {_PREFERRED} as preferred_score,
    {_SCORE} as score, case when r = 1 then 'subtask' else task end as subtask_description
  from (select *, cast(unnest(range(0, 3)) as int) as r from lf))"""
# pairs of the non-choice queries of a file, cut at the first bad pair
LOG_PAIRS_SQL = LOG_SAMPLES_SQL + """, nm as (select *, cast(row_number() over (partition by task, model_name order by q) - 1 as int) as pos
    from lq where query_type <> 'multiple_choice'),
  pr as (select g.task, g.model_family, g.model_name, g.q as gen_q, s.q as sco_q, g.shots, g.pos // 2 as pair,
      (g.query_type = 'generative' and s.query_type = 'scoring') as ok
    from nm g join nm s on g.task = s.task and g.model_name = s.model_name and s.pos = g.pos + 1 where g.pos % 2 = 0),
  good as (select * from (select *, bool_and(ok) over (partition by task, model_name order by pair) as kept from pr) where kept),
  paired as (select good.task, good.model_family, good.model_name, good.shots, 'scoring_generative' as query_type, good.gen_q as query_idx,
      a.s as sample_idx, b.input, b.targets, a.best_match as correct, a.generated as output
    from good join ls a on a.task = good.task and a.model_name = good.model_name and a.q = good.gen_q
              join ls b on b.task = good.task and b.model_name = good.model_name and b.q = good.sco_q and b.s = a.s),
  choice as (select task, model_family, model_name, shots, query_type, q as query_idx, s as sample_idx, input, targets, choice_correct as correct,
      cast(null as varchar) as output from ls where query_type = 'multiple_choice'),
  es as (select * from choice union all select * from paired)"""

# ---- text and logits -----------------------------------------------------------------


def ev_text(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: whole texts, task = language, a smooth probability."""
    return spark.sql(
        """select d.doc_id, lang as task, quality as correct, text as input, n_chars,
             1/(1+exp(-(n_chars-1500)/1000.0D)) as p
           from {d} d join {l} l on d.doc_id = l.doc_id""",
        d=table(spark, sf, "documents"),
        l=table(spark, sf, "labels"),
    )


EV_TEXT_SQL = """et as (select d.doc_id, lang as task, quality as correct, text as input, n_chars,
  1/(1+exp(-(n_chars-1500)/1000.0::double)) as p from documents d join labels l on d.doc_id = l.doc_id)"""


def folded(n: int) -> Column:
    """All values of an embedding as ``n`` logits: value ``i`` adds to logit ``i`` modulo ``n``."""
    own = lambda k: F.filter("embedding", lambda x, i: i % n == k)
    return F.array(*[F.aggregate(own(k), F.lit(0.0), lambda a, x: a + x.cast("double")) for k in range(n)])


def folded_sql(n: int) -> str:
    return f"[list_sum([cast(embedding[i] as double) for i in range(k + 1, len(embedding) + 1, {n})]) for k in range(0, {n})]"


def ev_mc(spark: SparkSession, sf: str) -> DataFrame:
    """Ten logits, two logits and a class label."""
    return table(spark, sf, "embeddings").select(
        "vec_id", folded(10).alias("logits"), folded(2).alias("two"), "label"
    )


EV_MC_SQL = f"""mc as (select vec_id, {folded_sql(10)} as logits, {folded_sql(2)} as two, label from embeddings),
  sm as (select vec_id, label, logits, two, list_transform(logits, lambda x: exp(x - list_max(logits))) as ex from mc),
  probs as (select vec_id, label, logits, two, list_transform(ex, lambda x: x / list_sum(ex)) as probs from sm)"""


def fewshot(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn of a conversation as the zero-shot text, the turn with its predecessor as the prompt."""
    return spark.sql(
        """select a.conv_id, a.turn, a.text as reference, concat(coalesce(b.text, ''), a.text) as input
           from {c} a left join {c} b on a.conv_id = b.conv_id and b.turn = a.turn - 1""",
        c=table(spark, sf, "conversations"),
    )


FEWSHOT_SQL = """fs as (select a.conv_id, a.turn, a.text as reference, concat(coalesce(b.text, ''), a.text) as input
  from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn = a.turn - 1)"""


def losses(spark: SparkSession, sf: str) -> DataFrame:
    """Training curves: user = run, event = step, value = loss, ``props.k`` = the metric watched."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("r"), "user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"),
        F.get_json_object("props", "$.k").cast("double").alias("value"), "event_type",
    )


LOSSES_SQL = """lo as (select concat('r', user_id) as run, event_id as step, value as loss,
  cast(json_extract_string(props, '$.k') as double) as value, event_type from events)"""
