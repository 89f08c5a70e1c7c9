"""The registered queries of the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm import chat, exact_dedup, hard_negatives, html_text, jaccard_join, language_model, mixing, sentencepiece, sharding, spelling, substring_dedup, topk, toxicity
from evalframe.llm.common import id_fold

SHARDS = 16
SOURCE_WEIGHTS = {"src0": 6, "src1": 3, "src2": 3, "src3": 2}  # parts; every other source has one
QUERIES = {}
ORACLE = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def crc(text) -> F.Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.write_shards(sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), SHARDS))
    return shards.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        crc(F.col("text")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sentencepiece.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), sentencepiece.load_vocabulary())
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", crc(F.col("decoded")).alias("decoded_crc32"), "exact")


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_copies(table(spark, sf_dir, "documents"))


ORACLE["op3_exact_dedup"] = r"""
with t as (select doc_id, text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents),
o as (select *, first_value(doc_id) over w as keep_id, row_number() over w as place, count(*) over (partition by norm) as group_size
  from t window w as (partition by norm order by length(coalesce(text, '')) desc, doc_id))
select doc_id, keep_id, group_size, place = 1 as kept, sha256(norm) as text_sha256 from o
"""


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS)
    return mixed.select("doc_id", "source", "phase", "slot", "row_in_block")


@query
def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE["op5_top_k"] = """
with v as (select vec_id, [floor(64 * x::double) for x in embedding] as e from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.learn_by_fold(docs, labels))
    return scored.select("doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


ORACLE["op7_jaccard_join"] = r"""
with recursive w as (select doc_id, [x for x in string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as l from documents),
g as (select doc_id, case when len(l) = 0 then [] when len(l) < 5 then [array_to_string(l, ' ')]
    else list_distinct([array_to_string(l[i:i + 4], ' ') for i in range(1, len(l) - 3)]) end as s from w),
u as (select doc_id, len(s) as n, unnest(s) as h from g),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as x, any_value(b.n) as y, count(*) as i
  from u a join u b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p where 100 * i >= 75 * (x + y - i)),
r as (select doc_id, doc_id as reach from g union select r.doc_id, e.b from r join e on r.reach = e.a)
select g.doc_id, len(g.s) as n_shingles, min(r.reach) as component_id from g join r using (doc_id) group by g.doc_id, len(g.s)
"""


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat.as_tool_messages(table(spark, sf_dir, "conversations"))
    return chat.link_tool_calls(messages, chat.ASK).drop("errors", "item")


ORACLE["op9_chat_formatting"] = """
with e as (select conv_id, turn, text,
    case role when 'user' then 'call' when 'assistant' then 'result' else 'message' end as kind,
    case role when 'user' then 'ask' when 'assistant' then 'tool' else role end as name,
    case role when 'user' then 't' || turn when 'assistant' then 't' || (turn - 1) end as call_id from conversations),
c as (select conv_id, call_id, turn, text from e where kind = 'call'),
a as (select conv_id, call_id, min(turn) as turn from e where kind = 'result' group by 1, 2),
d as (select conv_id, call_id, case when call_id is not null then 2 * (row_number() over (partition by conv_id order by turn) - 1) end as depth from c),
j as (select e.conv_id, e.turn, e.kind, e.call_id, e.name, e.text, d.depth, c.turn as call_turn, a.turn as answer_turn, p.call_id as before
  from e left join c using (conv_id, call_id) left join a using (conv_id, call_id) left join d using (conv_id, call_id)
  left join c p on p.conv_id = e.conv_id and p.turn = e.turn - 2),
s as (select *, case when kind = 'message' then 'message' when kind = 'call' and answer_turn is not null then 'answered' when kind = 'call' then 'open'
    when call_turn is null then 'orphan' else 'linked' end as status from j)
select conv_id, turn, kind, call_id, name, status, case kind when 'call' then answer_turn when 'result' then call_turn end as other_turn,
  kind <> 'call' or length(text) > 0 as valid, case kind when 'call' then depth when 'result' then depth + 1 end as level,
  case kind
    when 'call' then '{"arguments":{' || case when turn >= 2 then '"after":["t' || (turn - 2) || '"],' else '' end || '"text":' || to_json(text) || ',"turn":' || turn
      || '},"id":"' || call_id || '","kind":"call","name":"ask","status":"' || status || '","turn":' || turn || '}'
    when 'result' then '{"content":' || to_json(text) || ',"id":"' || call_id || '","kind":"result","status":"' || status || '","turn":' || turn || '}'
    else '{"content":' || to_json(text) || ',"kind":"message","role":"' || name || '","status":"message","turn":' || turn || '}' end as json
from s
"""


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"), typo_every=199)


ORACLE["op11_spelling_variants"] = r"""
with recursive c as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as crc),
w as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
r as (select doc_id, run, count(*) as n from w where length(run) >= 6 group by 1, 2),
b as (select run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda x: case when unicode(x) < 128 then [cast(unicode(x) as bigint)] else [195, cast(unicode(x) as bigint) - 64] end)) as bytes from r),
h as (select run, n, xor(list_reduce(list_concat([4294967295], bytes), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) as h from b, c),
t as (select case when h % 199 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h),
v as materialized (select word, cast(sum(n) as bigint) as n from t where length(word) >= 6 group by word having sum(n) >= 5),
k as (select word, n, unnest([{'i': i, 'l': left(word, i - 1) || substr(word, i + 1)} for i in range(1, length(word) + 1)]) as k from v),
p as (select a.word, b.word as other, b.n as m from k a join k b on a.k = b.k and a.word <> b.word
  union select distinct k.word, v.word, v.n from k join v on k.k.l = v.word
  union select distinct v.word, k.word, k.n from k join v on k.k.l = v.word),
f as (select word, count(*) as n_near, first(other order by m desc, other) as form, max(m) as form_n from p group by word),
g as materialized (select word, n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * n then form end as form, case when form_n >= 5 * n then form_n end as form_n
  from v left join f using (word)),
s as (select word, form as root from g where form is not null union select s.word, g.form from s join g on s.root = g.word where g.form is not null)
select g.word, g.n, g.n_near, g.form, g.form_n, coalesce(e.root, g.word) as root
from g left join (select s.word, s.root from s join g on s.root = g.word where g.form is null) e on e.word = g.word
"""


@query
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.drop_repeated_passages(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE["op12_substring_dedup"] = r"""
with w as (select doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as l from documents),
s as (select doc_id, unnest([{'i': i, 'h': array_to_string(l[i:i + 19], ' ')} for i in range(1, len(l) - 18)]) as s from w),
o as (select doc_id, s.i as i, row_number() over (partition by s.h order by doc_id, s.i) as place from s),
g as (select doc_id, list(distinct i) as gone from (select doc_id, unnest(range(i, i + 20)) as i from o where place > 1) group by doc_id),
k as (select w.doc_id, l, coalesce(g.gone, []) as gone from w left join g using (doc_id)),
m as (select doc_id, len(l) as n_words, cast(len(gone) as bigint) as n_removed, case when len(gone) = 0 then l else list_where(l, [not list_contains(gone, i) for i in range(1, len(l) + 1)]) end as kept from k)
select doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from m
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE["op13_hard_negatives"] = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as e from embeddings
  where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as alike, cast(list_dot_product(a.e, c.e) as bigint) as score
  from v a, v c where a.vec_id % 100 = 0 and c.vec_id <> a.vec_id),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where alike) where place <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    cast(row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as int) as rank
  from p join s on p.anchor_id = s.anchor_id where not s.alike and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
