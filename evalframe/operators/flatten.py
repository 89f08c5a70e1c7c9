"""From nested result files to one row per sample.

Pairing generative with scoring queries happens inside the file's own array,
so flattening reads each file once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe import schema as S
from evalframe.runtime import materialize
from evalframe.sources.logs import FILE_KEYS


def query_type_tag(kind: Column) -> Column:
    """The query type, or an error for an unknown one."""
    known = kind.isin(*S.QUERY_TYPES)
    return F.when(known, kind).otherwise(
        F.raise_error(F.concat(F.lit("not a query type: "), F.coalesce(kind, F.lit("NULL"))))
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is mentioned."""
    return F.element_at(F.transform(F.array(value), use), 1)


def best_exact_match(generative_targets: Column) -> Column:
    """Highest ``exact_str_match`` over the generative targets; at least one must exist."""
    matches = lambda targets: F.transform(F.map_values(targets), lambda m: m["exact_str_match"])
    none = F.raise_error(F.lit("Generative sample without targets."))
    best = lambda targets: F.when(F.size(targets) >= 1, F.array_max(matches(targets))).otherwise(none)
    return _once(F.from_json(generative_targets, S.TARGET_OBJECT), best)


def every_target_correct(targets: Column) -> Column:
    """A map giving 1 to each distinct target (scoring targets may repeat)."""
    distinct = F.array_distinct(targets)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda _: F.lit(1.0)))


def merge_pair(generative: Column, scoring: Column) -> Column:
    """What a scoring sample takes from its generative twin: correctness and output."""
    same = generative["input"].eqNullSafe(scoring["input"])
    best = best_exact_match(generative["targets"])
    correct = F.when(same, best).otherwise(F.raise_error(F.lit("Paired samples have different inputs.")))
    return F.struct(correct.alias("correct"), generative["output"].alias("output"))


def _twins(generative: Column, scoring: Column) -> Column:
    """``merge_pair`` for each sample of a pair of queries; the scoring samples themselves stay where they are."""
    merged = F.transform(
        F.arrays_zip(generative.alias("g"), scoring.alias("s")),
        lambda z: merge_pair(z["g"], z["s"]),
    )
    same_length = F.size(generative) == F.size(scoring)
    return F.when(same_length, merged).otherwise(F.raise_error(F.lit("Paired queries differ in length.")))


def pair_queries(queries: Column) -> Column:
    """Pair the non-multiple-choice queries of a file by position: (0,1), (2,3), …

    A trailing odd query is left out, and so is everything from the first pair
    on that is not (generative, scoring).
    """
    others = F.filter(queries, lambda q: query_type_tag(q["query_type"]) != S.MULTIPLE_CHOICE)
    side = lambda rest: lambda q, i: i % 2 == rest
    zipped = lambda o: F.arrays_zip(F.filter(o, side(0)).alias("gen"), F.filter(o, side(1)).alias("sco"))
    pairs = F.filter(_once(others, zipped), lambda p: p["sco"].isNotNull())
    is_good = lambda p: (p["gen"]["query_type"] == S.GENERATIVE) & (p["sco"]["query_type"] == S.SCORING)
    upto = lambda ps, bad: F.when(bad == 0, F.size(ps)).otherwise(bad - 1).cast("int")
    first_bad = lambda ps: F.array_position(F.transform(ps, is_good), F.lit(False))
    return _once(pairs, lambda ps: F.slice(ps, F.lit(1), _once(first_bad(ps), lambda bad: upto(ps, bad))))


def _row(query_idx: Column, query_type: str, shots: Column, samples: Column, twins: Column | None = None) -> Column:
    if twins is None:
        twins = F.lit(None).cast("array<struct<correct:double,output:string>>")
    return F.struct(
        query_idx.cast("int").alias("query_idx"),
        F.lit(query_type).alias("query_type"),
        shots.alias("shots"),
        samples.alias("samples"),
        twins.alias("twins"),
    )


def eval_samples(files: DataFrame) -> DataFrame:
    """The sample table of SURVEY §1.2: multiple-choice samples and merged pairs.

    Which queries go together is decided on their types and places; samples are fetched from the file's array once.
    """
    heads = F.transform("queries", lambda q, i: F.struct(i.alias("idx"), q["query_type"].alias("query_type")))
    query = lambda head: F.get("queries", head["idx"])
    choice = F.transform(
        F.filter(heads, lambda h: h["query_type"] == S.MULTIPLE_CHOICE),
        lambda h: _row(h["idx"], S.MULTIPLE_CHOICE, query(h)["shots"], query(h)["samples"]),
    )
    pair = lambda gen, sco: (query(sco)["samples"], _twins(query(gen)["samples"], query(sco)["samples"]))
    paired = F.transform(
        pair_queries(heads),
        lambda p: _row(p["gen"]["idx"], S.PAIRED, query(p["gen"])["shots"], *pair(p["gen"], p["sco"])),
    )
    return _samples(files.select(*FILE_KEYS, F.explode(F.concat(choice, paired)).alias("q")).select(*FILE_KEYS, "q.*"))


def _samples(queries: DataFrame) -> DataFrame:
    """One row per sample of (file keys, query_idx, query_type, shots, samples, twins), with the columns of both query kinds.

    Targets are parsed per row, so that Spark parses them once, and only where they are asked for.
    """
    keys = [*FILE_KEYS, "shots", "query_type", "query_idx", "sample_idx"]
    samples = queries.select(*keys[:-1], "twins", F.posexplode("samples").alias("sample_idx", "s"))
    key = F.concat_ws("|", *FILE_KEYS, "query_idx", "sample_idx")
    paired = F.col("query_type") == S.PAIRED
    twin = F.get("twins", F.col("sample_idx"))
    fields = {name: F.col(f"s.{name}") for name in S.RAW_SAMPLE.fieldNames()} | {
        "targets": F.from_json("s.targets", S.TARGET_LIST),
        "correct": F.when(paired, twin["correct"]).otherwise(F.col("s.correct")),
        "output": F.when(paired, twin["output"]),
        "metrics": F.when(~paired, F.col("s.metrics")),
    }
    parsed = samples.select(*keys, key.alias("sample_key"), *[c.alias(n) for n, c in fields.items()])
    values = F.when(paired, every_target_correct(F.col("targets"))).otherwise(F.col("target_values"))
    return parsed.withColumn("target_values", values)


def pairs_of_queries(queries: DataFrame, file: list[str] = FILE_KEYS) -> DataFrame:
    """(file…, pair, query_idx, is_generative): the queries that form pairs, by the rule of ``pair_queries``.

    Works on rows of (file…, query_idx, query_type) without their samples, in the order of ``query_idx``.
    """
    order = Window.partitionBy(*file).orderBy("query_idx")
    others = queries.select(*file, "query_idx", query_type_tag(F.col("query_type")).alias("query_type"))
    others = others.where(F.col("query_type") != S.MULTIPLE_CHOICE).withColumn("_n", F.row_number().over(order) - 1)
    first = F.col("_n") % 2 == 0
    fits = F.col("query_type") == F.when(first, S.GENERATIVE).otherwise(S.SCORING)
    placed = others.withColumns({"pair": F.floor(F.col("_n") / 2), "is_generative": first, "_fits": fits})
    whole = placed.groupBy(*file, "pair").agg((F.count("*") == 2).alias("_whole"), F.bool_and("_fits").alias("_good"))
    upto = Window.partitionBy(*file).orderBy("pair")
    kept = whole.where("_whole").withColumn("_all_good", F.bool_and("_good").over(upto)).where("_all_good").select(*file, "pair")
    return placed.join(kept, [*file, "pair"]).select(*file, "pair", "query_idx", "is_generative")


def eval_samples_of_queries(queries: DataFrame, file: list[str] = FILE_KEYS) -> DataFrame:
    """The table of ``eval_samples`` from a row per query, so that no file has to be one row.

    ``queries`` has (file keys…, query_idx, query_type, shots, samples) and is read four times: store it first.
    ``file`` names the columns that tell files apart. Samples of choice queries stay where they are; those of pairs meet by (file, pair).
    """
    keys = list(dict.fromkeys([*FILE_KEYS, *file]))
    choice = queries.where(F.col("query_type") == S.MULTIPLE_CHOICE).select(
        *FILE_KEYS, _row(F.col("query_idx"), S.MULTIPLE_CHOICE, F.col("shots"), F.col("samples")).alias("q")
    )
    placed = materialize(pairs_of_queries(queries, file), "pairs")
    # of a generative sample, only what its twin takes from it is moved
    taken = F.transform("samples", lambda s: F.struct(*[s[c].alias(c) for c in ("input", "targets", "output")]))
    slim = queries.select(*keys, "query_idx", "shots", taken.alias("samples"))
    generative = slim.join(placed.where("is_generative"), [*file, "query_idx"]).select(*keys, "pair", F.struct("query_idx", "shots", "samples").alias("gen"))
    whole = queries.select(*file, "query_idx", "samples")
    scoring = whole.join(placed.where("not is_generative"), [*file, "query_idx"]).select(*file, "pair", F.struct("samples").alias("sco"))
    paired = generative.join(scoring, [*file, "pair"]).select(
        *FILE_KEYS,
        _row(F.col("gen.query_idx"), S.PAIRED, F.col("gen.shots"), F.col("sco.samples"), _twins(F.col("gen.samples"), F.col("sco.samples"))).alias("q"),
    )
    return _samples(choice.unionByName(paired).select(*FILE_KEYS, "q.*"))


def stack_frames(*frames: DataFrame) -> DataFrame:
    """Concatenate frames whose columns differ; missing columns become NULL."""
    if not frames:
        raise ValueError("nothing to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def require_rows(df: DataFrame, message: str = "nothing to stack") -> DataFrame:
    if df.limit(1).isEmpty():
        raise ValueError(message)
    return df
