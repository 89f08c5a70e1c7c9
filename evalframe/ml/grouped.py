"""Many logistic models over tokens in one fit: one per task, per setting, per anything.

Every group of rows has a model, a vocabulary and a penalty of its own: a coefficient belongs to a (group, token),
so models share nothing, neither hash slots nor regularisation. Rows are packed
into blocks of one group with their tokens' numbers in its vocabulary, once. An iteration
then is one job for all models: blocks give sums of the gradient, added up per
coefficient, and each model takes its step. A group of any size is many blocks; what one
task holds of a model is its coefficients.

Groups are told apart by columns (``fit``, ``score``), whose rows meet in blocks, or are views of the same
rows (``fit_views``, ``score_views``): a view takes the rows of a condition, cuts their texts and puts words into slots. Rows of
views stay where they are: a task makes the blocks of all views from the rows it reads, in numbers of
its own that become the model's afterwards.

The step is that of a separable upper bound of the log-loss, with momentum that restarts where it
leads uphill. Tokens count by their share of the text, so the bound's curvature is half the
sum of a token's shares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from evalframe.operators.quality import binary_label
from evalframe.runtime import materialize, ship_by_value

ship_by_value(__name__)

BLOCK_ROWS = 4096
SCORED_ROWS = 20_000  # rows that one task scores at a time
VIEW_ROWS, VIEW_BYTES = 32_768, 32 << 20  # rows that become blocks of views together, and their bytes
PENALTY = 0.0001
ITERATIONS = 25


def _key(keys: list[str]) -> Column:
    """The group of a row as one value; NULL keys are a group like any other."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("{}")


def _numbered(texts: pa.Table, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' known tokens: how many a text has, their coefficients in order (0 is the intercept), and the texts' lengths, 1 at least."""
    lists = texts["_tokens"].combine_chunks()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    at = pc.index_in(lists.flatten(), value_set=words)
    row = np.repeat(np.arange(len(lists)), size)[at.is_valid().to_numpy(zero_copy_only=False)]
    return np.bincount(row, minlength=len(lists)), at.drop_null().to_numpy().astype(np.int64) + 1, np.maximum(size, 1)


def _number_type(n: int) -> type:
    """The smallest type for numbers below ``n``."""
    return np.uint16 if n <= 1 << 16 else np.uint32


BLOCK = "_key string, at binary, known binary, size binary, y binary"


def _packed(rows: pa.Table, model: pa.Table) -> pa.Table:
    """A block's tokens as numbers of its model's vocabulary."""
    names = ["_key", "at", "known", "size", "y"]
    if not rows.num_rows:
        return pa.table([pa.array([], pa.string()), *[pa.array([], pa.binary())] * 4], names=names)
    words = model["words"].combine_chunks().flatten()
    known, at, size = _numbered(rows, words)
    parts = (at.astype(_number_type(len(words) + 1)), known.astype(np.int32), size.astype(np.int32), rows["_y"].to_numpy().astype(np.uint8))
    return pa.table([rows["_key"][:1], *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=names)


def _sums(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The sum of each row's values, ``known`` of them in order."""
    out, filled = np.zeros(len(known)), np.flatnonzero(known)
    if len(filled):
        out[filled] = np.add.reduceat(values, (np.cumsum(known) - known)[filled])
    return out


def _margins(weights: np.ndarray, values: np.ndarray, known: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The intercept and the share of each known token times its value, in the order of the text."""
    row = np.repeat(np.arange(len(known)), known)
    return weights[0] + np.bincount(row, values * (1.0 / size)[row], len(known))


def _gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and model: the sums of the log-loss' gradient over the blocks met."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        get = lambda c, k, kind: np.frombuffer(batch.column(c)[k].as_buffer(), kind)
        for k, key in enumerate(batch.column("_key").to_pylist()):
            weights = batch.column("z")[k].values.to_numpy()
            at, known, size, y = get("at", k, _number_type(len(weights))), get("known", k, np.int32), get("size", k, np.int32), get("y", k, np.uint8)
            at, share = at.astype(np.intp), (1.0 / size).astype(np.float32)
            error = 1.0 / (1.0 + np.exp(-weights[0] - _sums(weights[at], known) * share)) - y
            total = sums.setdefault(key, np.zeros(len(weights)))
            total[0] += error.sum()
            total += np.bincount(at, np.repeat(error * share, known), len(weights))
    for key, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"_key": pa.array([key] * len(at), pa.string()), "at": pa.array(at.astype(np.int32)), "g": pa.array(total[at])})


STATE = "_key string, n long, penalty double, curvature array<double>, w array<double>, z array<double>, t double"


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each model's step; momentum restarts where the step goes against it."""
    for batch in batches:
        out = {"w": [], "z": [], "t": []}
        for row in range(batch.num_rows):
            get = lambda c: batch.column(c)[row]
            w, z, t, n, penalty = get("w").values.to_numpy(), get("z").values.to_numpy(), get("t").as_py(), get("n").as_py(), get("penalty").as_py()
            curvature = get("curvature").values.to_numpy() / n
            own = np.full(len(w), penalty)
            own[0] = 0
            gradient = own * z
            sums = get("sums").values  # the coefficients' sums; NULL where all are zero
            if sums is not None and len(sums):
                gradient[sums.field("at").to_numpy()] += sums.field("g").to_numpy() / n
            new = z - gradient / (curvature + own)
            if gradient @ (new - w) > 0:
                t = 1.0
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            for name, value in (("w", new), ("z", new + (t - 1) / after * (new - w)), ("t", after)):
                out[name].append(value)
        fixed = ["_key", "n", "penalty", "curvature"]
        arrays = [*(batch.column(c) for c in fixed), *(pa.array(out[c], pa.list_(pa.float64())) for c in ("w", "z")), pa.array(out["t"], pa.float64())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*fixed, "w", "z", "t"])


def fit(
    train: DataFrame,
    tokens: Column,
    keys: list[str] | None = None,
    label: str = "correct",
    penalty: float | Column = PENALTY,
    iterations: int = ITERATIONS,
) -> DataFrame:
    """A model per group of ``keys``: a stored table (_key, keys…, n, words, weights), the first weight the intercept's.

    Minimised is the mean log-loss plus penalty / 2 times the squared weights but the intercept's;
    ``penalty`` may be an expression over ``keys`` and ``n``, the group's number of rows. Rows without a binary label take no part.
    """
    keys = list(keys or [])
    rows = train.where(binary_label(label)).select(*keys, _key(keys).alias("_key"), F.col(label).cast("int").alias("_y"), tokens.alias("_tokens"))
    rows = materialize(rows, "labelled-tokens")
    sizes = rows.groupBy("_key", *keys).agg(F.count("*").alias("n"))
    shares = rows.select("_key", F.explode("_tokens").alias("word"), (F.lit(0.5) / F.size("_tokens")).alias("share"))
    models = _unfitted(sizes, shares, keys, penalty)
    blocks = materialize(_dealt(rows, models, BLOCK_ROWS, _packed, BLOCK), "blocks")
    return _fitted(models, blocks, iterations)


def _unfitted(sizes: DataFrame, shares: DataFrame, keys: list[str], penalty: float | Column) -> DataFrame:
    """(_key, keys…, n, penalty, words, curvature) of the models, stored; ``shares`` has (_key, word, share), several a word."""
    shares = shares.where("word is not null").groupBy("_key", "word").agg(F.sum("share").alias("share"))
    words = shares.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("word", "share"))).alias("v"))
    half = (F.col("n") / 2).alias("half")  # the intercept's curvature
    curvature = F.concat(F.array("half"), F.coalesce(F.col("v.share"), F.array().cast("array<double>")))
    models = sizes.join(words, "_key", "left").withColumn("half", half).select(
        "_key", *keys, "n", (penalty if isinstance(penalty, Column) else F.lit(float(penalty))).cast("double").alias("penalty"),
        F.coalesce(F.col("v.word"), F.array().cast("array<string>")).alias("words"), curvature.alias("curvature"),
    )
    return materialize(models, "models")


def _fitted(models: DataFrame, blocks: DataFrame, iterations: int) -> DataFrame:
    """The models with the weights that so many steps over the stored blocks lead to."""
    zeros = F.transform("curvature", lambda c: F.lit(0.0))
    state = materialize(models.select("_key", "n", "penalty", "curvature", zeros.alias("w"), zeros.alias("z"), F.lit(1.0).alias("t")), "weights")
    for _ in range(iterations):
        parts = blocks.join(state.select("_key", "z"), "_key").mapInArrow(_gradients, "_key string, at int, g double")
        sums = parts.groupBy("_key", "at").agg(F.sum("g").alias("g")).groupBy("_key").agg(F.collect_list(F.struct("at", "g")).alias("sums"))
        state = materialize(state.join(sums, "_key", "left").mapInArrow(_steps, STATE), "weights")
    return materialize(models.join(state.select("_key", F.col("w").alias("weights")), "_key").drop("penalty", "curvature"), "models")


def _dealt(rows: DataFrame, models: DataFrame, size: int, task: Callable, schema: StructType | str) -> DataFrame:
    """The rows of a stored table in blocks of about ``size`` rows of one group, each with the group's model."""
    counts = materialize(rows.groupBy("_key").agg(F.ceil(F.count("*") / size).alias("_blocks")), "blocks-per-group")
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).join(counts, "_key")
    dealt = dealt.withColumn("_block", F.pmod("_row", F.col("_blocks"))).drop("_blocks", "_row")
    each = models.join(counts, "_key").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    return dealt.groupBy("_key", "_block").cogroup(each.groupBy("_key", "_block")).applyInArrow(task, schema)


def score(models: DataFrame, df: DataFrame, tokens: Column, keys: list[str] | None = None, name: str = "assr", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the predicted probability of success by the model of the row's group; 0.5 where there is none.

    Tokens that a model hasn't seen don't count. Columns named in ``drop`` are neither stored nor moved nor returned.
    """
    keys, columns = list(keys or []), [c for c in df.columns if c.lower() != name.lower() and c not in drop]

    def task(rows: pa.Table, model: pa.Table) -> pa.Table:
        margin = np.zeros(rows.num_rows)
        if model.num_rows and rows.num_rows:
            weights = model["weights"][0].values.to_numpy()
            known, at, size = _numbered(rows, model["words"].combine_chunks().flatten())
            margin = _margins(weights, weights[at], known, size)
        return rows.select(columns).append_column(name, pa.array(1.0 / (1.0 + np.exp(-margin))))

    rows = materialize(df.select(*columns, _key(keys).alias("_key"), tokens.alias("_tokens")), "to-score")
    schema = StructType([*df.select(*columns).schema.fields, StructField(name, DoubleType())])
    return _dealt(rows, models.select("_key", "words", "weights"), SCORED_ROWS, task, schema)


@dataclass
class View:
    """The rows that a SQL condition takes, their texts cut to ``max_length`` tokens from ``side`` and put into ``n_features`` hash slots."""

    name: str
    where: str = "true"
    max_length: int | None = None
    side: str = "right"
    n_features: int | None = None


DRAFT = "_key string, rows long, words array<string>, shares array<double>, at binary, known binary, size binary"


def _viewed(df: DataFrame, tokens: Column, views: list[View], *columns: Column | str) -> DataFrame:
    """``columns`` of the rows that any view takes, with ``_views`` (the places of their views) and what the views need of their texts."""
    taken = F.array_compact(F.array(*[F.when(F.expr(v.where), F.lit(k)) for k, v in enumerate(views)]))
    rows = df.where(reduce(or_, [F.expr(v.where) for v in views])).select(*columns, taken.alias("_views"), tokens.alias("_tokens"))
    if any(v.n_features is not None for v in views):
        rows = rows.withColumn("_hashes", F.transform("_tokens", lambda word: F.xxhash64(word)))
    return rows if any(v.n_features is None for v in views) else rows.drop("_tokens")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= VIEW_ROWS or sum(b.nbytes for b in held) >= VIEW_BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _own_numbers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, and the place of each code among them."""
    if not len(codes) or codes.max() > 8 * len(codes):
        return np.unique(codes, return_inverse=True)
    seen = np.zeros(codes.max() + 1, dtype=bool)
    seen[codes] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[codes]


def _drafts(rows: pa.Table, views: list[View]) -> Iterator[tuple[np.ndarray, dict]]:
    """For each view that takes any of the rows: which, and their block with numbers of its own words."""
    names = [c for c in ("_tokens", "_hashes") if c in rows.column_names]
    lists = {c: rows[c].combine_chunks() for c in names}
    length = pc.fill_null(pc.list_value_length(lists[names[0]]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(length) - length
    if "_tokens" in lists:
        coded = lists["_tokens"].flatten().dictionary_encode()
        codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    if "_hashes" in lists:
        hashes = lists["_hashes"].flatten().to_numpy(zero_copy_only=False)
    taken = rows["_views"].combine_chunks()
    view_of = taken.flatten().to_numpy(zero_copy_only=False)
    row_of = np.repeat(np.arange(len(taken)), pc.list_value_length(taken).to_numpy(zero_copy_only=False))
    for k, view in enumerate(views):
        own = row_of[view_of == k]
        if not len(own):
            continue
        size = length[own] if view.max_length is None else np.minimum(length[own], view.max_length)
        start = first[own] + (length[own] - size if view.side == "left" else 0)
        place = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        known = size
        if view.n_features is None:
            code = codes[place]
            if len(code) and code.min() < 0:  # a NULL among the words counts for the length only
                known = np.bincount(np.repeat(np.arange(len(own)), size)[code >= 0], minlength=len(own))
                code = code[code >= 0]
            used, at = _own_numbers(code)
            words = coded.dictionary.take(pa.array(used, pa.int64())).cast(pa.string())
        else:
            used, at = _own_numbers(hashes[place] % view.n_features)
            words = pa.array(used).cast(pa.string())
        size = np.maximum(size, 1)
        shares = np.bincount(at, np.repeat(0.5 / size, known), len(words))
        parts = {"at": at.astype(_number_type(len(words))), "known": known.astype(np.int32), "size": size.astype(np.int32)}
        yield own, {"_key": view.name, "rows": len(own), "words": words, "shares": shares} | {c: x.tobytes() for c, x in parts.items()}


def _as_batch(draft: dict, more: dict[str, bytes]) -> pa.RecordBatch:
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    arrays = {"_key": pa.array([draft["_key"]], pa.string()), "rows": pa.array([draft["rows"]], pa.int64()), "words": one(draft["words"]), "shares": one(pa.array(draft["shares"], pa.float64()))}
    return pa.RecordBatch.from_pydict(arrays | {c: pa.array([x], pa.binary()) for c, x in ({c: draft[c] for c in ("at", "known", "size")} | more).items()})


def _renumbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of views in the numbers of their model's vocabulary."""
    for batch in batches:
        for k in range(batch.num_rows):
            words, own = batch.column("_all")[k].values, batch.column("words")[k].values
            number = pc.index_in(own, value_set=words).to_numpy(zero_copy_only=False) + 1
            at = np.frombuffer(batch.column("at")[k].as_buffer(), _number_type(len(own)))
            at = pa.array([number.astype(_number_type(len(words) + 1))[at].tobytes()], pa.binary())
            rest = [batch.column(c)[k : k + 1] for c in ("known", "size", "y")]
            yield pa.RecordBatch.from_arrays([batch.column("_key")[k : k + 1], at, *rest], names=["_key", "at", "known", "size", "y"])


def fit_views(
    train: DataFrame,
    tokens: Column,
    views: list[View],
    name: str,
    label: str = "correct",
    penalty: float | Column = PENALTY,
    iterations: int = ITERATIONS,
) -> DataFrame:
    """The table of ``fit`` with a model per view, its name as key and in the column ``name``. A row is read once, whichever views take it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches):
            y = rows["_y"].to_numpy().astype(np.uint8)
            for own, draft in _drafts(rows, views):
                yield _as_batch(draft, {"y": y[own].tobytes()})

    rows = _viewed(train.where(binary_label(label)), tokens, views, F.col(label).cast("int").alias("_y"))
    drafts = materialize(rows.mapInArrow(task, f"{DRAFT}, y binary"), "drafts")
    sizes = drafts.groupBy("_key").agg(F.sum("rows").alias("n")).withColumn(name, F.col("_key"))
    pairs = drafts.select("_key", F.explode(F.arrays_zip("words", "shares")).alias("p"))
    models = _unfitted(sizes, pairs.select("_key", F.col("p.words").alias("word"), F.col("p.shares").alias("share")), [name], penalty)
    numbered = drafts.drop("rows", "shares").join(models.select("_key", F.col("words").alias("_all")), "_key")
    return _fitted(models, materialize(numbered.mapInArrow(_renumbered, BLOCK), "blocks"), iterations)


def score_views(models: DataFrame, df: DataFrame, tokens: Column, views: list[View], key: str, columns: list[str], name: str = "assr") -> DataFrame:
    """``columns`` of each row once per view that takes it, with the view's name in ``key`` and the probability of success by its model; 0.5 where there is none."""
    kept = df.select(*columns).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches):
            carried = rows.select(columns).combine_chunks()
            for own, draft in _drafts(rows, views):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, carried.schema) as out:
                    out.write_table(carried.take(pa.array(own)))
                yield _as_batch(draft, {"carried": sink.getvalue().to_pybytes()})

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = pa.ipc.open_stream(batch.column("carried")[k].as_buffer()).read_all()
                margin = np.zeros(rows.num_rows)
                if batch.column("weights")[k].is_valid:
                    weights, own = batch.column("weights")[k].values.to_numpy(), batch.column("words")[k].values
                    number = pc.fill_null(pc.index_in(own, value_set=batch.column("_all")[k].values), -1).to_numpy(zero_copy_only=False) + 1
                    at, known, size = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in (("at", _number_type(len(own))), ("known", np.int32), ("size", np.int32)))
                    values = np.where(number > 0, weights[number], 0.0)  # a token that the model hasn't seen doesn't count
                    margin = _margins(weights, values[at], known, size)
                rows = rows.append_column(key, pa.repeat(batch.column("_key")[k], rows.num_rows))
                yield from rows.append_column(name, pa.array(1.0 / (1.0 + np.exp(-margin)))).to_batches()

    rows = _viewed(df, tokens, views, *columns)
    drafts = rows.mapInArrow(task, f"{DRAFT}, carried binary").drop("rows", "shares")
    own = models.select("_key", F.col("words").alias("_all"), "weights")
    schema = StructType([*kept.fields, StructField(key, StringType()), StructField(name, DoubleType())])
    return drafts.join(own, "_key", "left").mapInArrow(scored, schema)


def coefficients(models: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys…, word, weight), the intercept's word NULL."""
    words = F.concat(F.array(F.lit(None).cast("string")), F.col("words"))
    pairs = F.zip_with(words, "weights", lambda a, b: F.struct(a.alias("word"), b.alias("weight")))
    return models.select(*(keys or []), F.explode(pairs).alias("c")).select(*(keys or []), "c.*")
