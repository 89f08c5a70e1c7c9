"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

The white space of a text is deleted and the rest cut where its content says
so: after the first sentence end that follows ``CHUNK_MIN`` characters, at the
latest after ``CHUNK_MIN + CHUNK_MORE``. Equal texts are cut alike, wherever
they are. A chunk's identifier is a 64-bit hash; one pass over the distinct
chunks verifies that no two of them share one and numbers those that do. A
document then is its recipe, the ordered list of its chunks' identifiers, and
only recipes, 8 bytes per chunk, are shuffled to compare documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import small
from evalframe.runtime import materialize

BLANK = r"[\x20\x09-\x0D]+"
SENTENCE_END = ".!?;:。！？"
CHUNK_MIN = 256
CHUNK_MORE = 768
LABELS = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """The text without white space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def chunks(text: Column) -> Column:
    """The chunks of a normalised text in order; end to end they are the text."""
    cut = f"(?s).{{1,{CHUNK_MIN}}}[^{SENTENCE_END}]{{0,{CHUNK_MORE}}}[{SENTENCE_END}]?"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def shared_identifiers(parts: DataFrame) -> DataFrame:
    """(hash, chunk, number) of the chunks whose hash another chunk has too, numbered from 1 within a hash.

    ``parts`` has all chunks as (hash, chunk). Grouping by the chunk itself is the
    verification; hashes that stand for one chunk are not returned.
    """
    distinct = parts.distinct()
    several = distinct.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    several = materialize(several, "shared-hashes")
    if several.isEmpty():
        return several.select("hash", F.lit("").alias("chunk"), F.lit(0).alias("number"))
    same = distinct.join(several, "hash")
    # as many chunks as share one 64-bit hash
    return same.groupBy("hash").agg(F.array_sort(F.collect_list("chunk")).alias("c")).select("hash", F.posexplode("c").alias("number", "chunk"))


def recipes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, length, text_hash, text_sha256, recipe, row): the stored table that documents are compared by."""
    text = normalised(F.col(f"`{text_col}`"))
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long").alias("length"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("text"),
    )
    parts = rows.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(F.xxhash64("chunk").alias("hash"), "chunk")
    shared = materialize(shared_identifiers(parts), "shared-chunks")
    plain = F.transform(chunks(F.col("text")), lambda c: F.xxhash64(c))
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    if shared.isEmpty():
        table = rows.select("id", "length", "text_hash", sha, plain.alias("recipe"))
    else:  # the few shared hashes get their chunk's number; all others keep the plain identifier
        numbered = rows.withColumn("row", F.monotonically_increasing_id()).select(
            "row", "id", "length", "text_hash", sha, F.posexplode_outer(chunks(F.col("text"))).alias("at", "chunk")
        ).withColumn("hash", F.xxhash64("chunk"))
        numbered = numbered.join(shared, ["hash", "chunk"], "left")
        name = F.struct("at", F.when(F.col("number").isNull(), F.col("hash")).otherwise(F.xxhash64("hash", "number")))
        table = numbered.groupBy("row", "id", "length", "text_hash", "text_sha256").agg(F.array_sort(F.collect_list(F.when(F.col("chunk").isNotNull(), name))).alias("parts"))
        table = table.select("id", "length", "text_hash", "text_sha256", F.transform("parts", lambda p: p["col2"]).alias("recipe"))
    return materialize(table.withColumn("row", F.monotonically_increasing_id()), "recipes")


def label_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are without white space. Of equal texts the one
    with the most code points stays, then the smallest id (a NULL id first).
    Rows that also repeat the id are told apart by their place: one of them
    is kept. ``copies`` counts the rows of a group that have the kept one's id
    and length. Empty and NULL texts equal each other. An empty table gives no
    rows; other columns of ``df`` are not looked at.
    """
    return labelled(df, id_col, text_col).select(F.col("id").alias(id_col), *LABELS)


def labelled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The labels with ``id``, ``text_hash``, ``length`` and ``twin``: a row that is not kept but has the kept row's id and length."""
    table = recipes(df, id_col, text_col)
    order = F.struct((-F.col("length")).alias("shorter"), F.col("id"), F.col("row"))
    # a group of copies of any size is reduced to one row before it is shuffled
    groups = table.groupBy("recipe").agg(F.count("*").alias("n"), F.min(order).alias("best"))
    several = materialize(groups.where("n > 1").withColumnRenamed("recipe", "of"), "groups-of-copies")
    alone = F.col("of").isNull()
    kept = alone | (F.col("row") == F.col("best.row"))
    return table.join(several, table.recipe == several.of, "left").select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        kept.alias("kept"),
        "text_sha256",
        "text_hash",
        "length",
        (~kept & F.col("id").eqNullSafe(F.col("best.id")) & (F.col("length") == -F.col("best.shorter"))).alias("twin"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts, its columns as they were.

    Texts are not moved: the rows to drop are found by id, a hash of the
    normalised text and the length of the text as it is. Rows that repeat the
    kept row's id and length too are the only ones compared as whole rows.
    """
    labels = materialize(labelled(df, id_col, text_col).where("not kept").select("id", "text_hash", "length", "twin"), "copies")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.struct(F.col(f"`{id_col}`"), F.xxhash64(normalised(text)), F.length(text).cast("long"))
    drop = labels.where("not twin").select(F.struct("id", "text_hash", "length").alias("_drop")).distinct()
    left = df.join(small(drop, 40), key.eqNullSafe(F.col("_drop")), "left_anti")
    twins = labels.where("twin").select(F.struct("id", "text_hash", "length").alias("_twin")).distinct()
    if twins.isEmpty():
        return left
    twins = small(twins, 40)
    same = left.join(twins, key.eqNullSafe(F.col("_twin")), "left_semi").withColumn("_key", key)
    return left.join(twins, key.eqNullSafe(F.col("_twin")), "left_anti").unionByName(same.dropDuplicates(["_key"]).drop("_key"))
