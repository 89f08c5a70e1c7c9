"""JSON documents of unknown shape as VARIANT columns: flattened by a learned schema, or path by path.

The schema is one aggregate over the documents, so the driver gets one string whatever their number. Documents
may be nested to different depths, and a path may hold values of several types.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.runtime import materialize

MOST_COLUMNS = 5_000  # leaves of a schema; more raise
SCALARS = {"BIGINT", "DOUBLE", "STRING", "BOOLEAN", "DATE", "TIMESTAMP", "FLOAT", "BINARY", "VOID"}
PART = re.compile(r"\s*(`(?:[^`]|``)*`|DECIMAL\(\d+,\s*\d+\)|[<>,:]|[^<>,:`\s][^<>,:`]*)")


def leaves(schema: str) -> list[tuple[tuple[str, ...], str]]:
    """The (path, type) of everything in an ``OBJECT<…>`` that isn't an object itself; arrays are leaves."""
    parts, at = PART.findall(schema), 0

    def taken(expected: str | None = None) -> str:
        nonlocal at
        at += 1
        if expected is not None and parts[at - 1] != expected:
            raise ValueError(f"{expected} expected in the schema {schema!r}")
        return parts[at - 1]

    def read(path: tuple[str, ...]) -> list:
        kind = taken().strip()
        if at >= len(parts) or parts[at] != "<":
            return [(path, "DOUBLE" if kind.startswith("DECIMAL") else kind)]
        taken("<")
        if kind != "OBJECT":  # of an array only its end matters
            depth = 1
            while depth:
                depth += {"<": 1, ">": -1}.get(taken(), 0)
            return [(path, kind)]
        out = []
        while parts[at] != ">":
            if parts[at] == ",":
                taken(",")
            name = taken()
            taken(":")
            out += read((*path, name[1:-1].replace("``", "`") if name[0] == "`" else name.strip()))
        taken(">")
        return out

    return read(())


def parsed(text: Column | str) -> Column:
    """A document as VARIANT; NULL where it isn't JSON."""
    return F.try_parse_json(text)


def _at(path: tuple[str, ...]) -> str:
    for name in path:
        if "'" in name and '"' in name:
            raise ValueError(f"a name with both kinds of quotes can't be addressed: {name!r}")
    return "$" + "".join(f'["{name}"]' if "'" in name else f"['{name}']" for name in path)


def flatten_documents(df: DataFrame, column: str = "value", sep: str = ".") -> DataFrame:
    """The other columns of ``df`` and one column per leaf of the documents, named by its path.

    A leaf of one scalar type has that type, decimals as doubles; arrays, and leaves of several types, are JSON text. A leaf that a
    document lacks, or that isn't JSON, is NULL. More than ``MOST_COLUMNS`` leaves raise.
    """
    rows = df.withColumn(column, parsed(column))
    schema = rows.agg(F.schema_of_variant_agg(column)).first()[0]
    found = [] if schema is None or not schema.startswith("OBJECT") else leaves(schema)
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"the documents have {len(found)} leaves; take them path by path")
    value = lambda path, kind: F.try_variant_get(column, _at(path), kind if kind in SCALARS - {"VOID"} else "string")
    return rows.select(*[c for c in df.columns if c != column], *[value(p, k).alias(sep.join(p)) for p, k in found if p])


def paths_of(df: DataFrame, keys: list[str], column: str = "value", sep: str = ".") -> DataFrame:
    """(keys…, path, type, value): a row per leaf of each document, the value as text (JSON for arrays).

    Objects are opened level by level, as many rounds as the deepest document has levels; nothing about
    the shape is collected. Empty objects and JSON nulls are leaves.
    """
    rows = df.select(*keys, F.lit("").alias("path"), parsed(column).alias("v")).where("v is not null")
    done, level = None, 0
    while True:
        rows = materialize(rows.select("*", F.schema_of_variant("v").alias("type")), f"level-{level}")
        full = F.col("type").startswith("OBJECT<") & (F.col("type") != "OBJECT<>")
        ended = rows.where(~full)
        done = ended if done is None else done.unionByName(ended)
        open_ = rows.where(full)
        if open_.isEmpty():
            break
        names = ", ".join(f"`{k}`" for k in keys)
        opened = df.sparkSession.sql(
            f"select {names}{',' if keys else ''} path, e.key as name, e.value as v from {{rows}}, lateral variant_explode(v) e", rows=open_.drop("type")
        )
        path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws(sep, "path", "name"))
        rows, level = opened.select(*keys, path.alias("path"), "v"), level + 1
    text = F.try_variant_get("v", "$", "string")
    kind = F.when(F.col("type").startswith("ARRAY"), F.lit("ARRAY")).otherwise(F.col("type"))
    return done.select(*keys, "path", kind.alias("type"), F.when(F.col("type") != "VOID", text).alias("value"))
