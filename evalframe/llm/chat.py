"""Chat formatting: tool calls linked with their results, in DataFrame operations only.

A message that calls tools holds {"tool_calls": [{"id", "name", "arguments"}, …]};
a message of role ``tool`` holds {"tool_call_id", "content"}. Calls and results
join by identifier, calls are ordered by the calls their arguments wait for
(``after``: identifiers), arguments are validated against the tool's schema, and
every event becomes canonical JSON: keys sorted at all depths, no blanks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.runtime import materialize

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
RESULT = "struct<tool_call_id:string,content:string>"
# a type of a schema, and how a value of it begins in the notation of Spark's variant types
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def events(messages: DataFrame) -> DataFrame:
    """One row per call and per result, and per message that is neither: conv_id, turn, item, kind, call_id, name, body."""
    calls = F.from_json("text", CALLS)["tool_calls"]
    result = F.when(F.col("role") == "tool", F.from_json("text", RESULT))
    rows = messages.select("conv_id", "turn", "role", "text", calls.alias("calls"), result.alias("result"))
    plain = F.struct(F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.col("role").alias("name"), F.col("text").alias("body"))
    answer = F.struct(F.lit("result").alias("kind"), F.col("result.tool_call_id").alias("call_id"), F.col("role").alias("name"), F.col("result.content").alias("body"))
    call = F.transform("calls", lambda c: F.struct(F.lit("call").alias("kind"), c["id"].alias("call_id"), c["name"].alias("name"), c["arguments"].alias("body")))
    is_call = (F.size("calls") > 0) & F.col("role").eqNullSafe("assistant")
    # a message's own calls are exploded, nothing is grouped
    which = F.when(is_call, call).when(F.col("result.tool_call_id").isNotNull(), F.array(answer)).otherwise(F.array(plain))
    return rows.select("conv_id", "turn", F.posexplode(which).alias("item", "e")).select("conv_id", "turn", "item", "e.*")


def same(key: list[str], other: str) -> Column:
    condition = F.lit(True)
    for name in key:
        condition = condition & F.col(name).eqNullSafe(F.col(f"{other}_{name}"))
    return condition


def problems(schemas: Mapping[str, Mapping[str, Mapping]], name: Column, value: Column) -> Column:
    """What is wrong with a call's arguments (a variant), as sorted texts."""
    found = [F.when(value.isNull(), F.lit("arguments: not JSON")), F.when(~F.coalesce(name.isin(list(schemas)), F.lit(False)), F.lit("name: unknown tool"))]
    for tool, fields in schemas.items():
        mine = name.eqNullSafe(tool) & value.isNotNull()
        for field, rule in fields.items():
            part = F.try_variant_get(value, f"$.{field}", "variant")
            missing = part.isNull() | F.is_variant_null(part)
            kind = F.schema_of_variant(part)
            if rule.get("required"):
                found.append(F.when(mine & missing, F.lit(f"{field}: missing")))
            if "type" in rule:
                right = F.startswith(kind, F.lit("DECIMAL")) | kind.isin("BIGINT", "DOUBLE", "FLOAT") if rule["type"] == "number" else F.startswith(kind, F.lit(TYPES[rule["type"]]))
                found.append(F.when(mine & ~missing & ~right, F.lit(f"{field}: not of type {rule['type']}")))
            text, number = F.try_variant_get(value, f"$.{field}", "string"), F.try_variant_get(value, f"$.{field}", "double")
            if "min_length" in rule:
                found.append(F.when(mine & (F.length(text) < rule["min_length"]), F.lit(f"{field}: too short")))
            if "minimum" in rule:
                found.append(F.when(mine & (number < rule["minimum"]), F.lit(f"{field}: too small")))
            if "one_of" in rule:
                found.append(F.when(mine & ~missing & ~text.isin(list(rule["one_of"])), F.lit(f"{field}: not allowed")))
    return F.array_sort(F.array_compact(F.array(*found)))


def depths(nodes: DataFrame, edges: DataFrame, scope: Column) -> DataFrame:
    """(node, depth): the longest way to a node along edges (node, parent); NULL on and behind a cycle.

    Edges stay within a ``scope`` (an expression over the node). Where no node of a scope has several
    parents, ways are doubled, so a chain of any length takes as many rounds as its length has binary digits. Only the
    scopes where one has are followed round by round, as many rounds as their longest way is long.
    """
    edges = materialize(edges.distinct(), "after")
    several = edges.groupBy("node").count().where("count > 1").select(scope.alias("_scope")).distinct()
    several = materialize(several, "several-parents")
    if several.isEmpty():
        return by_doubling(nodes, edges)
    apart = lambda df, how: df.withColumn("_scope", scope).join(several, "_scope", how).drop("_scope")
    doubled = by_doubling(apart(nodes, "left_anti"), apart(edges, "left_anti"))
    return doubled.unionByName(by_rounds(apart(nodes, "left_semi"), apart(edges, "left_semi")))


def by_doubling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Depths where every node has one parent at most: each round doubles the part of its way that a node knows."""
    ways = materialize(nodes.join(edges, "node", "left").select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")), "ways")
    for _ in range(max(1, ways.count()).bit_length() + 1):
        if ways.where("up is not null").isEmpty():
            break
        above = ways.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        ways = materialize(ways.join(above, "up", "left").select("node", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "ways")
    return ways.select("node", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Depths of any graph: a node follows when all its parents are done."""
    nodes = materialize(nodes, "nodes")
    done = materialize(nodes.join(edges, "node", "left_anti").select("node", F.lit(0).cast("long").alias("depth")), "depths")
    rest = materialize(edges, "waiting")
    while True:
        known = rest.join(done.select(F.col("node").alias("parent"), "depth"), "parent", "left")
        ready = known.groupBy("node").agg(F.count_if(F.col("depth").isNull()).alias("open"), (F.max("depth") + 1).alias("depth")).where("open = 0")
        ready = materialize(ready.select("node", "depth"), "ready")
        if ready.isEmpty():
            return nodes.join(done, "node", "left").select("node", "depth")
        rest = materialize(rest.join(ready.select("node"), "node", "left_anti"), "waiting")
        done = materialize(done.union(ready), "depths")


def link_tool_calls(messages: DataFrame, schemas: Mapping[str, Mapping[str, Mapping]]) -> DataFrame:
    """One row per event: conv_id, turn, item, kind, call_id, name, status, other_turn, valid, errors, level, json.

    ``messages`` has conv_id, turn, role, text; other columns are not looked at.
    ``status`` is ``answered`` or ``open`` for a call, ``linked``, ``early`` (before its
    call) or ``orphan`` for a result, ``repeated`` for an event whose identifier an
    earlier event of its kind has, ``unnamed`` for one without identifier, ``message``
    for any other message. ``other_turn`` is the turn of the result or the call. Sorted
    by (conv_id, level, turn, item), results follow their calls and calls those they wait for;
    ``level`` is NULL on and behind a cycle, and for plain messages, whose place is
    their turn. A NULL text is a message without text. Identifiers hold within a
    conversation, a NULL conversation being one. Of events that agree in identifier, turn
    and item, as repeated rows do, all count as the first. An empty table gives no rows.
    """
    rows = events(messages)
    named = rows.where(F.col("call_id").isNotNull() & (F.col("kind") != "message"))
    place = F.struct("turn", "item")
    # one row per identifier before the join, however often it is used
    firsts = named.groupBy("conv_id", "call_id").agg(
        F.min(F.when(F.col("kind") == "call", place)).alias("call_at"), F.min(F.when(F.col("kind") == "result", place)).alias("result_at")
    )
    firsts = materialize(firsts, "identifiers")
    node = lambda c, i: F.to_json(F.array(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(i)))
    value = F.try_parse_json("body")
    waits = F.from_json(F.get_json_object("body", "$.after"), "array<string>")
    calls = rows.where("kind = 'call' and call_id is not null")
    nodes = firsts.where("call_at is not null").select(node("conv_id", "call_id").alias("node"))
    edges = calls.select(node("conv_id", "call_id").alias("node"), "conv_id", F.explode(waits).alias("call_id"))
    edges = edges.select("node", node("conv_id", "call_id").alias("parent")).where("parent is not null")
    edges = edges.join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi")
    depth = materialize(depths(nodes, edges, F.get_json_object("node", "$[0]")).withColumnRenamed("node", "of"), "call-depths")
    known = firsts.select(F.col("conv_id").alias("_conv_id"), F.col("call_id").alias("_call_id"), "call_at", "result_at", node("conv_id", "call_id").alias("id"))
    known = known.join(depth, F.col("id") == F.col("of"), "left").drop("id", "of")
    joined = rows.join(known, same(["conv_id"], "") & (F.col("call_id") == F.col("_call_id")) & (F.col("kind") != "message"), "left")
    is_call = F.col("kind") == "call"
    status = (
        F.when(F.col("kind") == "message", "message")
        .when(F.col("call_id").isNull(), "unnamed")
        .when(is_call & ~place.eqNullSafe(F.col("call_at")), "repeated")
        .when(is_call & F.col("result_at").isNotNull(), "answered")
        .when(is_call, "open")
        .when(~place.eqNullSafe(F.col("result_at")), "repeated")
        .when(F.col("call_at").isNull(), "orphan")
        .when(F.col("result_at") < F.col("call_at"), "early")
        .otherwise("linked")
    )
    errors = F.when(is_call, problems(schemas, F.col("name"), value)).otherwise(F.array().cast("array<string>"))
    out = joined.select(
        "conv_id", "turn", "item", "kind", "call_id", "name", status.alias("status"),
        F.when(is_call, F.col("result_at.turn")).when(F.col("kind") == "result", F.col("call_at.turn")).alias("other_turn"),
        (F.size(errors) == 0).alias("valid"), errors.alias("errors"),
        F.when(is_call, 2 * F.col("depth")).when(F.col("kind") == "result", 2 * F.col("depth") + 1).alias("level"),
        "body",
    )
    return out.withColumn("json", canonical()).drop("body")


def canonical() -> Column:
    """The event as JSON. Arguments that are JSON appear as such, with sorted keys; NULL fields are left out."""
    value = F.to_json(F.try_parse_json("body"))
    text = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    field = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f'"{name}":'), c))
    is_call = F.col("kind") == "call"
    quoted = lambda name: F.when(F.col(name).isNotNull(), text(F.col(name)))
    parts = [
        field("arguments", F.when(is_call, F.coalesce(value, quoted("body")))),
        field("content", F.when(~is_call, quoted("body"))),
        field("id", quoted("call_id")),
        field("kind", quoted("kind")),
        field("name", F.when(is_call, quoted("name"))),
        field("role", F.when(F.col("kind") == "message", quoted("name"))),
        field("status", quoted("status")),
        field("turn", F.col("turn").cast("string")),
    ]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


ASK = {
    "ask": {
        "text": {"type": "string", "required": True, "min_length": 1},
        "turn": {"type": "integer", "required": True, "minimum": 0},
        "after": {"type": "array"},
    }
}


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool use: a user turn asks, the assistant's next turn answers.

    The call's identifier is its turn; it waits for the question two turns before, if
    there is one. Other messages stay as they are.
    """
    key = F.concat(F.lit("t"), F.col("turn").cast("string"))
    two = F.col("turn") - 2
    earlier = F.when(two >= 0, F.array(F.concat(F.lit("t"), two.cast("string"))))
    arguments = F.struct(earlier.alias("after"), F.col("text").alias("text"), F.col("turn").alias("turn"))
    call = F.to_json(F.struct(F.array(F.struct(key.alias("id"), F.lit("ask").alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    asked = F.concat(F.lit("t"), (F.col("turn") - 1).cast("string"))
    answer = F.to_json(F.struct(asked.alias("tool_call_id"), F.col("text").alias("content")))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn",
        F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"),
        F.when(user, call).when(assistant, answer).otherwise(F.col("text")).alias("text"),
    )
