"""Only conversations in which a call waits for several others are ordered round by round."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from evalframe.llm import chat


def longest(nodes, edges):
    parents = {n: [b for a, b in edges if a == n] for n in nodes}
    depth: dict = {}
    for _ in range(len(nodes) + 1):
        for n in nodes:
            if n not in depth and all(p in depth for p in parents[n]):
                depth[n] = 1 + max((depth[p] for p in parents[n]), default=-1)
    return {n: depth.get(n) for n in nodes}


def test_depths_per_conversation(spark, monkeypatch):
    draw = random.Random(6)
    nodes, edges = [], set()
    name = lambda c, k: json.dumps([c, f"t{k}"])
    for c, size, most in (("long chain", 300, 1), ("many", 12, 3), ("cycle", 5, 1), ("both", 9, 2), ("alone", 3, 0)):
        nodes += [name(c, k) for k in range(size)]
        for k in range(1, size):
            for p in [k - 1] if most == 1 else draw.sample(range(k), min(k, draw.randrange(most + 1))):
                edges.add((name(c, k), name(c, p)))
    edges |= {(name("cycle", 0), name("cycle", 4)), (name("both", 0), name("both", 8)), (name("both", 8), name("both", 0)), (name("many", 5), name("many", 1)), (name("many", 5), name("many", 2))}
    rounds, real = [], chat.by_rounds
    monkeypatch.setattr(chat, "by_rounds", lambda n, e: (rounds.extend(r.node for r in n.collect()), real(n, e))[1])
    table = lambda rows, columns: spark.createDataFrame(rows, columns).repartition(3)
    got = chat.depths(table([(n,) for n in nodes], "node string"), table(list(edges), "node string, parent string"), F.get_json_object("node", "$[0]"))
    assert {r.node: r.depth for r in got.collect()} == longest(nodes, edges) and got.count() == len(nodes)
    assert {json.loads(n)[0] for n in rounds} == {c for c in ("many", "both") if any(sum(a == n for a, _ in edges) > 1 for n in nodes if json.loads(n)[0] == c)}


@pytest.mark.parametrize("edges", [[], [("a", "b")]])
def test_few_nodes(spark, edges):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    got = chat.depths(nodes, spark.createDataFrame(edges, "node string, parent string"), F.lit(0))
    assert {r.node: r.depth for r in got.collect()} == {"a": len(edges), "b": 0}
