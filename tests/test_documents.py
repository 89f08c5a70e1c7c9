"""Documents of unknown shape."""

import pytest

from evalframe.sources import documents

TEXTS = [
    '{"id": 1, "a": {"b": 1.5, "c": {"d": "x"}}, "list": [1, {"k": 2}]}',
    '{"id": 2, "a": {"b": 2.5}, "odd key": true, "n": null}',
    '{"id": 3, "a": {"c": {"d": "y", "e": {"f": {"g": 7}}}}, "mix": 5}',
    '{"id": 4, "mix": {"in": 1}, "empty": {}}',
    "not json", None, "[1, 2]", "3",
]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "k int, value string").repartition(3)


def test_schema_strings():
    schema = "OBJECT<a: OBJECT<b: DOUBLE, `odd, ``<key>`: ARRAY<OBJECT<x: BIGINT>>>, c: DECIMAL(2,1), d: VARIANT>"
    assert documents.leaves(schema)[:2] == [(("a", "b"), "DOUBLE"), (("a", "odd, `<key>"), "ARRAY")]
    assert documents.leaves("OBJECT<>") == [] and documents.leaves("VARIANT") == [((), "VARIANT")]


def test_wide_table_of_objects_of_any_depth(docs):
    flat = documents.flatten_documents(docs.where("k < 6"))
    rows = {r["k"]: r for r in flat.collect()}
    assert {"k", "id", "a.b", "a.c.d", "a.c.e.f.g", "list", "odd key", "mix"} <= set(flat.columns)
    assert rows[0]["a.b"] == 1.5 and rows[0]["a.c.d"] == "x" and rows[0]["list"] == '[1,{"k":2}]' and rows[1]["odd key"] is True
    assert rows[2]["a.c.e.f.g"] == 7 and rows[2]["mix"] == "5" and rows[3]["mix"] == '{"in":1}'
    assert rows[4]["id"] is None and rows[5]["id"] is None and len(rows) == 6


def test_paths_of_mixed_documents(docs):
    rows = {(r["k"], r["path"]): r["value"] for r in documents.paths_of(docs, ["k"]).collect()}
    assert rows[(2, "a.c.e.f.g")] == "7" and rows[(2, "mix")] == "5" and rows[(3, "mix.in")] == "1" and rows[(0, "list")] == '[1,{"k":2}]'
    assert rows[(1, "n")] is None and (3, "empty") in rows and rows[(6, "")] == "[1,2]" and rows[(7, "")] == "3"
    assert not any(k in (4, 5) for k, _ in rows) and (0, "a") not in rows


def test_empty_tables_and_too_many_leaves(docs, monkeypatch):
    assert documents.flatten_documents(docs.where("false")).columns == ["k"]
    assert documents.paths_of(docs.where("false"), ["k"]).count() == 0
    monkeypatch.setattr(documents, "MOST_COLUMNS", 3)
    with pytest.raises(ValueError):
        documents.flatten_documents(docs.where("k < 4"))
