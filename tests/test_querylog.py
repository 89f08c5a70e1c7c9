"""Result files streamed query by query."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from evalframe.operators import flatten
from evalframe.sources import logs, querylog
from evalframe.sources.logs import LogFilter
from test_logs import choice, document, generative, logdir, scoring  # noqa: F401


def rows_of(df):
    return sorted(map(tuple, df.select("task", "model_family", "model_name", "query_idx", "query_type", "function", "shots", "n_samples").collect()), key=repr)


def same_as_whole_files(spark, path, spec):
    files = logs.read_result_files(spark, path, spec)
    # positions of the queries that pass: the whole-file reader numbers them after filtering
    whole = logs.queries_of(files).drop("samples", "query_idx")
    mine = querylog.read_queries(spark, path, spec).select(*whole.columns)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, mine.collect()), key=repr)


@pytest.mark.parametrize("spec", [
    LogFilter(), LogFilter(include_unknown_shots=True), LogFilter(exclude_faulty_tasks=False), LogFilter(tasks=["color"]), LogFilter(model_sizes=["8b"]),
    LogFilter(model_families=["BIG T=0"], shots=[0], include_unknown_shots=True), LogFilter(query_types=["scoring"]), LogFilter(query_functions=["generate_text"], shots=[0]),
])
def test_same_queries_as_from_whole_files(spark, logdir, spec):  # noqa: F811
    same_as_whole_files(spark, logdir, spec)


def test_samples_are_the_same(spark, logdir):  # noqa: F811
    columns = ["task", "model_name", "query_type", "shots", "samples"]
    mine = querylog.with_samples(querylog.read_queries(spark, logdir, LogFilter(include_unknown_shots=True))).select(*columns)
    whole = logs.queries_of(logs.read_result_files(spark, logdir, LogFilter(include_unknown_shots=True))).select(*columns)

    def parsed(df):  # targets are JSON as it stands in the file, white space included
        rows = [json.loads(r.j) for r in df.select(F.to_json(F.struct("*")).alias("j")).collect()]
        return sorted(json.dumps([{**row, "samples": [{**x, "targets": json.loads(x["targets"])} for x in row["samples"]]}]) for row in rows)

    assert parsed(mine) == parsed(whole) and len(parsed(mine)) == 7


def test_files_of_other_models_are_not_opened(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x_A_8b.json").write_text(json.dumps(document("t", "A", "8b", [choice(0)])))
    (tmp_path / "t" / "x_A_2m.json").write_text('{"task": {"task_name": "t"}, "queries": [{"shots": 0, "samples": [')
    (tmp_path / "t" / "notes.txt").write_text("not a result file")
    assert querylog.read_queries(spark, str(tmp_path), LogFilter(model_sizes=["8b"])).count() == 1
    with pytest.raises(Exception, match="x_A_2m.json"):
        querylog.read_queries(spark, str(tmp_path)).collect()


def test_conditions_of_one_query_do_not_mix(spark, logdir):  # noqa: F811
    """One DataFrame used twice, and two readers, in the same query."""
    rows = querylog.read_queries(spark, logdir)
    kinds = ("multiple_choice", "generative", "scoring")
    alone = {k: rows.where(F.col("query_type") == k).count() for k in kinds}
    both = [rows.where(F.col("query_type") == k) for k in kinds] + [querylog.read_queries(spark, logdir, LogFilter(query_types=[k])) for k in kinds]
    stacked = flatten.stack_frames(*both).groupBy("query_type").count().collect()
    assert {r["query_type"]: r["count"] for r in stacked} == {k: 2 * n for k, n in alone.items()} and all(alone.values())


def test_conditions_act_in_the_scan():
    wanted, parsed = [], []
    real = querylog.Tokens.skip
    tokens = querylog.Tokens(io.BytesIO(json.dumps(document("t", "A", "8b", [choice(0, ["a"] * 50), choice(1)])).encode()))
    try:
        querylog.Tokens.skip = lambda self, first=None: (parsed.append(self.kept is not None), real(self, first))[1]
        wanted = list(querylog.queries(tokens, lambda v: v.get("shots", 1) == 1))
    finally:
        querylog.Tokens.skip = real
    assert [q[0] for q in wanted] == [1] and parsed.count(True) >= 2 and parsed.count(False) >= 50  # bytes of the first query are not kept


def test_keys_in_any_order_and_odd_values(monkeypatch):
    monkeypatch.setattr(querylog, "PIECE", 7)  # every token crosses pieces
    texts = ['quote " and \\ back', "brace } ] , :", "é漢😀 ", "", "x" * 500]
    doc = {"extra": [1, {"a": [None, True, -1.5e-7]}], "queries": [{"samples": [{"input": t} for t in texts], "other": {"shots": 9}, "shots": None, "query_type": "scoring", "function": None},
           {"shots": 2, "samples": []}, {"samples": None, "shots": 1}, {}], "model": {"model_name": "8b"}, "scores": [], "task": {"task_name": "t"}}
    for text in (json.dumps(doc), json.dumps(doc, indent=2, ensure_ascii=False)):
        data = text.encode()
        assert querylog.header(querylog.Tokens(io.BytesIO(data))) == {"model": doc["model"], "task": doc["task"]}
        got = list(querylog.queries(querylog.Tokens(io.BytesIO(data)), lambda v: True))
        assert [q[:5] for q in got] == [(0, "scoring", None, None, 5), (1, None, None, 2, 0), (2, None, None, 1, None), (3, None, None, None, None)]
        assert [s["input"] for s in json.loads(got[0][5])] == texts and json.loads(got[1][5]) == []


def test_broken_documents_are_refused():
    whole = json.dumps(document("t", "A", "8b", [choice(0)]))
    draw = random.Random(2)
    for cut in [1, len(whole) - 1, *(draw.randrange(2, len(whole) - 1) for _ in range(40))]:
        with pytest.raises((querylog.Unreadable, json.JSONDecodeError, UnicodeDecodeError)):
            list(querylog.queries(querylog.Tokens(io.BytesIO(whole[:cut].encode())), lambda v: True))
    for text in ("[]", "", '{"queries": [1]}', '{"queries": [{},]}', '{"queries" [ ]}'):
        with pytest.raises((querylog.Unreadable, json.JSONDecodeError)):
            list(querylog.queries(querylog.Tokens(io.BytesIO(text.encode())), lambda v: True))


def test_a_task_holds_one_query(monkeypatch):
    """The buffer stays within a query, however long the document."""
    monkeypatch.setattr(querylog, "PIECE", 4096)
    doc = json.dumps(document("t", "A", "8b", [choice(0, ["text " * 20] * 20) for _ in range(300)])).encode()
    tokens, largest = querylog.Tokens(io.BytesIO(doc)), 0
    for _ in querylog.queries(tokens, lambda v: True):
        largest = max(largest, len(tokens.buffer))
    assert len(doc) > 1_000_000 and largest < 100_000


def test_documents_written_by_name(spark, tmp_path):
    doc = json.dumps(document("t", "A", "8b", [generative(0), scoring(0)]))
    df = spark.createDataFrame([("t", "x_A_8b.json", doc), ("u", "x_B_2m.json", doc)], "directory string, name string, value string")
    assert querylog.write_documents(df, f"file:{tmp_path}/logs").agg(F.sum("n_bytes")).first()[0] == 2 * len(doc)
    got = querylog.read_queries(spark, f"{tmp_path}/logs").groupBy("directory", "family", "size").count().collect()
    assert sorted(map(tuple, got)) == [("t", "A", "8b", 2), ("u", "B", "2m", 2)]


def test_sample_table_from_queries(spark, tmp_path):
    """The same rows as from whole files: pairs by position, cut at the first bad one, an odd one left out."""
    files = {"x_A_8b": [choice(0), generative(0), scoring(0), choice(1), generative(1, ["c"]), scoring(1, ["c"]), generative(2)],
             "x_A_2m": [generative(0), scoring(0), scoring(1), generative(1), generative(2), scoring(2)], "x_B_8b": [scoring(0), choice(0)], "x_B_2m": []}
    for task in ("t", "u"):
        (tmp_path / task).mkdir()
        for stem, found in files.items():
            _, family, size = stem.split("_")
            (tmp_path / task / f"{stem}.json").write_text(json.dumps(document(task, family, size, found)))
    rows = querylog.with_samples(querylog.read_queries(spark, str(tmp_path)), "path")
    mine = flatten.eval_samples_of_queries(rows, ["path"])
    whole = flatten.eval_samples(logs.read_result_files(spark, str(tmp_path)))
    text = lambda df: sorted(r.j for r in df.select(F.to_json(F.struct(*whole.columns)).alias("j")).collect())
    assert text(mine) == text(whole) and len(text(whole)) == 2 * (2 + 2 + 2 + 1 + 2 + 2)


def test_packed_documents(spark, tmp_path):
    """Names that end in .gz are written packed, and read like the others."""
    doc = json.dumps(document("t", "A", "8b", [generative(0, ["text " * 200] * 20), scoring(0)]))
    df = spark.createDataFrame([("t", "x_A_8b_r.json.gz", doc), ("t", "x_A_8b_r.json", doc)], "directory string, name string, value string")
    assert querylog.write_documents(df, f"file:{tmp_path}").agg(F.sum("n_bytes")).first()[0] == 2 * len(doc)
    assert (tmp_path / "t/x_A_8b_r.json.gz").stat().st_size < len(doc) / 5
    rows = querylog.read_queries(spark, str(tmp_path), LogFilter(model_families=["A r"], model_sizes=["8b"]))
    assert rows.count() == 4 and rows.select("family", "size", "n_samples", "samples").distinct().count() == 2


def test_files_are_not_shuffled_to_meet_their_directory(spark):
    from evalframe.plans import views

    parts = spark.createDataFrame([(1, "name", "type", 4, "Brand#7")], "p_partkey long, p_name string, p_type string, p_size int, p_brand string")
    files = spark.sql(views._files_sql("concat('b', substr(p_brand, 7)) as directory"), p=parts)
    assert "Exchange" not in files._jdf.queryExecution().executedPlan().toString()
    assert {r.directory for r in files.select("directory").collect()} == {"b7"}


def test_pairs_meet_with_what_a_pair_needs(spark, logdir):  # noqa: F811
    """The generative side is moved without scores; its twin has them."""
    rows = querylog.with_samples(querylog.read_queries(spark, logdir), "path")
    plan = flatten.eval_samples_of_queries(rows, ["path"])._jdf.queryExecution().analyzed().toJSON()

    def types(node):
        if isinstance(node, dict) and node.get("name") == "gen" and "dataType" in node:
            yield json.dumps(node["dataType"])
        for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
            yield from types(child)

    moved = set(types(json.loads(plan)))
    assert moved and not any("normalized_scores" in t for t in moved)
