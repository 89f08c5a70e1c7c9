"""Registered queries against their SQL, and the pipeline against a brute-force version."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from evalframe.llm import mixing, sentencepiece
from evalframe.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, connection, name):
    assert oracle.difference(name, spark, connection, SF, QUERIES[name], ORACLE[name]) is None


def test_every_row_of_the_tables_is_in_the_results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("op1_sharding", "op2_sentencepiece", "op4_mixing", "op6_toxicity", "op8_lm_scoring"):
        got = QUERIES[name](spark, SF)
        assert got.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty() and got.count() == docs.count(), name
    assert QUERIES["op10_html_extraction"](spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_sharding_digests(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op1_sharding"](spark, SF).collect()
    assert all((r.size, r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 1, zlib.crc32((texts[r.doc_id] or "").encode())) for r in got)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_tokens_decode_to_the_documents(spark):
    assert QUERIES["op2_sentencepiece"](spark, SF).where("not exact").isEmpty()


def shingles(text: str) -> set:
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_pipeline_against_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    predicted = {r.doc_id: r.predicted for r in QUERIES["op6_toxicity"](spark, SF).collect()}
    rows = [r for r in rows if not predicted[r["doc_id"]]]
    best: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (-len(r["text"]), r["doc_id"])):
        best.setdefault("".join(c for c in r["text"] if c not in " \t\n\v\f\r"), r)
    rows = sorted(best.values(), key=lambda r: r["doc_id"])
    sets, root = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == [r["doc_id"] for r in rows]
    vocab = sentencepiece.load_vocabulary()
    again = sentencepiece.decode(spark.createDataFrame([(r.doc_id, r.token_ids) for r in got], "doc_id long, token_ids array<int>"), vocab)
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert {r.doc_id: r.decoded for r in again.collect()} == texts


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes


def test_mixing_stage_orders_the_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    place = {r.doc_id: (r.slot, r.row_in_block) for r in mixing.mix(docs, corpus_pipeline.SOURCE_WEIGHTS).collect()}
    got = corpus_pipeline.mix_sources(spark, docs, SF).select(F.col("doc_id")).collect()
    assert [place[r.doc_id] for r in got] == sorted(place.values())


def test_run_keeps_the_order_over_files_of_unequal_size(spark):
    name = "spark.sql.files.maxRecordsPerFile"
    spark.conf.set(name, 7)
    try:
        out = corpus_pipeline.run(spark, SF)
        got = [r.doc_id for r in out.collect()]
    finally:
        spark.conf.unset(name)
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(out.select("doc_id"), "doc_id", "left_semi")
    place = {r.doc_id: (r.slot, r.row_in_block) for r in mixing.mix(docs, corpus_pipeline.SOURCE_WEIGHTS).collect()}
    assert len(got) > 70 and [place[i] for i in got] == sorted(place.values())
