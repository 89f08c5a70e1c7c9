"""Documents are kept packed, and read packed or not."""

import gzip
import json
from pathlib import Path

import pytest

from evalframe.plans import sources
from evalframe.sources import logs
from test_logs import choice, document


def test_packed_documents_are_read_like_plain_ones(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for model, size, packed in (("A", "8b", True), ("A", "2m", False), ("B_T=0", "8b", True)):
        text = json.dumps(document("t", model[0], size, [choice(0)])).encode()
        name = f"x_{model[0]}_{size}{model[1:]}.json"
        (tmp_path / "t" / (name + ".gz" if packed else name)).write_bytes(gzip.compress(text) if packed else text)
    read = lambda **k: sorted((r["model_family"], r["model_name"]) for r in logs.read_result_files(spark, str(tmp_path), logs.LogFilter(**k)).collect())
    assert read() == [("A", "2m"), ("A", "8b"), ("B", "8b")]
    assert read(model_sizes=["8b"]) == [("A", "8b"), ("B", "8b")] and read(model_families=["B T=0"]) == [("B", "8b")]


@pytest.mark.parametrize("query", ["s01", "s01_report"])
def test_the_scans_keep_packed_documents(spark, monkeypatch, tmp_path, query):
    """The documents are the larger part of what the queries leave on disk."""
    monkeypatch.setattr(sources, "scratch_path", lambda spark, label: str(tmp_path / label))
    assert getattr(sources, query)(spark, "/root/testdata/sf0.001").count() > 0
    files = [f for f in Path(tmp_path / "logs" / "all").iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert 4 * sum(f.stat().st_size for f in files) < sum(len(gzip.decompress(f.read_bytes())) for f in files)
