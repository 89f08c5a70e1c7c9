"""Planning a scan of result files holds ranges of paths, and its tasks read what they stand for."""

import json
import pickle

import pytest

from evalframe.sources import querylog
from evalframe.sources.logs import LogFilter
from test_logs import choice, document


def reader(path, **conditions):
    return querylog.Reader({"path": str(path), "conditions": json.dumps(conditions)})


@pytest.fixture
def logs(tmp_path):
    doc = json.dumps(document("t", "A", "8b", [choice(0), choice(1)]))
    places = [f"{d}/x{k:04d}_A_{size}.json" for d in ("a", "b", "b/c", "z") for k in range(60) for size in ("8b", "2m")] + ["x_A_8b.json"]
    for place in places:
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text(doc)
    (tmp_path / "b" / "notes.txt").write_text("none")
    (tmp_path / "empty").mkdir()
    return tmp_path, places, len(doc)


@pytest.mark.parametrize("files", [1, 7, 1000])
def test_each_file_is_read_once(logs, monkeypatch, files):
    root, places, size = logs
    monkeypatch.setattr(querylog, "PARTITION_BYTES", files * size)
    for conditions, want in (({}, places), ({"size": ["2m"]}, [p for p in places if "2m" in p]), ({"directory": ["c"]}, [p for p in places if "/c/" in p])):
        source = reader(root, **conditions)
        parts = source.partitions()
        read = [[row[0] for row in source.read(pickle.loads(pickle.dumps(p)))] for p in parts]
        assert sorted(path for part in read for path in part) == sorted(str(root / p) for p in want for _ in range(2))
        assert len(parts) == -(-len(want) // files) and all(0 < len(set(part)) <= files for part in read)


def test_planning_keeps_no_list_of_files(logs, monkeypatch):
    """What a partition takes of the driver doesn't grow with its files, and one directory is listed at a time."""
    root, places, size = logs
    listed, real = [], querylog.fs.FileSelector
    monkeypatch.setattr(querylog.fs, "FileSelector", lambda directory, **options: listed.append(options.get("recursive", False)) or real(directory, **options))
    parts = reader(root).partitions()
    assert len(parts) == 1 and len(pickle.dumps(parts)) < 3000 < 40 * len(places)
    assert len(listed) == 6 and not any(listed)


def test_nothing_passes(spark, logs):
    assert reader(logs[0], size=["9b"]).partitions() == [querylog.Files([])]
    assert querylog.read_queries(spark, str(logs[0]), LogFilter(model_sizes=["9b"])).count() == 0
