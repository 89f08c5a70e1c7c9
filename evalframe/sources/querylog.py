"""Result files at the grain of queries: a data source that streams a document and yields a row per query.

A document is scanned token by token in pieces, so a file may be larger than the memory of a task; what a task
holds is one query. The samples of a query come as the JSON text they are in the file, and
Spark parses them when they are asked for. Filters are pushed into the scan: on the directory
and the model in the file's name before a file is opened, on queries before their samples are kept.
Planning lists one directory at a time and keeps no file names but those at the ends of a partition's ranges; a task lists its
directories again. What the driver holds is a directory's listing and the ranges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType

from evalframe import schema as S
from evalframe.runtime import ship_by_value
from evalframe.sources import catalog
from evalframe.sources.logs import LogFilter

ship_by_value(__name__)

PIECE = 1 << 20  # bytes read at a time
PARTITION_BYTES = 32 << 20  # small files are read together
ENDINGS, PACKED = (".json", ".json.gz"), 8  # a packed file counts as so many times its bytes
OF_FILE = ("directory", "family", "size")  # known from the path
OF_QUERY = ("query_type", "function", "shots")
SCHEMA = """path string, directory string, family string, size string, task string, model_family string, model_name string,
 parameters bigint, query_idx int, query_type string, function string, shots int, n_samples int, samples string"""
TOKEN = re.compile(rb'\s*("(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s"{}\[\],:]+)', re.DOTALL)


def system_of(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if place.startswith("file:"):
        return fs.LocalFileSystem(), "/" + place.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)


class Unreadable(ValueError):
    """A document that isn't JSON, or not of the layout of result files."""


class Tokens:
    """The tokens of a JSON stream, and the bytes of values between them."""

    def __init__(self, stream):
        self.stream, self.buffer, self.base, self.at, self.ended = stream, b"", 0, 0, False
        self.kept = None  # where the bytes that are still needed begin

    def more(self) -> None:
        piece = self.stream.read(max(PIECE, len(self.buffer) - self.at))  # a long string doubles what is read
        self.ended = not piece
        first = self.at if self.kept is None else min(self.kept, self.at)
        self.buffer, self.base = self.buffer[first:] + piece, self.base + first
        self.at -= first
        self.kept = None if self.kept is None else self.kept - first

    def next(self) -> bytes:
        while True:
            found = TOKEN.match(self.buffer, self.at)
            # a number or word that touches the end of the buffer may go on
            if found and (found.end() < len(self.buffer) or self.ended or found.group(1)[:1] in b'"{}[],:'):
                self.at = found.end()
                return found.group(1)
            if self.ended:
                raise Unreadable("the document ends too early")
            self.more()

    def expect(self, token: bytes) -> None:
        if (got := self.next()) != token:
            raise Unreadable(f"{token!r} expected, not {got[:20]!r}")

    def skip(self, first: bytes | None = None) -> bytes:
        """Pass a value; returns its first token."""
        first = token = first or self.next()
        depth = 0
        while True:
            if token in (b"{", b"["):
                depth += 1
            elif token in (b"}", b"]"):
                depth -= 1
            if depth == 0:
                if first in (b",", b":", b"}", b"]"):
                    raise Unreadable(f"a value expected, not {first!r}")
                return first
            token = self.next()

    def value(self):
        """A parsed value."""
        self.kept = self.at
        self.skip()
        text, self.kept = self.buffer[self.kept : self.at], None
        return json.loads(text)

    def items(self, close: bytes) -> Iterator[bytes]:
        """The first token of each item up to ``close``; the caller passes the rest of the item."""
        token = self.next()
        while token != close:
            yield token
            token = self.next()
            if token == b",":
                token = self.next()
                if token == close:
                    raise Unreadable("an item is missing")
            elif token != close:
                raise Unreadable(f"',' expected, not {token[:20]!r}")

    def members(self) -> Iterator[str]:
        """The keys of an object whose ``{`` is passed; the caller passes each value."""
        for token in self.items(b"}"):
            key = json.loads(token)
            self.expect(b":")
            yield key


def header(tokens: Tokens) -> dict:
    """The task and the model of a document, wherever in it they are."""
    found = {}
    tokens.expect(b"{")
    for key in tokens.members():
        if key in ("task", "model"):
            found[key] = tokens.value() or {}
            if len(found) == 2:
                break
        else:
            tokens.skip()
    return found


def queries(tokens: Tokens, wanted) -> Iterator[tuple]:
    """(index, query type, function, shots, number of samples, their text) of the queries that are wanted."""
    tokens.expect(b"{")
    for key in tokens.members():
        first = tokens.next()
        if key != "queries" or first != b"[":
            tokens.skip(first)
            continue
        for index, token in enumerate(tokens.items(b"]")):
            if token != b"{":
                raise Unreadable("a query is an object")
            values, n, text = dict.fromkeys(OF_QUERY), None, None
            for name in tokens.members():
                if name in OF_QUERY:
                    values[name] = tokens.value()
                elif name == "samples":
                    # what is known to be filtered out needs no bytes; the rest of the query may still follow
                    keep = wanted({k: v for k, v in values.items() if v is not None})
                    tokens.kept = tokens.at if keep else None
                    if (opened := tokens.next()) == b"[":
                        n = 0
                        for item in tokens.items(b"]"):
                            tokens.skip(item)
                            n += 1
                    else:
                        tokens.skip(opened)
                    text = tokens.buffer[tokens.kept : tokens.at].decode().strip() if keep and n is not None else None
                    tokens.kept = None
                else:
                    tokens.skip()
            if wanted(values):
                yield index, *values.values(), n, text


@dataclass
class Files(InputPartition):
    """The files of each (directory, first path, last path)."""

    ranges: list[tuple[str, str, str]]


def model_of(path: str) -> tuple[str, str | None, str | None]:
    """(directory, family, size) of ``<directory>/x_<family>_<size>[_<rest>].json``, packed or not."""
    *_, directory, name = path.split("/")
    parts = re.sub(r"\.json(\.gz)?$", "", name).split("_")
    family = " ".join([parts[1], *parts[3:]]) if len(parts) > 1 else ""
    return directory, family, parts[2] if len(parts) > 2 else None


def holds(conditions: dict[str, list], values: dict) -> bool:
    """Are the values that are known among those allowed? ``!column`` lists what isn't; a column that isn't known passes."""
    return all(
        (values[c] not in allowed if name[0] == "!" else values[c] in allowed)
        for name, allowed in conditions.items() if (c := name.lstrip("!")) in values
    )


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.conditions = options["path"], json.loads(options.get("conditions", "{}"))

    def files(self, system: fs.FileSystem, directory: str) -> tuple[list[tuple[str, int]], list[str]]:
        """(path, size) of the files of a directory that pass, and the directories in it; both in order."""
        found = system.get_file_info(fs.FileSelector(directory))
        passing = lambda path: path.endswith(ENDINGS) and holds(self.conditions, dict(zip(OF_FILE, model_of(path))))
        files = sorted((i.path, i.size) for i in found if i.is_file and passing(i.path))
        return files, sorted(i.path for i in found if i.type == fs.FileType.Directory)

    def partitions(self) -> list[Files]:
        """Files that pass, small ones together, as ranges of paths."""
        system, root = system_of(self.root)
        out, held, waiting = [Files([])], 0, [root.rstrip("/")]
        while waiting:
            directory = waiting.pop()
            files, inner = self.files(system, directory)
            waiting.extend(reversed(inner))
            begun = None  # where the range in this directory began
            for k, (path, size) in enumerate(files):
                size *= PACKED if path.endswith(".gz") else 1
                if held and held + size > PARTITION_BYTES:
                    if begun is not None:
                        out[-1].ranges.append((directory, begun, files[k - 1][0]))
                    out.append(Files([]))
                    begun, held = None, 0
                begun = path if begun is None else begun
                held += size
            if begun is not None:
                out[-1].ranges.append((directory, begun, files[-1][0]))
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = system_of(self.root)
        wanted = lambda values: holds(self.conditions, values)
        for path in (p for directory, first, last in partition.ranges for p, _ in self.files(system, directory)[0] if first <= p <= last):
            try:
                with system.open_input_stream(path) as stream:
                    head = header(Tokens(stream))
                task, model = head.get("task", {}), head.get("model", {})
                fixed = (path, *model_of(path), task.get("task_name"), model.get("model_family"), model.get("model_name"), model.get("flop_matched_non_embedding_params"))
                with system.open_input_stream(path) as stream:
                    for row in queries(Tokens(stream), wanted):
                        yield (*fixed, *row)
            except (Unreadable, json.JSONDecodeError, UnicodeDecodeError) as error:
                raise Unreadable(f"{path}: {error}") from None


class ResultFiles(DataSource):
    """``spark.read.format("result_files").load(logdir)`` once it is registered."""

    @classmethod
    def name(cls) -> str:
        return "result_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_queries(spark: SparkSession, logdir: str, spec: LogFilter = LogFilter()) -> DataFrame:
    """One row per query of ``<logdir>/<task>/x_<family>_<size>.json`` that passes ``spec``, samples unparsed.

    Documents that aren't result files fail the job, but only if the conditions on tasks and models let them be opened.
    """
    if spec.tasks is not None:
        conditions = {"directory": catalog.resolve_tasks(spec.tasks, exclude_faulty=spec.exclude_faulty_tasks)}
    else:
        conditions = {"!directory": catalog.NOT_IN_FULL_LIST + (catalog.FAULTY_TASKS if spec.exclude_faulty_tasks else [])}
    lists = {"family": spec.model_families, "size": spec.model_sizes, "query_type": spec.query_types, "function": spec.query_functions}
    conditions |= {column: list(values) for column, values in lists.items() if values is not None}
    if spec.shots is not None:
        conditions["shots"] = [*spec.shots, *([None] if spec.include_unknown_shots else [])]
    elif not spec.include_unknown_shots:
        conditions["!shots"] = [None]
    spark.dataSource.register(ResultFiles)
    return spark.read.format("result_files").option("conditions", json.dumps(conditions)).load(logdir)


def with_samples(rows: DataFrame, *more: str) -> DataFrame:
    """The queries with their samples parsed, in the columns of ``logs.queries_of``, after the columns ``more``."""
    samples = F.from_json("samples", ArrayType(S.RAW_SAMPLE), {"mode": "FAILFAST"})
    return rows.select(*more, "task", "model_family", "model_name", "query_idx", "query_type", "function", "shots", "n_samples", samples.alias("samples"))


def write_documents(files: DataFrame, logdir: str) -> DataFrame:
    """Write each (directory, name, value) to ``<logdir>/<directory>/<name>``; returns (path, n_bytes) when run.

    A name that ends in ``.gz`` is packed; ``n_bytes`` counts the text. A task that runs again writes the same files again.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = system_of(logdir)
        for batch in batches:
            done = {"path": [], "n_bytes": []}
            for directory, name, value in zip(*(batch.column(c).to_pylist() for c in ("directory", "name", "value"))):
                system.create_dir(f"{root}/{directory}", recursive=True)
                with system.open_output_stream(f"{root}/{directory}/{name}") as out:
                    out.write(value.encode())
                done["path"].append(f"{root}/{directory}/{name}")
                done["n_bytes"].append(len(value.encode()))
            yield pa.RecordBatch.from_pydict({"path": pa.array(done["path"], pa.string()), "n_bytes": pa.array(done["n_bytes"], pa.int64())})

    return files.select("directory", "name", "value").mapInArrow(rows, "path string, n_bytes long")
