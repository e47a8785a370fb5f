"""Scripts and project files as a Spark data source: many small files in few tasks.

``spark.dataSource.register(ScriptFiles)``, then
``spark.read.format("scripts").load(folder)`` or ``readStream``.  Columns: path
(below the folder), content, bytes, error.  Files are dealt to tasks by size.
What can't be read, or isn't UTF-8, is a row with an error and without content.

Options: ``path``; ``match``, a glob that paths must match, applied to the list
of files before any is opened (filters of a query aren't taken over: Spark
keeps what a reader was told for later queries of the same table); ``targetBytes`` of a task (32 MB); ``targetFiles`` (10,000);
``content`` false, for rows without content whose files are never opened.
Folders are opened by pyarrow, so they may lie on any file system it knows.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quern.functions import globs

SCHEMA = pa.schema([("path", pa.string()), ("content", pa.string()), ("bytes", pa.int64()), ("error", pa.string())])
BATCH_BYTES = 16 << 20


@dataclass
class Files(InputPartition):
    names: list[str]
    sizes: list[int]


def listed(root: str) -> list[tuple[str, int, int]]:
    """(path below the folder, bytes, time of change) of all files, in order; hidden ones are passed over."""
    system, folder = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("/") else fs.FileSystem.from_uri(f"file://{root}")
    skip = len(folder.rstrip("/")) + 1
    found = [(f.path[skip:], f.size, f.mtime_ns or 0) for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File]
    return sorted(f for f in found if not any(p.startswith((".", "_")) for p in f[0].split("/")))


def dealt(files: Iterable[tuple[str, int, int]], target_bytes: int, target_files: int) -> list[Files]:
    """Files by task: as many as come to the target, one at least."""
    out: list[Files] = []
    held = 0
    for name, size, _ in files:
        if not out or held + size > target_bytes or len(out[-1].names) >= target_files:
            out.append(Files([], []))
            held = 0
        out[-1].names.append(name)
        out[-1].sizes.append(size)
        held += size
    return out


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.target_bytes, self.target_files = int(options.get("targetBytes", 32 << 20)), int(options.get("targetFiles", 10_000))
        self.match = globs.to_regex(options["match"]) if "match" in options else None
        self.content = str(options.get("content", "true")).lower() != "false"

    def files(self) -> list[tuple[str, int, int]]:
        return [f for f in listed(self.root) if self.match is None or re.match(self.match[:-1] + r"\Z", f[0])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("/") else fs.FileSystem.from_uri(f"file://{self.root}")
        rows: list[tuple] = []
        held = 0
        for name, size in zip(partition.names, partition.sizes, strict=True):
            content, error = None, None
            if self.content:
                try:
                    with system.open_input_stream(f"{folder.rstrip('/')}/{name}") as f:
                        content = f.read().decode("utf-8")
                except (OSError, UnicodeDecodeError) as e:
                    error = f"{type(e).__name__}: {e}"[:500]
            rows.append((name, content, size, error))
            held += size if self.content else 0
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(SCHEMA)], schema=SCHEMA)


class ScriptReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return dealt(self.files(), self.target_bytes, self.target_files) or [Files([], [])]


class ScriptStreamReader(_Reading, DataSourceStreamReader):
    """New and changed files by their time of change; the last moment's are left for the next batch, so that none of the same time is missed."""

    SETTLED_NS = 1_000_000_000

    def initialOffset(self) -> dict:
        return {"upto": 0}

    def latestOffset(self) -> dict:
        old = time.time_ns() - self.SETTLED_NS
        return {"upto": max((t for _, _, t in self.files() if t <= old), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt([f for f in self.files() if start["upto"] < f[2] <= end["upto"]], self.target_bytes, self.target_files)


class ScriptFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scripts"

    def schema(self) -> str:
        return "path string, content string, bytes bigint, error string"

    def reader(self, schema) -> ScriptReader:
        return ScriptReader(dict(self.options))

    def streamReader(self, schema) -> ScriptStreamReader:
        return ScriptStreamReader(dict(self.options))
